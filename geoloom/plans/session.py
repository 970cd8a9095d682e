"""Making the package known to a session's Python workers."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def ship(spark: SparkSession) -> None:
    """Puts the package's folder on the workers' path, wherever the driver was started.

    That serves workers that see this folder. On other clusters the package is installed, or sent
    along with ``--py-files``.
    """
    environment = spark.sparkContext.environment
    path = environment.get("PYTHONPATH", "")
    if ROOT not in path.split(os.pathsep):
        environment["PYTHONPATH"] = os.pathsep.join(p for p in (ROOT, path) if p)
