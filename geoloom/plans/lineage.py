"""Cutting a plan where its result is used more than once."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The session's checkpoint folder, which all executors share.

    It is the one that ``spark.checkpoint.dir`` names. Where a session has none, a local one is made
    if driver and executors are one process, as in tests; elsewhere that is an error, since executors
    would not find each other's files.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and not (context.master == "local" or context.master.startswith("local[")):
            raise RuntimeError("spark.checkpoint.dir is not set: it must name a folder that all executors share")
        context.setCheckpointDir(named or os.path.join(tempfile.gettempdir(), "geoloom-checkpoints"))
    return context.getCheckpointDir()


def cut(df: DataFrame, keep_partitions: bool = False) -> DataFrame:
    """``df`` written to the shared folder and read from there.

    With ``keep_partitions``, what is known of how its rows are spread and sorted stays known, so joins
    on the same keys need not move them. That takes a plan that is not changed while it runs.
    """
    spark = df.sparkSession
    shared_folder(spark)
    if not keep_partitions:
        return df.checkpoint()
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        # planned anew, as the plan of ``df`` may be made already
        return df.select("*").checkpoint()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)


def discard(spark: SparkSession, folder: str) -> None:
    """Deletes a folder, wherever it is."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def release(spark: SparkSession) -> None:
    """Deletes what was written to the session's checkpoint folder; for when results are stored elsewhere."""
    folder = spark.sparkContext.getCheckpointDir()
    if folder is not None:
        discard(spark, folder)
