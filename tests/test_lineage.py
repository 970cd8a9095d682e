import os
import types

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from geoloom.plans import catalog
from geoloom.plans.lineage import cut, release, shared_folder


def test_partitions_stay_known(spark):
    rows = spark.range(1000).select((F.col("id") % 100).alias("k"), "id").repartition(3, "k")
    kept = cut(rows, keep_partitions=True)
    assert spark.conf.get("spark.sql.adaptive.enabled") == "true"
    joined = spark.range(100).withColumnRenamed("id", "k").join(kept.hint("merge"), "k")
    assert joined._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1 and joined.count() == 1000


def test_release(spark):
    kept = cut(spark.range(5))
    folder = shared_folder(spark).removeprefix("file:")
    assert kept.count() == 5 and os.listdir(folder)
    release(spark)
    assert not os.path.exists(folder) or not os.listdir(folder)
    assert cut(spark.range(6)).count() == 6


@pytest.mark.parametrize("master, fails", [("local[4]", False), ("local", False), ("local-cluster[2,1,1024]", True), ("yarn", True), ("k8s://x", True)])
def test_no_local_folder_on_clusters(master, fails):
    made = []
    context = types.SimpleNamespace(master=master, getCheckpointDir=lambda: made[-1] if made else None, setCheckpointDir=made.append)
    session = types.SimpleNamespace(sparkContext=context, conf=types.SimpleNamespace(get=lambda name, default: default))
    if fails:
        with pytest.raises(RuntimeError):
            shared_folder(session)
    else:
        assert shared_folder(session).endswith("geoloom-checkpoints")


def test_entry_without_the_optional_part(monkeypatch):
    import sys

    for name in [n for n in sys.modules if n.startswith("geoloom.llm")]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, "geoloom.llm", None)  # cannot be imported
    assert set(entry.queries()) == set(catalog.QUERIES) and set(entry.oracle_sql()) == set(catalog.ORACLE_SQL)
