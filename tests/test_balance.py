import pytest
from pyspark.sql import functions as F

from geoloom.operators.balance import aggregate_balanced, join_balanced, pack, plan_load, replicate, to_tasks
from pyspark.sql import types as T


def skewed(spark, n=4000):
    """A third of the rows have one key."""
    return spark.range(n).select(F.col("id"), F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.concat(F.lit("k"), F.col("id") % 97)).alias("key"))


def test_packing_is_even():
    plan = pack([5.0] * 32, [("hot", 300.0), ("warm", 60.0)], 8, T.StringType())
    shards = dict(plan.shards)
    assert len(shards["hot"]) == 5 and len(shards["warm"]) == 1
    assert sum(plan.loads) == 32 * 5 + 360 and max(plan.loads) <= 1.25 * min(plan.loads)


def test_hot_keys_are_split_evenly(spark):
    df = skewed(spark)
    plan = plan_load(df, "key", tasks=8)
    assert "hot" in dict(plan.shards)
    sizes = to_tasks(df, "key", ["id"], plan).groupBy(F.spark_partition_id().alias("p"), "_task").count().collect()
    assert all(r.p == r._task for r in sizes) and sum(r["count"] for r in sizes) == 4000
    assert max(r["count"] for r in sizes) < 1.6 * 4000 / 8


def test_other_side_goes_only_where_needed(spark):
    df = skewed(spark)
    plan = plan_load(df, "key", tasks=8)
    other = df.select("key").distinct()
    copies = {r.key: r["count"] for r in replicate(other, "key", plan).groupBy("key").count().collect()}
    assert copies["hot"] == len(set(dict(plan.shards)["hot"])) and all(n == 1 for k, n in copies.items() if k not in dict(plan.shards))


@pytest.mark.parametrize("most_sent", [0, 2, 100])
@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_join(spark, how, most_sent):
    df = skewed(spark).union(spark.createDataFrame([(-1, None)], "id long, key string"))
    other = df.where("key IN ('hot', 'k1', 'k2')").select("key").distinct().withColumn("value", F.length("key"))
    other = other.union(spark.createDataFrame([(None, 7)], "key string, value int"))
    got = join_balanced(df, other, "key", ["id"], plan_load(df, "key", 8), how, most_sent)
    want = df.join(other, "key", how)
    assert sorted(map(str, got.select(*want.columns).collect())) == sorted(map(str, want.collect()))
    with pytest.raises(ValueError):
        join_balanced(df, other, "key", ["id"], how="cross")


def test_clashing_names(spark):
    names = ["id", "key", "_bin", "_TASK", "_tasks", "_bin_task", "_hkey", "b"]
    df = skewed(spark, 300).select("id", "key", *(F.lit(n).alias(n) for n in names[2:]))
    other = df.groupBy("key").agg(F.count("*").alias("B"), F.min("id").alias("_task"))
    for most_sent in (0, 1000):
        got = join_balanced(df, other, "key", ["id"], plan_load(df, "key", 8), most_sent=most_sent)
        assert got.columns == [*names, "b_other", "_task_other"] and got.count() == 300
        row = got.where("id = 3").first()
        assert (row.b, row.b_other, row._task_other, row._bin) == ("b", 100, 0, "_bin")


def test_aggregate_with_nulls_and_clashing_names(spark):
    df = skewed(spark).withColumn("n", F.when(F.col("id") % 5 > 0, F.col("id"))).withColumn("_bin_", F.lit(1))
    df = df.union(spark.createDataFrame([(5, None, 3, 1)] * 3, "id long, key string, n long, _bin_ int"))
    got = aggregate_balanced(df, "key", ["id"], {"rows": F.lit(1), "total": F.coalesce("n", F.lit(0))})
    want = df.groupBy("key").agg(F.count("*").alias("rows"), F.sum(F.coalesce("n", F.lit(0))).alias("total"))
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_empty_tables(spark):
    none = skewed(spark).limit(0)
    assert aggregate_balanced(none, "key", ["id"], {"rows": F.lit(1)}).count() == 0
    assert join_balanced(none, skewed(spark).select("key").distinct(), "key", ["id"]).count() == 0
    assert join_balanced(skewed(spark), none.select("key"), "key", ["id"], how="left").count() == 4000
