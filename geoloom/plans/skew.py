"""Queries of the operators for skewed keys, over the buckets that shards send."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geoloom.operators.balance import aggregate_balanced, join_balanced, plan_load
from geoloom.plans.lineage import cut
from geoloom.sources.tables import first_delivery, table

SHARE = 0.02


def _buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return first_delivery(table(spark, sf_dir, "shard_buckets").where("hash IS NOT NULL"), "bucket_id", "hash", "doc_count")


def p2_per_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Buckets and documents of each hash; the load is estimated from the rows as delivered."""
    plan = plan_load(table(spark, sf_dir, "shard_buckets").select("hash").where("hash IS NOT NULL"), "hash")
    sums = {"n_buckets": F.lit(1), "sum_docs": F.coalesce("doc_count", F.lit(0))}
    return aggregate_balanced(_buckets(spark, sf_dir), "hash", ["bucket_id"], sums, plan)


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hashes with a large share of the buckets or of the documents."""
    per_hash = cut(p2_per_hash(spark, sf_dir))
    rows, docs = per_hash.agg(F.sum("n_buckets"), F.sum("sum_docs")).first()
    measures = F.array(
        F.when(F.col("n_buckets") >= F.lit(SHARE * (rows or 0)), F.lit("rows")),
        F.when(F.col("sum_docs") >= F.lit(SHARE * (docs or 0)), F.lit("docs")),
    )
    return per_hash.select(F.explode(F.array_compact(measures)).alias("measure"), "hash")


def p2_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each bucket with the area that enrichment stored for its shape, where there is one."""
    shapes = table(spark, sf_dir, "enriched_shapes").select(
        F.col("geo_shape_0.hash").alias("hash"), F.col("geo_shape_0.area").alias("area")
    )
    areas = shapes.where("hash IS NOT NULL").groupBy("hash").agg(F.max("area").alias("area"))
    plan = plan_load(table(spark, sf_dir, "shard_buckets").select("hash").where("hash IS NOT NULL"), "hash")
    buckets = _buckets(spark, sf_dir).withColumn("doc_count", F.coalesce("doc_count", F.lit(0)))
    return join_balanced(buckets, areas, "hash", ["bucket_id"], plan)


_PER_HASH = """
WITH b AS (SELECT DISTINCT bucket_id, hash, doc_count FROM shard_buckets WHERE hash IS NOT NULL AND bucket_id IS NOT NULL),
h AS (SELECT hash, CAST(count(*) AS BIGINT) AS n_buckets, CAST(sum(coalesce(doc_count, 0)) AS BIGINT) AS sum_docs FROM b GROUP BY hash)
"""

QUERIES = {"p2_found": p2_found, "p2_per_hash": p2_per_hash, "p2_join": p2_join}

ORACLE_SQL = {
    "p2_found": _PER_HASH
    + """SELECT 'rows' AS measure, hash FROM h WHERE n_buckets >= 0.02 * (SELECT sum(n_buckets) FROM h)
UNION ALL SELECT 'docs', hash FROM h WHERE sum_docs >= 0.02 * (SELECT sum(sum_docs) FROM h)""",
    "p2_per_hash": _PER_HASH + "SELECT hash, n_buckets, sum_docs FROM h",
    "p2_join": _PER_HASH
    + """SELECT b.bucket_id, b.hash, coalesce(b.doc_count, 0) AS doc_count, s.area FROM b JOIN (
  SELECT geo_shape_0.hash AS hash, max(geo_shape_0.area) AS area FROM enriched_shapes
  WHERE geo_shape_0.hash IS NOT NULL GROUP BY 1) s USING (hash)""",
}
