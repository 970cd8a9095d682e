"""Parquet tables by name, and row-level clean-up shared by the operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table ``name`` of a test-data directory; column pruning and filters reach the scan."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` over all cores, by a hash of ``keys``, where its scan has under half as many partitions.

    For work that is heavy for its bytes: a file of one row group is one task otherwise. Where a scan
    has partitions enough, as any large one, and on streams, nothing is moved.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df.isStreaming or df.rdd.getNumPartitions() * 2 > cores:
        return df
    return df.repartition(cores, F.xxhash64(*keys))


def first_delivery(df: DataFrame, key: str, *columns: str) -> DataFrame:
    """One row for each ``key`` of rows that were delivered again with the same content.

    Rows with a null key are left out. Only ``columns`` are shuffled, after a map-side combine;
    where deliveries do differ, the least struct of ``columns`` is kept, so the result is the same
    on every run.
    """
    rest = F.min(F.struct(*columns)).alias("_row")
    kept = df.where(F.col(key).isNotNull()).groupBy(key).agg(rest)
    return kept.select(key, *(F.col(f"_row.{c}").alias(c) for c in columns))
