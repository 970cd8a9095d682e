"""Shapes with closed-form measures, derived from the driver's tables.

Squares of ``customer``: k = c_custkey * 37 mod 40, side a = (1 + k) / 8, lower left corner
(k mod 5 * 10 - 20, 0). Zig-zag lines of ``part``: (0 0, 1 A, 2 0) with A = 1 + p_size / 64. Points
of ``events``: longitude user_id mod 360 - 180, latitude event_id mod 180 - 90. Roofs of ``part``: squares
of side 40 with a vertex 1 + p_size / 64 above the middle of their upper side, and a small hole beneath it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from geoloom.functions.shape_udfs import clean_wkb, shape_to_wkb
from geoloom.sources.tables import table


def wkt_of(*points: tuple[Column, Column], kind: str = "POLYGON") -> Column:
    """WKT of one ring or line."""
    inner = F.concat_ws(", ", *(F.concat_ws(" ", x.cast("string"), y.cast("string")) for x, y in points))
    left, right = ("((", "))") if kind == "POLYGON" else ("(", ")")
    return F.concat(F.lit(f"{kind} {left}"), inner, F.lit(right))


def squares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(c_custkey, c_nationkey, c_acctbal, k, a, x0, raw): ``raw`` is WKT with a doubled vertex."""
    k = F.pmod(F.col("c_custkey") * 37, F.lit(40)).cast("int")
    df = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_acctbal", k.alias("k"))
    df = df.withColumns({"a": (1 + F.col("k")) / F.lit(8.0), "x0": (F.col("k") % 5 * 10 - 20).cast("double")})
    a, x0, zero = F.col("a"), F.col("x0"), F.lit(0.0)
    return df.withColumn("raw", wkt_of((x0, zero), (x0, zero), (x0 + a, zero), (x0 + a, a), (x0, a), (x0, zero)))


def square_wkb(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Squares with their cleaned WKB."""
    return squares(spark, sf_dir).withColumn("wkb", clean_wkb("raw"))


def shared_corner(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Squares whose rings start at a corner that many share, as WKB: small ones collapse to it."""
    df = squares(spark, sf_dir).withColumn("x", (F.col("k") % 5 * 10).cast("double"))
    a, x, zero = F.col("a"), F.col("x"), F.lit(0.0)
    return df.withColumn("wkb", shape_to_wkb(wkt_of((x, zero), (x, a), (x - a, a), (x - a, zero), (x, zero))))


def zigzags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(p_partkey, height, wkb)."""
    df = table(spark, sf_dir, "part").select("p_partkey", (1 + F.col("p_size") / F.lit(64.0)).alias("height"))
    zero, one, two = F.lit(0.0), F.lit(1.0), F.lit(2.0)
    line = wkt_of((zero, zero), (one, F.col("height")), (two, zero), kind="LINESTRING")
    return df.withColumn("wkb", shape_to_wkb(line))


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(event_id, lon, lat, wkt)."""
    df = table(spark, sf_dir, "events").select(
        "event_id",
        (F.pmod("user_id", F.lit(360)) - 180).cast("double").alias("lon"),
        (F.pmod("event_id", F.lit(180)) - 90).cast("double").alias("lat"),
    )
    return df.withColumn("wkt", wkt_of((F.col("lon"), F.col("lat")), kind="POINT"))


def roofs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(p_partkey, height, wkb, holed): polygons without and with a hole that a flattened roof would jump over."""
    df = table(spark, sf_dir, "part").select("p_partkey", (1 + F.col("p_size") / F.lit(64.0)).alias("height"))
    at = lambda *xy: [tuple(F.lit(float(v)) for v in p) for p in xy]
    ring = [*at((0, 0), (40, 0), (40, 40)), (F.lit(20.0), 40 + F.col("height")), *at((0, 40), (0, 0))]
    hole = F.lit("(19.875 40.125, 20.125 40.125, 20 40.25, 19.875 40.125)")
    whole = wkt_of(*ring)
    holed = F.concat(F.substring(whole, F.lit(1), F.length(whole) - 1), F.lit(", "), hole, F.lit(")"))
    return df.select("p_partkey", "height", shape_to_wkb(whole).alias("wkb"), shape_to_wkb(holed).alias("holed"))
