"""Queries of the shape operators. Where the tables hold what enrichment must give, they are the oracle."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from geoloom.functions import columns as C
from geoloom.functions.options import ScriptParams, ShapeAggRequest
from geoloom.functions.registry import register
from geoloom.functions.shape_udfs import (
    dedup_wkb,
    shape_digest,
    shape_length,
    shape_to_wkb,
    shape_vertices,
    wkb_big_endian,
    wkb_to_geojson,
    wkb_to_wkt,
)
from geoloom.operators.enrich import enrich
from geoloom.operators.shape_agg import result_json, run_request, shape_agg
from geoloom.operators.simplify import compile_script, geo_simplify
from geoloom.plans import fixtures
from geoloom.plans.lineage import discard, shared_folder
from geoloom.sources.tables import spread, table
from geoloom.streaming.enrichment import enrich_files

QUERIES, ORACLE_SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


_SQUARES = """
WITH s AS (SELECT c_custkey, c_nationkey, c_acctbal, k, (1 + k) / 8.0::DOUBLE AS a, (k % 5 * 10 - 20)::DOUBLE AS x0
  FROM (SELECT *, CAST((c_custkey * 37) % 40 AS INTEGER) AS k FROM customer)),
t AS (SELECT *, 'POLYGON ((' || (x0 + a)::VARCHAR || ' 0.0, ' || (x0 + a)::VARCHAR || ' ' || a::VARCHAR || ', ' || x0::VARCHAR || ' ' || a::VARCHAR
  || ', ' || x0::VARCHAR || ' 0.0, ' || (x0 + a)::VARCHAR || ' 0.0))' AS wkt FROM s),
g AS (SELECT k, a, x0, wkt, count(*) AS n FROM t GROUP BY ALL)
"""
_HEX = "hex(ST_AsWKB(wkt::GEOMETRY))"


# --- enrichment --------------------------------------------------------------------------------


def _enriched(spark: SparkSession, sf_dir: str, *keep: str) -> DataFrame:
    """The shapes of the largest table, as sent, enriched anew; ``stored`` is what the table holds."""
    rows = table(spark, sf_dir, "enriched_shapes").select(
        "id", *keep, F.col("geo_shape_0").alias("stored"), F.col("geo_shape_0.shape").alias("shape")
    )
    return enrich(spread(rows.where("shape IS NOT NULL"), "id"), "shape", keep_original_shape=False)


@query("SELECT id, geo_shape_0.fixed_shape AS fixed_shape FROM enriched_shapes WHERE geo_shape_0.shape IS NOT NULL")
def enrich_fixed_wkt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _enriched(spark, sf_dir).select("id", "shape.fixed_shape")


def _as_stored() -> Column:
    """The new bytes, in the byte order of the stored ones."""
    older = F.hex(F.substring("stored.wkb", 1, 1)) == "00"
    return F.when(older, wkb_big_endian("shape.wkb")).otherwise(F.col("shape.wkb"))


@query("SELECT id, hex(geo_shape_0.wkb) AS wkb_hex FROM enriched_shapes WHERE geo_shape_0.wkb IS NOT NULL")
def enrich_wkb_hex(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _enriched(spark, sf_dir).where("stored.wkb IS NOT NULL").select("id", F.hex(_as_stored()).alias("wkb_hex"))


@query("SELECT id, geo_shape_0.hash AS hash FROM enriched_shapes WHERE geo_shape_0.wkb IS NOT NULL AND geo_shape_0.hash IS NOT NULL")
def enrich_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests as of enrichment, and those of the older byte order."""
    rows = _enriched(spark, sf_dir).where("stored.wkb IS NOT NULL AND stored.hash IS NOT NULL")
    older = F.hex(F.substring("stored.wkb", 1, 1)) == "00"
    return rows.select("id", F.when(older, shape_digest(_as_stored())).otherwise(F.col("shape.hash")).alias("hash"))


@query("SELECT id, geo_shape_0.hash AS hash FROM enriched_shapes WHERE geo_shape_0.wkb IS NOT NULL AND geo_shape_0.hash IS NOT NULL")
def digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the stored bytes."""
    rows = table(spark, sf_dir, "enriched_shapes").select("id", "geo_shape_0.wkb", F.col("geo_shape_0.hash").alias("stored"))
    rows = rows.where("wkb IS NOT NULL AND stored IS NOT NULL")
    return rows.select("id", shape_digest("wkb").alias("hash"))


@query("SELECT id, geo_shape_0.type AS type FROM enriched_shapes WHERE geo_shape_0.shape IS NOT NULL")
def enrich_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _enriched(spark, sf_dir).select("id", "shape.type")


@query("SELECT id, round(geo_shape_0.area, 8) AS area FROM enriched_shapes WHERE geo_shape_0.area IS NOT NULL")
def enrich_area(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _enriched(spark, sf_dir).where("stored.area IS NOT NULL").select("id", F.round("shape.area", 8).alias("area"))


@query(
    """SELECT id, round(geo_shape_0.centroid.lat + 1.7e-8, 7) AS lat, round(geo_shape_0.centroid.lon + 1.7e-8, 7) AS lon
FROM enriched_shapes WHERE geo_shape_0.shape IS NOT NULL AND geo_shape_0.centroid.lat IS NOT NULL"""
)
def enrich_centroid(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _enriched(spark, sf_dir).where("stored.centroid.lat IS NOT NULL")
    # coordinates have 6 decimals, so means of two lie on ties of rounding to 6; shifted, none does
    off_ties = lambda c: F.round(F.col(f"shape.centroid.{c}") + 1.7e-8, 7).alias(c)
    return rows.select("id", off_ties("lat"), off_ties("lon"))


@query(
    """SELECT id, geo_shape_0.bbox[1].lat AS low_lat, geo_shape_0.bbox[1].lon AS low_lon,
  geo_shape_0.bbox[2].lat AS high_lat, geo_shape_0.bbox[2].lon AS high_lon
FROM enriched_shapes WHERE geo_shape_0.shape IS NOT NULL"""
)
def enrich_bbox(spark: SparkSession, sf_dir: str) -> DataFrame:
    corner = lambda i, c, n: F.get(F.col("shape.bbox"), F.lit(i))[c].alias(n)
    return _enriched(spark, sf_dir).select(
        "id", corner(0, "lat", "low_lat"), corner(0, "lon", "low_lon"), corner(1, "lat", "high_lat"), corner(1, "lon", "high_lon")
    )


@query("SELECT id, geo_shape_0 IS NOT NULL AND geo_shape_0.shape IS NOT NULL AS enriched FROM enriched_shapes")
def null_shape_skip(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "enriched_shapes").select("id", F.col("geo_shape_0.shape").alias("shape"))
    return enrich(rows, "shape").select("id", F.col("shape").isNotNull().alias("enriched"))


@query(
    _SQUARES
    + """SELECT c_custkey, wkt AS clean, a * a AS surface, 'POLYGON ((' || x0::VARCHAR || ' 0.0, ' || x0::VARCHAR || ' 0.0, ' || (x0 + a)::VARCHAR
  || ' 0.0, ' || (x0 + a)::VARCHAR || ' ' || a::VARCHAR || ', ' || x0::VARCHAR || ' ' || a::VARCHAR || ', ' || x0::VARCHAR || ' 0.0))' AS sent,
  'clean,sent,surface' AS members FROM t"""
)
def enrich_toggles(spark: SparkSession, sf_dir: str) -> DataFrame:
    off = {n: False for n in ("hash", "wkb", "type", "centroid", "bbox")}
    rows = enrich(
        fixtures.squares(spark, sf_dir), "raw", shape_field="sent", fixed_field="clean", area_field="surface", **off
    )
    members = ",".join(sorted(rows.schema["raw"].dataType.names))
    return rows.select("c_custkey", "raw.sent", "raw.clean", "raw.surface", F.lit(members).alias("members"))


@query(_SQUARES + "SELECT c_custkey, wkt AS a_shape, wkt AS b_shape, k AS other FROM t")
def enrich_path_wildcard(spark: SparkSession, sf_dir: str) -> DataFrame:
    nested = F.struct(F.col("raw").alias("geo_a"), F.col("raw").alias("geo_b"), F.col("k").alias("other")).alias("doc")
    rows = enrich(fixtures.squares(spark, sf_dir).select("c_custkey", nested), "geo_*", path="doc")
    return rows.select(
        "c_custkey", F.col("doc.geo_a.fixed_shape").alias("a_shape"), F.col("doc.geo_b.fixed_shape").alias("b_shape"), "doc.other"
    )


@query(_SQUARES + "SELECT c_custkey, wkt AS fixed_shape FROM t")
def enrich_geojson_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shapes that come as GeoJSON objects."""
    a, x0, zero = F.col("a"), F.col("x0"), F.lit(0.0)
    ring = F.array(*(F.array(x, y) for x, y in ((x0, zero), (x0 + a, zero), (x0 + a, a), (x0, a), (x0, zero))))
    shape = F.struct(F.lit("Polygon").alias("type"), F.array(ring).alias("coordinates")).alias("geo_shape_0")
    rows = enrich(fixtures.squares(spark, sf_dir).select("c_custkey", shape), "geo_shape_*")
    return rows.select("c_custkey", "geo_shape_0.fixed_shape")


_NUMBERS = """
WITH s AS (SELECT c_custkey, (1 + CAST((c_custkey * 37) % 40 AS INTEGER)) / 8.0::DOUBLE AS a FROM customer)
"""


@query(
    _NUMBERS
    + """SELECT c_custkey, 'MULTIPOLYGON (((180.0 0.0, 180.0 ' || a || ', ' || (180 - a / 2) || ' ' || a || ', ' || (180 - a / 2) || ' 0.0, 180.0 0.0)'
  || CASE WHEN c_custkey % 2 = 0 THEN '' ELSE ',(' || (180 - a / 4) || ' ' || a / 4 || ', ' || (180 - a / 4) || ' ' || a / 2 || ', ' || (180 - a / 8) || ' ' || a / 2
    || ', ' || (180 - a / 8) || ' ' || a / 4 || ', ' || (180 - a / 4) || ' ' || a / 4 || ')' END
  || '),((-180.0 ' || a || ', -180.0 0.0, ' || (a / 2 - 180) || ' 0.0, ' || (a / 2 - 180) || ' ' || a || ', -180.0 ' || a || ')))' AS fixed_shape, 'MultiPolygon' AS type,
  a * a - CASE WHEN c_custkey % 2 = 0 THEN 0 ELSE a * a / 32 END AS area, -180.0::DOUBLE AS low_lon, 180.0::DOUBLE AS high_lon,
  'MULTILINESTRING ((179.0 0.0, 180.0 ' || a / 2 || '),(-180.0 ' || a / 2 || ', -179.0 ' || a || '))' AS line FROM s"""
)
def enrich_dateline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Squares, some with a hole, and lines over longitude 180."""
    a, zero = F.col("a"), F.lit(0.0)
    left, right = 180 - a / 2, 180 + a / 2
    whole = fixtures.wkt_of((left, zero), (right, zero), (right, a), (left, a), (left, zero))
    west, east = 180 - a / 4, 180 - a / 8
    hole = fixtures.wkt_of((west, a / 4), (east, a / 4), (east, a / 2), (west, a / 2), (west, a / 4))
    holed = F.concat(F.substring(whole, F.lit(1), F.length(whole) - 1), F.lit(", "), F.regexp_extract(hole, r"\((\(.*\))\)", 1), F.lit(")"))
    rows = fixtures.squares(spark, sf_dir).withColumns(
        {"geo_a": F.when(F.col("c_custkey") % 2 == 0, whole).otherwise(holed), "geo_b": fixtures.wkt_of((F.lit(179.0), zero), (F.lit(181.0), a), kind="LINESTRING")}
    )
    rows = enrich(rows.select("c_custkey", "geo_a", "geo_b"), "geo_*")
    return rows.select(
        "c_custkey", "geo_a.fixed_shape", "geo_a.type", "geo_a.area", F.col("geo_a.bbox")[0]["lon"].alias("low_lon"),
        F.col("geo_a.bbox")[1]["lon"].alias("high_lon"), F.col("geo_b.fixed_shape").alias("line"),
    )


@query(
    _NUMBERS
    + """SELECT c_custkey, 'MULTILINESTRING ((0.0 0.0, 1.0 ' || a || '),(2.0 0.0, 3.0 ' || a || ', 3.0 ' || a || '))' AS fixed_shape, 'MultiLineString' AS type,
  0.0::DOUBLE AS area, round(a / 2, 9) AS lat, 1.5::DOUBLE AS lon, a AS high_lat FROM s"""
)
def enrich_multilines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Doubled vertices stay in lines of several."""
    a, one = F.col("a"), lambda v: F.lit(float(v))
    first = fixtures.wkt_of((one(0), one(0)), (one(1), a), kind="")
    second = fixtures.wkt_of((one(2), one(0)), (one(3), a), (one(3), a), kind="")
    text = F.concat(F.lit("MULTILINESTRING ("), F.trim(first), F.lit(", "), F.trim(second), F.lit(")")).alias("shape")
    rows = enrich(fixtures.squares(spark, sf_dir).select("c_custkey", text), "shape")
    centre = F.col("shape.centroid")
    return rows.select(
        "c_custkey", "shape.fixed_shape", "shape.type", "shape.area", F.round(centre["lat"], 9).alias("lat"), F.round(centre["lon"], 9).alias("lon"),
        F.col("shape.bbox")[1]["lat"].alias("high_lat"),
    )


@query(
    _SQUARES
    + """SELECT c_custkey, 'GEOMETRYCOLLECTION (POINT (' || x0 || ' ' || a || '),' || wkt || ',GEOMETRYCOLLECTION (LINESTRING (0.0 0.0, 1.0 ' || a || ')))' AS fixed_shape,
  'GeometryCollection' AS type, a * a AS area, a / 2 AS lat, x0 + a / 2 AS lon FROM t"""
)
def enrich_collections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Collections in collections, with doubled vertices; the polygon alone counts for area and centroid."""
    a, x0, zero = F.col("a"), F.col("x0"), F.lit(0.0)
    line = fixtures.wkt_of((zero, zero), (zero, zero), (F.lit(1.0), a), kind="LINESTRING")
    parts = [F.lit("GEOMETRYCOLLECTION ("), fixtures.wkt_of((x0, a), kind="POINT"), F.lit(", "), F.col("raw"), F.lit(", GEOMETRYCOLLECTION ("), line, F.lit("))")]
    rows = enrich(fixtures.squares(spark, sf_dir).select("c_custkey", F.concat(*parts).alias("shape")), "shape")
    centre = F.col("shape.centroid")
    return rows.select(
        "c_custkey", "shape.fixed_shape", "shape.type", F.round("shape.area", 9).alias("area"), F.round(centre["lat"], 9).alias("lat"), F.round(centre["lon"], 9).alias("lon")
    )


@query(
    """SELECT event_id, (user_id % 360 - 180)::DOUBLE AS lon, (event_id % 180 - 90)::DOUBLE AS lat, true AS has_box, false AS line_has_box
FROM events"""
)
def bbox_degenerate_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A point has a box, a line along an axis has none."""
    flat = fixtures.wkt_of((F.col("lon"), F.col("lat")), (F.col("lon") / 2 + 90, F.col("lat")), kind="LINESTRING")
    lines = F.when(F.col("lon") != F.col("lon") / 2 + 90, flat)
    rows = enrich(fixtures.points(spark, sf_dir).withColumn("line", lines), "wkt")
    rows = enrich(rows, "line")
    box = F.col("wkt.bbox")
    return rows.select(
        "event_id", box[1]["lon"].alias("lon"), box[0]["lat"].alias("lat"), box.isNotNull().alias("has_box"), F.col("line.bbox").isNotNull().alias("line_has_box")
    )


@query("SELECT id, geo_shape_0.fixed_shape AS fixed_shape FROM enriched_shapes WHERE geo_shape_0.shape IS NOT NULL")
def stream_enrich(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored documents as a stream of files, enriched and written."""
    folder = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    source = table(spark, sf_dir, "enriched_shapes").select("id", F.col("geo_shape_0.shape").alias("shape"))
    source.where("shape IS NOT NULL").write.parquet(f"{folder}/in")
    run = enrich_files(spark, f"{folder}/in", f"{folder}/out", f"{folder}/checkpoint", source.schema, "shape", once=True)
    run.awaitTermination()
    for name in ("in", "checkpoint"):
        discard(spark, f"{folder}/{name}")
    return spark.read.parquet(f"{folder}/out").select("id", "shape.fixed_shape")


@query(
    _SQUARES
    + """SELECT c_custkey, CASE c_custkey % 5 WHEN 0 THEN wkt WHEN 1 THEN 'POLYGON EMPTY' WHEN 4 THEN 'POINT EMPTY' END AS fixed_shape, c_custkey % 5 IN (2, 3) AS failed,
  CASE WHEN c_custkey % 5 = 2 THEN 'unable to parse the geometry [LINESTRING (' || x0 || ' 0.0, ' || x0 || ' 0.0)]' END AS why,
  CASE c_custkey % 5 WHEN 0 THEN a * a WHEN 1 THEN 0 WHEN 4 THEN 0 END AS area, c_custkey % 5 = 0 AS has_box, c_custkey % 5 = 0 AS has_centroid FROM t"""
)
def enrich_permissive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Good, empty and bad shapes: lines that clean away to a single vertex, and texts that are no shape."""
    x0 = F.col("x0").cast("string")
    line = F.concat(F.lit("LINESTRING ("), x0, F.lit(" 0, "), x0, F.lit(" 0)"))
    n = F.col("c_custkey") % 5
    text = F.when(n == 0, F.col("raw")).when(n == 1, "POLYGON EMPTY").when(n == 2, line).when(n == 3, "no shape").otherwise("POINT EMPTY")
    rows = enrich(fixtures.squares(spark, sf_dir).select("c_custkey", text.alias("shape")), "shape", mode="PERMISSIVE", error_column="error")
    why = F.when(F.col("error").startswith("unable"), F.regexp_extract("error", r"^[^\]]*\]", 0))
    return rows.select(
        "c_custkey", "shape.fixed_shape", F.col("error").isNotNull().alias("failed"), why.alias("why"), "shape.area",
        F.col("shape.bbox").isNotNull().alias("has_box"), F.col("shape.centroid").isNotNull().alias("has_centroid"),
    )


# --- aggregation -------------------------------------------------------------------------------


@query(
    _SQUARES
    + f"""SELECT {_HEX} AS key, 'Polygon' AS type, n AS doc_count, ((SELECT count(*) FROM s) - sum(n) OVER ())::BIGINT AS sum_other_doc_count
FROM (SELECT * FROM g ORDER BY a DESC LIMIT 10)"""
)
def agg_topn_perimeter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shape_agg(fixtures.square_wkb(spark, sf_dir), "wkb", fmt="wkb").drop("digest")


@query(
    _SQUARES
    + f"""SELECT {_HEX} AS key, n AS doc_count, ((SELECT count(*) FROM s) - sum(n) OVER ())::BIGINT AS sum_other_doc_count
FROM (SELECT * FROM g ORDER BY a DESC LIMIT 3)"""
)
def agg_request(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same aggregation, asked for by a mapping; one key of ``simplify`` alone simplifies nothing."""
    body = {"field": "wkb", "output_format": "wkb", "size": 3, "shard_size": 7, "simplify": {"zoom": 5}}
    return run_request(fixtures.square_wkb(spark, sf_dir), body).select("key", "doc_count", "sum_other_doc_count")


@query(
    _SQUARES
    + f""", f AS (SELECT wkt, a, count(*) AS n FROM t WHERE c_nationkey = 7 GROUP BY ALL)
SELECT {_HEX} AS key, n AS doc_count, ((SELECT sum(n) FROM f) - sum(n) OVER ())::BIGINT AS sum_other_doc_count FROM (SELECT * FROM f ORDER BY a DESC LIMIT 2)"""
)
def agg_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows are filtered first, so what is filtered out is in no count."""
    rows = fixtures.square_wkb(spark, sf_dir).where("c_nationkey = 7")
    return shape_agg(rows, "wkb", size=2, fmt="wkb").select("key", "doc_count", "sum_other_doc_count")


@query(
    _SQUARES
    + f""", m AS (SELECT c_custkey % 4 = 0 AS gone, CASE WHEN c_custkey % 4 = 0 THEN 'POINT (1 2)' ELSE wkt END AS wkt FROM t)
SELECT {_HEX} AS key, count(*) AS doc_count FROM m GROUP BY wkt"""
)
def agg_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A shape that stands for those that are not there."""
    rows = fixtures.square_wkb(spark, sf_dir).select(F.when(F.col("c_custkey") % 4 > 0, F.col("wkb")).alias("wkb"))
    point = "0101000000000000000000F03F0000000000000040"
    return run_request(rows, {"field": "wkb", "output_format": "wkb", "size": 100, "missing": point}).select("key", "doc_count")


_CHECKS = {
    "agg_size_zero": lambda: ShapeAggRequest.parse({"field": "wkb", "size": 0}),
    "agg_size_negative": lambda: ShapeAggRequest.parse({"field": "wkb", "size": -3}),
    "agg_shard_size_zero": lambda: ShapeAggRequest.parse({"field": "wkb", "shard_size": 0}),
    "agg_shard_size_minus_one": lambda: ShapeAggRequest.parse({"field": "wkb", "shard_size": -1}),
    "agg_no_field": lambda: ShapeAggRequest.parse({"size": 3}),
    "agg_unknown_parameter": lambda: ShapeAggRequest.parse({"field": "wkb", "precision": 3}),
    "agg_format": lambda: ShapeAggRequest.parse({"field": "wkb", "output_format": "svg"}),
    "agg_algorithm": lambda: ShapeAggRequest.parse({"field": "wkb", "simplify": {"zoom": 1, "algorithm": "other"}}),
    "agg_missing_no_digits": lambda: ShapeAggRequest.parse({"field": "wkb", "missing": "xyz"}),
    "agg_good": lambda: ShapeAggRequest.parse({"field": "wkb", "output_format": "wKt", "size": 3, "shard_size": 1}).cut,
    "agg_simplify_by_half": lambda: ShapeAggRequest.parse({"field": "wkb", "simplify": {"zoom": 1}}).simplify,
    "same_requests": lambda: ShapeAggRequest.parse({"field": "wkb", "size": 10}) == ShapeAggRequest.parse({"size": 10, "field": "wkb", "output_format": "geojson"}),
    "other_requests": lambda: ShapeAggRequest.parse({"field": "wkb"}) == ShapeAggRequest.parse({"field": "wkb", "size": 11}),
    "script_no_parameters": lambda: compile_script("geo_simplify", {}),
    "script_no_field": lambda: compile_script("geo_simplify", {"zoom": 1}),
    "script_no_zoom": lambda: compile_script("geo_simplify", {"field": "wkb"}),
    "script_zoom_text": lambda: compile_script("geo_simplify", {"field": "wkb", "zoom": "1"}),
    "script_unknown": lambda: compile_script("other", {"field": "wkb", "zoom": 1}),
    "script_good": lambda: ScriptParams.parse({"field": "wkb", "zoom": 1}).algorithm.value,
}


@query(
    """SELECT * FROM (VALUES ('agg_size_zero', 'error'), ('agg_size_negative', 'error'), ('agg_shard_size_zero', 'error'), ('agg_shard_size_minus_one', 'error'),
  ('agg_no_field', 'error'), ('agg_unknown_parameter', 'error'), ('agg_format', 'error'), ('agg_algorithm', 'error'), ('agg_missing_no_digits', 'error'), ('agg_good', '3'), ('agg_simplify_by_half', 'None'),
  ('same_requests', 'True'), ('other_requests', 'False'), ('script_no_parameters', 'error'), ('script_no_field', 'error'), ('script_no_zoom', 'error'), ('script_zoom_text', 'error'),
  ('script_unknown', 'error'), ('script_good', 'DOUGLAS_PEUCKER'), ('agg_of_numbers', 'error')) AS t("check", outcome)"""
)
def option_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What becomes of parameters, good and bad, and of columns that hold no shapes."""
    checks = _CHECKS | {"agg_of_numbers": lambda: shape_agg(table(spark, sf_dir, "customer"), "c_custkey")}

    def outcome(run) -> str:
        try:
            return str(run())
        except (ValueError, TypeError):
            return "error"

    return spark.createDataFrame([(name, outcome(run)) for name, run in checks.items()], "check string, outcome string")


@query(_SQUARES + "SELECT (SELECT count(*) FROM s) - (SELECT n FROM g ORDER BY a DESC LIMIT 1) AS sum_other_doc_count")
def agg_sum_other(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shape_agg(fixtures.square_wkb(spark, sf_dir), "wkb", size=1, shard_size=10).select("sum_other_doc_count")


@query(
    """WITH s AS (SELECT CAST((c_custkey * 37) % 40 AS INTEGER) AS k FROM customer),
g AS (SELECT CASE WHEN k < 15 THEN 'POINT (' || (k % 5 * 10) || ' 0)' END AS point, CASE WHEN k >= 15 THEN k END AS kept, count(*) AS doc_count FROM s GROUP BY ALL)
SELECT coalesce(point, 'polygon') AS key, doc_count, CAST(0 AS BIGINT) AS sum_other_doc_count FROM g"""
)
def agg_simplified_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Small squares collapse to a corner that they share, and merge there."""
    rows = fixtures.shared_corner(spark, sf_dir).select("wkb")
    top = shape_agg(rows, "wkb", size=100, simplify={"zoom": 0, "algorithm": "douglas_peucker"}, fmt="wkt")
    key = F.when(F.col("key").startswith("POINT"), F.col("key")).otherwise("polygon")
    return top.select(key.alias("key"), "doc_count", "sum_other_doc_count")


@query(
    _SQUARES
    + f""", h AS (SELECT c_custkey % 4 AS shard, k, a, wkt, count(*) AS n FROM t GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY shard ORDER BY a DESC) AS rank FROM h),
m AS (SELECT wkt, a, sum(n) AS doc_count FROM r WHERE rank <= 5 GROUP BY ALL ORDER BY a DESC LIMIT 5)
SELECT {_HEX} AS key, doc_count::BIGINT AS doc_count, ((SELECT count(*) FROM s) - sum(doc_count) OVER ())::BIGINT AS sum_other_doc_count FROM m"""
)
def agg_sharded_topn(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fixtures.square_wkb(spark, sf_dir).withColumn("shard", (F.col("c_custkey") % 4).cast("int"))
    return shape_agg(rows, "wkb", size=5, fmt="wkb", shard="shard").select("key", "doc_count", "sum_other_doc_count")


@query(
    _SQUARES
    + f""", d AS (SELECT DISTINCT c_nationkey, wkt, a FROM t), c AS (SELECT wkt, a, count(*) AS doc_count FROM d GROUP BY ALL)
SELECT {_HEX} AS key, doc_count, ((SELECT count(*) FROM d) - sum(doc_count) OVER ())::BIGINT AS sum_other_doc_count
FROM (SELECT * FROM c ORDER BY a DESC LIMIT 10)"""
)
def agg_multivalued(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each nation, with the squares of all its customers."""
    rows = fixtures.square_wkb(spark, sf_dir).groupBy("c_nationkey").agg(F.collect_list("wkb").alias("wkbs"))
    return shape_agg(rows, "wkbs", fmt="wkb").select("key", "doc_count", "sum_other_doc_count")


@query(
    _SQUARES
    + f"""SELECT {_HEX} AS key, n AS doc_count, total, mean, ((SELECT count(*) FROM s) - sum(n) OVER ())::BIGINT AS sum_other_doc_count FROM (
  SELECT wkt, a, count(*) AS n, round(sum(c_acctbal), 2) AS total, round(avg(c_acctbal) + 0.00013, 3) AS mean FROM t GROUP BY wkt, a ORDER BY a DESC LIMIT 10)"""
)
def agg_subaggs(spark: SparkSession, sf_dir: str) -> DataFrame:
    subs = {"total": F.round(F.sum("c_acctbal"), 2), "mean": F.round(F.avg("c_acctbal") + 0.00013, 3)}  # off the ties of rounding
    return shape_agg(fixtures.square_wkb(spark, sf_dir), "wkb", fmt="wkb", sub_aggs=subs).drop("digest", "type")


@query(
    """WITH s AS (SELECT CAST((c_custkey * 37) % 40 AS INTEGER) AS k, c_acctbal FROM customer)
SELECT CASE WHEN k < 15 THEN 'POINT (' || (k % 5 * 10) || ' 0)' ELSE 'polygon' END AS key, count(*) AS doc_count, round(sum(c_acctbal), 2) AS total
FROM s GROUP BY CASE WHEN k < 15 THEN k % 5 ELSE 100 + k END, 1"""
)
def agg_simplified_subaggs(spark: SparkSession, sf_dir: str) -> DataFrame:
    top = shape_agg(
        fixtures.shared_corner(spark, sf_dir), "wkb", size=100, simplify={"zoom": 0, "algorithm": "DOUGLAS_PEUCKER"},
        fmt="wkt", sub_aggs={"total": F.round(F.sum("c_acctbal"), 2)},
    )
    key = F.when(F.col("key").startswith("POINT"), F.col("key")).otherwise("polygon")
    return top.select(key.alias("key"), "doc_count", "total")


@query("SELECT CAST(NULL AS VARCHAR) AS key, CAST(0 AS BIGINT) AS doc_count, CAST(0 AS BIGINT) AS sum_other_doc_count WHERE false")
def agg_missing_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shape_agg(table(spark, sf_dir, "customer"), "no_such_field").select("key", "doc_count", "sum_other_doc_count")


@query(
    _SQUARES
    + f""", v AS (SELECT * FROM t WHERE c_custkey % 3 <> 0), w AS (SELECT wkt, a, count(*) AS n FROM v GROUP BY ALL)
SELECT {_HEX} AS key, n AS doc_count, ((SELECT count(*) FROM s) - sum(n) OVER ())::BIGINT AS sum_other_doc_count FROM (SELECT * FROM w ORDER BY a DESC LIMIT 10)"""
)
def agg_malformed_wkb(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes that are no shape: cut polygons and cut points."""
    broken = F.when(F.col("c_custkey") % 2 == 0, F.substring("wkb", 1, 20)).otherwise(F.unhex(F.lit("0101000000FF")))
    rows = fixtures.square_wkb(spark, sf_dir)
    rows = rows.withColumn("wkb", F.when(F.col("c_custkey") % 3 == 0, broken).otherwise(F.col("wkb")))
    return shape_agg(rows, "wkb", fmt="wkb").select("key", "doc_count", "sum_other_doc_count")


@query(
    """WITH p AS (SELECT geo_shape_0.wkb AS wkb, count(*) AS doc_count, max(geo_shape_0.hash) AS digest FROM enriched_shapes
  WHERE geo_shape_0.type = 'Point' AND geo_shape_0.wkb IS NOT NULL GROUP BY 1)
SELECT hex(wkb) AS key, digest, 'Point' AS type, doc_count, (SELECT sum(doc_count) FROM p)::BIGINT - sum(doc_count) OVER ()::BIGINT AS sum_other_doc_count
FROM (SELECT * FROM p ORDER BY doc_count DESC, wkb LIMIT 20)"""
)
def agg_points_by_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points all have the perimeter 0, so the counts and then the bytes rank them."""
    rows = table(spark, sf_dir, "enriched_shapes").where("geo_shape_0.type = 'Point'")
    return shape_agg(rows, "geo_shape_0.wkb", size=20, fmt="wkb")


#: Perimeters of lines and polygons by the text that the tables hold.
_PERIMETERS = r"""
WITH e AS (SELECT geo_shape_0.wkb AS wkb, geo_shape_0.type AS type, geo_shape_0.hash AS hash, geo_shape_0.fixed_shape AS wkt, dataset, ingested_at FROM enriched_shapes
  WHERE geo_shape_0.wkb IS NOT NULL),
g AS (SELECT wkb, any_value(type) AS type, max(hash) AS digest, any_value(wkt) AS wkt, count(*) AS doc_count, count(DISTINCT dataset) AS n_datasets, max(ingested_at) AS last_seen
  FROM e GROUP BY wkb),
r AS (SELECT wkb, list_transform(regexp_extract_all(unnest(regexp_extract_all(wkt, '\([^()]+\)')), '-?[0-9.]+(?:E-?[0-9]+)?'), lambda t: t::DOUBLE) AS v
  FROM g WHERE type NOT IN ('Point', 'MultiPoint')),
p AS (SELECT wkb, sum(list_sum(list_transform(range(1, len(v) // 2), lambda i: sqrt((v[2 * i + 1] - v[2 * i - 1]) ** 2 + (v[2 * i + 2] - v[2 * i]) ** 2)))) AS perimeter FROM r GROUP BY wkb)
"""


@query(
    _PERIMETERS
    + """SELECT hex(wkb) AS key, digest, type, doc_count, n_datasets, last_seen, ((SELECT count(*) FROM e) - sum(doc_count) OVER ())::BIGINT AS sum_other_doc_count
FROM (SELECT * FROM g JOIN p USING (wkb) ORDER BY round(perimeter, 9) DESC, doc_count DESC, wkb LIMIT 50)"""
)
def agg_top_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Top shapes of the largest table, with the datasets that have them, and their digests where the table has them too."""
    rows = table(spark, sf_dir, "enriched_shapes")
    subs = {"n_datasets": F.countDistinct("dataset"), "last_seen": F.max("ingested_at"), "stored": F.max("geo_shape_0.hash")}
    top = shape_agg(rows, "geo_shape_0.wkb", size=50, fmt="wkb", sub_aggs=subs)
    return top.withColumn("digest", F.when(F.col("stored").isNotNull(), F.col("digest"))).drop("stored")


@query()
def agg_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Top shapes of the largest table, simplified, with the datasets that have them."""
    rows = table(spark, sf_dir, "enriched_shapes")
    subs = {"n_datasets": F.countDistinct("dataset"), "last_seen": F.max("ingested_at")}
    return shape_agg(
        rows, "geo_shape_0.wkb", size=20, shard_size=100, simplify={"zoom": 8, "algorithm": "TOPOLOGY_PRESERVING"}, sub_aggs=subs
    )


@query(
    """WITH p AS (SELECT geo_shape_0.wkb AS wkb, count(*) AS n, max(geo_shape_0.hash) AS digest FROM enriched_shapes
  WHERE geo_shape_0.type = 'Point' AND geo_shape_0.wkb IS NOT NULL GROUP BY 1),
t AS (SELECT * FROM p ORDER BY n DESC, wkb LIMIT 3)
SELECT '{"sum_other_doc_count":' || ((SELECT sum(n) FROM p) - (SELECT sum(n) FROM t))::BIGINT || ',"buckets":['
  || (SELECT string_agg('{"key":"' || hex(wkb) || '","digest":"' || digest || '","type":"Point","doc_count":' || n || '}', ',' ORDER BY n DESC, wkb) FROM t) || ']}' AS json"""
)
def agg_result_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "enriched_shapes").where("geo_shape_0.type = 'Point'")
    return result_json(shape_agg(rows, "geo_shape_0.wkb", size=3, fmt="wkb"))


@query(_SQUARES + "SELECT c_custkey, regexp_replace(wkt, '\\.0([ ,)])', '\\1', 'g') AS wkt FROM t")
def output_wkt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixtures.square_wkb(spark, sf_dir).select("c_custkey", wkb_to_wkt("wkb").alias("wkt"))


@query(
    """WITH s AS (SELECT p_partkey, 1 + p_size / 64.0::DOUBLE AS h FROM part)
SELECT p_partkey, '{"type":"LineString","coordinates":[[0.0,0.0],[1,' || regexp_replace(h::VARCHAR, '\\.0$', '')
  || '],[2,0.0]],"crs":{"type":"name","properties":{"name":"EPSG:0"}}}' AS geojson FROM s"""
)
def output_geojson(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixtures.zigzags(spark, sf_dir).select("p_partkey", wkb_to_geojson("wkb").alias("geojson"))


@query(
    """SELECT id, hex(geo_shape_0.wkb)[1:2] AS byte_order, hex(geo_shape_0.wkb)[1:2] = '00' AS unchanged, geo_shape_0.type AS type, geo_shape_0.type = 'Point' AS is_point
FROM enriched_shapes WHERE geo_shape_0.wkb IS NOT NULL"""
)
def wkb_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a WKB header says, read in the JVM, and re-encoding to the older byte order."""
    rows = table(spark, sf_dir, "enriched_shapes").select("id", F.col("geo_shape_0.wkb").alias("wkb")).where("wkb IS NOT NULL")
    return rows.select(
        "id",
        F.hex(F.substring("wkb", 1, 1)).alias("byte_order"),
        (wkb_big_endian("wkb") == F.col("wkb")).alias("unchanged"),
        C.wkb_type(F.col("wkb")).alias("type"),
        C.wkb_is_point(F.col("wkb")).alias("is_point"),
    )


# --- scalar functions --------------------------------------------------------------------------


@query(_SQUARES + "SELECT c_custkey, 5 AS n_clean, 6 AS n_raw FROM t")
def dedup_vertices(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fixtures.squares(spark, sf_dir).withColumn("wkb", shape_to_wkb("raw"))
    return rows.select("c_custkey", shape_vertices("wkb").alias("n_raw"), shape_vertices(dedup_wkb("wkb")).alias("n_clean"))


@query(
    _SQUARES
    + """SELECT c_custkey, a * a AS area, 4 * a AS length, a / 2 AS lat, x0 + a / 2 AS lon, 0.0::DOUBLE AS low_lat, x0 AS low_lon, a AS high_lat, x0 + a AS high_lon,
  5 AS n_clean FROM s"""
)
def ring_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measures of rings as expressions in the JVM, without Python."""
    a, x0, zero = F.col("a"), F.col("x0"), F.lit(0.0)
    vertex = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    ring = F.array(*(vertex(x, y) for x, y in ((x0, zero), (x0, zero), (x0 + a, zero), (x0 + a, a), (x0, a), (x0, zero))))
    rows = fixtures.squares(spark, sf_dir).withColumn("ring", C.drop_repeats(ring))
    box, centre = C.points_bbox(F.col("ring")), C.ring_centroid(F.col("ring"))
    rows = rows.withColumns({"box": box, "centre": centre})
    return rows.select(
        "c_custkey", C.polygon_area(F.array("ring")).alias("area"), C.rings_length(F.array("ring")).alias("length"),
        F.round("centre.lat", 9).alias("lat"), F.round("centre.lon", 9).alias("lon"),
        F.col("box")[0]["lat"].alias("low_lat"), F.col("box")[0]["lon"].alias("low_lon"),
        F.col("box")[1]["lat"].alias("high_lat"), F.col("box")[1]["lon"].alias("high_lon"), F.size("ring").alias("n_clean"),
    )


@query(
    """SELECT zoom, 360.0::DOUBLE / 256 / power(2, zoom) AS tolerance, round(2 * pi() * 6378137 / 256 * cos(radians(n_nationkey)) / power(2, zoom), 6) AS meters, n_nationkey
FROM nation, (SELECT unnest(range(0, 21))::INTEGER AS zoom)"""
)
def tolerance_by_zoom(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "nation").select("n_nationkey", F.explode(F.sequence(F.lit(0), F.lit(20))).alias("zoom"))
    meters = C.meter_by_pixel(F.col("zoom"), F.col("n_nationkey"))
    return rows.select("zoom", C.tolerance_of_zoom(F.col("zoom")).alias("tolerance"), F.round(meters, 6).alias("meters"), "n_nationkey")


@query(
    """SELECT s_suppkey, round(s_acctbal * 360 / (2 * pi() * 6378137 * cos(radians(s_nationkey))), 9) AS degrees,
  round(s_acctbal * 360 / (2 * pi() * 6378137), 9) AS at_equator FROM supplier"""
)
def degrees_by_meters(spark: SparkSession, sf_dir: str) -> DataFrame:
    degrees = C.degrees_of_meters(F.col("s_acctbal"), F.col("s_nationkey"))
    at_equator = C.degrees_of_meters(F.col("s_acctbal"))
    return table(spark, sf_dir, "supplier").select("s_suppkey", F.round(degrees, 9).alias("degrees"), F.round(at_equator, 9).alias("at_equator"))


_COLLAPSE = (
    _SQUARES
    + """SELECT c_custkey, CASE WHEN k < 15 THEN 'SimplificationPoint' ELSE 'Polygon' END AS type, CASE WHEN k >= 15 THEN 'Polygon' END AS real_type,
  CASE WHEN k < 15 THEN 'POINT (' || regexp_replace((x0 + a)::VARCHAR, '\\.0$', '') || ' 0)' END AS point FROM s"""
)


def _collapsed(rows: DataFrame, simplified: Column) -> DataFrame:
    rows = rows.withColumn("s", simplified)
    point = F.when(F.col("s.type") == "SimplificationPoint", F.col("s.shape"))
    return rows.select("c_custkey", "s.type", "s.real_type", point.alias("point"))


@query(_COLLAPSE)
def simplify_dp_collapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fixtures.square_wkb(spark, sf_dir)
    return _collapsed(rows, geo_simplify(F.col("wkb"), 0, "DOUGLAS_PEUCKER", "WKT"))


@query(_COLLAPSE)
def simplify_script(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same through a script of parameters, over an array column of which the first value counts."""
    rows = fixtures.square_wkb(spark, sf_dir).withColumn("wkbs", F.array("wkb", F.lit(None).cast("binary")))
    script = compile_script("geo_simplify", {"field": "wkbs", "zoom": 0, "output_format": "wkt"})
    return _collapsed(rows, script(rows))


@query(_COLLAPSE)
def simplify_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same as a function in SQL text."""
    register(spark)
    fixtures.square_wkb(spark, sf_dir).createOrReplaceTempView("geoloom_squares")
    return spark.sql(
        """SELECT c_custkey, s.type, s.real_type, CASE WHEN s.type = 'SimplificationPoint' THEN s.shape END AS point
        FROM (SELECT c_custkey, geo_simplify(wkb, 0, 'DOUGLAS_PEUCKER', 'WKT') AS s FROM geoloom_squares)"""
    )


@query(
    """WITH s AS (SELECT p_partkey, 1 + p_size / 64.0::DOUBLE AS h FROM part)
SELECT p_partkey, CASE WHEN h <= 1.40625 THEN 'LINESTRING (0 0, 2 0)' ELSE 'LINESTRING (0 0, 1 ' || regexp_replace(h::VARCHAR, '\\.0$', '') || ', 2 0)' END AS shape,
  'LineString' AS type, 'LineString' AS real_type FROM s"""
)
def simplify_dp_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fixtures.zigzags(spark, sf_dir)
    return rows.select("p_partkey", geo_simplify(F.col("wkb"), 0, fmt="WKT").alias("s")).select("p_partkey", "s.*")


_ROOF = """WITH s AS (SELECT p_partkey, 1 + p_size / 64.0::DOUBLE AS h FROM part),
t AS (SELECT *, 'POLYGON ((0 0, 40 0, 40 40, ' AS head, '20 ' || regexp_replace((40 + h)::VARCHAR, '\\.0$', '') || ', ' AS roof, '0 40, 0 0)' AS tail,
  ', (19.875 40.125, 20.125 40.125, 20 40.25, 19.875 40.125)' AS hole FROM s)
SELECT p_partkey, {shape} AS shape, 'Polygon' AS type, 'Polygon' AS real_type FROM t"""
_FLAT = "head || CASE WHEN h <= 1.40625 THEN '' ELSE roof END || tail || ')'"


def _roofs(spark: SparkSession, sf_dir: str, column: str, how: str) -> DataFrame:
    rows = fixtures.roofs(spark, sf_dir)
    return rows.select("p_partkey", geo_simplify(F.col(column), 0, how, "WKT").alias("s")).select("p_partkey", "s.*")


@query(_ROOF.format(shape=_FLAT))
def simplify_tp_roof(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _roofs(spark, sf_dir, "wkb", "TOPOLOGY_PRESERVING")


@query(_ROOF.format(shape="head || roof || tail || hole || ')'"))
def simplify_tp_hole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A hole under a roof keeps it from being flattened, and small holes stay."""
    return _roofs(spark, sf_dir, "holed", "TOPOLOGY_PRESERVING")


@query(_ROOF.format(shape=_FLAT))
def simplify_dp_hole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Small holes go, and roofs over them are flattened."""
    return _roofs(spark, sf_dir, "holed", "DOUGLAS_PEUCKER")


@query(
    """WITH s AS (SELECT p_partkey, 1 + p_size / 64.0::DOUBLE AS h FROM part)
SELECT p_partkey, CASE WHEN h <= 1.40625 THEN 'LINESTRING (0 0, 2 0)' ELSE 'LINESTRING (0 0, 1 ' || regexp_replace(h::VARCHAR, '\\.0$', '') || ', 2 0)' END AS shape,
  'LineString' AS type, 'LineString' AS real_type FROM s"""
)
def simplify_tp_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fixtures.zigzags(spark, sf_dir)
    return rows.select("p_partkey", geo_simplify(F.col("wkb"), 0, "TOPOLOGY_PRESERVING", "WKT").alias("s")).select("p_partkey", "s.*")


@query(_SQUARES + "SELECT c_custkey, regexp_replace(wkt, '\\.0([ ,)])', '\\1', 'g') AS shape, 'Polygon' AS type, 'Polygon' AS real_type FROM t")
def simplify_tp_square(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A ring of four vertices stays, however small."""
    rows = fixtures.square_wkb(spark, sf_dir)
    return rows.select("c_custkey", geo_simplify(F.col("wkb"), 0, "TOPOLOGY_PRESERVING", "WKT").alias("s")).select("c_custkey", "s.*")


@query(
    _SQUARES
    + f"""SELECT {_HEX} AS key, n AS doc_count, ((SELECT count(*) FROM s) - sum(n) OVER ())::BIGINT AS sum_other_doc_count
FROM (SELECT * FROM g ORDER BY a DESC LIMIT 12)"""
)
def agg_tp_squares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Aggregation that simplifies, of shapes that topology keeps as they are; its keys are of the older byte order."""
    top = shape_agg(fixtures.square_wkb(spark, sf_dir), "wkb", size=12, simplify={"zoom": 0, "algorithm": "TOPOLOGY_PRESERVING"}, fmt="wkb")
    return top.select(F.hex(shape_to_wkb(wkb_to_wkt(F.unhex("key")))).alias("key"), "doc_count", "sum_other_doc_count")


@query()
def simplify_tp(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every shape of the largest table, keeping the topology, for zoom 8."""
    rows = spread(table(spark, sf_dir, "enriched_shapes").select("id", F.col("geo_shape_0.wkb").alias("wkb")), "id")
    return rows.select("id", geo_simplify(F.col("wkb"), 8, "TOPOLOGY_PRESERVING", "WKB").alias("s")).select("id", "s.*")


@query(
    """SELECT bucket_id, round(perimeter, 7) AS perimeter FROM shard_buckets WHERE wkb IS NOT NULL AND perimeter IS NOT NULL"""
)
def perimeters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Perimeters computed anew from the buckets' WKB."""
    rows = table(spark, sf_dir, "shard_buckets").where("wkb IS NOT NULL AND perimeter IS NOT NULL")
    return rows.select("bucket_id", F.round(shape_length("wkb"), 7).alias("perimeter"))
