"""Enrichment, simplification and aggregation over small frames."""

import json

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from geoloom.functions.options import Algorithm, OutputFormat, ScriptParams, ShapeAggRequest, Simplify
from geoloom.functions.registry import register
from geoloom.functions.shape_udfs import clean_wkb, is_point_wkb, shape_area, shape_bbox, shape_centroid, shape_length, shape_to_wkb, shape_type, shape_vertices
from geoloom.operators.enrich import EnrichOptions, enrich, matching
from geoloom.operators.shape_agg import result_json, shape_agg
from geoloom.operators.simplify import compile_script, geo_simplify
from geoloom.sources.documents import read_documents, write_documents
from geoloom.streaming.enrichment import enrich_files


def square(side, x=0.0):
    return f"POLYGON (({x} 0, {x + side} 0, {x + side} {side}, {x} {side}, {x} 0))"


def frame(spark, *texts):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, geo_shape_0 string")


def wkb_frame(spark, *texts):
    return frame(spark, *texts).select("id", shape_to_wkb("geo_shape_0").alias("wkb"))


def test_enriched_members(spark):
    row = enrich(frame(spark, square(2)), "geo_shape_*").first().geo_shape_0
    assert row.asDict(True) == {
        "shape": square(2),
        "fixed_shape": "POLYGON ((2.0 0.0, 2.0 2.0, 0.0 2.0, 0.0 0.0, 2.0 0.0))",
        "hash": row.hash,
        "wkb": row.wkb,
        "type": "Polygon",
        "area": 4.0,
        "centroid": {"lat": 1.0, "lon": 1.0},
        "bbox": [{"lat": 0.0, "lon": 0.0}, {"lat": 2.0, "lon": 2.0}],
    }
    assert int(row.hash) and row.wkb[0] == 1


def test_enrich_nulls_bad_texts_and_empty_shapes(spark):
    df = frame(spark, None, "POINT (1 2)", "nonsense", "POLYGON EMPTY", "LINESTRING (1 1, 1 1)")
    rows = enrich(df, "geo_shape_0", mode="PERMISSIVE", error_column="why").orderBy("id").collect()
    assert [r.geo_shape_0 is None for r in rows] == [True, False, True, False, True]
    assert rows[3].geo_shape_0.area == 0 and rows[3].geo_shape_0.centroid is None and rows[3].geo_shape_0.bbox is None
    assert rows[0].why is None and rows[1].why is None and rows[2].why
    assert rows[4].why.startswith("unable to parse the geometry [LINESTRING (1.0 1.0, 1.0 1.0)]")
    with pytest.raises(Exception, match="unsupported|unexpected|expected|unable"):
        enrich(df, "geo_shape_0").collect()


def test_enrich_toggles_and_names(spark):
    off = dict.fromkeys(("keep_original_shape", "fix_shape", "wkb", "type", "area", "centroid", "bbox"), False)
    assert enrich(frame(spark, square(1)), "geo_shape_0", hash_field="h", **off).schema["geo_shape_0"].dataType.names == ["hash"]
    renamed = enrich(frame(spark, square(1)), "geo_shape_0", hash_field="h", rename_hash=True, **off)
    assert renamed.schema["geo_shape_0"].dataType.names == ["h"]
    with pytest.raises(ValueError):
        enrich(frame(spark, square(1)), "geo_shape_0", no_such_option=True)
    assert len(EnrichOptions().members()) == 7


def test_enrich_paths_wildcards_and_objects(spark):
    assert matching(["geo_1", "geo_2", "g?o_1", "name"], "geo_*") == ["geo_1", "geo_2"]
    assert matching(["geo_1", "g?o_1"], "g?o*") == ["g?o_1"]
    assert enrich(frame(spark, square(1)), "other_*").columns == ["id", "geo_shape_0"]
    point = {"type": "Point", "coordinates": [1.0, 2.0]}
    df = spark.createDataFrame(
        [Row(doc=Row(a=Row(**point), keep=1), b=json.dumps(point))], "doc struct<a:struct<type:string,coordinates:array<double>>,keep:int>, b string"
    )
    row = enrich(df, "a", path="doc").first()
    assert row.doc.a.fixed_shape == "POINT (1.0 2.0)" and row.doc.a.shape.type == "Point" and row.doc.keep == 1
    with pytest.raises(ValueError):
        enrich(df, "x", path="b")
    with pytest.raises(TypeError):
        enrich(spark.range(1), "id")


def test_enrich_empty_frame(spark):
    assert enrich(frame(spark, "x").limit(0), "geo_*").count() == 0


def test_scalar_functions(spark):
    row = wkb_frame(spark, square(2), "nonsense").orderBy("id").select(
        shape_area("wkb").alias("a"), shape_centroid("wkb").alias("c"), shape_bbox("wkb").alias("b"), shape_type("wkb").alias("t")
    )
    first, second = row.collect()
    assert (first.a, first.c.lat, first.b[1].lon, first.t) == (4.0, 1.0, 2.0, "Polygon")
    assert (second.a, second.c, second.b, second.t) == (None, None, None, None)


def test_simplify_rows(spark):
    df = wkb_frame(spark, square(0.5), square(9), None)
    rows = df.orderBy("id").select(geo_simplify(F.col("wkb"), 0, "douglas_peucker", "wkt").alias("s")).collect()
    assert rows[0].s == Row(shape="POINT (0 0)", type="SimplificationPoint", real_type=None)
    assert (rows[1].s.type, rows[1].s.real_type) == ("Polygon", "Polygon") and rows[2].s is None
    hexed = df.where("id = 1").select(geo_simplify(F.col("wkb"), 0, "topology_preserving", "wkb").alias("s")).first()
    assert hexed.s.shape.startswith("0000000003")
    with pytest.raises(Exception, match="can't parse WKB"):
        spark.sql("SELECT X'0103' AS wkb").select(geo_simplify(F.col("wkb"), 0)).collect()


def test_scripts(spark):
    df = wkb_frame(spark, square(9)).select(F.array("wkb").alias("w"), F.array().cast("array<binary>").alias("none"))
    run = compile_script("geo_simplify", {"field": "w", "zoom": 0, "output_format": "WKT"})
    assert df.select(run(df).alias("s")).first().s.type == "Polygon"
    for field in ("none", "no_such_field"):
        run = compile_script("geo_simplify", {"field": field, "zoom": 0})
        assert df.select(run(df).alias("s")).first().s is None
    for bad, error in (({}, ValueError), ({"field": "w"}, ValueError), ({"zoom": 1}, ValueError), ({"field": "w", "zoom": "1"}, TypeError)):
        with pytest.raises(error):
            compile_script("geo_simplify", bad)
    with pytest.raises(ValueError):
        compile_script("other", {"field": "w", "zoom": 1})


def test_sql_functions(spark):
    assert "geo_simplify" in register(spark)
    wkb_frame(spark, square(9), None).createOrReplaceTempView("shapes_for_sql")
    rows = spark.sql("SELECT geo_simplify(wkb, 0, null, 'wkt') AS s, shape_area(wkb) AS a FROM shapes_for_sql ORDER BY id").collect()
    assert rows[0].s.type == "Polygon" and rows[0].a == 81 and rows[1].s is None and rows[1].a is None
    heads = ["0101000000", "0000000001", "0107000000", "01EB030000", "0103000080", "0000000006", "01", "0108000000", "0000000000", "00000003EA"]
    df = spark.createDataFrame([(bytes.fromhex(h),) for h in heads] + [(None,)], "wkb binary")
    df.createOrReplaceTempView("headers_for_sql")
    called = spark.sql("SELECT shape_type(wkb) AS t, is_point_wkb(wkb) AS p FROM headers_for_sql")
    assert "Arrow" not in called._jdf.queryExecution().toString()
    got = [tuple(r) for r in called.collect()]
    assert got == [tuple(r) for r in df.select(shape_type("wkb"), is_point_wkb("wkb")).collect()]
    names = ["Point", "Point", "GeometryCollection", "Polygon", "Polygon", "MultiPolygon", None, None, None, "LineString", None]
    assert [t for t, _ in got] == names and [p for _, p in got] == [True, True, *[False] * 8, None]


def test_measures_of_broken_and_rare_shapes(spark):
    texts = [square(2), "GEOMETRYCOLLECTION (POINT (9 9), LINESTRING (0 0, 3 4))", "POLYGON EMPTY", "LINESTRING (0 0, 5 0)", square(2)]
    df = wkb_frame(spark, *texts, "nonsense").union(spark.createDataFrame([(9, b"\x01\x03")], "id int, wkb binary")).coalesce(1)
    rows = df.select("id", shape_area("wkb"), shape_length("wkb"), shape_vertices("wkb"), shape_bbox("wkb"), shape_centroid("wkb")).collect()
    got = [(r[1], r[2], r[3], r[4] and [tuple(c) for c in r[4]], r[5] and tuple(r[5])) for r in sorted(rows)]
    two = (4.0, 8.0, 5, [(0, 0), (2, 2)], (1, 1))
    none = (None,) * 5
    assert got == [two, (0.0, 5.0, 3, [(0, 0), (9, 9)], (2, 1.5)), (0.0, 0.0, 0, None, None), (0.0, 5.0, 2, None, (0, 2.5)), two, none, none]


def test_options():
    assert Simplify.parse({"zoom": 3, "algorithm": "douglas_peucker"}) == Simplify(3, Algorithm.DOUGLAS_PEUCKER)
    for nothing in (None, {}, {"zoom": 3}, {"algorithm": "douglas_peucker"}, {"zoom": -1, "algorithm": "douglas_peucker"}, []):
        assert Simplify.parse(nothing) is None
    assert Simplify.parse([{"zoom": 1, "algorithm": "topology_preserving"}, {"zoom": 9}]).zoom == 1
    with pytest.raises(ValueError):
        Simplify.parse({"zoom": 1, "algorithm": "other"})
    request = ShapeAggRequest.parse({"field": "wkb", "output_format": "wKt"})
    assert (request.size, request.cut, request.output_format) == (10, 10, OutputFormat.WKT)
    assert ShapeAggRequest.parse({"field": "wkb", "shard_size": 3}).cut == 10
    for bad in ({}, {"field": "w", "size": 0}, {"field": "w", "shard_size": 0}, {"field": "w", "output_format": "x"}, {"field": "w", "x": 1}):
        with pytest.raises(ValueError):
            ShapeAggRequest.parse(bad)
    assert ScriptParams.parse({"field": "f", "zoom": 2}) == ScriptParams("f", 2)


@pytest.mark.parametrize("size, shard_size, buckets, other", [(1, 10, 1, 3), (10, -1, 3, 0), (1, 1, 1, 3)])
def test_truncation(spark, size, shard_size, buckets, other):
    df = wkb_frame(spark, square(1), square(0.1), square(0.1), square(0.01))
    rows = shape_agg(df, "wkb", size=size, shard_size=shard_size).collect()
    assert len(rows) == buckets and all(r.sum_other_doc_count == other for r in rows)


def test_agg_golden_keys(spark):
    triangle = "POLYGON ((-3.3858489990234375 47.7442871774986, -3.3889389038085938 47.73770713305151, -3.3777809143066406 47.738515253481545, -3.3858489990234375 47.7442871774986))"
    df = frame(spark, triangle).select(clean_wkb("geo_shape_0").alias("wkb"))
    crs = '"crs":{"type":"name","properties":{"name":"EPSG:0"}}'
    one = shape_agg(df, "wkb", size=4, simplify={"zoom": 1, "algorithm": "DOUGLAS_PEUCKER"}).first()
    assert one.key == '{"type":"Point","coordinates":[-3.3889389,47.73770713],' + crs + "}" and one.type == "Polygon"
    two = shape_agg(df, "wkb", size=4, simplify={"zoom": 1, "algorithm": "TOPOLOGY_PRESERVING"}).first()
    ring = "[[[-3.3889389,47.73770713],[-3.37778091,47.73851525],[-3.385849,47.74428718],[-3.3889389,47.73770713]]]"
    assert two.key == '{"type":"Polygon","coordinates":' + ring + "," + crs + "}"


def test_agg_ranking_and_sub_aggregates(spark):
    df = wkb_frame(spark, square(2), square(1), square(1, 5.0), square(1), "POINT (3 3)", None)
    rows = shape_agg(df, "wkb", size=3, fmt="wkt", sub_aggs={"ids": F.sum("id")}).collect()
    assert [(r.doc_count, r.ids) for r in rows] == [(1, 0), (2, 4), (1, 2)]
    assert {r.sum_other_doc_count for r in rows} == {1}
    with pytest.raises(ValueError):
        shape_agg(df, "wkb", sub_aggs={"key": F.sum("id")})
    with pytest.raises(TypeError):
        shape_agg(df, "id")


def test_agg_merges_after_simplification(spark):
    df = wkb_frame(spark, square(0.1), square(0.2), square(0.2), square(9, 20.0))
    rows = shape_agg(df, "wkb", simplify={"zoom": 0, "algorithm": "DOUGLAS_PEUCKER"}, fmt="wkt", sub_aggs={"ids": F.sum("id")}).collect()
    assert [(r.key[:7], r.doc_count, r.ids, r.sum_other_doc_count) for r in rows] == [("POLYGON", 1, 3, 0), ("POINT (", 3, 3, 0)]
    # the first cut goes by the original perimeter
    rows = shape_agg(df, "wkb", size=1, shard_size=2, simplify={"zoom": 0, "algorithm": "DOUGLAS_PEUCKER"}).collect()
    assert [(r.doc_count, r.sum_other_doc_count) for r in rows] == [(1, 3)]


def test_agg_shards_multivalues_missing_and_broken(spark):
    df = wkb_frame(spark, square(3), square(2), square(2), square(1)).withColumn("shard", F.col("id") % 2)
    rows = shape_agg(df, "wkb", size=1, shard="shard").collect()
    assert [(r.doc_count, r.sum_other_doc_count) for r in rows] == [(1, 3)]
    both = df.agg(F.collect_list("wkb").alias("w"))
    assert [(r.doc_count, r.sum_other_doc_count) for r in shape_agg(both, "w").collect()] == [(1, 0)] * 3
    broken = df.select(F.when(F.col("id") == 0, F.unhex(F.lit("0101000000FF"))).otherwise(F.col("wkb")).alias("wkb"))
    assert [r.doc_count for r in shape_agg(broken, "wkb").collect()] == [2, 1]
    assert shape_agg(broken, "wkb").first().sum_other_doc_count == 1
    nulls = df.select(F.when(F.col("id") > 0, F.col("wkb")).alias("wkb"))
    missing = shape_agg(nulls, "wkb", fmt="wkt", missing=bytes.fromhex("0101000000") + bytes(16)).collect()
    assert missing[-1].key == "POINT (0 0)" and missing[-1].doc_count == 1


def test_agg_of_nothing(spark):
    df = wkb_frame(spark, square(1))
    for empty in (shape_agg(df.limit(0), "wkb"), shape_agg(df, "no_field"), shape_agg(df, "no.field", sub_aggs={"n": F.count("id")})):
        assert empty.count() == 0 and empty.columns[:4] == ["key", "digest", "type", "doc_count"]
    assert json.loads(result_json(shape_agg(df.limit(0), "wkb")).first().json) == {"sum_other_doc_count": 0, "buckets": []}
    body = json.loads(result_json(shape_agg(df, "wkb", fmt="wkt")).first().json)
    assert body["buckets"][0]["type"] == "Polygon"


def test_documents_and_streams(spark, tmp_path):
    df = frame(spark, square(1), None, "POINT (1 2)")
    write_documents(df, str(tmp_path / "in"), "json")
    back = read_documents(spark, str(tmp_path / "in"), "json", df.schema)
    assert back.count() == 3
    for _ in range(2):  # a second run finds nothing new
        run = enrich_files(
            spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "checkpoint"), df.schema, "geo_shape_0", fmt="json", once=True
        )
        run.awaitTermination()
    out = read_documents(spark, str(tmp_path / "out"), "json")
    assert sorted(str(r.t) for r in out.select(F.col("geo_shape_0.type").alias("t")).collect()) == ["None", "Point", "Polygon"]
    with pytest.raises(ValueError):
        read_documents(spark, str(tmp_path), "csv")


def test_agg_columns_of_any_name(spark):
    names = ("wkb", "_shape", "out", "shard", "perimeter", "doc_count", "_wkb", "_at", "_tell")
    df = wkb_frame(spark, square(3), square(2), square(2), square(0.1)).select(F.col("wkb").alias("geo"), *(F.lit(f"u{n}").alias(n) for n in names))
    subs = {f"m{n}": F.max(n) for n in names}
    for more in ({}, {"simplify": {"zoom": 0, "algorithm": "DOUGLAS_PEUCKER"}}, {"shard": "shard"}):
        rows = shape_agg(df, "geo", sub_aggs=subs, **more).collect()
        assert [r.doc_count for r in rows] == [1, 2, 1]
        assert all(r[f"m{n}"] == f"u{n}" for r in rows for n in names)


@pytest.mark.parametrize("most", [0, 100_000])
def test_agg_sub_aggregates_of_shards(spark, monkeypatch, most):
    from geoloom.operators import shape_agg as module

    monkeypatch.setattr(module, "MOST_BROADCAST", most)
    df = wkb_frame(spark, square(3), square(2), square(2), square(1)).withColumn("s", F.when(F.col("id") < 3, F.lit(1)))
    rows = shape_agg(df, "wkb", size=2, shard="s", sub_aggs={"ids": F.sum("id")}).collect()
    assert [(r.doc_count, r.ids, r.sum_other_doc_count) for r in rows] == [(1, 0, 1), (2, 3, 1)]
    rows = shape_agg(df, "wkb", size=9, simplify={"zoom": 0, "algorithm": "TOPOLOGY_PRESERVING"}, sub_aggs={"ids": F.sum("id")}).collect()
    assert [(r.doc_count, r.ids) for r in rows] == [(1, 0), (2, 3), (1, 3)]


def test_agg_missing_in_arrays(spark):
    point = bytes.fromhex("0101000000") + bytes(16)
    df = wkb_frame(spark, square(3)).select(F.array("wkb", "wkb", F.lit(None)).alias("w"))
    df = df.union(spark.createDataFrame([(None,), ([],), ([None],)], "w array<binary>"))
    rows = shape_agg(df, "w", fmt="wkt", missing=point).collect()
    assert [(r.key[:5], r.doc_count) for r in rows] == [("POLYG", 1), ("POINT", 3)]
    assert [r.doc_count for r in shape_agg(df, "w").collect()] == [1]
