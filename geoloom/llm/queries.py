"""Queries over the project's tables, and their SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geoloom.llm.heavy_hitters import heavy_hitters
from geoloom.llm.outlines import near_outlines, outline_pairs
from geoloom.llm.packing import pack_all
from geoloom.llm.quality import fit_quality, text_quality
from geoloom.llm.spellings import collapse_spellings
from geoloom.llm.tokens import encode
from geoloom.sources.tables import spread, table

SHARE = 0.005


def vocabulary(name: str = "byte_bpe_50k.json") -> str:
    """Path of a public vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def p1_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    shapes = table(spark, sf_dir, "enriched_shapes")
    fields = {"hash": F.col("geo_shape_0.hash"), "wkb": F.col("geo_shape_0.wkb")}
    return heavy_hitters(shapes, fields, SHARE)


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p1_counts(spark, sf_dir).select("field", "val")


FORMS = {"hash": "digits", "wkb": "hex", "fixed_shape": "shape", "props": "json"}


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, members = collapse_spellings(table(spark, sf_dir, "shape_feed"), "rec_id", FORMS, only_repeated=True)
    return members.where("id <> keep_id").select("keep_id", F.col("id").alias("dup_id"))


def p3_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collapse_spellings(table(spark, sf_dir, "shape_feed"), "rec_id", FORMS, with_members=False)[0]


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    outlines = table(spark, sf_dir, "outlines")
    return outline_pairs(near_outlines(outlines, "outline_id", "geoshape", "area"))


def p4_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each outline with its class of equal vertices and the number of classes linked to it."""
    near = near_outlines(table(spark, sf_dir, "outlines"), "outline_id", "geoshape", "area")
    ends = near.links.select(F.explode(F.array("a_class", "b_class")).alias("class_id"))
    n_links = ends.groupBy("class_id").agg(F.count(F.lit(1)).alias("n_links"))
    members = near.members.select(F.col("id").alias("outline_id"), "class_id")
    return members.join(n_links, "class_id", "left").select(
        "outline_id", "class_id", F.coalesce("n_links", F.lit(0)).alias("n_links")
    )


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")


def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(_texts(spark, sf_dir), ["doc_id"], F.col("text"), vocabulary())


def p6_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(_texts(spark, sf_dir), ["doc_id"], F.col("text"), vocabulary(), "tokens", only_counts=True)


def p7_packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document, or piece of one, with its container of each capacity."""
    sizes = p6_counts(spark, sf_dir).select(F.col("doc_id").alias("id"), F.col("tokens").alias("size"))
    packed = pack_all(sizes, table(spark, sf_dir, "pack_sizes"), "pack_kind", "capacity")
    names = {"id": "doc_id", "size": "tokens", "used": "used_tokens"}
    return packed.withColumnsRenamed(names)


def p7_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Containers of each capacity, the tokens in them and the share of their room that is used."""
    by = p7_packed(spark, sf_dir).groupBy("pack_kind", "capacity")
    fill = F.sum("tokens") / (F.countDistinct("container") * F.col("capacity"))
    return by.agg(F.countDistinct("container").alias("containers"), F.sum("tokens").alias("tokens"), fill.alias("fill"))


def p8_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = fit_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "doc_labels"), table(spark, sf_dir, "common_words"))
    return text_quality(_texts(spark, sf_dir), "doc_id", "text", model)


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p8_stats(spark, sf_dir).where("label <> 'prose'").select("doc_id")


_P1 = """
WITH v AS (
  SELECT 'hash' AS field, geo_shape_0.hash AS val FROM enriched_shapes WHERE geo_shape_0.hash IS NOT NULL
  UNION ALL
  SELECT 'wkb', hex(geo_shape_0.wkb) FROM enriched_shapes WHERE geo_shape_0.wkb IS NOT NULL
), c AS (SELECT field, val, count(*) AS cnt FROM v GROUP BY ALL),
n AS (SELECT field, count(*) AS rows_seen FROM v GROUP BY ALL)
SELECT {columns} FROM c JOIN n USING (field) WHERE cnt >= 0.005 * rows_seen
"""

#: Canonical texts, written for records whose ``props`` have the fields that those of ``shape_feed`` have.
_P3 = r"""
WITH c AS (
  SELECT rec_id,
    CASE WHEN regexp_matches(hash, '^[^\p{L}\p{N}]*-\.?[0-9]') THEN '-' ELSE '' END || replace(regexp_replace(regexp_replace(
      regexp_replace(lower(hash), '([0-9])\.([0-9])', '\1' || chr(57344) || '\2', 'g'), '([0-9])\.([0-9])', '\1' || chr(57344) || '\2', 'g'),
      '[^\p{L}\p{N}' || chr(57344) || ']', '', 'g'), chr(57344), '.') AS hash,
    regexp_replace(lower(wkb), '[^\p{L}\p{N}]', '', 'g') AS wkb,
    array_to_string(regexp_extract_all(lower(fixed_shape), '-?(?:[0-9]+\.[0-9]+|[0-9]+|\.[0-9]+)(?:e[+-]?[0-9]+)?|\p{L}+'), ' ') AS fixed_shape,
    '{dataset:' || regexp_replace(props ->> '$.dataset', '[^\p{L}\p{N}]', '', 'g') || ',height:' || regexp_extract(props, '"height"\s*:\s*([-+0-9.e]+)', 1)
      || ',level:' || regexp_extract(props, '"level"\s*:\s*([-+0-9.e]+)', 1) || ',name:' || regexp_replace(props ->> '$.name', '[^\p{L}\p{N}]', '', 'g')
      || ',survey:{crew:' || regexp_replace(props ->> '$.survey.crew', '[^\p{L}\p{N}]', '', 'g') || ',day:' || regexp_replace(props ->> '$.survey.day', '[^\p{L}\p{N}]', '', 'g')
      || '},tags:[' || array_to_string(list_transform(props ->> '$.tags[*]', lambda t: regexp_replace(t, '[^\p{L}\p{N}]', '', 'g')), ',') || ']}' AS props
  FROM (SELECT * REPLACE (lower(props) AS props) FROM shape_feed)
), r AS (SELECT *, min(rec_id) OVER w AS keep_id FROM c WINDOW w AS (PARTITION BY hash, wkb, fixed_shape, props))
"""

#: Sets of vertices, and their numbers; digits decide how an ordinate is rounded.
_P4 = r"""
WITH o AS (
  SELECT outline_id, min(area) AS area, list_transform(regexp_extract_all(min_by(geoshape, area), '-?[0-9]+(?:\.[0-9]+)?(?:[eE][-+]?[0-9]+)?'), lambda t: printf('%.5f', t::DOUBLE)::DOUBLE + 0.0) AS n
  FROM outlines WHERE outline_id IS NOT NULL AND geoshape IS NOT NULL AND area > 0 GROUP BY outline_id
), v AS (SELECT DISTINCT outline_id, area, n[2 * i - 1] AS x, n[2 * i] AS y FROM (SELECT outline_id, area, n, unnest(range(1, len(n) // 2 + 1)) AS i FROM o)),
s AS (SELECT outline_id, area, count(*) AS size FROM v GROUP BY ALL)
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "p1_found": p1_found,
    "p1_counts": p1_counts,
    "p3_found": p3_found,
    "p3_records": p3_records,
    "p4_found": p4_found,
    "p4_classes": p4_classes,
    "p6_ids": p6_ids,
    "p6_counts": p6_counts,
    "p7_packed": p7_packed,
    "p7_fill": p7_fill,
    "p8_found": p8_found,
    "p8_stats": p8_stats,
}

ORACLE_SQL: dict[str, str] = {
    "p1_found": _P1.format(columns="field, val"),
    "p1_counts": _P1.format(columns="field, val, cnt, rows_seen"),
    "p3_found": _P3 + "SELECT keep_id, rec_id AS dup_id FROM r WHERE rec_id <> keep_id",
    "p3_records": _P3 + "SELECT keep_id, count(*) AS copies, hash, wkb, fixed_shape, props FROM r GROUP BY ALL",
    "p4_found": _P4
    + """,
p AS (SELECT a.outline_id AS a_id, b.outline_id AS b_id, count(*) AS shared FROM v a JOIN v b ON a.x = b.x AND a.y = b.y AND a.outline_id < b.outline_id
  AND least(a.area, b.area) / greatest(a.area, b.area) >= 0.9 GROUP BY ALL)
SELECT a_id, b_id FROM p JOIN s a ON a.outline_id = a_id JOIN s b ON b.outline_id = b_id WHERE shared / (a.size + b.size - shared) >= 0.7""",
    "p4_classes": _P4
    + """, k AS (SELECT outline_id, area, list_sort(list({'x': x, 'y': y})) AS vertices FROM v GROUP BY ALL),
c AS (SELECT vertices, min(outline_id) AS class_id, min(area) AS lo, max(area) AS hi, len(vertices) AS size FROM k GROUP BY vertices),
t AS (SELECT class_id, unnest(vertices) AS xy FROM c),
p AS (SELECT a.class_id AS a, b.class_id AS b, count(*) AS shared FROM t a JOIN t b ON a.xy = b.xy AND a.class_id <> b.class_id GROUP BY ALL),
n AS (SELECT a AS class_id, count(*) AS n_links FROM p JOIN c l ON l.class_id = a JOIN c r ON r.class_id = b
  WHERE shared / (l.size + r.size - shared) >= 0.7 AND l.lo * 0.9 <= r.hi AND r.lo * 0.9 <= l.hi GROUP BY a)
SELECT k.outline_id, c.class_id, coalesce(n_links, 0) AS n_links FROM k JOIN c USING (vertices) LEFT JOIN n USING (class_id)""",
}
