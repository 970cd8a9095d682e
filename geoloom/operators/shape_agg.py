"""Aggregation by shape: the top shapes by perimeter, with counts and sub-aggregates.

The key of a shape is its exact WKB bytes. Rows are counted for each distinct shape before a shape
is decoded, only the shapes that survive the first ranking are simplified, and only those that are
returned are rendered. Without simplification the ranking is exact in one step. With it, the first
ranking, of ``shard_size`` shapes, goes by the original perimeter; survivors are simplified, merged
where they became equal, and ranked again by the new perimeter, so fewer than ``size`` may come out.

Defined results
    null shapes         not counted
    several values      a row counts once for each distinct value
    bytes that are no shape   never returned, but counted in sum_other_doc_count
    ties                perimeter, then doc_count, both falling, then the bytes of the key
    merged shapes       digest and type of the one with the least original bytes
    no such column      no buckets, with the result's columns
    other columns       may have any name, those of the result included
    missing             stands for a null, and for an array without values
    empty table         no buckets
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from geoloom.functions.options import OutputFormat, ShapeAggRequest, Simplify, output_format
from geoloom.functions.shape_udfs import attributes, render, simplified_wkb
from geoloom.operators.balance import _fresh, join_balanced
from geoloom.plans.lineage import cut

#: Survivors up to this many are sent to every task when sub-aggregates find their rows again; more
#: are joined with hot keys split.
MOST_BROADCAST = 100_000

#: Names that sub-aggregates cannot have.
_RESERVED = {"key", "digest", "type", "doc_count", "sum_other_doc_count"}

_RANKING = (F.desc, "perimeter"), (F.desc, "doc_count"), (F.asc, "wkb")


def _ranking() -> list[Column]:
    return [f(c) for f, c in _RANKING]


def _values(df: DataFrame, field: str, name: str, missing: bytes | None) -> DataFrame:
    """A row for each row of ``df`` and distinct value of it, with the value as ``name``."""
    kind = df.select(F.col(field).alias("c")).schema["c"].dataType
    several = isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.BinaryType)
    if not several and not isinstance(kind, T.BinaryType):
        raise TypeError(f"{field} must be binary or an array of binary, not {kind.simpleString()}")
    value = F.array_distinct(F.array_compact(F.col(field))) if several else F.col(field)
    if missing is not None:
        value = F.when(F.size(value) > 0, value).otherwise(F.array(F.lit(missing))) if several else F.coalesce(value, F.lit(missing))
    # sub-aggregates read columns of the input, so all of them go along until Catalyst prunes them
    return df.select("*", (F.explode(value) if several else value).alias(name)).where(F.col(name).isNotNull())


def _has(df: DataFrame, field: str) -> bool:
    kind: T.DataType = df.schema
    for part in field.split("."):
        if not isinstance(kind, T.StructType) or part not in kind.names:
            return False
        kind = kind[part].dataType
    return True


def shape_agg(
    df: DataFrame,
    field: str,
    size: int = 10,
    shard_size: int = -1,
    simplify: Simplify | dict | None = None,
    fmt: str | OutputFormat = "GEOJSON",
    sub_aggs: dict[str, Column] | None = None,
    shard: str | None = None,
    missing: bytes | None = None,
) -> DataFrame:
    """(key, digest, type, doc_count, sub-aggregates, sum_other_doc_count), best first.

    ``sub_aggs`` are aggregate expressions over columns of ``df``. ``shard`` names a column whose
    values rank their shapes apart in the first step, as separate shards would. ``missing`` stands
    for shapes that are not there.
    """
    request = ShapeAggRequest(field, output_format(fmt), Simplify.parse(simplify), size, shard_size)
    subs = sub_aggs or {}
    if clash := {n for n in subs if n.lower() in _RESERVED}:
        raise ValueError(f"names of sub-aggregates: {sorted(clash)}")
    if not _has(df, field):
        nothing = df.limit(0).agg(F.count(F.lit(1)).alias("doc_count"), *(e.alias(n) for n, e in subs.items()))
        text = lambda n: F.lit(None).cast("string").alias(n)
        return nothing.where("false").select(
            text("key"), text("digest"), text("type"), "doc_count", *subs, F.lit(0).cast("long").alias("sum_other_doc_count")
        )
    shape = _fresh("_shape", df)
    rows = _values(df, field, shape, missing)
    by = [F.col(shape).alias("wkb")] + ([F.col(f"`{shard}`").alias("shard")] if shard else [])
    # behind the grouping there are no columns of the input, so no names can clash
    numbered = {f"s{i}": e for i, e in enumerate(subs.values())}
    early = {} if request.simplify or shard else numbered  # one grouping is enough where nothing is merged
    counted = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("doc_count"), *(e.alias(n) for n, e in early.items()))
    # shapes without a perimeter rank last and go after the limit: a filter before it would be pushed
    # below the grouping, and with it the decoding of every row
    known = counted.withColumn("_a", attributes("wkb")).select("*", "_a.*").drop("_a")

    if shard:
        order = Window.partitionBy("shard").orderBy(*_ranking())
        top = known.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= request.cut).drop("_n")
    else:
        top = known.orderBy(*_ranking()).limit(request.cut if request.simplify else request.size)
    top = top.where("perimeter IS NOT NULL")
    if request.simplify:
        top = top.withColumn("_s", simplified_wkb(F.col("wkb"), request.simplify.zoom, request.simplify.algorithm))
        top = top.withColumns({"out": F.col("_s.wkb"), "perimeter": F.col("_s.perimeter")}).drop("_s")
    else:
        top = top.withColumn("out", F.col("wkb"))
    if request.simplify or shard:
        few = not shard and request.cut <= MOST_BROADCAST
        if subs and not few:
            top = cut(top)
            few = top.count() <= MOST_BROADCAST
        first = lambda c: F.min_by(c, "wkb").alias(c)
        merged = top.groupBy("out").agg(F.sum("doc_count").alias("doc_count"), *map(first, ("digest", "type", "perimeter")))
        merged = merged.withColumnRenamed("out", "wkb").orderBy(*_ranking()).limit(request.size)
        if subs:
            found = _rows_of(rows, shape, shard, top, few).agg(*(e.alias(n) for n, e in numbered.items()))
            merged = merged.join(found.withColumnsRenamed({found.columns[0]: "wkb"}), "wkb")
    else:
        merged = top
    total = rows.agg(F.count(F.lit(1))).scalar()
    kept = F.sum("doc_count").over(Window.partitionBy())  # over at most ``size`` rows
    merged = merged.withColumn("sum_other_doc_count", total - kept).orderBy(*_ranking())
    named = [F.col(n).alias(name) for n, name in zip(numbered, subs)]
    return merged.select(
        render(F.col("wkb"), request.output_format).alias("key"), "digest", "type", "doc_count", *named, "sum_other_doc_count"
    )


def _rows_of(rows: DataFrame, shape: str, shard: str | None, top: DataFrame, few: bool):
    """The rows behind the shapes of ``top``, grouped by what their shape became."""
    wkb, of, out = (_fresh(n, rows) for n in ("_wkb", "_of_shard", "_out"))
    survivors = top.select(F.col("wkb").alias(wkb), F.col("out").alias(out), *([F.col("shard").alias(of)] if shard else [])).distinct()
    same = F.col(shape) == F.col(wkb)
    if shard:
        same &= F.col(f"`{shard}`").eqNullSafe(F.col(of))
    if few:
        return rows.join(F.broadcast(survivors), same).groupBy(out)
    # a shape, or a shape of one shard, may hold a third of all rows
    at = _fresh("_at", rows, survivors)
    whole = [f"`{f.name}`" for f in rows.schema.fields if not _has_map(f.dataType)]
    tell = _fresh("_tell", rows, survivors)
    keyed = rows.withColumns({at: F.xxhash64(shape, *([f"`{shard}`"] if shard else [])), tell: F.xxhash64(*whole)})
    survivors = survivors.withColumn(at, F.xxhash64(wkb, *([of] if shard else [])))
    return join_balanced(keyed, survivors, at, [tell]).where(same).groupBy(out)


def _has_map(kind: T.DataType) -> bool:
    """Whether values cannot be hashed."""
    if isinstance(kind, T.ArrayType):
        return _has_map(kind.elementType)
    if isinstance(kind, T.StructType):
        return any(_has_map(f.dataType) for f in kind.fields)
    return isinstance(kind, (T.MapType, T.VariantType))


def run_request(df: DataFrame, body: dict, sub_aggs: dict[str, Column] | None = None, shard: str | None = None) -> DataFrame:
    """``shape_agg`` for the parameters of a mapping: field, output_format, simplify, size, shard_size, missing."""
    r = ShapeAggRequest.parse(body)
    return shape_agg(df, r.field, r.size, r.shard_size, r.simplify, r.output_format, sub_aggs, shard, r.missing)


def result_json(buckets: DataFrame) -> DataFrame:
    """One row, ``json``: {"sum_other_doc_count": ..., "buckets": [...]} of a result of ``shape_agg``."""
    names = [c for c in buckets.columns if c != "sum_other_doc_count"]
    # a result has at most ``size`` rows
    rows = buckets.select(F.struct(*names).alias("b"), "sum_other_doc_count").withColumn("_at", F.monotonically_increasing_id())
    gathered = rows.agg(
        F.coalesce(F.max("sum_other_doc_count"), F.lit(0)).alias("sum_other_doc_count"),
        F.transform(F.array_sort(F.collect_list(F.struct("_at", "b"))), lambda x: x["b"]).alias("buckets"),
    )
    return gathered.select(F.to_json(F.struct("sum_other_doc_count", "buckets")).alias("json"))
