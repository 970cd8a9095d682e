"""Enrichment of shape columns: the cleaned shape and what derives from it.

One Arrow function decodes a shape once and returns all members. There is no shuffle and no state,
so the operator works on streams as well.

Defined results
    null            a null struct
    bad text        an error (FAILFAST), or a null struct and the reason in ``error_column`` (PERMISSIVE)
    empty shape     null centroid and bbox, area 0
    no match        a pattern that matches no column leaves the frame as it is
    metadata        rows have none, so a lone * matches every column and nothing else
"""

from __future__ import annotations

import re
from dataclasses import dataclass, fields

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from geoloom.functions.shape_udfs import POINT_TYPE, _POINT, _bbox, _latlon, distinct
from geoloom.kernel import measures, murmur
from geoloom.kernel.normal import dedup, normalize
from geoloom.kernel.shapes import TYPE_NAMES, ShapeError, encode_wkb, parse, to_wkt

FAILFAST, PERMISSIVE = "FAILFAST", "PERMISSIVE"


@dataclass(frozen=True)
class EnrichOptions:
    """Which members the struct has, and their names. Shapes are cleaned whatever is asked for."""

    keep_original_shape: bool = True
    shape_field: str = "shape"
    fix_shape: bool = True
    fixed_field: str = "fixed_shape"
    hash: bool = True
    hash_field: str = "hash"
    wkb: bool = True
    wkb_field: str = "wkb"
    type: bool = True
    type_field: str = "type"
    area: bool = True
    area_field: str = "area"
    centroid: bool = True
    centroid_field: str = "centroid"
    bbox: bool = True
    bbox_field: str = "bbox"
    #: Off, the digest is always named hash, whatever hash_field says.
    rename_hash: bool = False

    def members(self) -> list[tuple[str, str, str, pa.DataType]]:
        """(what, name, Spark type, Arrow type) of the derived members, in their order."""
        every = [
            ("fix_shape", self.fixed_field, "string", pa.string()),
            ("hash", self.hash_field if self.rename_hash else "hash", "string", pa.string()),
            ("wkb", self.wkb_field, "binary", pa.binary()),
            ("type", self.type_field, "string", pa.string()),
            ("area", self.area_field, "double", pa.float64()),
            ("centroid", self.centroid_field, POINT_TYPE, _POINT),
            ("bbox", self.bbox_field, f"array<{POINT_TYPE}>", pa.list_(_POINT)),
        ]
        return [m for m in every if getattr(self, m[0])]


def derive(text: str, wanted: set[str]) -> dict:
    """The members of one shape by what they are, all but the digest of its ``wkb``."""
    shape = parse(text)
    try:
        clean = normalize(dedup(shape))
    except ShapeError as e:
        raise ShapeError(f"unable to parse the geometry [{to_wkt(shape, host=True)}]{e}") from None
    raw = encode_wkb(clean) if wanted & {"wkb", "hash"} else None
    out = {"wkb": raw}
    if "fix_shape" in wanted:
        out["fix_shape"] = to_wkt(clean, host=True)
    if "type" in wanted:
        out["type"] = TYPE_NAMES[clean[0]]
    if "area" in wanted:
        out["area"] = measures.area(clean)
    if "centroid" in wanted:
        out["centroid"] = _latlon(measures.centroid(clean))
    if "bbox" in wanted:
        out["bbox"] = _bbox(clean)
    return out


def _derived(texts: Column, options: EnrichOptions, mode: str) -> Column:
    members = options.members()
    wanted = {what for what, *_ in members}
    fields_ = [pa.field(f"m{i}", kind) for i, (*_, kind) in enumerate(members)] + [pa.field("error", pa.string())]
    returns = "struct<" + "".join(f"m{i}:{spark}," for i, (_, _, spark, _) in enumerate(members)) + "error:string>"

    def over(values: pa.Array) -> pa.Array:
        made, errors = [], []
        for text in values.to_pylist():
            row, error = None, None
            try:
                row = None if text is None else derive(text, wanted)
            except (ShapeError, RecursionError) as e:
                if mode == FAILFAST:
                    raise ValueError(str(e)) from None
                error = str(e)
            made.append(row or {})
            errors.append(error)
        if "hash" in wanted:
            rows = [row for row in made if row]
            for row, d in zip(rows, murmur.digests([row["wkb"] for row in rows]).tolist()):
                row["hash"] = str(d)
        columns = [pa.array([row.get(what) for row in made], kind) for what, _, _, kind in members]
        return pa.StructArray.from_arrays([*columns, pa.array(errors, pa.string())], fields=fields_)

    return F.arrow_udf(lambda values: distinct(values, over), returns)(texts)


def _text(df: DataFrame, c: Column) -> Column:
    """GeoJSON objects come as text; texts stay."""
    kind = df.select(c.alias("c")).schema["c"].dataType
    if isinstance(kind, T.StringType):
        return c
    if isinstance(kind, (T.StructType, T.MapType)):
        return F.to_json(c)
    if isinstance(kind, T.VariantType):
        return F.to_json(c)
    raise TypeError(f"a shape column must be text or an object, not {kind.simpleString()}")


def matching(names: list[str], pattern: str) -> list[str]:
    """Names that match a pattern, in which only * stands for anything."""
    as_regex = re.compile(".*".join(map(re.escape, pattern.split("*"))), re.DOTALL)
    return [n for n in names if as_regex.fullmatch(n)]


def enrich(
    df: DataFrame, field: str, path: str | None = None, mode: str = FAILFAST, error_column: str | None = None, **options
) -> DataFrame:
    """Replaces each column that matches ``field`` by a struct of the shape's derived members.

    ``field`` may hold *; with ``path``, it is matched against the fields of that struct column.
    ``options`` are those of EnrichOptions. With ``error_column``, which needs PERMISSIVE mode, that
    column has the reason of the first column that failed.
    """
    if mode not in (FAILFAST, PERMISSIVE):
        raise ValueError(f"mode: {mode}")
    if error_column and mode != PERMISSIVE:
        raise ValueError("error_column needs PERMISSIVE mode")
    if unknown := set(options) - {f.name for f in fields(EnrichOptions)}:
        raise ValueError(f"unknown options: {sorted(unknown)}")
    wanted = EnrichOptions(**options)
    if path is not None:
        at = df.select(F.col(path).alias("c")).schema["c"].dataType
        if not isinstance(at, T.StructType):
            raise ValueError(f"{path} is no object")
        names = matching(at.names, field)
    else:
        names = matching(df.columns, field)
    if not names:
        return df.withColumn(error_column, F.lit(None).cast("string")) if error_column else df

    at = {n: F.col(f"{path}.`{n}`" if path else f"`{n}`") for n in names}
    made = df.withColumns({f"_derived_{i}": _derived(_text(df, at[n]), wanted, mode) for i, n in enumerate(names)})
    structs = {}
    for i, n in enumerate(names):
        d = F.col(f"_derived_{i}")
        parts = [at[n].alias(wanted.shape_field)] if wanted.keep_original_shape else []
        parts += [d[f"m{k}"].alias(name) for k, (_, name, *_) in enumerate(wanted.members())]
        structs[n] = F.when(at[n].isNotNull() & d["error"].isNull(), F.struct(*parts))
    errors = F.coalesce(*(F.col(f"_derived_{i}.error") for i in range(len(names))))
    if path:
        column = F.col(path)
        for n, s in structs.items():
            column = column.withField(f"`{n}`", s)
        head, _, rest = path.partition(".")
        made = made.withColumn(head, F.col(head).withField(rest, column) if rest else column)
        new = {}
    else:
        new = structs
    if error_column:
        new = new | {error_column: errors}
    made = made.withColumns(new) if new else made
    return made.drop(*(f"_derived_{i}" for i in range(len(names))))
