"""Scalar functions over shapes, as Arrow functions over whole batches.

They take WKB of either byte order, or GeoJSON or WKT text. A null gives a null; bytes or text that
are no shape give a null too, unless a function says otherwise. A value that recurs in a batch is worked
on once. Measures are taken of all shapes of a batch at once (``kernel.flat``); the few that this does
not read are taken one by one.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from geoloom.functions import columns
from geoloom.functions.options import Algorithm, OutputFormat, algorithm, output_format, zoom_level
from geoloom.kernel import measures, murmur
from geoloom.kernel.flat import FlatShapes, flat_shapes
from geoloom.kernel.normal import dedup, normalize
from geoloom.kernel.shapes import (
    TYPE_NAMES,
    Shape,
    ShapeError,
    decode_wkb,
    encode_wkb,
    parse,
    to_geojson,
    to_wkt,
)
from geoloom.kernel.simplify import simplify_or_point

POINT_TYPE = "struct<lat:double,lon:double>"
_POINT = pa.struct([("lat", pa.float64()), ("lon", pa.float64())])


def distinct(values: pa.Array, of: Callable[[pa.Array], pa.Array]) -> pa.Array:
    """``of``, an array function that keeps nulls, of the distinct values."""
    held = values.dictionary_encode()
    if len(held.dictionary) == len(values):
        return of(held.dictionary)
    return of(held.dictionary).take(held.indices)


def _one(v, what: Callable):
    try:
        return None if v is None else what(v)
    except (ShapeError, RecursionError):
        return None


def _each(values: pa.Array, what: Callable, kind: pa.DataType) -> pa.Array:
    """``what`` of each value that is not null; null where it raises ShapeError."""
    return distinct(values, lambda some: pa.array([_one(v, what) for v in some.to_pylist()], kind))


def _patched(values: pa.Array, made: pa.Array, known: np.ndarray, what: Callable) -> pa.Array:
    """``made`` where it is known, else ``what`` of the value."""
    rest = np.flatnonzero(~known)
    if not len(rest):
        return made
    more = pa.array([_one(v, what) for v in values.take(pa.array(rest)).to_pylist()], made.type)
    at = np.arange(len(values))
    at[rest] = len(values) + np.arange(len(rest))
    return pa.concat_arrays([made, more]).take(pa.array(at))


@dataclass(frozen=True)
class ShapeFunction:
    """A function of one column; the Arrow function is made when it is first needed in a session."""

    sql_name: str
    returns: str
    kind: pa.DataType
    what: Callable

    def udf(self) -> Callable:
        what, kind = self.what, self.kind

        def over(values: pa.Array) -> pa.Array:
            return _each(values, what, kind)

        over.__name__ = self.sql_name
        return F.arrow_udf(over, self.returns)

    def __call__(self, c: Column | str) -> Column:
        return self.udf()(c)


def _latlon(p: tuple | None) -> dict | None:
    return None if p is None else {"lat": p[1], "lon": p[0]}


def _bbox(shape: Shape) -> list | None:
    box = measures.bbox(shape)
    return None if box is None else [_latlon(box[0]), _latlon(box[1])]


def export(shape: Shape, fmt: OutputFormat) -> str:
    """Text of a shape; WKB is upper-case hexadecimal digits of the big-endian bytes."""
    if fmt is OutputFormat.WKT:
        return to_wkt(shape)
    if fmt is OutputFormat.WKB:
        return encode_wkb(shape, little=False).hex().upper()
    return to_geojson(shape)


shape_to_wkb = ShapeFunction("shape_to_wkb", "binary", pa.binary(), lambda t: encode_wkb(parse(t)))
clean_wkb = ShapeFunction("clean_wkb", "binary", pa.binary(), lambda t: encode_wkb(normalize(dedup(parse(t)))))
dedup_wkb = ShapeFunction("dedup_wkb", "binary", pa.binary(), lambda w: encode_wkb(dedup(decode_wkb(w))))
normalize_wkb = ShapeFunction("normalize_wkb", "binary", pa.binary(), lambda w: encode_wkb(normalize(decode_wkb(w))))
wkb_big_endian = ShapeFunction("wkb_big_endian", "binary", pa.binary(), lambda w: encode_wkb(decode_wkb(w), little=False))
wkb_to_wkt = ShapeFunction("wkb_to_wkt", "string", pa.string(), lambda w: to_wkt(decode_wkb(w)))
wkb_to_host_wkt = ShapeFunction("wkb_to_host_wkt", "string", pa.string(), lambda w: to_wkt(decode_wkb(w), host=True))
wkb_to_geojson = ShapeFunction("wkb_to_geojson", "string", pa.string(), lambda w: to_geojson(decode_wkb(w)))


@dataclass(frozen=True)
class BatchFunction:
    """A function of one column that takes all distinct values of a batch, none of them null, at once."""

    sql_name: str
    returns: str
    of: Callable[[pa.Array], pa.Array]

    def udf(self) -> Callable:
        of = self.of

        def over(values: pa.Array) -> pa.Array:
            return distinct(values, of)

        over.__name__ = self.sql_name
        return F.arrow_udf(over, self.returns)

    def __call__(self, c: Column | str) -> Column:
        return self.udf()(c)


shape_digest = BatchFunction("shape_digest", "string", lambda values: pa.array(murmur.digests(values.to_pylist()).astype(str), pa.string()))


@dataclass(frozen=True)
class Measure:
    """A function of WKB: ``many`` gives values, and which of them are known, of all shapes; ``one`` is for the rest."""

    sql_name: str
    returns: str
    kind: pa.DataType
    many: Callable[[FlatShapes], tuple[pa.Array, np.ndarray]]
    one: Callable

    def of(self, values: pa.Array) -> pa.Array:
        def measured(some: pa.Array) -> pa.Array:
            flat = flat_shapes(some)
            made, known = self.many(flat)
            return _patched(some, made, known & (flat.kind > 0), lambda raw: self.one(decode_wkb(raw)))

        return distinct(values, measured)

    def udf(self) -> Callable:
        of = self.of

        def over(values: pa.Array) -> pa.Array:
            return of(values)

        over.__name__ = self.sql_name
        return F.arrow_udf(over, self.returns)

    def __call__(self, c: Column | str) -> Column:
        return self.udf()(c)


def _points(x: np.ndarray, y: np.ndarray) -> pa.Array:
    return pa.StructArray.from_arrays([pa.array(y), pa.array(x)], fields=list(_POINT))


def _centroids(flat: FlatShapes) -> tuple[pa.Array, np.ndarray]:
    x, y = flat.centroids()
    return _points(x, y), np.isfinite(x) & np.isfinite(y)


def _boxes(flat: FlatShapes) -> tuple[pa.Array, np.ndarray]:
    west, south, east, north = flat.boxes()
    has = (west == east) == (south == north)
    x, y = (np.stack(c, 1)[has].ravel() for c in ((west, east), (south, north)))
    ends = np.append(0, np.cumsum(2 * has)).astype(np.int32)
    made = pa.ListArray.from_arrays(pa.array(ends, mask=np.append(~has, False)), _points(x, y))
    return made.cast(pa.list_(_POINT)), np.ones(len(has), bool)


def _every(values: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    return pa.array(values), np.ones(len(values), bool)


shape_area = Measure("shape_area", "double", pa.float64(), lambda flat: _every(flat.areas()), measures.area)
shape_length = Measure("shape_length", "double", pa.float64(), lambda flat: _every(flat.lengths()), measures.length)
shape_centroid = Measure("shape_centroid", POINT_TYPE, _POINT, _centroids, lambda shape: _latlon(measures.centroid(shape)))
shape_bbox = Measure("shape_bbox", f"array<{POINT_TYPE}>", pa.list_(_POINT), _boxes, _bbox)
shape_vertices = Measure(
    "shape_vertices", "int", pa.int32(), lambda flat: _every(flat.vertex_counts().astype(np.int32)), lambda shape: sum(1 for _ in measures.vertices(shape))
)

SCALARS = (
    shape_to_wkb, clean_wkb, dedup_wkb, normalize_wkb, wkb_big_endian, wkb_to_wkt, wkb_to_host_wkt, wkb_to_geojson,
    shape_digest, shape_area, shape_length, shape_centroid, shape_bbox, shape_vertices,
)


def shape_type(wkb: Column | str) -> Column:
    """Type name by the header alone; an expression of the JVM."""
    return columns.wkb_type(F.col(wkb) if isinstance(wkb, str) else wkb)


def is_point_wkb(wkb: Column | str) -> Column:
    """Whether the header is that of a plain point; an expression of the JVM."""
    return columns.wkb_is_point(F.col(wkb) if isinstance(wkb, str) else wkb)


def render(wkb: Column, fmt: OutputFormat) -> Column:
    """The key of a bucket; as WKB, the hexadecimal digits of the bytes as they are."""
    if fmt is OutputFormat.WKB:
        return F.hex(wkb)
    return wkb_to_wkt(wkb) if fmt is OutputFormat.WKT else wkb_to_geojson(wkb)


_ATTRIBUTES = pa.struct([("digest", pa.string()), ("perimeter", pa.float64()), ("type", pa.string())])


def _attributes(values: pa.Array) -> pa.Array:
    flat = flat_shapes(values)
    made = _patched(values, pa.array(flat.lengths()), flat.kind > 0, lambda raw: measures.length(decode_wkb(raw)))
    names = np.array([None, *(TYPE_NAMES[k] for k in sorted(TYPE_NAMES))], object)[flat.kind]
    rest = np.flatnonzero((flat.kind == 0) & made.is_valid().to_numpy(zero_copy_only=False))
    names[rest] = [TYPE_NAMES[decode_wkb(raw)[0]] for raw in values.take(pa.array(rest)).to_pylist()]
    perimeter, kind = made, names
    known = perimeter.is_valid().to_numpy(zero_copy_only=False) & ~np.isnan(perimeter.to_numpy(zero_copy_only=False))
    kept = values.filter(pa.array(known))
    digests = np.full(len(values), "", object)
    digests[known] = murmur.digests(kept.to_pylist()).astype(str)
    columns_ = [pa.array(digests, pa.string()), perimeter, pa.array(kind, pa.string())]
    return pa.StructArray.from_arrays(columns_, fields=list(_ATTRIBUTES), mask=pa.array(~known))


def attributes(wkb: Column | str) -> Column:
    """(digest, perimeter, type) of a shape in one decoding; null where the bytes are no shape, or where
    the perimeter is no number."""
    return F.arrow_udf(_attributes, "struct<digest:string,perimeter:double,type:string>")(wkb)


def simplified_wkb(wkb: Column, zoom: int, how: Algorithm) -> Column:
    """(wkb, perimeter) of the simplified shape, big-endian; a shape that vanishes is its first vertex."""
    tolerance, name = measures.tolerance(zoom), how.value
    kind = pa.struct([("wkb", pa.binary()), ("perimeter", pa.float64())])

    def of(raw: bytes) -> dict:
        small, _ = simplify_or_point(decode_wkb(raw), tolerance, name)
        return {"wkb": encode_wkb(small, little=False), "perimeter": measures.length(small)}

    return F.arrow_udf(lambda v: _each(v, of, kind), "struct<wkb:binary,perimeter:double>")(wkb)


_SIMPLIFIED = pa.struct([("shape", pa.string()), ("type", pa.string()), ("real_type", pa.string())])
SIMPLIFIED_TYPE = "struct<shape:string,type:string,real_type:string>"


def simplify_row(raw: bytes, tolerance: float, name: str, fmt: OutputFormat) -> dict:
    shape = decode_wkb(raw)
    small, vanished = simplify_or_point(shape, tolerance, name)
    if vanished:
        return {"shape": export(small, fmt), "type": "SimplificationPoint", "real_type": None}
    return {"shape": export(small, fmt), "type": TYPE_NAMES[small[0]], "real_type": TYPE_NAMES[shape[0]]}


def _simplified(values: pa.Array, tolerance: float, name: str, fmt: OutputFormat) -> pa.Array:
    """Bad bytes are an error, unlike nulls."""

    def over(some: pa.Array) -> pa.Array:
        try:
            return pa.array([None if raw is None else simplify_row(raw, tolerance, name, fmt) for raw in some.to_pylist()], _SIMPLIFIED)
        except ShapeError as e:
            raise ValueError(f"can't parse WKB: {e}") from None

    return distinct(values, over)


def _simplify_sql(wkb: pa.Array, zoom: pa.Array, name: pa.Array, fmt: pa.Array) -> pa.Array:
    out = []
    for w, z, n, f in zip(wkb.to_pylist(), zoom.to_pylist(), name.to_pylist(), fmt.to_pylist()):
        if z is None:
            raise ValueError("parameter zoom is missing")
        try:
            how, text = algorithm(n or "DOUGLAS_PEUCKER").value, output_format(f or "GEOJSON")
            out.append(None if w is None else simplify_row(w, measures.tolerance(zoom_level(z)), how, text))
        except ShapeError as e:
            raise ValueError(f"can't parse WKB: {e}") from None
    return pa.array(out, _SIMPLIFIED)
