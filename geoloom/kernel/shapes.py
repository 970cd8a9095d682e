"""Shapes in memory, and their codecs: WKB, two WKT dialects and GeoJSON.

A shape is a tuple (kind, data). The kinds are the WKB codes 1 to 7; data is

    POINT        (x, y), or None if empty
    LINE         list of vertices
    POLYGON      list of rings, the shell first; a ring is a closed list of vertices
    MULTI_...    list of the members' data
    COLLECTION   list of shapes

with x the longitude and y the latitude, in degrees. A third ordinate is read and left out.
"""

from __future__ import annotations

import json
import math
import re
import struct
from decimal import Decimal

POINT, LINE, POLYGON, MULTI_POINT, MULTI_LINE, MULTI_POLYGON, COLLECTION = range(1, 8)

#: Type names, in the order of the kinds; fixed values.
TYPE_NAMES = {
    POINT: "Point",
    LINE: "LineString",
    POLYGON: "Polygon",
    MULTI_POINT: "MultiPoint",
    MULTI_LINE: "MultiLineString",
    MULTI_POLYGON: "MultiPolygon",
    COLLECTION: "GeometryCollection",
}
KINDS = {name.upper(): kind for kind, name in TYPE_NAMES.items()}
MEMBER = {MULTI_POINT: POINT, MULTI_LINE: LINE, MULTI_POLYGON: POLYGON}

Shape = tuple


class ShapeError(ValueError):
    """A text or byte string that is no shape."""


def is_empty(shape: Shape) -> bool:
    kind, data = shape
    if kind == POINT:
        return data is None
    if kind in (LINE, MULTI_POINT):
        return not data
    if kind == POLYGON:
        return not data or not data[0]
    if kind == COLLECTION:
        return all(is_empty(s) for s in data)
    return all(is_empty((MEMBER[kind], d)) for d in data)


def vertices(shape: Shape):
    """All vertices, in order."""
    kind, data = shape
    if kind == POINT:
        if data is not None:
            yield data
    elif kind in (LINE, MULTI_POINT):
        yield from data
    elif kind in (POLYGON, MULTI_LINE):
        for part in data:
            yield from part
    elif kind == MULTI_POLYGON:
        for polygon in data:
            for ring in polygon:
                yield from ring
    else:
        for s in data:
            yield from vertices(s)


def checked(shape: Shape) -> Shape:
    """Refuses rings that are open or have under 4 vertices, and lines of a single vertex."""
    kind, data = shape
    if kind == LINE and len(data) == 1:
        raise ShapeError("a line of one vertex")
    if kind == POLYGON:
        for ring in data:
            if ring and (len(ring) < 4 or ring[0] != ring[-1]):
                raise ShapeError("a ring that is open or too short")
    elif kind in (MULTI_LINE, MULTI_POLYGON):
        for d in data:
            checked((MEMBER[kind], d))
    return shape


# --- WKB ---------------------------------------------------------------------------------------


def decode_wkb(raw: bytes) -> Shape:
    """Of either byte order, with or without SRID and further ordinates; raises ShapeError on anything else."""
    try:
        shape, at = _read_wkb(raw, 0)
    except (struct.error, IndexError, MemoryError) as e:
        raise ShapeError("truncated WKB") from e
    return shape


def _read_points(raw: bytes, at: int, n: int, order: str, width: int) -> tuple[list, int]:
    end = at + 8 * width * n
    if n < 0 or end > len(raw):
        raise ShapeError("truncated WKB")
    flat = struct.unpack_from(f"{order}{width * n}d", raw, at)
    return list(zip(flat[0::width], flat[1::width])), end


def _read_wkb(raw: bytes, at: int) -> tuple[Shape, int]:
    order = ">" if raw[at] == 0 else "<"
    code = struct.unpack_from(order + "I", raw, at + 1)[0]
    at += 5
    # a third and fourth ordinate and an SRID, as flags or in the thousands of the code
    kind, more = (code & 0xFFFF) % 1000, (code & 0xFFFF) // 1000
    width = 2 + (bool(code & 0x80000000) or more in (1, 3)) + (bool(code & 0x40000000) or more in (2, 3))
    at += 4 * bool(code & 0x20000000)
    if kind not in TYPE_NAMES or more > 3:
        raise ShapeError(f"WKB kind {code}")
    if kind == POINT:
        (p,), at = _read_points(raw, at, 1, order, width)
        return (POINT, None if math.isnan(p[0]) and math.isnan(p[1]) else p), at
    n = struct.unpack_from(order + "I", raw, at)[0]
    at += 4
    if kind == LINE:
        points, at = _read_points(raw, at, n, order, width)
        return checked((LINE, points)), at
    data = []
    if kind == POLYGON:
        for _ in range(n):
            m = struct.unpack_from(order + "I", raw, at)[0]
            ring, at = _read_points(raw, at + 4, m, order, width)
            data.append(ring)
        return checked((POLYGON, data)), at
    for _ in range(n):
        member, at = _read_wkb(raw, at)
        if kind != COLLECTION and member[0] != MEMBER[kind]:
            raise ShapeError("a member of another kind")
        data.append(member if kind == COLLECTION else member[1])
    return (kind, data), at


def encode_wkb(shape: Shape, little: bool = True) -> bytes:
    out: list[bytes] = []
    _write_wkb(shape, "<" if little else ">", b"\x01" if little else b"\x00", out)
    return b"".join(out)


def _write_points(points: list, order: str, out: list[bytes]) -> None:
    out.append(struct.pack(f"{order}{2 * len(points)}d", *(v for p in points for v in p)))


def _write_wkb(shape: Shape, order: str, mark: bytes, out: list[bytes]) -> None:
    kind, data = shape
    out.append(mark + struct.pack(order + "I", kind))
    if kind == POINT:
        _write_points([data or (math.nan, math.nan)], order, out)
        return
    out.append(struct.pack(order + "I", len(data)))
    if kind == LINE:
        _write_points(data, order, out)
    elif kind == POLYGON:
        for ring in data:
            out.append(struct.pack(order + "I", len(ring)))
            _write_points(ring, order, out)
    else:
        for d in data:
            _write_wkb(d if kind == COLLECTION else (MEMBER[kind], d), order, mark, out)


def wkb_is_point(raw: bytes) -> bool:
    """Whether the header is that of a plain point; nothing behind the header is looked at."""
    if raw is None or len(raw) < 5:
        return False
    return raw[1:5] == (b"\x00\x00\x00\x01" if raw[0] == 0 else b"\x01\x00\x00\x00")


# --- numbers -----------------------------------------------------------------------------------


def java_double(v: float) -> str:
    """Shortest digits; an exponent below 1e-3 and from 1e7 on; always a decimal point."""
    if 1e-3 <= v < 1e7 or -1e7 < v <= -1e-3:
        return repr(v)  # these always have a point and no exponent
    if v == 0:
        return "-0.0" if math.copysign(1, v) < 0 else "0.0"
    if math.isnan(v):
        return "NaN"
    if math.isinf(v):
        return "Infinity" if v > 0 else "-Infinity"
    sign, digits, exponent = Decimal(repr(v)).normalize().as_tuple()
    text = "".join(map(str, digits))
    return f"{'-' * sign}{text[0]}.{text[1:] or '0'}E{exponent + len(text) - 1}"


def plain_double(v: float) -> str:
    """Shortest digits, never an exponent, no point where it is integral."""
    if v != v or v in (math.inf, -math.inf):
        return {math.inf: "Inf", -math.inf: "-Inf"}.get(v, "NaN")
    text = repr(v)
    if "e" in text or "E" in text:
        text = format(Decimal(text), "f")
    if "." in text:
        text = text.rstrip("0").rstrip(".")
    return text


def rounded_double(v: float, decimals: int = 8) -> str:
    """Rounded half up to ``decimals``; integral values of middling size have no point."""
    scale = 10.0**decimals
    middling = 1e-3 <= abs(v) < 1e7
    r = math.floor(v * scale + 0.5) / scale if math.isfinite(v) else v
    return str(int(r)) if middling and r == int(r) else java_double(r)


# --- WKT ---------------------------------------------------------------------------------------


def to_wkt(shape: Shape, host: bool = False) -> str:
    """WKT in one of two dialects.

    Host dialect: ``0.0``, exponents, no blank between parts, flat MULTIPOINT. The other: ``0``, no
    exponents, a blank between parts, MULTIPOINT with a bracket around each member.
    """
    number, gap = (java_double, ",") if host else (plain_double, ", ")

    def run(points: list) -> str:
        return "(" + ", ".join(f"{number(x)} {number(y)}" for x, y in points) + ")"

    def rings(polygon: list) -> str:
        return "(" + gap.join(map(run, polygon)) + ")"

    def text(s: Shape) -> str:
        kind, data = s
        name = TYPE_NAMES[kind].upper()
        if data is None or not data or (kind == POLYGON and not data[0]):
            return f"{name} EMPTY"
        if kind == POINT:
            return f"{name} {run([data])}"
        if kind == LINE:
            return f"{name} {run(data)}"
        if kind == POLYGON:
            return f"{name} {rings(data)}"
        if kind == MULTI_POINT:
            return f"{name} {run(data)}" if host else f"{name} ({gap.join(run([p]) for p in data)})"
        if kind == MULTI_LINE:
            return f"{name} {rings(data)}"
        if kind == MULTI_POLYGON:
            return f"{name} ({gap.join(map(rings, data))})"
        return f"{name} ({gap.join(map(text, data))})"

    return text(shape)


_WKT_TOKEN = re.compile(r"\s*([A-Za-z]+|[-+]?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?|[(),;=])")


_COMMON_WKT = re.compile(r"(POINT|LINESTRING|POLYGON|MULTILINESTRING|MULTIPOLYGON) ?\(([0-9eE+\-.,()\s]+)\)")
_BETWEEN_PARTS, _BETWEEN_POLYGONS = re.compile(r"\)\s*,\s*\("), re.compile(r"\)\s*\)\s*,\s*\(\s*\(")


def _run_of(text: str) -> list:
    return [(float(x), float(y)) for x, y in map(str.split, text.split(","))]


def _parts_of(text: str) -> list:
    """Runs in brackets, which text has around all of them."""
    if text[0] != "(" or text[-1] != ")":
        raise ValueError
    return [_run_of(part) for part in _BETWEEN_PARTS.split(text[1:-1])]


def _common_wkt(text: str) -> Shape | None:
    """A shape in the usual spelling of the usual kinds, by splitting; None if it is anything else."""
    m = _COMMON_WKT.fullmatch(text)
    if not m:
        return None
    kind, body = KINDS[m[1]], m[2].strip()
    try:
        if kind == POINT:
            (data,) = _run_of(body)
        elif kind == LINE:
            data = _run_of(body)
        elif kind in (POLYGON, MULTI_LINE):
            data = _parts_of(body)
        else:
            if body[:1] != "(" or body[-1:] != ")":
                return None
            data = [_parts_of(f"({part.strip()})") for part in _BETWEEN_POLYGONS.split(body[1:-1].strip()[1:-1])]
    except (ValueError, IndexError):
        return None
    return _closed((kind, data))


def _closed(shape: Shape) -> Shape:
    """Rings that are left open are closed."""
    kind, data = shape
    if kind in (POLYGON, MULTI_POLYGON):
        for polygon in [data] if kind == POLYGON else data:
            for ring in polygon:
                if ring and ring[0] != ring[-1]:
                    ring.append(ring[0])
    return checked(shape)


def parse_wkt(text: str) -> Shape:
    """Of the kinds known, in any letter case; rings that are left open are closed."""
    text = text.strip()
    if shape := _common_wkt(text):
        return shape
    tokens, at = [], 0
    while at < len(text):
        m = _WKT_TOKEN.match(text, at)
        if not m:
            raise ShapeError(f"unexpected {text[at : at + 10]!r}")
        tokens.append(m[1])
        at = m.end()
    reader = _WktReader(tokens)
    shape = reader.shape()
    if reader.at != len(tokens):
        raise ShapeError("text behind the shape")
    return shape


class _WktReader:
    def __init__(self, tokens: list[str]):
        self.tokens, self.at = tokens, 0

    def peek(self) -> str:
        return self.tokens[self.at] if self.at < len(self.tokens) else ""

    def take(self, wanted: str = "") -> str:
        token = self.peek()
        if not token or (wanted and token != wanted):
            raise ShapeError(f"expected {wanted or 'more'}, got {token or 'the end'}")
        self.at += 1
        return token

    def several(self, item) -> list:
        if self.peek().upper() == "EMPTY":
            self.at += 1
            return []
        self.take("(")
        out = [item()]
        while self.peek() == ",":
            self.at += 1
            out.append(item())
        self.take(")")
        return out

    def vertex(self) -> tuple[float, float]:
        try:
            xy = (float(self.take()), float(self.take()))
            while self.peek() not in (",", ")", ""):
                float(self.take())
        except ValueError as e:
            raise ShapeError(str(e)) from None
        return xy

    def member_point(self) -> tuple[float, float]:
        if self.peek() != "(":
            return self.vertex()
        self.take("(")
        p = self.vertex()
        self.take(")")
        return p

    def run(self) -> list:
        return self.several(self.vertex)

    def rings(self) -> list:
        return self.several(self.run)

    def shape(self) -> Shape:
        kind = KINDS.get(self.take().upper())
        if kind is None:
            raise ShapeError("unsupported kind of shape")
        if self.peek().upper() in ("Z", "M", "ZM"):
            self.at += 1
        if kind == POINT:
            points = self.run()
            if len(points) > 1:
                raise ShapeError("a point of several vertices")
            return kind, points[0] if points else None
        read = {
            LINE: self.run,
            POLYGON: self.rings,
            MULTI_POINT: lambda: self.several(self.member_point),
            MULTI_LINE: self.rings,
            MULTI_POLYGON: lambda: self.several(self.rings),
            COLLECTION: lambda: self.several(self.shape),
        }[kind]
        return _closed((kind, read()))


# --- GeoJSON -----------------------------------------------------------------------------------

_CRS = ',"crs":{"type":"name","properties":{"name":"EPSG:0"}}}'


def _geojson_body(shape: Shape, decimals: int) -> str:
    kind, data = shape

    def run(points: list) -> str:
        return "[" + ",".join(f"[{rounded_double(x, decimals)},{rounded_double(y, decimals)}]" for x, y in points) + "]"

    def runs(parts: list) -> str:
        return "[" + ",".join(map(run, parts)) + "]"

    if kind == COLLECTION:
        inner = ",".join(_geojson_body(s, decimals) + "}" for s in data)
        return f'{{"type":"GeometryCollection","geometries":[{inner}]'
    if kind == POINT:
        body = run([data])[1:-1] if data is not None else "[]"
    elif kind in (LINE, MULTI_POINT):
        body = run(data)
    elif kind in (POLYGON, MULTI_LINE):
        body = runs(data)
    else:
        body = "[" + ",".join(map(runs, data)) + "]"
    return f'{{"type":"{TYPE_NAMES[kind]}","coordinates":{body}'


def to_geojson(shape: Shape, decimals: int = 8) -> str:
    """Compact, ordinates rounded, with the crs member at its end."""
    return _geojson_body(shape, decimals) + _CRS


def from_geojson(obj: dict) -> Shape:
    """Of a GeoJSON object. Rings that are left open are closed."""
    if not isinstance(obj, dict) or not isinstance(obj.get("type"), str):
        raise ShapeError("no GeoJSON object")
    kind = KINDS.get(obj["type"].upper())
    if kind is None:
        raise ShapeError(f"unsupported kind of shape: {obj['type']}")
    try:
        if kind == COLLECTION:
            return kind, [from_geojson(g) for g in obj["geometries"]]
        c = obj["coordinates"]
        if kind == POINT:
            return kind, _xy(c) if c else None
        if kind in (LINE, MULTI_POINT):
            return checked((kind, [_xy(p) for p in c]))
        if kind == POLYGON:
            return checked((kind, [_ring(r) for r in c]))
        if kind == MULTI_LINE:
            return checked((kind, [[_xy(p) for p in r] for r in c]))
        return checked((kind, [[_ring(r) for r in p] for p in c]))
    except (KeyError, TypeError, IndexError, ValueError) as e:
        raise e if isinstance(e, ShapeError) else ShapeError(f"bad coordinates: {e}") from None


def _xy(p) -> tuple[float, float]:
    return float(p[0]), float(p[1])


def _ring(points) -> list:
    ring = [_xy(p) for p in points]
    if ring and ring[0] != ring[-1]:
        ring.append(ring[0])
    return ring


def parse(text: str) -> Shape:
    """GeoJSON if the text begins with a brace, else WKT."""
    text = text.strip()
    if not text.startswith("{"):
        return parse_wkt(text)
    try:
        return from_geojson(json.loads(text))
    except json.JSONDecodeError as e:
        raise ShapeError(f"bad JSON: {e}") from None
