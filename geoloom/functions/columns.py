"""Geometry functions that stay in the JVM: expressions over rings, and arithmetic of map zooms.

A ring, or a line, is an array of structs (x, y).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from geoloom.kernel.measures import EQUATOR
from geoloom.kernel.shapes import TYPE_NAMES


def _pairs(ring: Column, of) -> Column:
    """``of`` (vertex, next vertex) over the edges of a ring."""
    n = F.greatest(F.size(ring) - 1, F.lit(0))
    return F.zip_with(F.slice(ring, 1, n), F.slice(ring, 2, n), of)


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda total, v: total + v)


def ring_signed_area(ring: Column) -> Column:
    """Positive if it runs counterclockwise."""
    return _sum(_pairs(ring, lambda a, b: a["x"] * b["y"] - b["x"] * a["y"])) / 2


def ring_area(ring: Column) -> Column:
    return F.abs(ring_signed_area(ring))


def polygon_area(rings: Column) -> Column:
    """The shell's area less those of the holes."""
    shell = ring_area(F.element_at(rings, 1))
    return shell * 2 - _sum(F.transform(rings, ring_area))


def line_length(line: Column) -> Column:
    edges = _pairs(line, lambda a, b: F.sqrt((b["x"] - a["x"]) * (b["x"] - a["x"]) + (b["y"] - a["y"]) * (b["y"] - a["y"])))
    return _sum(edges)


def rings_length(rings: Column) -> Column:
    return _sum(F.transform(rings, line_length))


def drop_repeats(points: Column) -> Column:
    """Without vertices equal to the one before them."""
    return F.filter(points, lambda p, i: (i == 0) | (p != F.get(points, i - 1)))


def points_bbox(points: Column) -> Column:
    """[least corner, greatest corner] as (lat, lon); null of no points and of lines along an axis."""
    x, y = F.transform(points, lambda p: p["x"]), F.transform(points, lambda p: p["y"])
    low_x, high_x, low_y, high_y = F.array_min(x), F.array_max(x), F.array_min(y), F.array_max(y)
    corner = lambda lat, lon: F.struct(lat.alias("lat"), lon.alias("lon"))
    flat = (low_x == high_x) != (low_y == high_y)
    return F.when(~flat, F.array(corner(low_y, low_x), corner(high_y, high_x)))


def ring_centroid(ring: Column) -> Column:
    """(lat, lon) of a ring's area; null where it has none."""
    cross = lambda a, b: a["x"] * b["y"] - b["x"] * a["y"]
    six = ring_signed_area(ring) * 6
    cx = _sum(_pairs(ring, lambda a, b: (a["x"] + b["x"]) * cross(a, b)))
    cy = _sum(_pairs(ring, lambda a, b: (a["y"] + b["y"]) * cross(a, b)))
    return F.when(six != 0, F.struct((cy / six).alias("lat"), (cx / six).alias("lon")))


def wkb_is_point(wkb: Column) -> Column:
    """Whether the header is that of a plain point."""
    head = F.hex(F.substring(wkb, 1, 5))
    big = F.substring(head, 1, 2) == "00"
    code = F.when(big, F.lit("00000001")).otherwise(F.lit("01000000"))
    return (F.length(wkb) >= 5) & (F.substring(head, 3, 8) == code)


def wkb_type(wkb: Column) -> Column:
    """Type name from the header alone, with or without further ordinates; null of other kinds."""
    head = F.hex(F.substring(wkb, 1, 5))
    big = F.substring(head, 1, 2) == "00"
    # the lower half of the code; the upper one has flags
    code = F.when(big, F.substring(head, 7, 4)).otherwise(F.concat(F.substring(head, 5, 2), F.substring(head, 3, 2)))
    number = F.conv(code, 16, 10).cast("int") % 1000
    names = F.array(*(F.lit(TYPE_NAMES[kind]) for kind in sorted(TYPE_NAMES)))
    return F.when((F.length(wkb) >= 5) & (number > 0), F.get(names, number - 1))


def meter_by_pixel(zoom: Column, lat: Column) -> Column:
    return F.lit(EQUATOR / 256.0) * F.cos(F.radians(lat)) / F.pow(F.lit(2.0), zoom)


def degrees_of_meters(meters: Column, lat: Column | None = None) -> Column:
    degrees = meters * 360.0 / F.lit(EQUATOR)
    return degrees if lat is None else degrees / F.cos(F.radians(lat))


def tolerance_of_zoom(zoom: Column) -> Column:
    """Degrees of a pixel."""
    return F.lit(360.0 / 256.0) / F.pow(F.lit(2.0), zoom)
