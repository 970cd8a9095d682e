"""Planar measures in degrees."""

from __future__ import annotations

import math

from geoloom.kernel.normal import signed_area
from geoloom.kernel.shapes import COLLECTION, LINE, MULTI_LINE, MULTI_POINT, MULTI_POLYGON, POINT, POLYGON, Shape, vertices


def _flat(shape: Shape) -> tuple[list, list, list]:
    """Polygons, lines and points of a shape."""
    kind, data = shape
    if kind == POINT:
        return [], [], [data] if data is not None else []
    if kind == LINE:
        return [], [data] if data else [], []
    if kind == POLYGON:
        return [data] if data and data[0] else [], [], []
    if kind == MULTI_POINT:
        return [], [], list(data)
    if kind == MULTI_LINE:
        return [], [d for d in data if d], []
    if kind == MULTI_POLYGON:
        return [p for p in data if p and p[0]], [], []
    out: tuple[list, list, list] = ([], [], [])
    for s in data:
        for a, b in zip(out, _flat(s)):
            a += b
    return out


def _polygon_area(polygon: list) -> float:
    return abs(signed_area(polygon[0])) - sum(abs(signed_area(h)) for h in polygon[1:])


def area(shape: Shape) -> float:
    return float(sum(_polygon_area(p) for p in _flat(shape)[0]))


def _run_length(points: list) -> float:
    return sum(math.sqrt((b[0] - a[0]) ** 2 + (b[1] - a[1]) ** 2) for a, b in zip(points, points[1:]))


def length(shape: Shape) -> float:
    """Of lines, and of all rings of polygons."""
    polygons, lines, _ = _flat(shape)
    return float(sum(_run_length(r) for p in polygons for r in p) + sum(map(_run_length, lines)))


def centroid(shape: Shape) -> tuple[float, float] | None:
    """Of the parts of the highest dimension that have an extent."""
    polygons, lines, points = _flat(shape)
    if polygons:
        x0, y0 = polygons[0][0][0]
        total = cx = cy = 0.0
        for polygon in polygons:
            for i, ring in enumerate(polygon):
                sign = 1.0 if (signed_area(ring) > 0) == (i == 0) else -1.0
                for (xa, ya), (xb, yb) in zip(ring, ring[1:]):
                    twice = sign * ((xa - x0) * (yb - y0) - (xb - x0) * (ya - y0))
                    cx += twice * (x0 + xa + xb)
                    cy += twice * (y0 + ya + yb)
                    total += twice
        if total:
            return cx / 3 / total, cy / 3 / total
        lines = lines + [r for p in polygons for r in p]
    whole = cx = cy = 0.0
    for line in lines:
        for (xa, ya), (xb, yb) in zip(line, line[1:]):
            part = math.sqrt((xb - xa) ** 2 + (yb - ya) ** 2)
            whole += part
            cx += part * (xa + xb) / 2
            cy += part * (ya + yb) / 2
    if whole:
        return cx / whole, cy / whole
    points = points + [line[0] for line in lines]
    if not points:
        return None
    return sum(p[0] for p in points) / len(points), sum(p[1] for p in points) / len(points)


def envelope(shape: Shape) -> tuple[float, float, float, float] | None:
    """(min x, min y, max x, max y)."""
    points = list(vertices(shape))
    if not points:
        return None
    xs, ys = [p[0] for p in points], [p[1] for p in points]
    return min(xs), min(ys), max(xs), max(ys)


def bbox(shape: Shape) -> tuple[tuple[float, float], tuple[float, float]] | None:
    """The least and the greatest corner; None of an empty shape, and of a line along an axis."""
    e = envelope(shape)
    if e is None or (e[0] == e[2]) != (e[1] == e[3]):
        return None
    return (e[0], e[1]), (e[2], e[3])


def tolerance(zoom: int) -> float:
    """Degrees of a pixel of a map of 256 pixels a tile."""
    if zoom < 0:
        raise ValueError("zoom must not be negative")
    return 360.0 / (256.0 * 2.0**zoom)


EQUATOR = 2 * math.pi * 6378137.0


def meter_by_pixel(zoom: int, lat: float) -> float:
    return EQUATOR / 256.0 * math.cos(math.radians(lat)) / 2.0**zoom


def degrees_of_meters(meters: float, lat: float = 0.0) -> float:
    return meters * 360.0 / (EQUATOR * math.cos(math.radians(lat)))
