"""Cleaning of shapes: doubled vertices, orientation, ring starts, the range of degrees, the dateline.

A polygon's shell runs counterclockwise and its holes clockwise; a shell starts at what was its
second vertex, holes keep their start. What lies beyond longitude 180 is cut off and moved by 360 degrees; each piece then starts
where its ring meets the cut. Latitudes beyond the poles are folded back without moving the
longitude.

ShapeError is raised of shapes with ordinates that are not finite, of shapes over more than
MOST_SHEETS sheets of 360 degrees, and of a polygon to be cut that has a hole outside of its shell.
"""

from __future__ import annotations

import math

from geoloom.kernel.shapes import (
    COLLECTION,
    LINE,
    MULTI_LINE,
    MULTI_POINT,
    MULTI_POLYGON,
    POINT,
    POLYGON,
    Shape,
    ShapeError,
    checked,
)

#: More than the range of any map projection in meters, taken as degrees.
MOST_SHEETS = 1 << 17


def drop_repeats(points: list) -> list:
    """Without vertices equal to the one before them."""
    return [p for i, p in enumerate(points) if not i or p != points[i - 1]]


def dedup(shape: Shape) -> Shape:
    """Without doubled vertices; MultiPoint and MultiLineString stay as they are.

    Raises ShapeError where a line keeps under two vertices, or a ring under four.
    """
    kind, data = shape
    if kind == LINE:
        return checked((kind, drop_repeats(data)))
    if kind == POLYGON:
        return checked((kind, [drop_repeats(r) for r in data]))
    if kind == MULTI_POLYGON:
        return checked((kind, [[drop_repeats(r) for r in p] for p in data]))
    if kind == COLLECTION:
        return kind, [dedup(s) for s in data]
    return shape


def signed_area(ring: list) -> float:
    """Positive if the ring runs counterclockwise."""
    if len(ring) < 3:
        return 0.0
    x0, total = ring[0][0], 0.0
    for (xa, ya), (xb, yb) in zip(ring, ring[1:]):
        total += (xa - x0) * yb - (xb - x0) * ya
    return total / 2


def _centred(v: float) -> float:
    """v modulo 360, over -180 and up to 180."""
    if not math.isfinite(v):
        raise ShapeError(f"an ordinate of {v}")
    r = math.fmod(v, 360.0)
    if r <= 0:
        r += 360.0
    return r - 360.0 if r > 180.0 else r


def wrap_lon(lon: float) -> float:
    return lon if -180.0 <= lon <= 180.0 else _centred(lon)


def fold_lat(lat: float) -> float:
    if -90.0 <= lat <= 90.0:
        return lat
    lat = _centred(lat)
    if lat < -90.0:
        return -180.0 - lat
    return 180.0 - lat if lat > 90.0 else lat


def _wrap(p: tuple) -> tuple:
    return wrap_lon(p[0]), fold_lat(p[1])


def _oriented(ring: list, hole: bool) -> list:
    return ring[::-1] if (signed_area(ring) < 0) != hole else ring


def _sheet(x: float) -> int:
    """Number of the 360-degree sheet; an edge of a sheet belongs to the sheet nearer 0."""
    if -180.0 <= x <= 180.0:
        return 0
    if not math.isfinite(x):
        raise ShapeError(f"an ordinate of {x}")
    return math.ceil((x - 180.0) / 360.0) if x > 0 else math.floor((x + 180.0) / 360.0)


def _cut_parts(rings: list[tuple[list, bool]], edge: float) -> tuple[list, list]:
    """Rings, each with whether it is a hole, on the left and on the right of the line x = edge.

    Runs of vertices on one side end where the ring leaves the side. Sorted by latitude, the
    crossings bound the stretches of the line that lie inside, two by two; so each run goes on at
    the other end of the stretch on which it ends. A ring made of runs is a hole if all of them are
    of holes.
    """
    whole: tuple[list, list] = ([], [])
    crossings: list[float] = []
    runs: tuple[list, list] = ([], [])  # (entry, vertices, exit, hole) with crossing numbers
    for ring, hole in rings:
        # a vertex on the line belongs to the side of its neighbours
        sides = [(x > edge) - (x < edge) for x, _ in ring[:-1]]
        if all(s <= 0 for s in sides):
            whole[0].append((ring, hole))
            continue
        if all(s >= 0 for s in sides):
            whole[1].append((ring, hole))
            continue
        n = len(sides)
        last = next(s for s in reversed(sides) if s)
        for i in range(n):
            if not sides[i]:
                sides[i] = last
            last = sides[i]
        pieces, points = [], []
        start = next(i for i in range(n) if sides[i] != sides[i - 1])
        for k in range(start, start + n):
            i, before = k % n, (k - 1) % n
            if sides[i] != sides[before]:
                (xa, ya), (xb, yb) = ring[before], ring[i]
                y = ya if xa == edge else yb if xb == edge else ya + (yb - ya) * ((edge - xa) / (xb - xa))
                number = len(crossings)
                crossings.append(y)
                if points:
                    pieces[-1][2] = number
                points = []
                pieces.append([number, points, -1, 1 if sides[i] > 0 else 0])
            points.append(ring[i])
        pieces[-1][2] = pieces[0][0]
        for entry, points, leave, side in pieces:
            runs[side].append((entry, points, leave, hole))
    order = sorted(range(len(crossings)), key=lambda c: crossings[c])
    partner = {}
    for a, b in zip(order[0::2], order[1::2]):
        partner[a], partner[b] = b, a
    for side in (0, 1):
        by_entry = {run[0]: run for run in runs[side]}
        while by_entry:
            first = entry = next(iter(by_entry))
            parts = []
            while entry in by_entry:
                parts.append(by_entry.pop(entry))
                entry = partner.get(parts[-1][2], first)
            # begins at the crossing where its last run leaves
            ring = [(edge, crossings[parts[-1][2]])]
            for entry, points, leave, _ in parts:
                ring += [(edge, crossings[entry]), *points, (edge, crossings[leave])]
            ring = drop_repeats(ring)
            if ring[0] != ring[-1]:
                ring.append(ring[0])
            if len(ring) >= 4:
                whole[side].append((ring, all(hole for *_, hole in parts)))
    return whole


def _span(xs: list[float]) -> tuple[int, int]:
    """The first and the last sheet."""
    sheets = [_sheet(x) for x in xs]
    low, high = min(sheets), max(sheets)
    if high - low > MOST_SHEETS:
        raise ShapeError(f"a shape over {high - low} times the range of longitudes")
    return low, high


def _crossed(ring: list, y: float) -> list[float]:
    """Where a ring crosses the latitude y, in order."""
    return sorted(
        xa + (y - ya) * (xb - xa) / (yb - ya) for (xa, ya), (xb, yb) in zip(ring, ring[1:]) if (ya > y) != (yb > y)
    )


def _within(ring: list) -> tuple[float, float]:
    """A point inside of a ring that has an area."""
    ys = sorted({y for _, y in ring})
    low, high = max(zip(ys, ys[1:]), key=lambda pair: pair[1] - pair[0])
    y = low + (high - low) / 2
    xs = _crossed(ring, y)
    left, right = max(zip(xs[0::2], xs[1::2]), key=lambda pair: pair[1] - pair[0])
    return left + (right - left) / 2, y


def _inside(p: tuple, ring: list) -> bool:
    return sum(x > p[0] for x in _crossed(ring, p[1])) % 2 == 1


def _polygon_pieces(polygon: list) -> list[list]:
    """Polygons within the range of degrees."""
    rings = [r for r in polygon if r]
    if not rings:
        return []
    shell = rings[0]
    lons = [x for x, _ in shell]
    if 180.0 < max(lons) - min(lons) < 360.0 and min(lons) < 0 and max(lons) <= 180.0 and signed_area(shell) < 0:
        # runs the short way over the dateline
        rings = [[(x + 360.0 if x < 0 else x, y) for x, y in r] for r in rings]
    rings = [_oriented(r, i > 0) for i, r in enumerate(rings)]
    lower, upper = _span([x for x, _ in rings[0]])
    if lower == upper:
        shell, *holes = [[_wrap(p) for p in r] for r in rings]
        return [[_rotated(shell), *holes]]
    out = []
    rest = [(r, i > 0) for i, r in enumerate(rings)]
    for sheet in range(lower, upper + 1):
        part = rest
        if sheet < upper:
            part, rest = _cut_parts(rest, 180.0 + 360.0 * sheet)
        # a shell that crosses itself may leave pieces that run the other way
        shells = [[_oriented(r, False)] for r, hole in part if not hole or not signed_area(r)]
        for hole in (r for r, hole in part if hole and signed_area(r)):
            p = _within(hole)
            owners = [s for s in shells if _inside(p, s[0])]
            if not owners:
                raise ShapeError("a hole outside of its shell")
            min(owners, key=lambda s: signed_area(s[0])).append(hole)
        # latitudes are folded last: that may turn a ring round
        out += [[[(x - 360.0 * sheet, fold_lat(y)) for x, y in r] for r in s] for s in shells]
    return out


def _rotated(ring: list) -> list:
    return ring[1:] + [ring[1]] if len(ring) > 2 else ring


def _line_pieces(line: list) -> list[list]:
    if not line:
        return []
    low, high = _span([x for x, _ in line])
    if low == high:
        return [[_wrap(p) for p in line]]
    sheets = [_sheet(x) for x, _ in line]
    out, part = [], [(line[0][0] - 360.0 * sheets[0], fold_lat(line[0][1]))]
    for (xa, ya), (xb, yb), sa, sb in zip(line, line[1:], sheets, sheets[1:]):
        step = 1 if sb > sa else -1
        for sheet in range(sa, sb, step):
            edge = 360.0 * sheet + 180.0 * step
            y = fold_lat(ya + (yb - ya) * ((edge - xa) / (xb - xa)))
            part.append((180.0 * step, y))
            out.append(drop_repeats(part))
            part = [(-180.0 * step, y)]
        part.append((xb - 360.0 * sb, fold_lat(yb)))
    out.append(drop_repeats(part))
    return [p for p in out if len(p) > 1]


def normalize(shape: Shape) -> Shape:
    """The clean shape; a single piece comes out as a single Polygon or LineString."""
    kind, data = shape
    if kind == POINT:
        return kind, _wrap(data) if data is not None else None
    if kind == MULTI_POINT:
        return kind, [_wrap(p) for p in data]
    if kind == COLLECTION:
        return kind, [normalize(s) for s in data]
    polygonal = kind in (POLYGON, MULTI_POLYGON)
    single, multi, cut = (POLYGON, MULTI_POLYGON, _polygon_pieces) if polygonal else (LINE, MULTI_LINE, _line_pieces)
    members = [data] if kind == single else data
    pieces = [piece for m in members for piece in cut(m)]
    if len(pieces) == 1:
        return single, pieces[0]
    return (multi, pieces) if pieces or kind == multi else (single, [])
