"""Simplification of shapes: Douglas-Peucker, and a variant that keeps the topology.

Both keep a vertex if it lies further than the tolerance from the segment between the vertices kept
around it. The first drops rings that end with under four vertices, and what consists of them; the
second never lets a ring or closed line fall under four vertices, nor a new segment cross another
one, nor another line come to lie on its other side. Ring ends stay, unless ``free_ends`` is set:
then the vertex at which a ring begins and ends goes too where it is within the tolerance of its
neighbours' segment. Invalid results are not repaired.
"""

from __future__ import annotations

import math

import numpy as np

from geoloom.kernel.shapes import (
    COLLECTION,
    LINE,
    MULTI_LINE,
    MULTI_POINT,
    MULTI_POLYGON,
    POINT,
    POLYGON,
    Shape,
    is_empty,
    vertices,
)

ALGORITHMS = ("DOUGLAS_PEUCKER", "TOPOLOGY_PRESERVING")


#: Up to so many vertices or segments, plain loops are faster than arrays.
SMALL = 48


def _furthest_of_few(points: list, i: int, j: int) -> tuple[int, float]:
    ax, ay = points[i]
    bx, by = points[j]
    dx, dy = bx - ax, by - ay
    whole = dx * dx + dy * dy
    root = math.sqrt(whole)
    best, furthest = -1.0, i
    for k in range(i + 1, j):
        px, py = points[k]
        ux, uy = px - ax, py - ay
        t = ux * dx + uy * dy
        if t <= 0 or not whole:
            d = math.sqrt(ux * ux + uy * uy)
        elif t / whole >= 1:
            ux, uy = px - bx, py - by
            d = math.sqrt(ux * ux + uy * uy)
        else:
            d = abs(uy * dx - ux * dy) / root
        if d > best:
            best, furthest = d, k
    return furthest, best


class _Line:
    """A line's vertices; as arrays too, once that pays."""

    def __init__(self, points: list):
        self.points = points
        self.arrays = np.array(points, float).T if len(points) > SMALL else None

    def furthest(self, i: int, j: int) -> tuple[int, float]:
        """The vertex between i and j that is furthest from their segment, and its distance."""
        if j - i <= SMALL:
            return _furthest_of_few(self.points, i, j)
        xs, ys = self.arrays
        px, py = xs[i + 1 : j], ys[i + 1 : j]
        ax, ay = xs[i], ys[i]
        dx, dy = xs[j] - ax, ys[j] - ay
        whole = dx * dx + dy * dy
        ux, uy = px - ax, py - ay
        if whole:
            t = (ux * dx + uy * dy) / whole
            # beyond the ends the end itself is nearest; between them the line is
            d = np.where(
                t <= 0,
                np.sqrt(ux * ux + uy * uy),
                np.where(t >= 1, np.sqrt((px - xs[j]) ** 2 + (py - ys[j]) ** 2), np.abs(uy * dx - ux * dy) / np.sqrt(whole)),
            )
        else:
            d = np.sqrt(ux * ux + uy * uy)
        best = int(d.argmax())
        return i + 1 + best, float(d[best])


def _distance(p: tuple, a: tuple, b: tuple) -> float:
    """Of p from the segment ab."""
    return _furthest_of_few([a, p, b], 0, 2)[1]


def reduce_ring(points: list, tolerance: float) -> list:
    """Douglas-Peucker; the vertex at the ends is one like the others."""
    ring = reduce_line(points, tolerance)
    if len(ring) < 4 or ring[0] != ring[-1] or _distance(ring[0], ring[1], ring[-2]) > tolerance:
        return ring
    return [*ring[1:-1], ring[1]]


def reduce_line(points: list, tolerance: float) -> list:
    """Douglas-Peucker; the ends stay."""
    n = len(points)
    if n < 3:
        return list(points)
    line = _Line(points)
    keep = [False] * n
    keep[0] = keep[-1] = True
    stack = [(0, n - 1)]
    while stack:
        i, j = stack.pop()
        if i + 1 >= j:
            continue
        k, d = line.furthest(i, j)
        if d > tolerance:
            keep[k] = True
            stack += [(i, k), (k, j)]
    return [p for p, kept in zip(points, keep) if kept]


def _turn(ax, ay, bx, by, cx, cy):
    return np.sign((bx - ax) * (cy - ay) - (by - ay) * (cx - ax))


def _meets_inside(segments: np.ndarray, a: tuple, b: tuple) -> np.ndarray:
    """Whether segments (x0, y0, x1, y1) meet ab at a point that is no end of one of the two."""
    x0, y0, x1, y1 = segments.T
    near = (
        (np.minimum(x0, x1) <= max(a[0], b[0]))
        & (np.maximum(x0, x1) >= min(a[0], b[0]))
        & (np.minimum(y0, y1) <= max(a[1], b[1]))
        & (np.maximum(y0, y1) >= min(a[1], b[1]))
    )
    out = np.zeros(len(segments), bool)
    at = np.flatnonzero(near)
    if not len(at):
        return out
    x0, y0, x1, y1 = segments[at].T
    d1, d2 = _turn(a[0], a[1], b[0], b[1], x0, y0), _turn(a[0], a[1], b[0], b[1], x1, y1)
    d3, d4 = _turn(x0, y0, x1, y1, a[0], a[1]), _turn(x0, y0, x1, y1, b[0], b[1])
    apart = (d1 * d2 > 0) | (d3 * d4 > 0)
    proper = (d1 * d2 < 0) & (d3 * d4 < 0)

    def touches(side, px, py, qx0, qy0, qx1, qy1):
        """p lies on q and is not an end of q."""
        within = (
            (px >= np.minimum(qx0, qx1)) & (px <= np.maximum(qx0, qx1)) & (py >= np.minimum(qy0, qy1)) & (py <= np.maximum(qy0, qy1))
        )
        ends = ((px == qx0) & (py == qy0)) | ((px == qx1) & (py == qy1))
        return (side == 0) & within & ~ends

    inner = touches(d1, x0, y0, a[0], a[1], b[0], b[1]) | touches(d2, x1, y1, a[0], a[1], b[0], b[1])
    inner |= touches(d3, a[0], a[1], x0, y0, x1, y1) | touches(d4, b[0], b[1], x0, y0, x1, y1)
    out[at] = (proper | inner) & ~apart
    return out


def _one_meets_inside(s: tuple, a: tuple, b: tuple) -> bool:
    """``_meets_inside`` of one segment."""
    x0, y0, x1, y1 = s
    ax, ay = a
    bx, by = b
    if (x0 if x0 < x1 else x1) > (ax if ax > bx else bx) or (x0 if x0 > x1 else x1) < (ax if ax < bx else bx):
        return False
    if (y0 if y0 < y1 else y1) > (ay if ay > by else by) or (y0 if y0 > y1 else y1) < (ay if ay < by else by):
        return False
    d1 = (bx - ax) * (y0 - ay) - (by - ay) * (x0 - ax)
    d2 = (bx - ax) * (y1 - ay) - (by - ay) * (x1 - ax)
    if (d1 > 0 and d2 > 0) or (d1 < 0 and d2 < 0):
        return False
    d3 = (x1 - x0) * (ay - y0) - (y1 - y0) * (ax - x0)
    d4 = (x1 - x0) * (by - y0) - (y1 - y0) * (bx - x0)
    if (d3 > 0 and d4 > 0) or (d3 < 0 and d4 < 0):
        return False
    if d1 and d2 and d3 and d4:
        return True

    def touches(side: float, px: float, py: float, q: tuple) -> bool:
        if side:
            return False
        qx0, qy0, qx1, qy1 = q
        within = min(qx0, qx1) <= px <= max(qx0, qx1) and min(qy0, qy1) <= py <= max(qy0, qy1)
        return within and (px, py) != (qx0, qy0) and (px, py) != (qx1, qy1)

    ab = (ax, ay, bx, by)
    return touches(d1, x0, y0, ab) or touches(d2, x1, y1, ab) or touches(d3, ax, ay, s) or touches(d4, bx, by, s)


def _odd_crossings(p: tuple, points: list) -> bool:
    """Whether a ray to the east from p meets the line an odd number of times."""
    x, y = p
    odd = False
    for (xa, ya), (xb, yb) in zip(points, points[1:]):
        if (ya > y) != (yb > y) and x < xa + (y - ya) * (xb - xa) / (yb - ya):
            odd = not odd
    return odd


class _Network:
    """The lines of a shape while they are simplified together."""

    def __init__(self, lines: list[tuple[list, bool]], tolerance: float, free_ends: bool):
        self.tolerance = tolerance
        self.free_ends = free_ends
        self.lines, self.is_ring = [line for line, _ in lines], [ring for _, ring in lines]
        lines = self.lines
        # lines do not cross, so one vertex tells on which side of a segment a line lies
        self.marks = [line[min(1, len(line) - 1)] if line else None for line in lines]
        # segments of all lines end to end; those that were flattened are no longer looked at
        flat = [(*p, *q) for line in lines for p, q in zip(line, line[1:])]
        self.first = [0]
        for line in lines:
            self.first.append(self.first[-1] + max(len(line) - 1, 0))
        self.few = len(flat) <= SMALL
        self.segments = flat if self.few else np.array(flat, float)
        self.open = [True] * len(flat) if self.few else np.ones(len(flat), bool)
        self.made: list[tuple] = []

    def _jumps(self, line: int, section: list) -> bool:
        """Whether another line is between a section and the segment of its ends."""
        if len(self.marks) == 1:
            return False
        xs, ys = [x for x, _ in section], [y for _, y in section]
        west, east, south, north = min(xs), max(xs), min(ys), max(ys)
        round_it = [*section, section[0]]
        return any(
            west <= p[0] <= east and south <= p[1] <= north and _odd_crossings(p, round_it)
            for n, p in enumerate(self.marks)
            if n != line and p is not None
        )

    def _crosses(self, a: tuple, b: tuple, low: int, high: int) -> bool:
        """Whether ab meets a segment, those from low to high left out."""
        if self.few:
            return any(_one_meets_inside(s, a, b) for s in self.made) or any(
                _one_meets_inside(s, a, b) for n, s in enumerate(self.segments) if self.open[n] and not low <= n < high
            )
        if self.made and _meets_inside(np.array(self.made), a, b).any():
            return True
        hit = _meets_inside(self.segments, a, b) & self.open
        hit[low:high] = False
        return bool(hit.any())

    def reduce(self, line: int) -> list:
        points = self.lines[line]
        n = len(points)
        if n < 3:
            return list(points)
        own = _Line(points)
        least = 4 if points[0] == points[-1] else 2
        kept = [0]
        stack = [(0, n - 1, 1)]
        while stack:
            i, j, depth = stack.pop()
            if i + 1 == j:
                kept.append(j)
                continue
            k, d = own.furthest(i, j)
            size = len(kept) if len(kept) > 1 else 0
            low, high = self.first[line] + i, self.first[line] + j
            flat = d <= self.tolerance and not (size < least and depth + 1 < least)
            flat = flat and not self._crosses(points[i], points[j], low, high) and not self._jumps(line, points[i : j + 1])
            if flat:
                self.open[low:high] = [False] * (high - low)
                self.made.append((*points[i], *points[j]))
                kept.append(j)
            else:
                stack += [(k, j, depth + 1), (i, k, depth + 1)]
        out = [points[i] for i in kept]
        if self.free_ends and self.is_ring[line] and len(out) > least and out[0] == out[-1]:
            a, end, b = out[-2], out[0], out[1]
            turn = (end[0] - a[0]) * (b[1] - a[1]) - (end[1] - a[1]) * (b[0] - a[0])
            if _distance(end, a, b) <= self.tolerance and (
                not turn or not self._crosses(a, b, 0, 0) and not self._jumps(line, [a, end, b])
            ):
                out = [a, *out[1:-1]]
        return out


def _lines_of(shape: Shape) -> list[tuple[list, bool]]:
    """Lines and rings of a shape, and whether they are rings."""
    kind, data = shape
    if kind == LINE:
        return [(data, False)]
    if kind in (POLYGON, MULTI_LINE):
        return [(d, kind == POLYGON) for d in data]
    if kind == MULTI_POLYGON:
        return [(r, True) for p in data for r in p]
    if kind == COLLECTION:
        return [line for s in data for line in _lines_of(s)]
    return []


def _rebuilt(shape: Shape, run, drop: bool) -> Shape:
    """``shape`` with each line replaced by run(line, whether it is a ring); short rings go if ``drop`` is set."""
    kind, data = shape
    if kind == POINT:
        return shape
    if kind == MULTI_POINT:
        return (POINT, data[0]) if len(data) == 1 else shape
    if kind == LINE:
        return kind, run(data, False) if data else []
    if kind == COLLECTION:
        members = [_rebuilt(s, run, drop) for s in data]
        return kind, [s for s in members if not is_empty(s)]

    def polygon(rings: list) -> list:
        out = []
        for i, r in enumerate(rings):
            new = run(r, True)
            if drop and len(new) < 4:
                if i == 0:
                    return []
                continue
            out.append(new)
        return out

    if kind == POLYGON:
        return kind, polygon(data) if data else []
    single = LINE if kind == MULTI_LINE else POLYGON
    members = [run(d, False) if kind == MULTI_LINE else polygon(d) for d in data if d]
    members = [m for m in members if m]
    return (single, members[0]) if len(members) == 1 else (kind, members)


def simplify(shape: Shape, tolerance: float, algorithm: str, free_ends: bool = False) -> Shape:
    """The simplified shape, which may be empty under DOUGLAS_PEUCKER."""
    if algorithm == "DOUGLAS_PEUCKER":
        of_ring = reduce_ring if free_ends else reduce_line
        return _rebuilt(shape, lambda line, ring: (of_ring if ring else reduce_line)(line, tolerance), True)
    if algorithm != "TOPOLOGY_PRESERVING":
        raise ValueError(f"algorithm: {algorithm}")
    network = _Network(_lines_of(shape), tolerance, free_ends)
    done = iter([network.reduce(i) for i in range(len(network.lines))])
    return _rebuilt(shape, lambda line, ring: next(done), False)


def simplify_or_point(shape: Shape, tolerance: float, algorithm: str) -> tuple[Shape, bool]:
    """The simplified shape; where nothing is left of it, its first vertex, and True."""
    small = simplify(shape, tolerance, algorithm)
    if not is_empty(small):
        return small, False
    return (POINT, next(vertices(shape), None)), True
