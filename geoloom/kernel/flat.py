"""Measures of many WKB values at once, in arrays.

``flat_shapes`` finds the rings, lines and points of all values, round by round: the r-th part of every
value that has one. What it does not read - collections, further ordinates, empty or broken shapes - is
left to the functions that take one shape, and so are shapes without an extent where that matters.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa

from geoloom.kernel.shapes import LINE, MULTI_LINE, MULTI_POINT, MULTI_POLYGON, POINT, POLYGON

_SHELL, _HOLE, _RUN, _DOT = range(4)
_FEWEST = {_SHELL: 4, _HOLE: 4, _RUN: 2, _DOT: 1}


@dataclass
class FlatShapes:
    """Vertices end to end, in order; ``part`` and ``shape`` of each, and ``role`` of each part.

    ``kind`` is 0 of values that were not read.
    """

    kind: np.ndarray
    x: np.ndarray
    y: np.ndarray
    part: np.ndarray
    part_shape: np.ndarray
    part_role: np.ndarray
    part_start: np.ndarray

    @property
    def shape(self) -> np.ndarray:
        return self.part_shape[self.part]

    def _edges(self) -> np.ndarray:
        """Numbers of the vertices that have a next one in their part, points left out."""
        inner = np.ones(len(self.part), bool)
        inner[:-1] = self.part[1:] == self.part[:-1]
        inner[-1:] = False
        inner &= self.part_role[self.part] != _DOT
        return np.flatnonzero(inner)

    def _by_shape(self, values: np.ndarray, at: np.ndarray) -> np.ndarray:
        return _sums(self.part_shape[self.part[at]], values, len(self.kind))

    def lengths(self) -> np.ndarray:
        a = self._edges()
        dx, dy = self.x[a + 1] - self.x[a], self.y[a + 1] - self.y[a]
        return self._by_shape(np.sqrt(dx * dx + dy * dy), a)

    def _areal_edges(self) -> np.ndarray:
        a = self._edges()
        return a[self.part_role[self.part[a]] <= _HOLE]

    def _signed(self, a: np.ndarray) -> np.ndarray:
        """Signed area of each part, over the edges ``a``."""
        x0 = self.x[self.part_start[self.part[a]]]
        terms = (self.x[a] - x0) * self.y[a + 1] - (self.x[a + 1] - x0) * self.y[a]
        return _sums(self.part[a], terms, len(self.part_shape)) / 2

    def areas(self) -> np.ndarray:
        own = np.abs(self._signed(self._areal_edges()))
        return _sums(self.part_shape, np.where(self.part_role == _HOLE, -own, own), len(self.kind))

    def centroids(self) -> tuple[np.ndarray, np.ndarray]:
        """(x, y); not a number where a shape has no extent of its dimension."""
        n = len(self.kind)
        cx, cy, weight = np.zeros(n), np.zeros(n), np.zeros(n)
        a = self._areal_edges()
        if len(a):
            of = self.part_shape[self.part[a]]
            first = self.part_start[np.searchsorted(self.part_shape, of, "left")]
            x0, y0 = self.x[first], self.y[first]
            turn = np.where((self._signed(a) > 0) == (self.part_role == _SHELL), 1.0, -1.0)[self.part[a]]
            xa, ya, xb, yb = self.x[a], self.y[a], self.x[a + 1], self.y[a + 1]
            twice = turn * ((xa - x0) * (yb - y0) - (xb - x0) * (ya - y0))
            cx += self._by_shape(twice * (x0 + xa + xb), a)
            cy += self._by_shape(twice * (y0 + ya + yb), a)
            weight += self._by_shape(3 * twice, a)
        a = self._edges()
        a = a[self.part_role[self.part[a]] == _RUN]
        if len(a):
            xa, ya, xb, yb = self.x[a], self.y[a], self.x[a + 1], self.y[a + 1]
            size = np.sqrt((xb - xa) ** 2 + (yb - ya) ** 2)
            cx += self._by_shape(size * (xa + xb) / 2, a)
            cy += self._by_shape(size * (ya + yb) / 2, a)
            weight += self._by_shape(size, a)
        dots = np.flatnonzero(self.part_role[self.part] == _DOT)
        cx += self._by_shape(self.x[dots], dots)
        cy += self._by_shape(self.y[dots], dots)
        weight += self._by_shape(np.ones(len(dots)), dots)
        with np.errstate(all="ignore"):
            return cx / weight, cy / weight

    def boxes(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(min x, min y, max x, max y); not a number of values that were not read."""
        out = [np.full(len(self.kind), np.nan) for _ in range(4)]
        if len(self.x):
            shape = self.shape
            start = np.flatnonzero(np.append(True, shape[1:] != shape[:-1]))
            of = shape[start]
            for i, (values, least) in enumerate(((self.x, np.minimum), (self.y, np.minimum), (self.x, np.maximum), (self.y, np.maximum))):
                out[i][of] = least.reduceat(values, start)
        return tuple(out)

    def vertex_counts(self) -> np.ndarray:
        return np.bincount(self.shape, minlength=len(self.kind))


def _sums(at: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(at, values, n).astype(float)  # of nothing, it would be integers


class _Reader:
    """Parts that are found, and values that cannot be read."""

    def __init__(self, raw: np.ndarray, end: np.ndarray):
        self.raw, self.end = raw, end
        self.words = np.ndarray((max(len(raw) - 3, 0),), "<u4", raw, strides=(1,))
        self.bad = np.zeros(len(end), bool)
        self.parts: list[tuple[np.ndarray, ...]] = []

    def numbers(self, of: np.ndarray, at: np.ndarray, big: np.ndarray) -> np.ndarray:
        """32-bit numbers at byte positions; 0, and the value is bad, where its bytes end before."""
        over = at + 4 > self.end[of]
        self.bad[of[over]] = True
        if not len(self.words):
            return np.zeros(len(at), np.int64)
        found = self.words[np.where(over, 0, at)]
        return np.where(over, 0, np.where(big, found.byteswap(), found)).astype(np.int64)

    def headers(self, of: np.ndarray, at: np.ndarray, big: np.ndarray, kind: int) -> None:
        """Members must have the byte order of the whole and the kind."""
        code = self.numbers(of, at + 1, big)
        self.bad[of[(code != kind) | ((self.raw[np.minimum(at, len(self.raw) - 1)] == 0) != big)]] = True

    def add(self, of: np.ndarray, at: np.ndarray, n: np.ndarray, role: np.ndarray | int, order: np.ndarray | int) -> np.ndarray:
        """Parts of n vertices from the byte ``at`` on; gives where they end."""
        role = np.broadcast_to(role, of.shape)
        fewest = np.array([_FEWEST[r] for r in range(4)])[role]
        self.bad[of[(n < fewest) | (at + 16 * n > self.end[of])]] = True
        self.parts.append((of, at, n, role, np.broadcast_to(order, of.shape)))
        return at + 16 * n


def flat_shapes(values: pa.Array) -> FlatShapes:
    """Of an array of binary values, nulls among them."""
    values = values.cast(pa.binary())
    n = len(values)
    buffers = values.buffers()
    offsets = np.frombuffer(buffers[1], np.int32)[values.offset : values.offset + n + 1].astype(np.int64) if n else np.zeros(1, np.int64)
    raw = np.frombuffer(buffers[2], np.uint8) if n and buffers[2] is not None else np.zeros(0, np.uint8)
    start, end = offsets[:-1], offsets[1:]
    reader = _Reader(raw, end)
    every = np.flatnonzero(end - start >= 9)
    big = np.zeros(n, bool)
    big[every] = raw[start[every]] == 0
    code = np.zeros(n, np.int64)
    code[every] = reader.numbers(every, start[every] + 1, big[every])
    code[(code < POINT) | (code > MULTI_POLYGON)] = 0

    def of_kind(*kinds: int) -> np.ndarray:
        return np.flatnonzero(np.isin(code, kinds))

    at = of_kind(POINT)
    reader.add(at, start[at] + 5, np.ones(len(at), np.int64), _DOT, 0)
    at = of_kind(LINE)
    reader.add(at, start[at] + 9, reader.numbers(at, start[at] + 5, big[at]), _RUN, 0)

    # members or rings that are still to come, and the byte where the next one begins
    left = np.zeros(n, np.int64)
    at = of_kind(POLYGON, MULTI_POINT, MULTI_LINE, MULTI_POLYGON)
    left[at] = reader.numbers(at, start[at] + 5, big[at])
    reader.bad[at[left[at] < 1]] = True
    place, rings = start + 9, np.where(code == POLYGON, left, 0)
    inner = np.zeros(n, bool)  # not the first ring of its polygon
    left[code == POLYGON] = 1
    active = at
    turn = 0
    while len(active := active[~reader.bad[active] & (left[active] > 0)]):
        turn += 1
        dots = active[code[active] == MULTI_POINT]
        reader.headers(dots, place[dots], big[dots], POINT)
        place[dots] = reader.add(dots, place[dots] + 5, np.ones(len(dots), np.int64), _DOT, turn)
        left[dots] -= 1
        runs = active[code[active] == MULTI_LINE]
        reader.headers(runs, place[runs], big[runs], LINE)
        place[runs] = reader.add(runs, place[runs] + 9, reader.numbers(runs, place[runs] + 5, big[runs]), _RUN, turn)
        left[runs] -= 1
        # a polygon of several begins with a header
        fresh = active[(code[active] == MULTI_POLYGON) & (rings[active] == 0)]
        reader.headers(fresh, place[fresh], big[fresh], POLYGON)
        rings[fresh] = reader.numbers(fresh, place[fresh] + 5, big[fresh])
        reader.bad[fresh[rings[fresh] < 1]] = True
        place[fresh] += 9
        inner[fresh] = False
        areal = active[((code[active] == POLYGON) | (code[active] == MULTI_POLYGON)) & ~reader.bad[active]]
        role = np.where(inner[areal], _HOLE, _SHELL)
        place[areal] = reader.add(areal, place[areal] + 4, reader.numbers(areal, place[areal], big[areal]), role, turn)
        inner[areal] = True
        rings[areal] -= 1
        left[areal[rings[areal] == 0]] -= 1
    return _gathered(reader, code, big)


def _gathered(reader: _Reader, code: np.ndarray, big: np.ndarray) -> FlatShapes:
    of, at, count, role, order = (np.concatenate(c) for c in zip(*reader.parts))
    while True:
        kept = ~reader.bad[of]
        of, at, count, role, order = (c[kept] for c in (of, at, count, role, order))
        sort = np.lexsort((order, of))
        of, at, count, role, order = (c[sort] for c in (of, at, count, role, order))
        part = np.repeat(np.arange(len(of)), count)
        upto = np.cumsum(count)
        byte = np.repeat(at, count) + 16 * (np.arange(len(part)) - np.repeat(upto - count, count))
        numbers = np.ndarray((max(len(reader.raw) - 7, 0),), "<f8", reader.raw, strides=(1,))
        swap = big[of][part]

        def read(byte: np.ndarray) -> np.ndarray:
            found = numbers[byte] if len(byte) else np.empty(0)
            return np.where(swap, found.byteswap(), found)

        x, y = read(byte), read(byte + 8)
        first, last = upto - count, upto - 1
        ring = role <= _HOLE
        wrong = np.zeros(len(of), bool)
        if len(of):
            wrong[ring] = (x[first] != x[last])[ring] | (y[first] != y[last])[ring]
            # an empty point is not a number, and nor is what derives from any such ordinate
            odd = ~np.isfinite(x) | ~np.isfinite(y)
            wrong |= np.bincount(part, odd, len(of)) > 0
        if not wrong.any():
            kind = np.where(reader.bad, 0, code)
            return FlatShapes(kind, x, y, part, of, role, first)
        reader.bad[of[wrong]] = True
