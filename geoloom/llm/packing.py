"""Filling containers of a fixed capacity with items of varying size.

The plan is made on the histogram of sizes, whose length is the capacity and not the number of
items. Sizes are taken from the largest down. The gap that a size leaves is looked up among the
sizes, the sums of two sizes and the sums of three sizes that are still there: a combination that
fills it exactly is consumed as often as its members last. What no combination fills takes the
largest size that fits (best fit) and looks its smaller gap up again. The result is a list of
patterns, each with the number of containers that have it.

Items then find their place without meeting each other: the r-th item of a size goes to the pattern
whose range of that size holds r. Ranks are counted within groups of (size, part of the rows), of which
there are the more the more items there are, so no size, however common, is ranked by one task; the
ranks at which the groups begin are summed over the groups' counts and joined where the groups are.
The parts depend on the items alone, so the result does not depend on a session's settings.

Defined results
    null sizes       counted as 0
    size 0           takes no room: container 0, with what else is in there
    size > capacity  split into pieces of the capacity and a last one of the rest, numbered from 0
    ties             items of one size are ranked by part (a hash of their id), then by id
    repeated ids     an item each
    empty table      an empty result
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from geoloom.plans.lineage import cut

#: Items in a part on average, and the least number of parts.
PART_ITEMS, LEAST_PARTS = 1 << 14, 16


@dataclass
class Pattern:
    """Sizes that share a container, and the number of containers."""

    sizes: tuple[int, ...]
    times: int


class _Stock:
    """Sizes that are left, with indexes of the sums of two and of three of them.

    An index may say yes of sums whose sizes are used up; it is made anew after some misses.
    """

    def __init__(self, counts: np.ndarray):
        self.left = counts.astype(np.int64).copy()
        self.left[0] = 0
        self._index()

    def _index(self) -> None:
        there = self.left > 0
        n = 1 << int(2 * len(there) - 1).bit_length()

        def sums(a: np.ndarray, b: np.ndarray) -> np.ndarray:
            """Whether there are members of a and b with a sum, for each sum."""
            return np.fft.irfft(np.fft.rfft(a.astype(float), n) * np.fft.rfft(b.astype(float), n), n)[: len(there)] > 0.5

        self.pairs = sums(there, there)
        self.triples = sums(there, self.pairs)
        self.misses = 0

    def single(self, gap: int) -> tuple[int, ...] | None:
        return (gap,) if self.left[gap] > 0 else None

    def pair(self, gap: int, for_good: bool = True) -> tuple[int, ...] | None:
        """``for_good``: whether the sizes left now are all there will be."""
        if not self.pairs[gap]:
            return None
        larger = self.left[(gap + 1) // 2 : gap]
        smaller = self.left[1 : gap // 2 + 1][::-1]
        ok = (larger > 0) & (smaller > 0)
        if gap % 2 == 0:
            ok[0] = larger[0] > 1
        hit = np.flatnonzero(ok)
        if len(hit):
            a = (gap + 1) // 2 + int(hit[-1])
            return (a, gap - a)
        if for_good:
            self.pairs[gap] = False
            self._missed()
        return None

    def triple(self, gap: int) -> tuple[int, ...] | None:
        if not self.triples[gap]:
            return None
        first = np.flatnonzero((self.left[1 : gap - 1] > 0) & self.pairs[2:gap][::-1]) + 1
        for a in first[::-1].tolist():
            found = self.pair(gap - a)
            if found and self.left[a] <= found.count(a):
                # the pair took up the last of this size
                self.left[a] -= 1
                found = self.pair(gap - a, for_good=False)
                self.left[a] += 1
            if found:
                return (a, *found)
        self.triples[gap] = False
        self._missed()
        return None

    def _missed(self) -> None:
        self.misses += 1
        if self.misses == 256:
            self._index()


def plan(counts: np.ndarray, capacity: int) -> list[Pattern]:
    """Patterns that hold ``counts[s]`` items of each size s from 1 to ``capacity``."""
    stock, out = _Stock(counts), []
    left = stock.left
    for size in range(capacity, 0, -1):
        while left[size]:
            sizes, gap = [size], capacity - size
            left[size] -= 1
            while gap:
                found = stock.single(gap) or stock.pair(gap) or stock.triple(gap)
                if found:
                    sizes += found
                    for s in found:
                        left[s] -= 1
                    break
                below = np.flatnonzero(left[1 : gap + 1])
                if not len(below):
                    break
                best = int(below[-1]) + 1
                sizes.append(best)
                left[best] -= 1
                gap -= best
            kind, needs = np.unique(sizes, return_counts=True)
            more = int((left[kind] // needs).min())
            left[kind] -= more * needs
            out.append(Pattern(tuple(sizes), 1 + more))
    return out


def ranges(patterns: list[Pattern]) -> dict[str, np.ndarray]:
    """For each size of a pattern: the ranks it holds, its first container, items a container, room used."""
    rows, taken, first = [], {}, 0
    for p in patterns:
        kind, needs = np.unique(p.sizes, return_counts=True)
        used = int(sum(p.sizes))
        for size, each in zip(kind.tolist(), needs.tolist()):
            start = taken.get(size, 0)
            taken[size] = start + each * p.times
            rows.append((size, start, taken[size], first, each, used))
        first += p.times
    names = ("size", "from_rank", "to_rank", "container", "each", "used")
    return {n: np.array([r[i] for r in rows], np.int64) for i, n in enumerate(names)}


def _pieces(items: DataFrame, capacity: int) -> DataFrame:
    """(id, piece, size): items over the capacity in pieces."""
    size = F.greatest(F.coalesce("size", F.lit(0)), F.lit(0)).cast("long")
    rows = items.select("id", size.alias("whole"))
    last = F.greatest(F.ceil(F.col("whole") / capacity) - 1, F.lit(0)).cast("int")
    rows = rows.select("id", "whole", F.explode(F.sequence(F.lit(0), last)).alias("piece"))
    return rows.select("id", "piece", F.least(F.lit(capacity), F.col("whole") - F.col("piece").cast("long") * capacity).cast("int").alias("size"))


class _Ranges:
    """Finds the container, and the room used there, of a size and a rank."""

    def __init__(self, patterns: list[Pattern], capacity: int):
        table = ranges(patterns)
        order = np.lexsort((table["from_rank"], table["size"]))
        self.size, self.from_rank, self.container, self.each, self.used = (
            table[n][order] for n in ("size", "from_rank", "container", "each", "used")
        )
        # the ranks of all sizes on one axis
        held = np.zeros(capacity + 2, np.int64)
        np.maximum.at(held, table["size"] + 1, table["to_rank"])
        self.base = np.cumsum(held)
        self.starts = self.base[self.size] + self.from_rank

    def find(self, size: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.searchsorted(self.starts, self.base[size] + rank, "right") - 1
        return self.container[at] + (rank - self.from_rank[at]) // self.each[at], self.used[at]


_PLACE = pa.struct([("container", pa.int64()), ("used", pa.int64())])


def pack(items: DataFrame, capacity: int) -> DataFrame:
    """(id, piece, size, container, used) for (id, size) rows; ``used`` is the room used in the container.

    The driver holds the number of items of each size, and the plan, which has at most a few ranges
    for each size: both are bounded by the capacity, whatever the number of items.
    """
    if capacity < 1:
        raise ValueError("capacity must be at least 1")
    items = cut(items.select("id", "size"))
    return _pack(items, capacity, *_pieces_of(items, [capacity]))


def _pieces_of(items: DataFrame, capacities: list[int]) -> list[int]:
    """The number of pieces for each capacity."""
    size = F.greatest(F.coalesce("size", F.lit(0)), F.lit(0))
    sums = [F.sum(F.greatest(F.ceil(size / c), F.lit(1))).alias(f"n{i}") for i, c in enumerate(capacities)]
    return [n or 0 for n in items.agg(*sums).first()]


def _pack(items: DataFrame, capacity: int, pieces: int) -> DataFrame:
    parts = max(LEAST_PARTS, 1 << (pieces // PART_ITEMS).bit_length())
    rows = _pieces(items, capacity).withColumn("part", F.pmod(F.xxhash64("id", "piece"), F.lit(parts)).cast("int"))
    some = rows.where("size > 0")
    held = some.groupBy("size", "part").agg(F.count(F.lit(1)).alias("n"))
    counts = np.zeros(capacity + 1, np.int64)
    for size, n in some.groupBy("size").count().collect():  # at most ``capacity`` rows
        counts[size] = n
    patterns = plan(counts, capacity)
    sent = items.sparkSession.sparkContext.broadcast(_Ranges(patterns, capacity))
    first_used = sum(patterns[0].sizes) if patterns else 0

    def place(size: pa.Array, rank: pa.Array) -> pa.Array:
        container, used = sent.value.find(size.to_numpy(), rank.to_numpy())
        return pa.StructArray.from_arrays([pa.array(container), pa.array(used)], fields=list(_PLACE))

    upto = Window.partitionBy("size").orderBy("part").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    begins = held.select("size", "part", (F.sum("n").over(upto) - F.col("n")).alias("before"))
    within = Window.partitionBy("size", "part").orderBy("id", "piece")
    ranked = some.withColumn("n", F.row_number().over(within) - 1).join(begins, ["size", "part"])
    at = F.arrow_udf(place, "struct<container:bigint,used:bigint>")(F.col("size").cast("long"), F.col("before") + F.col("n"))
    placed = ranked.withColumn("at", at).select("id", "piece", "size", "at.container", "at.used")
    nothing = rows.where("size = 0").select("id", "piece", "size", F.lit(0).cast("long").alias("container"), F.lit(first_used).cast("long").alias("used"))
    return placed.union(nothing)


def pack_all(items: DataFrame, capacities: DataFrame, kind: str, capacity: str) -> DataFrame:
    """``pack`` for each row of a small table of capacities, with its ``kind``; null capacities are left out."""
    items = cut(items.select("id", "size"))
    out = None
    kinds = capacities.where(F.col(capacity) > 0).select(kind, capacity).distinct().orderBy(kind, capacity).collect()
    for row, n in zip(kinds, _pieces_of(items, [int(row[capacity]) for row in kinds]) if kinds else ()):
        one = _pack(items, int(row[capacity]), n)
        one = one.select(F.lit(row[kind]).alias(kind), F.lit(int(row[capacity])).alias(capacity), *one.columns)
        out = one if out is None else out.union(one)
    if out is None:
        id_type = items.schema["id"].dataType
        schema = T.StructType([T.StructField(kind, T.StringType()), T.StructField(capacity, T.IntegerType()), T.StructField("id", id_type)])
        for name, t in (("piece", T.IntegerType()), ("size", T.IntegerType()), ("container", T.LongType()), ("used", T.LongType())):
            schema = schema.add(name, t)
        return items.sparkSession.createDataFrame([], schema)
    return out
