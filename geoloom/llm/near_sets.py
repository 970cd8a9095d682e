"""Near-duplicates among sets of tokens, found exactly without comparing all pairs.

Two sets of sizes s >= b with Jaccard similarity t or more differ in at most
H = (s + b)(1 - t)/(1 + t) tokens. The universe of tokens is hashed into m segments, m fixed for each
band of sizes. If a set spends more than H units over the segments - one on a segment for which it
looks up equal segments, two on one for which it also looks up segments that differ by one token -
then at least one look-up meets every partner (pigeonhole). The index holds each segment and each
segment less one token. Which segments get units is decided by cost: a sketch of how often each
signature is in the index is sent to all tasks, and the cheapest units are taken. A look-up of which
the sketch says that it meets nothing but the set itself counts as a unit, but is not made; nor are
index entries made that no look-up can meet, as a bitmap of the look-ups' cells tells. So what is
shuffled is little more than what may match. Candidates are verified on the whole sets.

Equal sets are one class from the start, so copies cost nothing. Sets are told apart by a digest of
128 bits, so tokens are moved once to make the classes and once with each candidate; the classes stay
where they are while candidates come to them.

The sketch has four to eight cells a token, MOST_CELLS cells of a byte at most, the bitmap a bit a
cell: that is what is broadcast. From about two million sets of 40 tokens on, cells are shared by
signatures of chance, and less can be left out: up to about as many rows of 32 bytes a set as it has
tokens and look-ups. Heavy signatures stand out from any load, so they are still avoided, and the
number of rows stays in proportion to the data. Signatures and classes that hold much are split over
tasks.

A segment's hash is the sum of its tokens' hashes, so all of this is array arithmetic. Empty segments
are neither indexed nor looked up, and a segment of one token gets one unit at most; the few sets
that cannot place enough units so look up single tokens instead: the rarest, as many as are sure to
meet each partner, among sets of the sizes that partners may have.

Defined results
    null sets, empty sets    in no class and no link
    repeated tokens          count once
    ties                     a pair at the threshold is linked; a class is named after its least id
    repeated ids             the same set: one member; different sets: a member of each class, or,
                             with ``one_set``, of the class of the least weight and digest
    very long sets           as any other; bands follow the sizes without end
    empty table              empty results
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from geoloom.llm import sketches
from geoloom.operators.balance import join_balanced, plan_load, tasks_for
from geoloom.plans.lineage import cut

#: Bounds of the number of cells of the sketch, at a byte each.
LEAST_CELLS, MOST_CELLS = 1 << 16, 1 << 26
#: Sets in a task while they are made, and rows up to which a side is sent to every task.
LEAST_SETS, MOST_BROADCAST = 2000, 100_000
_BAND_RATIO = 1.2
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x.astype(np.uint64) + np.uint64(salt)) * _MULTIPLIER
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


@dataclass(frozen=True)
class Bands:
    """Bands of set sizes up to ``largest``, and what a threshold asks of them."""

    threshold: float
    largest: int

    @property
    def lows(self) -> np.ndarray:
        lows = [1]
        while lows[-1] <= self.largest:
            lows.append(max(lows[-1] + 1, math.ceil(lows[-1] * _BAND_RATIO)))
        return np.array(lows)

    def differ(self, total: np.ndarray) -> np.ndarray:
        """Most tokens in which sets of sizes that sum to ``total`` may differ."""
        t = self.threshold
        return np.floor(total * ((1 - t) / (1 + t)) + 1e-9).astype(np.int64)


class _Segments:
    """Segments of a batch of sets, each set taken as of one band."""

    def __init__(self, tokens: np.ndarray, owner: np.ndarray, band: np.ndarray, bands: Bands):
        lows = bands.lows
        highs = lows[band + 1] - 1
        m = bands.differ(2 * highs) + 1
        h = _mix(tokens)
        segment = (_mix(tokens, 7) % m[owner].astype(np.uint64)).astype(np.int64)
        order = np.lexsort((segment, owner))
        self.h, seg, own = h[order], segment[order], owner[order]
        new = np.ones(len(own), bool)
        new[1:] = (own[1:] != own[:-1]) | (seg[1:] != seg[:-1])
        start = np.flatnonzero(new)
        self.of = np.cumsum(new) - 1  # segment of each token
        self.owner = own[start]
        self.size = np.diff(np.append(start, len(own)))
        with np.errstate(over="ignore"):
            total = np.add.reduceat(self.h, start) if len(start) else self.h
            self.salt = _mix(band[self.owner].astype(np.uint64) * np.uint64(1 << 20) + seg[start].astype(np.uint64), 3)
            less = total[self.of] - self.h
        self.equal = self._key(total, self.salt, 1)  # the segment among segments
        self.within = self._key(total, self.salt, 2)  # the segment among segments less one token
        self.less_equal = self._key(less, self.salt[self.of], 1)  # less one token, among segments
        self.less_within = self._key(less, self.salt[self.of], 2)  # less one token, for the index
        self.shrinks = self.size[self.of] > 1

    @staticmethod
    def _key(content: np.ndarray, salt: np.ndarray, kind: int) -> np.ndarray:
        with np.errstate(over="ignore"):
            return _mix(content + salt * np.uint64(3), kind)


#: Tokens that a task works on at once; a larger set is a part of its own.
PART_TOKENS = 1 << 20


@dataclass
class _Part:
    """Sets of a batch: ids, what is known of them as one number, sizes, and the tokens end to end."""

    ids: np.ndarray
    info: np.ndarray
    sizes: np.ndarray
    tokens: np.ndarray

    def rows(self, sig: np.ndarray, at: np.ndarray, known: np.ndarray | None = None) -> pa.RecordBatch:
        """A row for each signature, with what is known of the set ``at`` which it belongs."""
        made = pa.array(sig.view(np.int64), mask=None if known is None else ~known)
        return pa.RecordBatch.from_arrays([made, pa.array(self.ids[at]), pa.array(self.info[at])], ["sig", "cid", "info"])


_ROW = "sig long, cid long, info long"


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[_Part]:
    """Batches of (cid, info, tokens) in parts of PART_TOKENS tokens at most."""
    for batch in batches:
        ids, info = (batch.column(i).to_numpy() for i in range(2))
        lists = batch.column(2)
        upto = lists.offsets.to_numpy().astype(np.int64)
        tokens = lists.values.to_numpy()
        at = 0
        while at < len(ids):
            to = max(at + 1, int(np.searchsorted(upto, upto[at] + PART_TOKENS, "right")) - 1)
            yield _Part(ids[at:to], info[at:to], np.diff(upto[at : to + 1]), tokens[upto[at] : upto[to]])
            at = to


def _entries(part: _Part, bands: Bands) -> tuple[np.ndarray, np.ndarray]:
    """Signatures of the index, and the positions of the sets that they belong to."""
    owner = np.repeat(np.arange(len(part.ids)), part.sizes)
    s = _Segments(part.tokens, owner, np.searchsorted(bands.lows, part.sizes, "right") - 1, bands)
    return np.concatenate([s.equal, s.less_within[s.shrinks]]), np.concatenate([s.owner, s.owner[s.of[s.shrinks]]])


def _cells(sig: np.ndarray, cells: int) -> np.ndarray:
    return (sig & np.uint64(cells - 1)).astype(np.int64)


#: Counts up to EXACT stand for themselves, larger ones for eighths of powers of two.
EXACT = 64
_COUNTS = np.append(np.arange(EXACT), np.round(EXACT * 2 ** (np.arange(256 - EXACT) / 8)).astype(np.int64))


def _codes(counts: np.ndarray) -> np.ndarray:
    """A byte for each count; those of counts above what a byte can say are the largest."""
    return (np.searchsorted(_COUNTS, counts, "right") - 1).astype(np.uint8)


def _bits(counts: np.ndarray) -> np.ndarray:
    return np.packbits(counts > 0, bitorder="little")


#: Signatures that a task holds before it sends their counts.
HELD = 1 << 23


def _counts_of(cells: Iterator[np.ndarray]) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for cell in cells:
        held.append(cell)
        size += len(cell)
        if size > HELD:
            yield from sketches.sparse_blocks(np.concatenate(held))
            held, size = [], 0
    if size:
        yield from sketches.sparse_blocks(np.concatenate(held))


def _count(batches: Iterator[pa.RecordBatch], bands: Bands, cells: int) -> Iterator[pa.RecordBatch]:
    """One task's counts of the index."""
    return _counts_of(_cells(_entries(part, bands)[0], cells) for part in _parts(batches))


def _index(batches: Iterator[pa.RecordBatch], bands: Bands, cells: int, wanted) -> Iterator[pa.RecordBatch]:
    """The index, without what lies in cells that nothing looks up."""
    bits = wanted.value
    for part in _parts(batches):
        sig, at = _entries(part, bands)
        cell = _cells(sig, cells)
        met = np.flatnonzero((bits[cell >> 3] >> (cell & 7).astype(np.uint8)) & 1)
        yield part.rows(sig[met], at[met])


def _look_up(batches: Iterator[pa.RecordBatch], bands: Bands, sketch) -> Iterator[pa.RecordBatch]:
    """Signatures that each set looks up; sets that cannot place their units come with a null."""
    codes = sketch.value
    n_cells = len(codes)
    count = lambda sig: _COUNTS[codes[_cells(sig, n_cells)]]
    lows, t = bands.lows, bands.threshold
    for part in _parts(batches):
        sizes, tokens = part.sizes, part.tokens
        starts = np.cumsum(sizes) - sizes
        own_band = np.searchsorted(lows, sizes, "right") - 1
        least_band = np.searchsorted(lows, np.maximum(1, np.ceil(t * sizes - 1e-9)), "right") - 1
        sigs, found, short = [], [], []
        for down in range(int((own_band - least_band).max()) + 1):
            here = np.flatnonzero(own_band - down >= least_band)
            n, band = sizes[here], own_band[here] - down
            owner = np.repeat(np.arange(len(here)), n)
            at = np.repeat(starts[here] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            s = _Segments(tokens[at], owner, band, bands)
            need = bands.differ(n + np.minimum(n, lows[band + 1] - 1)) + 1
            # of its own band, the index has the set itself among the equal segments
            equal = count(s.equal) - (down == 0)
            within, less = count(s.within), count(s.less_equal)
            second = np.maximum(np.bincount(s.of, less, len(s.size)) + within, equal)
            two = np.flatnonzero(s.size > 1)
            unit_seg = np.append(np.arange(len(s.size)), two)
            unit_kind = np.append(np.zeros(len(s.size), np.int8), np.ones(len(two), np.int8))
            order = np.lexsort((unit_kind, np.append(equal, second[two]), s.owner[unit_seg]))
            unit_owner = s.owner[unit_seg[order]]
            have = np.bincount(unit_owner, minlength=len(here))
            rank = np.arange(len(order)) - (np.cumsum(have) - have)[unit_owner]
            taken = order[(rank < need[unit_owner]) & (have >= need)[unit_owner]]
            one, both = unit_seg[taken[unit_kind[taken] == 0]], unit_seg[taken[unit_kind[taken] == 1]]
            is_both = np.zeros(len(s.size), bool)
            is_both[both] = True
            one, both, spread = one[equal[one] > 0], both[within[both] > 0], np.flatnonzero(is_both[s.of] & (less > 0))
            sigs += [s.equal[one], s.within[both], s.less_equal[spread]]
            found += [here[s.owner[x]] for x in (one, both, s.of[spread])]
            short.append(here[have < need])
        lost = np.unique(np.concatenate(short))
        sig = np.concatenate([*sigs, np.zeros(len(lost), np.uint64)])
        yield part.rows(sig, np.concatenate([*found, lost]), np.arange(len(sig)) < len(sig) - len(lost))


@dataclass
class NearSets:
    """Classes of equal sets and the links between classes.

    ``sets``: id, w, key, key2, one row for each set. ``classes``: key, key2, class_id, one (whether it
    has a single member), lo and hi (least and greatest weight). ``links``: for a and b class, key, one,
    lo and hi, and the similarity; each pair of classes once.
    """

    sets: DataFrame
    classes: DataFrame
    links: DataFrame

    @property
    def members(self) -> DataFrame:
        """(id, w, class_id, key), one row for each set."""
        several = self.several().select("id", "w", "class_id", "key")
        lone = self.classes.where("one").select(F.col("class_id").alias("id"), F.col("lo").alias("w"), "class_id", "key")
        return several.union(lone)

    def several(self) -> DataFrame:
        """The same of classes of several members."""
        named = self.classes.where("NOT one").select("key", F.col("key2").alias("of"), "class_id")
        found = join_balanced(self.sets, named, "key", ["id"], most_sent=MOST_BROADCAST)
        return found.where("key2 = of").select("id", "w", "class_id", "key")


def _once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each set of a batch once, so that copies are not moved."""
    for batch in batches:
        if batch.num_rows:
            keys = np.stack([batch.column(i).to_numpy() for i in range(2)])
            yield batch.take(pa.array(np.sort(np.unique(keys, axis=1, return_index=True)[1])))


def _at_class(rows: DataFrame, candidates: DataFrame, classes: DataFrame, side: str) -> DataFrame:
    """A row for each candidate with the class whose number is in the column ``side``, without moving the classes.

    Only classes that many candidates name go to the tasks over which these are spread.
    """
    plan = plan_load(candidates.select(side), side)
    hot = [k for k, tasks in plan.shards if len(tasks) > 1]  # fewer than tasks
    of = classes.withColumnRenamed("cid", side)
    if not hot:
        return rows.join(of.hint("shuffle_merge"), side)
    other = "y" if side == "x" else "x"
    is_hot = F.col(side).isin(hot)
    cool = rows.where(~is_hot).join(of.hint("shuffle_merge"), side)
    return cool.unionByName(join_balanced(rows.where(is_hot), of.where(is_hot), side, [other], plan))


def near_sets(
    df: DataFrame, id_column: str, tokens: Column, threshold: float, weight_ratio: float | None = None, one_set: bool = False, sorted_sets: bool = False
) -> NearSets:
    """Classes of equal sets, and the pairs of classes with Jaccard similarity ``threshold`` or more.

    ``tokens`` is an array of 64-bit integers; ``sorted_sets`` says that they are sorted and distinct.
    With ``weight_ratio``, pairs of classes are left out if the ranges of their weights (the positive
    column ``_weight`` of ``df``) do not come within that ratio of each other.
    """
    if not 0 < threshold <= 1:
        raise ValueError("threshold must be over 0 and at most 1")
    spark = df.sparkSession
    weight = F.col("_weight").cast("double") if weight_ratio is not None else F.lit(1.0)
    sets = tokens if sorted_sets else F.array_sort(F.array_distinct(F.array_compact(tokens)))
    rows = df.select(F.col(id_column).cast("long").alias("id"), sets.alias("tokens"), weight.alias("w")).where("id IS NOT NULL AND size(tokens) > 0")
    rows = rows.withColumns({"key": F.xxhash64("tokens"), "key2": F.xxhash64(F.lit(1), "tokens")})

    known = rows.select("id", "w", "key", "key2")
    if one_set:
        known = known.groupBy("id").agg(F.min(F.struct("w", "key", "key2")).alias("s")).select("id", "s.*")
    else:
        known = known.groupBy("id", "key", "key2").agg(F.min("w").alias("w"))
    known = cut(known.select("id", "w", "key", "key2"))
    owners = known.groupBy("key", F.col("key2").alias("of")).agg(
        F.min("id").alias("class_id"), (F.min("id") == F.max("id")).alias("one"), F.min("w").alias("lo"), F.max("w").alias("hi")
    )

    # the ratio's logarithm is a step at most, so weights in that ratio are a step apart at most
    step = max(-math.log(weight_ratio), 0.025) if weight_ratio else 1.0
    of_weight = lambda c: F.floor(F.log(c) / step).cast("long") + 32768
    info = F.shiftleft(F.size("tokens").cast("long"), 32).bitwiseOR(F.shiftleft(of_weight("lo"), 16)).bitwiseOR(of_weight("hi"))
    tasks = tasks_for(spark, known.count(), LEAST_SETS)
    whole = rows.select("key", "key2", "tokens").mapInArrow(_once, "key long, key2 long, tokens array<long>")
    whole = whole.repartition(tasks, "key").groupBy("key", "key2").agg(F.first("tokens").alias("tokens"))
    # equality of key2 is no join key here: the sides meet where ``key`` has brought them
    classes = whole.join(owners, "key").where(F.col("key2").bitwiseXOR(F.col("of")) == 0)
    classes = cut(
        classes.select(F.col("key").alias("cid"), "key2", "class_id", "one", "lo", "hi", info.alias("info"), "tokens"), keep_partitions=True
    )
    largest, total = classes.agg(F.max(F.size("tokens")), F.sum(F.size("tokens"))).first()
    bands = Bands(threshold, largest or 1)
    cells = min(MOST_CELLS, max(LEAST_CELLS, 1 << (4 * (total or 1)).bit_length()))

    context, numbered = spark.sparkContext, classes.select("cid", "info", "tokens")
    sketch = context.broadcast(sketches.summed(numbered.mapInArrow(lambda it: _count(it, bands, cells), sketches.SCHEMA), cells, _codes))
    look = cut(numbered.mapInArrow(lambda it: _look_up(it, bands, sketch), _ROW))
    probes, short = look.where("sig IS NOT NULL"), look.where("sig IS NULL").select("cid", "info")
    marks = probes.select("sig").mapInArrow(
        lambda it: _counts_of(_cells(b.column(0).to_numpy().view(np.uint64), cells) for b in it), sketches.SCHEMA
    )
    wanted = context.broadcast(sketches.summed(marks, cells, _bits))
    index = numbered.mapInArrow(lambda it: _index(it, bands, cells, wanted), _ROW)

    def pairs(left: DataFrame, right: DataFrame) -> DataFrame:
        met = join_balanced(left, right.withColumnsRenamed({"cid": "y", "info": "y_info"}), "sig", ["cid"])
        size = lambda c: F.shiftrightunsigned(c, 32)
        low = lambda c: F.shiftrightunsigned(c, 16).bitwiseAND(F.lit(65535))
        high = lambda c: F.col(c).bitwiseAND(F.lit(65535))
        worth = (size("info") > size("y_info")) | ((size("info") == size("y_info")) & (F.col("cid") > F.col("y")))
        worth &= size("y_info") >= size("info") * threshold - 1e-9
        if weight_ratio is not None:
            worth &= (low("info") <= high("y_info") + 1) & (low("y_info") <= high("info") + 1)
        return met.where(worth).select(F.col("cid").alias("x"), "y")

    size = F.shiftrightunsigned("info", 32)
    n_short, least, most = short.agg(F.count(F.lit(1)), F.min(size), F.max(size)).first()
    if n_short:
        some, every = _single_tokens(classes, short, least, most, threshold)
        # signatures and tokens may be equal by chance: such candidates are verified like others
        probes, index = probes.union(some), index.union(every)
    candidates = cut(pairs(probes, index).distinct())

    side = lambda s: classes.select("cid", *(F.col(c).alias(f"{s}_{c}") for c in ("class_id", "one", "lo", "hi", "tokens")))
    both = _at_class(_at_class(candidates, candidates, side("x"), "x"), candidates, side("y"), "y")
    shared = F.size(F.array_intersect("x_tokens", "y_tokens"))
    both = both.withColumn("similarity", shared / (F.size("x_tokens") + F.size("y_tokens") - shared)).where(F.col("similarity") >= threshold)
    if weight_ratio is not None:
        both = both.where((F.col("x_lo") * weight_ratio <= F.col("y_hi")) & (F.col("y_lo") * weight_ratio <= F.col("x_hi")))
    first = F.struct("x_class_id", "x") < F.struct("y_class_id", "y")
    named = {"class": "class_id", "key": None, "one": "one", "lo": "lo", "hi": "hi"}

    def end(name: str, s: str, t: str) -> list[Column]:
        of = lambda s, c: F.col(f"{s}_{c}" if c else s)
        return [F.when(first, of(s, c)).otherwise(of(t, c)).alias(f"{name}_{n}") for n, c in named.items()]

    links = both.select(*end("a", "x", "y"), *end("b", "y", "x"), "similarity")
    return NearSets(known, classes.select(F.col("cid").alias("key"), "key2", "class_id", "one", "lo", "hi"), links)


def _single_tokens(classes: DataFrame, short: DataFrame, least: int, most: int, threshold: float) -> tuple[DataFrame, DataFrame]:
    """Look-ups by the rarest tokens of each set of ``short``, of ``least`` to ``most`` tokens, and the index that they need.

    Any partner shares more tokens than these leave out.
    """
    short = cut(classes.join(short.select("cid"), "cid", "left_semi").select("cid", "info", "tokens"))
    n = F.size("tokens")
    sized = classes.where((n >= least * threshold - 1e-9) & (n <= most))
    every = sized.select(F.explode("tokens").alias("sig"), "cid", "info")
    own = short.select(F.explode("tokens").alias("sig"), "cid", "info")
    named = cut(own.select("sig").distinct())
    if named.count() <= MOST_BROADCAST:
        every = every.join(F.broadcast(named), "sig", "left_semi")
        counts = every.groupBy("sig").agg(F.count(F.lit(1)).alias("n"))
        counted = own.join(F.broadcast(counts), "sig")  # as many rows as ``named`` at most
    else:
        counted = join_balanced(own, every.groupBy("sig").agg(F.count(F.lit(1)).alias("n")), "sig", ["cid"])
    rarest = Window.partitionBy("cid").orderBy("n", "sig")  # over the tokens of one set
    size = F.shiftrightunsigned("info", 32)
    some = counted.withColumn("rank", F.row_number().over(rarest)).where(F.col("rank") <= size - F.ceil(size * threshold - 1e-9) + 1)
    return cut(some.select("sig", "cid", "info")), every
