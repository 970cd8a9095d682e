"""Outlines that are edited versions of each other: by their vertices and their areas.

The tokens of an outline are its distinct vertices, both coordinates rounded to some decimals.

Defined results
    null shape or area        in no pair; so is an area that is not a positive number
    text that is no shape     its numbers are taken two by two; without any, it is in no pair
    repeated ids              one outline; where deliveries differ, the one of the least area and digest
    same vertices             similarity 1; such outlines are one class, paired if their areas agree
    ties                      at a threshold counts
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geoloom.kernel.shapes import ShapeError, parse, vertices
from geoloom.llm.near_sets import MOST_BROADCAST, NearSets, near_sets
from geoloom.operators.balance import join_balanced
from geoloom.plans.lineage import cut

_NUMBER = re.compile(r"-?\d+(?:\.\d+)?(?:[eE][-+]?\d+)?")
#: Texts of which all numbers are ordinates, two for each vertex, and none has an exponent.
_PLAIN = r"-?\d+(?:\.\d+)?"
_PLAIN_WKT = re.compile(rf"\s*(?:MULTI|Multi|multi)?(?:POLYGON|Polygon|polygon)\s*[(\s]*{_PLAIN}\s+{_PLAIN}(?:[(),\s]+{_PLAIN}\s+{_PLAIN})*[)\s]*")
_PLAIN_JSON = re.compile(
    rf'\s*\{{\s*"type"\s*:\s*"(?:Multi)?Polygon"\s*,\s*"coordinates"\s*:[\[\s]*{_PLAIN}\s*,\s*{_PLAIN}(?:\s*\][\[\],\s]*\[\s*{_PLAIN}\s*,\s*{_PLAIN})*[\]\s]*\}}\s*'
)
_VERTEX_END = re.compile(r"\d\s*\]")
_BLANKED = str.maketrans({chr(c): " " for c in range(128) if chr(c) not in "0123456789.-"})


def vertex_tokens(text: str | None, decimals: int = 5) -> list[int] | None:
    """One 64-bit number for each distinct vertex."""
    if text is None:
        return None
    try:
        points = list(vertices(parse(text)))
    except (ShapeError, RecursionError):
        numbers = [float(x) for x in _NUMBER.findall(text)]
        points = list(zip(numbers[0::2], numbers[1::2]))
    scale = 10**decimals
    out = set()
    for x, y in points:
        if not (math.isfinite(x) and math.isfinite(y)):
            continue
        x, y = round(x, decimals), round(y, decimals)
        a, b = round(x * scale), round(y * scale)
        small = -(1 << 31) <= a < 1 << 31 and -(1 << 31) <= b < 1 << 31
        out.add((a << 32) + b if small else hash((x, y)))
    return sorted(out)


def _vertices_of(text: str) -> int:
    """The number of vertices of a text whose numbers can be read off; -1 of others."""
    if _PLAIN_WKT.fullmatch(text):
        return text.count(",") + 1
    return len(_VERTEX_END.findall(text)) if _PLAIN_JSON.fullmatch(text) else -1


def _rounded(x: np.ndarray, scale: float) -> np.ndarray:
    """x * scale, rounded half to even by the exact product."""
    product = x * scale
    whole = np.rint(product)
    at = np.flatnonzero(np.abs(np.abs(product - whole) - 0.5) < 1e-4)
    # near a tie, what the product lost decides; it is found by products of halves of the digits
    x, near = x[at], product[at]
    high = x * 134217729.0
    high -= high - x
    low = x - high
    top = scale * 134217729.0
    top -= top - scale
    rest = scale - top
    lost = ((high * top - near) + high * rest + low * top) + low * rest
    below = np.floor(near)
    over = (near - (below + 0.5)) + lost
    whole[at] = below + np.where(over == 0, below % 2, over > 0)
    return whole


def batch_tokens(texts: list[str | None], decimals: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """``vertex_tokens`` of many texts: the tokens end to end, and their number for each text."""
    slow: dict[int, list[int]] = {}
    plain = []
    for i, text in enumerate(texts):
        n = _vertices_of(text) if text is not None else -1
        if n < 0:
            slow[i] = vertex_tokens(text, decimals) or []
        else:
            plain.append((i, n))
    # a mark behind each text tells its numbers from the next ones
    read = np.fromstring(" ".join(f"{texts[i].translate(_BLANKED)} nan" for i, _ in plain), sep=" ") if plain else np.empty(0)
    marks = np.flatnonzero(np.isnan(read))
    of, expected = np.array([i for i, _ in plain], np.int64), np.array([n for _, n in plain], np.int64)
    fits = np.diff(marks, prepend=-1) - 1 == 2 * expected
    kept = np.repeat(fits, np.diff(marks, prepend=-1))
    kept[marks] = False
    read = read[kept]
    slow |= {int(i): vertex_tokens(texts[i], decimals) or [] for i in of[~fits]}
    owner = np.repeat(of[fits], expected[fits])
    whole = _rounded(read, 10.0**decimals)
    far = np.abs(whole).max(initial=0) >= 1 << 31
    if far:
        for i in np.unique(owner[(np.abs(whole) >= 1 << 31).reshape(-1, 2).any(axis=1)]):
            slow[int(i)] = vertex_tokens(texts[i], decimals) or []
        stay = ~np.isin(owner, list(slow))
        owner, whole = owner[stay], whole.reshape(-1, 2)[stay].ravel()
    x, y = whole.astype(np.int64).reshape(-1, 2).T
    tokens = (x << 32) + y
    more = [t for made in slow.values() for t in made]
    tokens = np.append(tokens, np.array(more, np.int64))
    owner = np.append(owner, np.repeat(np.array(list(slow), np.int64), np.array(list(map(len, slow.values())), np.int64)))
    order = np.argsort(tokens)
    small = np.uint16 if len(texts) <= 1 << 16 else np.int64  # those are sorted by their digits
    order = order[np.argsort(owner[order].astype(small), kind="stable")]
    tokens, owner = tokens[order], owner[order]
    new = np.append(True, (tokens[1:] != tokens[:-1]) | (owner[1:] != owner[:-1]))[: len(tokens)]
    return tokens[new], np.bincount(owner[new], minlength=len(texts))


def _tokens(batches: Iterator[pa.RecordBatch], decimals: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        tokens, n = batch_tokens(batch.column(1).to_pylist(), decimals)
        made = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(n)).astype(np.int32)), pa.array(tokens))
        yield pa.RecordBatch.from_arrays([batch.column(0), made, batch.column(2)], ["id", "tokens", "_weight"])


def near_outlines(
    df: DataFrame, id_column: str, shape: str, area: str, similarity: float = 0.7, area_ratio: float = 0.9, decimals: int = 5
) -> NearSets:
    """Classes of outlines with the same vertices, and links between classes of similar vertices."""
    usable = df.select(F.col(id_column).cast("long").alias("id"), F.col(shape).alias("shape"), F.col(area).cast("double").alias("area"))
    usable = usable.where("shape IS NOT NULL AND area > 0 AND area < double('Infinity')")
    tokens = usable.where("id IS NOT NULL").mapInArrow(lambda it: _tokens(it, decimals), "id long, tokens array<long>, _weight double")
    return near_sets(tokens, "id", F.col("tokens"), similarity, area_ratio, one_set=True, sorted_sets=True)


def outline_pairs(near: NearSets, area_ratio: float = 0.9) -> DataFrame:
    """Pairs (a_id, b_id), smaller first, of linked or equal outlines whose areas agree.

    A link between classes of one member each is a pair as it is. Members of other classes only meet
    where their areas may agree, by buckets of the logarithm, and classes with many members are split
    over tasks.
    """
    step = -math.log(area_ratio) if area_ratio < 1 else 1e-12
    bucket = lambda w: F.floor(F.log(w) / step)
    agree = F.least("lw", "rw") / F.greatest("lw", "rw") >= area_ratio
    links = cut(near.links.drop("similarity"))
    single = links.where("a_one AND b_one").select(F.col("a_class").alias("l"), F.col("a_lo").alias("lw"), F.col("b_class").alias("r"), F.col("b_lo").alias("rw"))

    members = cut(near.several().select("id", "w", "key", bucket(F.col("w")).alias("bucket")))
    # from the end of several members to the other end
    swapped = links.where("a_one AND NOT b_one").select(*(F.col(f"{x}_{c}").alias(f"{n}_{c}") for n, x in (("a", "b"), ("b", "a")) for c in ("class", "key", "one", "lo")))
    several = links.where("NOT a_one").select(swapped.columns).union(swapped)
    left = members.select(F.col("id").alias("l"), F.col("w").alias("lw"), F.col("key").alias("a_key"))
    linked = cut(join_balanced(left, several.select("a_key", "b_class", "b_key", "b_one", "b_lo"), "a_key", ["l"], most_sent=MOST_BROADCAST))
    to_one = linked.where("b_one").select("l", "lw", F.col("b_class").alias("r"), F.col("b_lo").alias("rw"))

    own = left.select("l", "lw", F.col("a_key").alias("b_key"), F.lit(True).alias("same"))
    met = own.union(linked.where("NOT b_one").select("l", "lw", "b_key", F.lit(False)))
    near_by = F.explode(F.sequence(bucket(F.col("lw")) - 1, bucket(F.col("lw")) + 1)).alias("l_bucket")
    met = met.select("l", "lw", "b_key", "same", near_by).withColumn("at", F.xxhash64("b_key", "l_bucket"))
    right = members.select(F.col("id").alias("r"), F.col("w").alias("rw"), "key", "bucket", F.xxhash64("key", "bucket").alias("at"))
    met = join_balanced(met, right, "at", ["l"], most_sent=MOST_BROADCAST).where("b_key = key AND l_bucket = bucket AND (NOT same OR l < r)")
    every = single.union(to_one).union(met.select("l", "lw", "r", "rw")).where(agree & (F.col("l") != F.col("r")))
    return every.select(F.least("l", "r").alias("a_id"), F.greatest("l", "r").alias("b_id"))
