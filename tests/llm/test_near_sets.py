import itertools
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from geoloom.llm.near_sets import Bands, near_sets
from geoloom.llm.outlines import _rounded, batch_tokens, near_outlines, outline_pairs, vertex_tokens


def brute(sets, threshold):
    out = set()
    for (i, a), (j, b) in itertools.combinations(sorted(sets.items()), 2):
        if len(a & b) / len(a | b) >= threshold:
            out.add((i, j))
    return out


def expanded(near):
    """Pairs of ids that links and classes stand for."""
    members, classes = {}, {}
    for r in near.members.collect():
        members.setdefault((r.class_id, r.key), []).append(r.id)
    out = {tuple(sorted(p)) for m in members.values() for p in itertools.combinations(m, 2)}
    for r in near.links.collect():
        for i, j in itertools.product(members[r.a_class, r.a_key], members[r.b_class, r.b_key]):
            out.add(tuple(sorted((i, j))))
    return out


def random_sets(rng, sizes, n, edits):
    """Families of sets with a few edits, over a universe that many share."""
    sets, i = {}, 0
    while len(sets) < n:
        base = set(rng.integers(0, 3000, rng.choice(sizes)).tolist())
        for _ in range(rng.integers(1, 5)):
            s = set(base)
            for _ in range(rng.integers(0, edits + 1)):
                s.discard(rng.choice(sorted(s)) if s and rng.random() < 0.5 else -1)
                if rng.random() < 0.5:
                    s.add(int(rng.integers(0, 3000)))
            if s:
                sets[i] = s
                i += 1
    return sets


@pytest.mark.parametrize("threshold", [0.5, 0.7, 0.85, 1.0])
@pytest.mark.parametrize("sizes", [(1, 2, 3, 4, 5, 6), (10, 30, 70)])
def test_all_pairs_are_found(spark, threshold, sizes):
    sets = random_sets(np.random.default_rng(len(sizes)), sizes, 250, max(1, sizes[-1] // 6))
    df = spark.createDataFrame([(i, sorted(s) + sorted(s)[:1]) for i, s in sets.items()], "id long, t array<long>")
    assert expanded(near_sets(df, "id", F.col("t"), threshold)) == brute(sets, threshold)


def test_common_tokens_and_copies(spark):
    # all share twelve tokens, and a third are equal
    shared = set(range(12))
    sets = {i: shared | {1000 + 5 * i + k for k in range(5 + i % 3)} for i in range(60)}
    sets |= {100 + i: shared | {7, 8, 9, 5000} for i in range(30)}
    df = spark.createDataFrame([(i, sorted(s)) for i, s in sets.items()], "id long, t array<long>")
    near = near_sets(df, "id", F.col("t"), 0.7)
    assert expanded(near) == brute(sets, 0.7)
    assert near.members.where("class_id = 100").count() == 30


def test_nothing_comes_of_nothing(spark):
    rows = [(1, None), (2, []), (3, [5]), (None, [5]), (4, [None, 5]), (5, [6])]
    near = near_sets(spark.createDataFrame(rows, "id long, t array<long>"), "id", F.col("t"), 0.7)
    assert sorted((r.id, r.class_id) for r in near.members.collect()) == [(3, 3), (4, 3), (5, 5)]
    assert near.links.count() == 0
    none = near_sets(spark.createDataFrame([], "id long, t array<long>"), "id", F.col("t"), 0.7)
    assert none.members.count() == 0 and none.links.count() == 0


def test_small_parts(spark, monkeypatch):
    from geoloom.llm import near_sets as module

    lists = pa.array([[5, 6], [7], [8, 9, 10]], pa.list_(pa.int64()))
    batch = pa.RecordBatch.from_arrays([pa.array([1, 2, 3]), pa.array([0, 0, 0]), lists], ["cid", "info", "tokens"])
    monkeypatch.setattr(module, "PART_TOKENS", 3)
    parts = [(p.ids.tolist(), p.sizes.tolist(), p.tokens.tolist()) for p in module._parts(iter([batch.slice(0, 0), batch, batch.slice(1)]))]
    assert parts == [([1, 2], [2, 1], [5, 6, 7]), ([3], [3], [8, 9, 10]), ([2], [1], [7]), ([3], [3], [8, 9, 10])]


def test_bands():
    bands = Bands(0.7, 1000)
    assert (np.diff(bands.lows) > 0).all() and bands.lows[-1] > 1000
    assert bands.differ(np.array([60])).tolist() == [10]


SQUARE = "POLYGON ((0 0, 1 0, 1 1, 0 1, 0.5 0.5, 0 0))"
SCHEMA = "oid long, shape string, area double, id int, tokens int"


def test_outlines(spark):
    rows = [
        (1, SQUARE, 1.0),
        (2, "POLYGON ((1 0, 1 1, 0 1, 0.5 0.5000000001, 0 0, 0 0, 1 0))", 0.95),  # the same vertices
        (3, '{"type":"Polygon","coordinates":[[[0,0],[1,0],[1,1],[0,1],[0,0]]]}', 1.0),  # 4 of 5
        (4, SQUARE, 0.8),  # another area
        (5, None, 1.0), (6, SQUARE, None), (7, SQUARE, 0.0), (8, SQUARE, float("nan")), (9, "nonsense", 1.0), (10, "POLYGON EMPTY", 1.0),
        (1, SQUARE, 1.0), (None, SQUARE, 1.0),
        (11, "POLYGON ((0 0, 1 0, 1 1, 0 1, 0.5 0.5", 1.0),  # cut off, but its vertices can be read
    ]
    df = spark.createDataFrame([(*r, 0, 0) for r in rows], SCHEMA)
    got = outline_pairs(near_outlines(df, "oid", "shape", "area")).collect()
    assert len(got) == len(set(map(tuple, got)))
    assert set(map(tuple, got)) == {(1, 2), (1, 3), (2, 3), (1, 11), (2, 11), (3, 11)}
    assert outline_pairs(near_outlines(df.limit(0), "oid", "shape", "area")).count() == 0


@pytest.mark.parametrize("most", [0, 100_000])
def test_outlines_against_brute_force(spark, monkeypatch, most):
    for module in ("near_sets", "outlines"):
        monkeypatch.setattr(f"geoloom.llm.{module}.MOST_BROADCAST", most)
    rng = np.random.default_rng(4)
    rows, sets = [], {}
    for i in range(120):
        if i % 3 == 0:
            n = int(rng.integers(4, 40))
            base = [(round(float(x), 5), round(float(y), 5)) for x, y in rng.uniform(-90, 90, (n, 2))]
        points = [p if rng.random() > 0.05 else (round(p[0] + 0.001, 5), p[1]) for p in base]
        area = float(rng.uniform(0.85, 1.0))
        sets[i] = (frozenset(points), area)
        ring = [*points, points[0]]
        rows.append((i, "POLYGON ((" + ", ".join(f"{x} {y}" for x, y in ring) + "))", area))
    df = spark.createDataFrame(rows, "oid long, shape string, area double")
    want = set()
    for i, j in itertools.combinations(range(120), 2):
        (a, x), (b, y) = sets[i], sets[j]
        if len(a & b) / len(a | b) >= 0.7 and min(x, y) / max(x, y) >= 0.9:
            want.add((i, j))
    assert want and set(map(tuple, outline_pairs(near_outlines(df, "oid", "shape", "area")).collect())) == want


def test_vertex_tokens():
    assert vertex_tokens("POINT (1.000004 -2)") == vertex_tokens("POINT (1 -2)") != vertex_tokens("POINT (1.00001 -2)")
    assert len(vertex_tokens("POLYGON ((0 0, 3000000.5 0, 1 1, 0 0))")) == 3 and vertex_tokens(None) is None


TEXTS = [
    None, "", "nonsense 5 and 6", "POLYGON EMPTY", "MULTIPOLYGON (((0 0, 1 0, 1 1, 0 0)), ((5 5,6 5,6 6.000005,5 5)))", "POLYGON Z ((0 0 1, 1 0 1, 1 1 1, 0 0 1))",
    "POLYGON ((0 0 1, 1 0 1, 1 1 1, 0 0 1))", "POLYGON ((0 0, 1e1 0, 1 1, 0 0))", "POLYGON ((0 0, 1 0, 1 1", "POLYGON ((0 0, 1 0, 1))", "POLYGON ((0 0, 40000.5 0, 1 1, 0 0))",
    '{"type":"Polygon","coordinates":[[[0,0],[1.5,0],[-1.000015,1],[0,0]]]}', '{"type": "Polygon", "coordinates": [[[0,0,9],[1,0,9],[1,1,9],[0,0,9]]]}',
    '{"coordinates":[[[0,0],[1.5,0],[1,1],[0,0]]],"type":"Polygon"}', "POLYGON ((12.345675 -0.000005, 12.345665 0.000015, 1 1, 12.345675 -0.000005))", "polygon ((0 0, 1 0, 1 1, 0 0))",
    "POLYGON ((0 0, 1-2 0, 1 1, 0 0))", "POLYGON ((0 0, 1..2 0, 1 1, 0 0))", "POLYGON ((. -, 1 0, 1 1, 0 0))",
]


def test_tokens_of_batches():
    rng = np.random.default_rng(8)
    texts = [*TEXTS, *(f"POLYGON (({', '.join(f'{x:.6f} {y:.5f}' for x, y in rng.uniform(-180, 180, (20, 2)))}))" for _ in range(50))]
    for some in (texts, texts[::-1], texts[-20:], [], [None], *([t] for t in TEXTS)):
        tokens, n = batch_tokens(some)
        ends = np.cumsum(n)
        assert [tokens[e - k : e].tolist() for e, k in zip(ends, n)] == [vertex_tokens(t) or [] for t in some]


@given(st.lists(st.one_of(st.floats(-1e4, 1e4), st.integers(-(10**9), 10**9).map(lambda v: v / 10**6)), max_size=50))
def test_rounding(values):
    assert _rounded(np.array(values), 1e5).tolist() == [float(round(round(v, 5) * 10**5)) for v in values]


def test_hot_signatures_and_classes(spark, monkeypatch):
    """A hub that hundreds of sets resemble, none of which resembles another."""
    from geoloom.llm import near_sets as module
    from geoloom.operators import balance

    monkeypatch.setattr(balance, "ROWS_PER_TASK", 10)
    monkeypatch.setattr(module, "MOST_BROADCAST", 0)
    monkeypatch.setattr(module, "HELD", 100)
    sets = {0: set(range(40))} | {i: set(range(40)) - {i % 40, (7 * i + 1) % 40, (11 * i + 5) % 40} | {100 * i, 100 * i + 1} for i in range(1, 120)}
    sets |= {200: sets[5], 201: sets[0]}
    df = spark.createDataFrame([(i, sorted(s)) for i, s in sets.items()], "id long, t array<long>")
    near = near_sets(df, "id", F.col("t"), 0.86, sorted_sets=True)
    assert expanded(near) == brute(sets, 0.86)


def test_weights(spark):
    rows = [(1, [1, 2, 3, 4], 1.0), (2, [1, 2, 3, 4, 5], 1.1), (3, [1, 2, 3, 4, 6], 2.0), (4, [1, 2, 3, 4, 5], 1.9), (1, [1, 2, 3, 4], 1.0)]
    df = spark.createDataFrame(rows, "id long, t array<long>, _weight double")
    near = near_sets(df, "id", F.col("t"), 0.6, weight_ratio=0.9)
    assert {(r.a_class, r.b_class) for r in near.links.collect()} >= {(1, 2), (2, 3)}
    none = near_sets(df.where("id <> 4"), "id", F.col("t"), 0.6, weight_ratio=0.99)
    assert (1, 3) not in {(r.a_class, r.b_class) for r in none.links.collect()}


def test_deliveries_that_differ(spark):
    rows = [(1, SQUARE, 1.0), (1, "POLYGON ((5 5, 6 5, 6 6, 5 5))", 0.5), (2, SQUARE, 1.0), (3, "POLYGON ((5 5, 6 5, 6 6, 5 5))", 0.5)]
    df = spark.createDataFrame(rows, "oid long, shape string, area double")
    assert [tuple(r) for r in outline_pairs(near_outlines(df, "oid", "shape", "area")).collect()] == [(1, 3)]


def test_codes_of_counts():
    from geoloom.llm import near_sets as module

    counts = np.array([0, 1, 5, 63, 64, 65, 1000, 10**6, 2**40])
    codes = module._codes(counts)
    assert (np.diff(module._COUNTS) > 0).all() and (np.diff(codes.astype(int)) >= 0).all()
    read = module._COUNTS[codes]
    assert read[:5].tolist() == counts[:5].tolist() and (read[:-1] <= counts[:-1]).all() and (read[:-1] >= counts[:-1] * 0.91).all()


def test_a_sketch_that_is_too_small(spark, monkeypatch):
    """Nothing is lost where all cells are shared by chance."""
    from geoloom.llm import near_sets as module

    monkeypatch.setattr(module, "MOST_CELLS", 1 << 16)
    rng = np.random.default_rng(12)
    sets = {}
    for i in range(3000):
        base = rng.choice(20_000, 45, replace=False) if i % 3 == 0 else base
        sets[i] = frozenset(base[rng.random(45) > 0.06].tolist())
    counts, holders = Counter(), {}
    for i, s in sets.items():
        for t in s:
            for j in holders.setdefault(t, []):
                counts[j, i] += 1
            holders[t].append(i)
    want = {(i, j) for (i, j), n in counts.items() if n / (len(sets[i]) + len(sets[j]) - n) >= 0.8}
    df = spark.createDataFrame([(i, sorted(s)) for i, s in sets.items()], "id long, t array<long>")
    assert len(want) > 1000 and expanded(near_sets(df, "id", F.col("t"), 0.8)) == want
