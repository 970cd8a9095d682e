import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from geoloom.llm import packing
from geoloom.llm.packing import pack, pack_all, plan, ranges


def checked(counts, capacity):
    patterns = plan(counts, capacity)
    got = np.zeros_like(counts)
    for p in patterns:
        assert 0 < sum(p.sizes) <= capacity and p.times > 0
        np.add.at(got, list(p.sizes), p.times)
    assert (got[1:] == counts[1:]).all()
    return patterns


@settings(deadline=None, max_examples=80)
@given(st.integers(1, 60), st.data())
def test_plans_use_every_item_once(capacity, data):
    counts = np.array([0, *data.draw(st.lists(st.integers(0, 5), min_size=capacity, max_size=capacity))])
    patterns = checked(counts, capacity)
    table = ranges(patterns)
    for size in range(1, capacity + 1):  # the ranges of a size are its ranks, without gaps
        at = table["size"] == size
        spans = sorted(zip(table["from_rank"][at], table["to_rank"][at]))
        assert [a for a, _ in spans] == [0, *(b for _, b in spans)][: len(spans)]
        assert sum(b - a for a, b in spans) == counts[size]


def test_exact_fits_are_found():
    counts = np.zeros(101, np.int64)
    for s, n in ((70, 3), (30, 1), (20, 1), (10, 1), (15, 1), (8, 1), (7, 1), (100, 2)):
        counts[s] = n
    patterns = checked(counts, 100)
    assert sorted(sum(p.sizes) for p in patterns for _ in range(p.times)) == [100] * 5


def test_fill_is_close_to_full():
    sizes = np.random.default_rng(0).lognormal(4.5, 1, 5000).astype(int).clip(1, 512)
    counts = np.bincount(sizes, minlength=513)
    assert sum(p.times for p in checked(counts, 512)) <= 1.005 * sizes.sum() / 512 + 1


@pytest.mark.parametrize("capacity", [1, 10, 64])
def test_pack_rows(spark, capacity):
    rng = np.random.default_rng(capacity)
    sizes = np.concatenate([rng.integers(0, 40, 300), np.full(150, 7), [200, 64, 10]]).tolist()  # a third of one size
    rows = [(i, s) for i, s in enumerate(sizes)] + [(9000, None), (1, 5)]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "id long, size int, container int, part int").repartition(5)
    got = pack(df, capacity).collect()
    held, used = {}, {}
    for r in got:
        held[r.container] = held.get(r.container, 0) + r.size
        assert used.setdefault(r.container, r.used) == r.used
    assert held == used and max(held.values()) <= capacity
    assert sum(r.size for r in got) == sum(sizes) + 5
    pieces = [r for r in got if r.id == 450]  # of size 200
    assert len(pieces) == -(-200 // capacity) and sorted(r.piece for r in pieces) == list(range(len(pieces)))
    assert all(len([r for r in got if r.id == i]) == 1 for i, s in rows[:300] if s is not None and s <= capacity and i != 1)
    assert [r.container for r in got if r.size == 0] == [0] * (sizes.count(0) + 1)
    # neither the partitions nor the session's settings change anything
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "37")
    again = pack(df.repartition(3), capacity).collect()
    spark.conf.set("spark.sql.shuffle.partitions", before)
    assert sorted(map(tuple, got)) == sorted(map(tuple, again))


def test_pack_all(spark):
    df = spark.createDataFrame([(1, 5), (2, 5), (3, 0)], "id long, size int")
    kinds = spark.createDataFrame([("a", 10), ("b", 5), ("c", None), ("d", 0)], "kind string, cap int")
    got = pack_all(df, kinds, "kind", "cap")
    assert got.columns == ["kind", "cap", "id", "piece", "size", "container", "used"]
    assert {(r.kind, r.used) for r in got.collect()} == {("a", 10), ("b", 5)}
    assert pack_all(df.limit(0), kinds, "kind", "cap").count() == 0
    assert pack_all(df, kinds.limit(0), "kind", "cap").count() == 0
    assert pack_all(spark.createDataFrame([(3, 0)], "id long, size int"), kinds, "kind", "cap").count() == 2
    with pytest.raises(ValueError):
        pack(df, 0)


def test_many_parts(spark, monkeypatch):
    monkeypatch.setattr(packing, "PART_ITEMS", 8)
    got = pack(spark.range(1000).selectExpr("id", "IF(id % 3 = 0, 7, id % 10) AS size"), 20).collect()
    held = {}
    for r in got:
        held[r.container] = held.get(r.container, 0) + r.size
    assert len(got) == 1000 and max(held.values()) <= 20 and {(r.container, r.used) for r in got} == set(held.items())


def test_sums_of_three():
    stock = packing._Stock(np.bincount([3, 5, 9, 9, 20], minlength=31))
    assert [g for g in range(31) if stock.triples[g] and stock.triple(g)] == [17, 21, 23, 28]
    assert stock.triple(21) == (9, 9, 3) and stock.pair(18) == (9, 9) and stock.pair(10) is None
