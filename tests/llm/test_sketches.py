import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st

from geoloom.llm import sketches


@given(st.lists(st.one_of(st.just(0), st.integers(-3, 3), st.integers(-(2**62), 2**62)), max_size=30), st.integers(0, 60_000))
def test_packing(values, zeros):
    counts = np.append(np.array(values, np.int64), np.zeros(zeros, np.int64))
    for some in (counts, counts[::-1]):
        total = np.ones(len(some) + 3, np.int64)
        sketches.add(sketches.packed(some), total)
        assert (total[: len(some)] == some + 1).all() and (total[len(some) :] == 1).all()


@pytest.mark.parametrize("cells", [1, 65_536, 200_000])
def test_sums_of_tasks(spark, cells):
    def fill(batches):
        counts = np.zeros(cells, np.int64)
        for batch in batches:
            np.add.at(counts, batch.column(0).to_numpy() * 977 % cells, 1)
        yield from sketches.blocks(counts)

    got = sketches.summed(spark.range(0, 5000, 1, 7).mapInArrow(fill, sketches.SCHEMA), cells)
    want = np.bincount(np.arange(5000) * 977 % cells, minlength=cells)
    assert (got == want).all()
    assert not sketches.summed(spark.range(0).mapInArrow(fill, sketches.SCHEMA), cells).any()


def test_bytes_of_sums(spark):
    cells = 1 << 17

    def fill(batches):
        for batch in batches:
            yield from sketches.sparse_blocks(batch.column(0).to_numpy() * 40 % cells)

    rows = spark.range(0, 5000, 1, 7).mapInArrow(fill, sketches.SCHEMA)
    want = np.bincount(np.arange(5000) * 40 % cells, minlength=cells)
    assert (sketches.summed(rows, cells) == want).all()
    bits = sketches.summed(rows, cells, lambda c: np.packbits(c > 0, bitorder="little"))
    assert (np.unpackbits(bits, bitorder="little") == (want > 0)).all()
