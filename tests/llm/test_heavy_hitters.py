from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from geoloom.llm import sketches
from geoloom.llm.heavy_hitters import SketchShape, _descend, _fill, heavy_hitters


def test_counts_match_brute_force(spark):
    rng = np.random.default_rng(1)
    # a third of the rows have one value, some values are over the threshold, most occur once
    values = ["hot"] * 3000 + [f"v{i}" for i in rng.zipf(1.5, 3000) % 500] + [f"once{i}" for i in range(3000)]
    rows = [(v, v.encode(), 1) for v in values] + [(None, None, 1)] * 500 + [("", b"", 1)] * 200
    df = spark.createDataFrame(rows, "s string, b binary, field int").repartition(5)
    got = heavy_hitters(df, {"text": F.col("s"), "bytes": F.col("b")}, 0.01).collect()
    counts = Counter(values) + Counter({"": 200})
    want = {v: n for v, n in counts.items() if n >= 0.01 * 9200}
    assert {r.val: r.cnt for r in got if r.field == "text"} == want
    assert {bytes.fromhex(r.val).decode(): r.cnt for r in got if r.field == "bytes"} == want
    assert {r.rows_seen for r in got} == {9200}


def test_threshold_is_inclusive(spark):
    df = spark.createDataFrame([("a",)] * 50 + [(f"x{i}",) for i in range(50)], "s string")
    assert [r.val for r in heavy_hitters(df, {"s": F.col("s")}, 0.5).collect()] == ["a"]


def test_nothing_to_count(spark):
    df = spark.createDataFrame([(None,)] * 3, "s string")
    assert heavy_hitters(df, {"s": F.col("s")}, 0.1).count() == 0
    assert heavy_hitters(df.limit(0), {"s": F.col("s")}, 0.1).count() == 0
    for bad in (0, 1.5):
        with pytest.raises(ValueError):
            heavy_hitters(df, {"s": F.col("s")}, bad)


def test_small_sketches_still_find_heavy_prefixes():
    import pyarrow as pa

    shape = SketchShape(top_bits=8, step_bits=8, depth=5, width=256)
    rng = np.random.default_rng(2)
    heavy = rng.integers(-(2**63), 2**63, 5)
    hashes = np.concatenate([np.repeat(heavy, 2000), rng.integers(-(2**63), 2**63, 20000)])
    rng.shuffle(hashes)
    sketch = np.zeros(shape.cells, np.int64)
    for part in np.array_split(hashes, 3):  # sketches of tasks add up
        for out in _fill(iter([pa.RecordBatch.from_arrays([pa.array(part)], ["h0"])]), 1, shape):
            sketches.add(out.column(1)[0].as_py(), sketch)  # there is one block
    assert set(heavy.tolist()) <= set(_descend(sketch, 1000, shape).view(np.int64).tolist())
