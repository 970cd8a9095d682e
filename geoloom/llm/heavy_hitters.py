"""Most frequent values of columns, in memory that does not grow with the data.

Method: count-sketches with signed hashes, one for each level of a hierarchy of hash-bit prefixes.
A first scan fills the sketches, each task its own and then summed block by block; the driver walks
down the prefixes whose estimate stays above the threshold and ends with a bounded list of 64-bit
hashes; a second scan counts the values behind these hashes exactly.

Defined results
    null values      not counted, and not part of the base of the share
    empty strings    a value like any other
    ties             every value at or over the threshold is returned
    empty table      an empty result
    repeated rows    counted as they stand
    other columns    ignored, whatever they are called
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geoloom.llm import sketches

SKETCHES_PER_CORE = 8
_GOLDEN = 0x9E3779B97F4A7C15


@dataclass(frozen=True)
class SketchShape:
    """Size of the sketches of one column.

    The first level counts prefixes of ``top_bits`` bits exactly. Each further level has
    ``step_bits`` more and ``depth`` rows of ``width`` signed counters. A row's error has the
    standard deviation sqrt(F2 / width); the median of the rows is used. The defaults take
    2.5 MB a column, whatever the number of rows and of distinct values.
    """

    top_bits: int = 16
    step_bits: int = 8
    depth: int = 5
    width: int = 8192

    @property
    def prefix_bits(self) -> list[int]:
        return list(range(self.top_bits + self.step_bits, 65, self.step_bits))

    @property
    def cells(self) -> int:
        return (1 << self.top_bits) + len(self.prefix_bits) * self.depth * self.width


def _mix(x: np.ndarray, seed: int) -> np.ndarray:
    """A 64-bit finaliser over ``x`` and ``seed`` (wrap-around arithmetic)."""
    with np.errstate(over="ignore"):
        x = (x + np.uint64((seed * _GOLDEN) % (1 << 64))).astype(np.uint64)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _row_cells(prefix: np.ndarray, level: int, row: int, shape: SketchShape) -> tuple[np.ndarray, np.ndarray]:
    """Cell number and sign (+1, -1) of each prefix in one row of one level."""
    mixed = _mix(prefix, 1 + level * shape.depth + row)
    base = (1 << shape.top_bits) + (level * shape.depth + row) * shape.width
    sign = 1 - 2 * (mixed >> np.uint64(63)).astype(np.int64)
    return base + (mixed % np.uint64(shape.width)).astype(np.int64), sign


def _fill(batches: Iterator[pa.RecordBatch], columns: int, shape: SketchShape) -> Iterator[pa.RecordBatch]:
    """One task's sketches of 64-bit hashes, as blocks of counters."""
    sketch = np.zeros(columns * shape.cells, np.int64)
    for batch in batches:
        for c in range(columns):
            values = batch.column(c).drop_null()
            if not len(values):
                continue
            hashes, counts = np.unique(values.to_numpy(zero_copy_only=False).view(np.uint64), return_counts=True)
            own = sketch[c * shape.cells : (c + 1) * shape.cells]
            np.add.at(own, (hashes >> np.uint64(64 - shape.top_bits)).astype(np.int64), counts)
            for level, bits in enumerate(shape.prefix_bits):
                prefix = hashes >> np.uint64(64 - bits)
                for row in range(shape.depth):
                    cell, sign = _row_cells(prefix, level, row, shape)
                    own += np.bincount(cell, sign * counts, shape.cells).astype(np.int64)
    yield from sketches.blocks(sketch)


def _descend(sketch: np.ndarray, least: float, shape: SketchShape) -> np.ndarray:
    """The 64-bit hashes whose prefixes are estimated at ``least`` or more on every level."""
    heavy = np.flatnonzero(sketch[: 1 << shape.top_bits] >= least).astype(np.uint64)
    children = np.arange(1 << shape.step_bits, dtype=np.uint64)
    for level in range(len(shape.prefix_bits)):
        prefix = ((heavy[:, None] << np.uint64(shape.step_bits)) | children).ravel()
        rows = []
        for row in range(shape.depth):
            cell, sign = _row_cells(prefix, level, row, shape)
            rows.append(sketch[cell] * sign)
        heavy = prefix[np.median(rows, axis=0) >= least] if len(prefix) else prefix
    return heavy


def heavy_hitters(
    df: DataFrame, columns: dict[str, Column], share: float, shape: SketchShape | None = None, slack: float = 0.5
) -> DataFrame:
    """The values that make up at least ``share`` of the non-null values of each column.

    ``columns`` maps the name under which a column is reported to a string or binary expression.
    Candidates are the hashes estimated at ``slack * share`` or more, so a value at the threshold
    is only lost where the median estimate errs by (1 - slack) of it. Their number is at most about
    1 / (slack * share) a column. Returns (field, val, cnt, rows_seen): ``val`` is the string, or
    the upper-case hexadecimal digits of the bytes, ``cnt`` its exact count, ``rows_seen`` the
    number of non-null values of the field.
    """
    if not 0 < share <= 1:
        raise ValueError("share must be over 0 and at most 1")
    if not 0 < slack <= 1:
        raise ValueError("slack must be over 0 and at most 1")
    shape = shape or SketchShape()
    names = list(columns)
    hashed = df.select(
        *(F.when(c.isNotNull(), F.xxhash64(c)).alias(f"h{i}") for i, c in enumerate(columns.values()))
    )
    # so many sketches at most, however many partitions the scan has
    hashed = hashed.coalesce(SKETCHES_PER_CORE * df.sparkSession.sparkContext.defaultParallelism)
    filled = hashed.mapInArrow(lambda it: _fill(it, len(names), shape), sketches.SCHEMA)
    sketch = sketches.summed(filled, len(names) * shape.cells)
    parts = []
    for i, name in enumerate(names):
        own = sketch[i * shape.cells : (i + 1) * shape.cells]
        total = int(own[: 1 << shape.top_bits].sum())
        found = _descend(own, slack * share * total, shape).view(np.int64).tolist() if total else []
        parts.append((name, total, found))
    # one scan for all columns: a row gives one entry for each column whose hash is a candidate
    entries = F.array(
        *(
            F.when(
                F.xxhash64(columns[name]).isin(found) & columns[name].isNotNull() if found else F.lit(False),
                F.struct(F.lit(name).alias("field"), columns[name].cast("binary").alias("raw"), F.lit(total).alias("rows_seen")),
            )
            for name, total, found in parts
        )
    )
    binary = [n for n in names if dict(df.select(columns[n].alias("c")).dtypes)["c"] == "binary"]
    counted = (
        df.select(F.explode(F.filter(entries, lambda e: e.isNotNull())).alias("e"))
        .groupBy("e.field", "e.raw", "e.rows_seen")
        .agg(F.count(F.lit(1)).alias("cnt"))
        .where(F.col("cnt") >= F.lit(share) * F.col("rows_seen"))
    )
    val = F.when(F.col("field").isin(binary), F.hex("raw")).otherwise(F.col("raw").cast("string")) if binary else F.col("raw").cast("string")
    return counted.select("field", val.alias("val"), "cnt", F.col("rows_seen").cast("long").alias("rows_seen"))
