"""Arrays of counters that tasks fill and that are summed block by block.

A task's counters travel as a few binary blocks, in the narrowest integers that hold them and
compressed, not as a row for each counter.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

BLOCK_CELLS = 1 << 16
SCHEMA = "block int, raw binary"
_KINDS = (np.int8, np.int16, np.int32, np.int64)


#: Blocks in which under one cell in so many is in use travel as the cells and their counters.
SPARSE = 8


def _kind(counts: np.ndarray) -> int:
    most = int(np.abs(counts).max(initial=0))
    return next(i for i, k in enumerate(_KINDS) if most <= np.iinfo(k).max)


def packed(counts: np.ndarray) -> bytes:
    """Bytes of integers; the first says how wide they are, and whether all or only some are there."""
    used = np.flatnonzero(counts)
    if len(used) * SPARSE < len(counts) <= BLOCK_CELLS:
        return _packed_some(used, counts[used])
    kind = _kind(counts)
    return bytes([kind]) + zlib.compress(counts.astype(_KINDS[kind]).tobytes(), 1)


def _packed_some(cell: np.ndarray, counts: np.ndarray) -> bytes:
    """Of the counters of rising cells."""
    kind = _kind(counts)
    steps = np.diff(cell, prepend=0).astype(np.uint16)
    return bytes([len(_KINDS) + kind]) + zlib.compress(counts.astype(_KINDS[kind]).tobytes() + steps.tobytes(), 1)


def add(raw: bytes, total: np.ndarray) -> None:
    """Adds packed counters to those of a block."""
    kind, body = raw[0], zlib.decompress(raw[1:])
    if kind < len(_KINDS):
        counts = np.frombuffer(body, _KINDS[kind])
        total[: len(counts)] += counts
        return
    width = np.dtype(_KINDS[kind - len(_KINDS)]).itemsize
    n = len(body) // (width + 2)
    cell = np.cumsum(np.frombuffer(body, np.uint16, n, n * width).astype(np.int64))
    total[cell] += np.frombuffer(body, _KINDS[kind - len(_KINDS)], n)


def blocks(counts: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Rows of SCHEMA: the blocks of ``counts`` that are not all 0."""
    for at in range(0, len(counts), BLOCK_CELLS):
        part = counts[at : at + BLOCK_CELLS]
        if part.any():
            yield _row(at // BLOCK_CELLS, packed(part))


def sparse_blocks(cell: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Rows of SCHEMA of how often each cell is in ``cell``."""
    cell, n = np.unique(cell, return_counts=True)
    ends = np.flatnonzero(np.diff(cell // BLOCK_CELLS, append=-1)) + 1
    for at, to in zip(np.append(0, ends[:-1]), ends):
        block, own = int(cell[at]) // BLOCK_CELLS, cell[at:to] % BLOCK_CELLS
        if (to - at) * SPARSE < BLOCK_CELLS:
            yield _row(block, _packed_some(own, n[at:to]))
            continue
        part = np.zeros(BLOCK_CELLS, np.int64)
        part[own] = n[at:to]
        yield _row(block, packed(part))


def _row(block: int, raw: bytes) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"block": pa.array([block], pa.int32()), "raw": [raw]})


def _sums(batches: Iterator[pa.RecordBatch], finish: Callable[[np.ndarray], np.ndarray] | None) -> Iterator[pa.RecordBatch]:
    held: dict[int, np.ndarray] = {}
    for batch in batches:
        for block, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if block not in held:
                held[block] = np.zeros(BLOCK_CELLS, np.int64)
            add(raw, held[block])
    for block, counts in held.items():
        yield _row(block, zlib.compress(finish(counts).tobytes(), 1) if finish else packed(counts))


def summed(rows: DataFrame, cells: int, finish: Callable[[np.ndarray], np.ndarray] | None = None) -> np.ndarray:
    """The sum of the counters of all tasks, of which there are ``cells``.

    With ``finish``, the result is bytes: what it makes of each block, the same number of them for
    each; it must make zeros of zeros.
    """
    size = BLOCK_CELLS if finish is None else len(finish(np.zeros(BLOCK_CELLS, np.int64)))
    n = -(-cells // BLOCK_CELLS)
    out = np.zeros(n * size, np.int64 if finish is None else np.uint8)
    tasks = min(rows.sparkSession.sparkContext.defaultParallelism, n)
    made = rows.repartition(tasks, "block").mapInArrow(lambda it: _sums(it, finish), SCHEMA)
    for row in made.collect():  # one for each block
        at = row["block"] * size
        if finish is None:
            add(row["raw"], out[at : at + size])
        else:
            out[at : at + size] = np.frombuffer(zlib.decompress(row["raw"]), np.uint8)
    return out if finish else out[:cells]
