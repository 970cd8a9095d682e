"""The subpackage's queries over the smallest tables, against their SQL, or another way to the same rows."""

import math
from collections import defaultdict

import pyarrow.parquet as pq
import pytest

from comparing import same_rows
from conftest import SMALL
from geoloom.llm.queries import ORACLE_SQL, QUERIES, vocabulary

COLUMNS = {
    "p1_found": ["field", "val"],
    "p3_found": ["keep_id", "dup_id"],
    "p4_found": ["a_id", "b_id"],
    "p6_ids": ["doc_id", "ids"],
    "p8_found": ["doc_id"],
}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    df = QUERIES[name](spark, SMALL)
    if name in COLUMNS:
        assert df.columns == COLUMNS[name]
    if name in ORACLE_SQL:
        same_rows(df, ORACLE_SQL[name], SMALL)
    else:
        OTHERWISE[name](df.collect())


def documents():
    return pq.read_table(f"{SMALL}/documents.parquet", columns=["doc_id", "text"]).to_pylist()


def library_ids():
    """By a library of tokenizers."""
    tokenizer = pytest.importorskip("tokenizers").Tokenizer.from_file(vocabulary())
    tokenizer.encode_special_tokens = True
    return {r["doc_id"]: tokenizer.encode(r["text"] or "", add_special_tokens=False).ids for r in documents()}


def p6_ids(rows):
    assert {r.doc_id: r.ids for r in rows} == library_ids() and len(rows) == len(documents())


def p6_counts(rows):
    assert {r.doc_id: r.tokens for r in rows} == {k: len(v) for k, v in library_ids().items()}


def capacities():
    return {r["pack_kind"]: r["capacity"] for r in pq.read_table(f"{SMALL}/pack_sizes.parquet").to_pylist()}


def p7_packed(rows):
    sizes = {k: len(v) for k, v in library_ids().items()}
    for kind, capacity in capacities().items():
        own = [r for r in rows if r.pack_kind == kind]
        held, pieces = defaultdict(int), defaultdict(list)
        for r in own:
            held[r.container] += r.tokens
            pieces[r.doc_id].append((r.piece, r.tokens))
        assert {(r.container, r.used_tokens) for r in own if r.tokens} == {(c, n) for c, n in held.items() if n}
        assert max(held.values()) <= capacity and set(held) == set(range(len(held)))
        for doc, size in sizes.items():
            whole, rest = divmod(size, capacity)
            assert sorted(pieces[doc]) == [(i, capacity) for i in range(whole)] + ([(whole, rest)] if rest or not whole else [])


def p7_fill(rows):
    total = sum(map(len, library_ids().values()))
    assert {r.pack_kind: r.capacity for r in rows} == capacities() and {r.tokens for r in rows} == {total}
    for r in rows:
        least = math.ceil(total / r.capacity)
        assert least <= r.containers <= max(least + 1, 1.01 * least) and r.fill == pytest.approx(total / r.containers / r.capacity)


def labels():
    return {r["doc_id"]: r["label"] for r in pq.read_table(f"{SMALL}/doc_labels.parquet").to_pylist()}


def p8_stats(rows):
    by = {r.doc_id: r for r in rows}
    assert len(by) == len(rows) == len(documents())
    for d in documents():
        r, text = by[d["doc_id"]], d["text"]
        if text is None or not text.strip():
            assert r.label is None and r.n_lines == 0
            continue
        assert r.n_chars == len(text)
        assert r.prose_share + r.list_share + r.table_share + r.junk_share == pytest.approx(1)
        assert (r.label == "prose") == (r.prose_share >= 0.5)
    known = {k: v for k, v in labels().items() if by[k].label}
    assert sum((by[k].label == "prose") == (v == "prose") for k, v in known.items()) >= 0.95 * len(known)


def p8_found(rows):
    known = labels()
    found = {r.doc_id for r in rows} & set(known)
    assert len(found ^ {k for k, v in known.items() if v != "prose"}) <= 0.05 * len(known)


OTHERWISE = {f.__name__: f for f in (p6_ids, p6_counts, p7_packed, p7_fill, p8_stats, p8_found)}
