"""Runs a query and its SQL and compares the rows."""

from collections import Counter

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings enriched_shapes shard_buckets "
    "shape_feed outlines sites zones doc_labels common_words pack_sizes"
).split()


def _plain(v):
    if isinstance(v, float):
        return "nan" if v != v else float(f"{v:.9g}")
    if isinstance(v, (bytes, bytearray)):
        return bytes(v)
    if isinstance(v, (list, tuple)):
        return tuple(map(_plain, v))
    return v


def same_rows(df, sql, folder):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    expected = con.sql(sql)
    assert sorted(df.columns) == sorted(expected.columns)
    names = sorted(df.columns)
    got = Counter(repr(tuple(map(_plain, r))) for r in df.select(*names).collect())
    want = Counter(repr(tuple(map(_plain, r))) for r in expected.select(*(f'"{n}"' for n in names)).fetchall())
    assert got == want
    return sum(got.values())
