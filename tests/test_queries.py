"""Every registered query over the smallest tables, against its SQL, or another way to the same rows."""

from collections import Counter

import pytest

import __spark_entry__ as entry
from comparing import same_rows
from conftest import SMALL
from geoloom.kernel import measures
from geoloom.kernel.shapes import decode_wkb, encode_wkb, to_geojson, vertices
from geoloom.kernel.simplify import simplify_or_point
from geoloom.plans import catalog
from geoloom.sources.tables import table


def test_entry(spark):
    rows = entry.entry(spark)
    assert rows.count() == 10 and rows.columns == ["key", "type", "doc_count", "sum_other_doc_count"]


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, name):
    df = catalog.QUERIES[name](spark, SMALL)
    if name in catalog.ORACLE_SQL:
        same_rows(df, catalog.ORACLE_SQL[name], SMALL)
    else:
        OTHERWISE[name](spark, df.collect())


def _shapes(spark):
    return [r.wkb for r in table(spark, SMALL, "enriched_shapes").select("geo_shape_0.wkb").collect() if r.wkb]


def agg_shapes(spark, rows):
    """The same in plain Python, from the kernel of which other tests tell that it is right."""
    by = {}
    for raw, n in Counter(_shapes(spark)).items():
        shape = decode_wkb(raw)
        by[raw] = (measures.length(shape), n, shape)
    first = sorted(by.items(), key=lambda x: (-x[1][0], -x[1][1], x[0]))[:100]
    merged = {}
    for _, (_, n, shape) in first:
        small, _ = simplify_or_point(shape, measures.tolerance(8), "TOPOLOGY_PRESERVING")
        raw = encode_wkb(small, little=False)
        merged[raw] = (measures.length(small), merged.get(raw, (0, 0))[1] + n, to_geojson(small))
    want = sorted(merged.items(), key=lambda x: (-x[1][0], -x[1][1], x[0]))[:20]
    assert [(r.key, r.doc_count) for r in rows] == [(text, n) for _, (_, n, text) in want]
    total = sum(n for _, n, _ in by.values())
    assert {r.sum_other_doc_count for r in rows} == {total - sum(n for _, (_, n, _) in want)}


def simplify_tp(spark, rows):
    """Ends of rings stay, kinds too, and no vertex is new; ``test_simplify_peer`` compares the vertices."""
    whole = {r.id: r.wkb for r in table(spark, SMALL, "enriched_shapes").select("id", "geo_shape_0.wkb").collect() if r.wkb}
    for r in rows:
        if r.shape is None:
            continue
        small, shape = decode_wkb(bytes.fromhex(r.shape)), decode_wkb(whole[r.id])
        assert set(vertices(small)) <= set(vertices(shape)) and r.type == r.real_type
        assert next(vertices(small)) == next(vertices(shape))
    assert sum(r.shape is not None for r in rows) == len(_shapes(spark))


OTHERWISE = {"agg_shapes": agg_shapes, "simplify_tp": simplify_tp}


def test_names_match():
    assert set(entry.oracle_sql()) <= set(entry.queries()) >= set(catalog.QUERIES)
