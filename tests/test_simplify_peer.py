"""Simplification against the geometry library among PySpark's own jars, over all shapes of the smallest tables.

That library also lets the vertex go at which a ring begins, so it is compared with ``free_ends`` set.
It lets an end go even if the new segment crosses a hole as it was before; here the end stays then.
"""

import pyarrow.parquet as pq
import pytest

from conftest import SMALL
from geoloom.kernel.measures import tolerance
from geoloom.kernel.shapes import POLYGON, decode_wkb, encode_wkb, is_empty, parse_wkt
from geoloom.kernel.simplify import _one_meets_inside, simplify

COMB = "POLYGON ((0 0, 20 0, 20 10, 16 10, 15 4, 14 10, 10 10, 9 3, 8 10, 0 10, 0 0), (7 2, 9 2, 9 2.6, 7 2.6, 7 2))"
#: A hole that a flattened shell would jump over, rings that end on a straight line, a tiny hole near a bulge.
SPECIAL = [
    COMB,
    "POLYGON ((1 0, 2 0, 2 2, 0 2, 0 0, 1 0))",
    "POLYGON ((0 0, 10 0, 10 10, 5 10.6, 0 10, 0 0), (4.9 10.2, 5.1 10.2, 5 10.3, 4.9 10.2))",
    "MULTIPOLYGON (((0 0, 4 0, 4 4, 2 4.5, 0 4, 0 0)), ((1.9 4.6, 2.1 4.6, 2 4.9, 1.9 4.6)))",
    "MULTILINESTRING ((0 0, 5 1, 10 0), (4.9 0.2, 5.1 0.2))",
]


@pytest.fixture(scope="module")
def raws():
    shapes = pq.read_table(f"{SMALL}/enriched_shapes.parquet", columns=["geo_shape_0"]).column(0).to_pylist()
    stored = {s["wkb"] for s in shapes if s and s["wkb"]}
    return [*sorted(stored), *(encode_wkb(parse_wkt(t)) for t in SPECIAL)]


@pytest.mark.parametrize("zoom", [2, 8])
@pytest.mark.parametrize("algorithm, peer", [("DOUGLAS_PEUCKER", "DouglasPeuckerSimplifier"), ("TOPOLOGY_PRESERVING", "TopologyPreservingSimplifier")])
def test_every_shape(spark, raws, zoom, algorithm, peer):
    try:
        library = spark._jvm.org.locationtech.jts
        read, write = library.io.WKBReader(), library.io.WKBWriter(2, 2)
    except TypeError:
        pytest.skip("no geometry library among the jars")
    simplifier, stricter = getattr(library.simplify, peer), 0
    for raw in raws:
        want = simplifier.simplify(read.read(raw), tolerance(zoom))
        got = simplify(decode_wkb(raw), tolerance(zoom), algorithm, free_ends=True)
        if is_empty(got) and want.isEmpty() or encode_wkb(got) == bytes(write.write(want)):
            continue
        shape, theirs = decode_wkb(raw), decode_wkb(bytes(write.write(want)))
        assert algorithm == "TOPOLOGY_PRESERVING" and shape[0] == theirs[0] == POLYGON, want.toText()
        a, b = theirs[1][0][:2]
        assert got[1][0][0] not in theirs[1][0] and got[1][1:] == theirs[1][1:]
        assert any(_one_meets_inside((*p, *q), a, b) for hole in shape[1][1:] for p, q in zip(hole, hole[1:])), want.toText()
        stricter += 1
    assert stricter <= len(raws) // 500
