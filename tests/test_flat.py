import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from conftest import SMALL
from geoloom.kernel import measures
from geoloom.kernel.flat import flat_shapes
from geoloom.kernel.shapes import ShapeError, decode_wkb, encode_wkb, parse_wkt, vertices

TEXTS = [
    "POINT (1 2)", "LINESTRING (0 0, 3 4, 3 5)", "LINESTRING (1 1, 1 1)", "POLYGON ((0 0, 4 0, 4 4, 0 4, 0 0), (1 1, 2 1, 2 2, 1 2, 1 1))",
    "POLYGON ((0 0, 0 4, 4 4, 4 0, 0 0))", "POLYGON ((0 0, 2 0, 0 0, 0 0))", "MULTIPOINT ((1 1), (2 5), (1 1))", "MULTILINESTRING ((0 0, 1 1), (5 5, 6 6, 7 5))",
    "MULTIPOLYGON (((0 0, 1 0, 1 1, 0 0)), ((5 5, 9 5, 9 9, 5 9, 5 5), (6 6, 7 6, 7 7, 6 6)), ((20 20, 21 20, 21 21, 20 20)))",
    "POINT EMPTY", "LINESTRING EMPTY", "POLYGON EMPTY", "MULTIPOINT EMPTY", "MULTIPOLYGON EMPTY", "GEOMETRYCOLLECTION (POINT (1 2), LINESTRING (0 0, 1 1))", "LINESTRING (0 0, 5 0)",
]


def check(raws):
    flat = flat_shapes(pa.array(raws, pa.binary()))
    areas, lengths, (cx, cy), boxes, counts = flat.areas(), flat.lengths(), flat.centroids(), flat.boxes(), flat.vertex_counts()
    read = 0
    for i, raw in enumerate(raws):
        if not flat.kind[i]:
            continue
        read += 1
        shape = decode_wkb(raw)
        assert flat.kind[i] == shape[0] and counts[i] == len(list(vertices(shape)))
        assert areas[i] == pytest.approx(measures.area(shape), rel=1e-12, abs=1e-12)
        assert lengths[i] == pytest.approx(measures.length(shape), rel=1e-12)
        assert tuple(b[i] for b in boxes) == measures.envelope(shape)
        if np.isfinite(cx[i]):
            assert (cx[i], cy[i]) == pytest.approx(measures.centroid(shape), rel=1e-9, abs=1e-9)
        else:
            assert measures.area(shape) == 0
    return read


def test_every_kind():
    raws = [encode_wkb(parse_wkt(t), little) for t in TEXTS for little in (True, False)]
    assert check(raws) == 20 and check(raws[::-1]) == 20
    assert check([None, *raws, None]) == 20 and check([]) == 0 and check([None]) == 0


def test_points_alone():
    flat = flat_shapes(pa.array([encode_wkb(parse_wkt("POINT (1 2)"))], pa.binary()))
    for values in (flat.areas(), flat.lengths(), *flat.centroids(), *flat.boxes()):
        assert values.dtype == float


def test_slices():
    raws = pa.array([encode_wkb(parse_wkt(t)) for t in TEXTS], pa.binary())
    assert flat_shapes(raws.slice(3, 2)).areas().tolist() == [15, 16]


def test_tables():
    shapes = pq.read_table(f"{SMALL}/enriched_shapes.parquet", columns=["geo_shape_0"]).column(0).to_pylist()
    raws = [s["wkb"] if s else None for s in shapes]
    assert check(raws) == sum(r is not None for r in raws)


@settings(deadline=None, max_examples=300)
@given(st.sampled_from(TEXTS), st.booleans(), st.data())
def test_broken_values_are_left_alone(text, little, data):
    raw = bytearray(encode_wkb(parse_wkt(text), little))
    for _ in range(data.draw(st.integers(0, 3))):
        raw[data.draw(st.integers(0, len(raw) - 1))] = data.draw(st.integers(0, 255))
    raw = bytes(raw[: data.draw(st.integers(0, len(raw)))])
    good = encode_wkb(parse_wkt(TEXTS[3]))
    flat = flat_shapes(pa.array([good, raw, good], pa.binary()))
    assert flat.areas()[[0, 2]].tolist() == [15, 15]
    try:
        shape = decode_wkb(raw)
    except ShapeError:
        assert not flat.kind[1]
        return
    if flat.kind[1]:
        assert flat.kind[1] == shape[0] and flat.vertex_counts()[1] == len(list(vertices(shape)))
