import json
import math
import os
from unittest import mock

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from geoloom.kernel import measures, murmur
from geoloom.kernel import shapes as kernel_shapes
from geoloom.kernel import simplify as kernel_simplify
from geoloom.kernel.normal import dedup, drop_repeats, fold_lat, normalize, signed_area, wrap_lon
from geoloom.kernel.shapes import (
    LINE,
    MULTI_LINE,
    MULTI_POLYGON,
    POINT,
    POLYGON,
    ShapeError,
    decode_wkb,
    encode_wkb,
    from_geojson,
    is_empty,
    java_double,
    parse,
    parse_wkt,
    plain_double,
    rounded_double,
    to_geojson,
    to_wkt,
    vertices,
    wkb_is_point,
)
from geoloom.kernel.simplify import reduce_line, simplify, simplify_or_point

GOLDENS = json.load(open(os.path.join(os.path.dirname(__file__), "data", "goldens.json")))


def clean(shape):
    return normalize(dedup(shape))


@pytest.mark.parametrize("golden", GOLDENS["clean"], ids=lambda g: str(g["id"]))
def test_cleaned_shapes(golden):
    assert to_wkt(clean(from_geojson(golden["shape"])), host=True) == golden["fixed"]


def test_touching_holes_are_accepted():
    shape = clean(parse(GOLDENS["touching_holes"]))
    assert shape[0] == POLYGON and len(shape[1]) == 4


@pytest.mark.parametrize(
    "number, zoom, algorithm, expected", [(0, 1, "DOUGLAS_PEUCKER", 0), (0, 1, "TOPOLOGY_PRESERVING", 1), (1, 1, "DOUGLAS_PEUCKER", 2)]
)
def test_simplified_shapes(number, zoom, algorithm, expected):
    shape = clean(from_geojson(GOLDENS["simplify"][number]["shape"]))
    small, _ = simplify_or_point(shape, measures.tolerance(zoom), algorithm)
    assert to_geojson(small) == GOLDENS["simplified"][expected]


@pytest.mark.parametrize("algorithm", ["DOUGLAS_PEUCKER", "TOPOLOGY_PRESERVING"])
def test_simplified_building(algorithm):
    shape = clean(from_geojson(GOLDENS["simplify"][2]["shape"]))
    small = simplify(shape, measures.tolerance(20), algorithm)
    assert len(list(vertices(small))) == 37 and len(to_geojson(small)) == 935


RING = [(2.021484375, 48.596592251456705), (3.262939453125, 48.922499263758255), (2.779541015625, 49.196064000723794),
        (2.0654296875, 49.23194729854559), (1.6809082031249998, 49.05227025601607), (2.021484375, 48.596592251456705)]


def test_digest_depends_on_byte_order():
    shape = (POLYGON, [RING])
    assert murmur.digest(encode_wkb(shape)) == -4836187838120623980
    assert murmur.digest(encode_wkb(shape, little=False)) == -5012816342630707936


@given(st.lists(st.binary(max_size=80), max_size=20))
def test_digests_of_a_batch(values):
    assert murmur.digests(values).tolist() == [murmur.digest(v) for v in values]


def test_measures_of_a_ring():
    shape = (POLYGON, [RING])
    assert measures.area(shape) == pytest.approx(0.594432056845634, rel=1e-14)
    assert measures.centroid(shape) == pytest.approx((2.3829210191713015, 48.9555346367187), rel=1e-13)
    assert measures.length(shape) == pytest.approx(3.5472902323720774, rel=1e-14)


def test_unit_square_wkb():
    shape = parse("POLYGON ((1 0, 1 1, 0 1, 0 0, 1 0))")
    assert encode_wkb(shape).hex().upper() == (
        "01030000000100000005000000000000000000F03F0000000000000000000000000000F03F000000000000F03F"
        "0000000000000000000000000000F03F00000000000000000000000000000000000000000000F03F0000000000000000"
    )


@pytest.mark.parametrize(
    "wkt",
    ["POINT (1 2)", "LINESTRING (1 2, 3 4.5)", "POLYGON ((0 0, 1 0, 1 1, 0 0))", "MULTIPOINT ((1 1), (2 2))",
     "MULTILINESTRING ((0 0, 1 1), (2 2, 3 3))", "MULTIPOLYGON (((0 0, 1 0, 1 1, 0 0)), ((5 5, 6 5, 6 6, 5 5)))",
     "GEOMETRYCOLLECTION (POINT (1 2), GEOMETRYCOLLECTION (LINESTRING (0 0, 1 1)))", "POINT EMPTY", "POLYGON EMPTY",
     "GEOMETRYCOLLECTION EMPTY", "MULTIPOLYGON EMPTY"],
)
def test_codecs_round_trip(wkt):
    shape = parse_wkt(wkt)
    assert to_wkt(shape) == wkt
    for little in (True, False):
        assert decode_wkb(encode_wkb(shape, little)) == shape
    assert from_geojson(json.loads(to_geojson(shape))) == shape or "EMPTY" in wkt


@pytest.mark.parametrize("text", [
    "POINT (1 2)", "POINT(1 2)", "LINESTRING (1 2, 3 4e-5,5 -6.5)", "POLYGON ((0 0, 1 0, 1 1, 0 0),(0.1 0.1,0.2 0.1,0.2 0.2,0.1 0.1))",
    "POLYGON ( ( 0 0, 1 0, 1 1, 0 0 ) , ( 2 2, 3 2, 3 3, 2 2 ) )", "MULTILINESTRING ((0 0, 1 1),(2 2, 3 3))",
    "MULTIPOLYGON (((0 0, 1 0, 1 1, 0 0)),((5 5, 6 5, 6 6, 5 5), (5 5, 6 5, 6 6, 5 5)))", "MULTIPOLYGON (((0 0, 1 0, 1 1, 0 0)))",
    "MULTIPOLYGON ( ( (0 0, 1 0, 1 1, 0 0) ) , ( (5 5, 6 5, 6 6, 5 5) ) )",
    "POLYGON (0 0, 1 0, 1 1, 0 0)", "POLYGON (((0 0, 1 0, 1 1, 0 0)))", "MULTIPOLYGON ((0 0, 1 0, 1 1, 0 0))", "POINT (1)", "POINT (1 2, 3 4)",
    "LINESTRING ()", "POLYGON ((0 0, 1 0, 1 1, 0 0)", "POLYGON ((0 0, 1 0, 1 1, 0 0)))", "POINT (1 2 3)", "LINESTRING (1_0 2, 3 4)",
    "MULTIPOLYGON (((0 0, 1 0, 1 1, 0 0), ((5 5, 6 5, 6 6, 5 5)))", "MULTILINESTRING ((0 0, 1 1), 2 2, 3 3)", "POINT (1 - 2)",
])
def test_splitting_and_reading_agree(text):
    def outcome():
        try:
            return parse_wkt(text)
        except ShapeError:
            return None

    with mock.patch.object(kernel_shapes, "_common_wkt", lambda t: None):
        read = outcome()
    assert outcome() == read


def test_dialects():
    shape = parse("MULTIPOINT (1 2, 3.5 4e-17)")
    assert to_wkt(shape, host=True) == "MULTIPOINT (1.0 2.0, 3.5 4.0E-17)"
    assert to_wkt(shape) == "MULTIPOINT ((1 2), (3.5 0.00000000000000004))"
    polygons = parse("MULTIPOLYGON (((0 0, 1 0, 1 1, 0 0)), ((5 5, 6 5, 6 6, 5 5)))")
    assert ")),((" in to_wkt(polygons, host=True) and ")), ((" in to_wkt(polygons)


@pytest.mark.parametrize("text", ["", "POINT", "CIRCLE (1 2 3)", "POINT (1)", "POLYGON ((0 0, 1 1))", "LINESTRING (0 0)",
                                  "POINT (1 2) x", "{", "{}", '{"type": "Point"}', '{"type": "Nope", "coordinates": []}',
                                  '{"type": "Point", "coordinates": ["a", 1]}'])
def test_bad_texts(text):
    with pytest.raises(ShapeError):
        parse(text)


def test_open_rings_are_closed():
    for text in ("POLYGON ((0 0, 1 0, 1 1))", "polygon((0 0,1 0,1 1))", '{"type":"Polygon","coordinates":[[[0,0],[1,0],[1,1]]]}'):
        assert to_wkt(parse(text)) == "POLYGON ((0 0, 1 0, 1 1, 0 0))"


def test_further_ordinates_are_left_out():
    import struct

    three = struct.pack("<3d", 1, 2, 9)
    for raw in (
        b"\x01" + struct.pack("<I", 0x80000001) + three,
        b"\x01" + struct.pack("<I", 1001) + three,
        b"\x01" + struct.pack("<I", 0xA0000001) + struct.pack("<I", 4326) + three,
        b"\x01" + struct.pack("<I", 3001) + struct.pack("<4d", 1, 2, 9, 9),
        b"\x00" + struct.pack(">I", 2001) + struct.pack(">3d", 1, 2, 9),
    ):
        assert decode_wkb(raw) == (POINT, (1, 2)) and not wkb_is_point(raw)
    assert parse("POINT Z (1 2 3)") == parse("POINT (1 2 3)") == (POINT, (1, 2))


@pytest.mark.parametrize("raw", [b"", b"\x01", bytes.fromhex("0101000000FF"), bytes.fromhex("0163000000"), bytes.fromhex("01030000000100000005000000")])
def test_bad_bytes(raw):
    with pytest.raises(ShapeError):
        decode_wkb(raw)


def test_numbers():
    assert [java_double(v) for v in (0.0, -0.0, 140.0, 4e-17, 1e7, 0.001, 0.00099, 12345678.9, 1.5e300)] == [
        "0.0", "-0.0", "140.0", "4.0E-17", "1.0E7", "0.001", "9.9E-4", "1.23456789E7", "1.5E300",
    ]
    assert [plain_double(v) for v in (1.0, 1.5, 1e22, 1e-7)] == ["1", "1.5", "10000000000000000000000", "0.0000001"]
    assert [rounded_double(v) for v in (1.0, -3.388938903808594, 0.0, 1.000000001)] == ["1", "-3.3889389", "0.0", "1"]


def test_box_of_lines_and_points():
    assert measures.bbox(parse("POINT (3 4)")) == ((3, 4), (3, 4))
    assert measures.bbox(parse("LINESTRING (0 0, 5 0)")) is None
    assert measures.bbox(parse("LINESTRING (0 0, 5 1)")) == ((0, 0), (5, 1))
    assert measures.bbox(parse("POLYGON EMPTY")) is None


def test_centroid_takes_the_highest_dimension():
    shape = parse("GEOMETRYCOLLECTION (POINT (9 9), LINESTRING (5 5, 7 7), POLYGON ((0 0, 1 0, 1 1, 0 1, 0 0)))")
    assert measures.centroid(shape) == pytest.approx((0.5, 0.5))
    assert measures.centroid(parse("LINESTRING (0 0, 2 0)")) == (1, 0)
    assert measures.centroid(parse("POLYGON ((0 0, 2 0, 0 0, 0 0))")) == (1, 0)
    assert measures.centroid(parse("MULTIPOINT (0 0, 2 4)")) == (1, 2)
    assert measures.centroid(parse("POINT EMPTY")) is None


def test_length_counts_holes():
    assert measures.length(parse("POLYGON ((0 0, 4 0, 4 4, 0 4, 0 0), (1 1, 2 1, 2 2, 1 2, 1 1))")) == 20


def test_wrapping():
    assert (wrap_lon(190.0), wrap_lon(-190.0), wrap_lon(180.0), wrap_lon(540.0)) == (-170, 170, 180, 180)
    assert (fold_lat(91.0), fold_lat(-91.0), fold_lat(90.0), fold_lat(270.0)) == (89, -89, 90, -90)


def test_holes_over_the_dateline():
    shape = clean(parse("POLYGON ((170 0, 190 0, 190 10, 170 10, 170 0), (178 4, 182 4, 182 6, 178 6, 178 4), (172 1, 173 1, 173 2, 172 2, 172 1))"))
    assert shape[0] == MULTI_POLYGON
    assert measures.area(shape) == pytest.approx(200 - 8 - 1)
    assert all(-180 <= x <= 180 for x, _ in vertices(shape))
    assert sum(len(p) - 1 for p in shape[1]) == 1


def test_short_way_over_the_dateline():
    shape = clean(parse("POLYGON ((170 0, -170 0, -170 10, 170 10, 170 0))"))
    assert shape[0] == MULTI_POLYGON and measures.area(shape) == pytest.approx(200)


def test_comb_over_the_dateline():
    teeth = clean(parse("POLYGON ((170 0, 190 1, 170 2, 190 3, 170 4, 165 2, 170 0))"))
    assert teeth[0] == MULTI_POLYGON and len(teeth[1]) == 3
    whole = measures.area(parse("POLYGON ((170 0, 190 1, 170 2, 190 3, 170 4, 165 2, 170 0))"))
    assert measures.area(teeth) == pytest.approx(whole)


def test_line_over_the_dateline():
    assert to_wkt(clean(parse("LINESTRING (170 0, 190 10)"))) == "MULTILINESTRING ((170 0, 180 5), (-180 5, -170 10))"


def test_dedup():
    counts = lambda t: [len(r) for r in dedup(parse(t))[1]]
    assert len(dedup(parse("LINESTRING (0 0, 1 1, 1 1, 2 2, 3 3)"))[1]) == 4
    assert counts("POLYGON ((3 3, 3 3, 5 3, 5 5, 5 5, 3 5, 3 3))") == [5]
    assert counts("POLYGON ((0 0, 9 0, 9 0, 9 9, 0 9, 0 0), (1 1, 2 1, 2 1, 2 1, 2 2, 1 1, 1 1))") == [5, 4]
    assert dedup(parse("MULTIPOINT (1 1, 1 1)"))[1] == [(1, 1), (1, 1)]
    with pytest.raises(ShapeError):
        dedup(parse("LINESTRING (1 1, 1 1)"))


def test_point_header():
    assert wkb_is_point(bytes.fromhex("0101000000")) and wkb_is_point(bytes.fromhex("0000000001"))
    assert wkb_is_point(bytes.fromhex("0701000000"))
    assert not wkb_is_point(b"\x01\x01") and not wkb_is_point(bytes.fromhex("0102000000")) and not wkb_is_point(None)


def test_tolerance():
    assert [measures.tolerance(z) for z in (0, 1, 8, 20)] == [1.40625, 0.703125, 0.0054931640625, 1.341104507446289e-06]
    for z in (0, 1, 8, 20):
        by_way_of_meters = measures.degrees_of_meters(measures.meter_by_pixel(z, 48.9), 48.9)
        assert by_way_of_meters == pytest.approx(measures.tolerance(z), rel=1e-12)
    with pytest.raises(ValueError):
        measures.tolerance(-1)


@pytest.mark.parametrize(
    "wkt, dp, tp",
    [
        ("POLYGON ((0 0, 0.05 0, 0 0.05, 0 0))", "POLYGON EMPTY", "POLYGON ((0 0, 0.05 0, 0 0.05, 0 0))"),
        ("LINESTRING (0 0, 1 0.1, 2 0)", "LINESTRING (0 0, 2 0)", "LINESTRING (0 0, 2 0)"),
        ("LINESTRING (0 0, 0.01 0, 0.01 0.01, 0 0)", "LINESTRING (0 0, 0 0)", "LINESTRING (0 0, 0.01 0, 0.01 0.01, 0 0)"),
        ("MULTIPOINT ((1 1), (1 1.01))", "MULTIPOINT ((1 1), (1 1.01))", "MULTIPOINT ((1 1), (1 1.01))"),
        ("GEOMETRYCOLLECTION (POINT (1 1), POLYGON ((0 0, 0.01 0, 0.01 0.01, 0 0)))", "GEOMETRYCOLLECTION (POINT (1 1))",
         "GEOMETRYCOLLECTION (POINT (1 1), POLYGON ((0 0, 0.01 0, 0.01 0.01, 0 0)))"),
        ("POLYGON ((0 0, 9 0, 9 9, 0 9, 0 0), (1 1, 1.01 1, 1.01 1.01, 1 1))", "POLYGON ((0 0, 9 0, 9 9, 0 9, 0 0))",
         "POLYGON ((0 0, 9 0, 9 9, 0 9, 0 0), (1 1, 1.01 1, 1.01 1.01, 1 1))"),
    ],
)
def test_simplifiers_on_small_shapes(wkt, dp, tp):
    assert to_wkt(simplify(parse(wkt), 0.1, "DOUGLAS_PEUCKER")) == dp
    assert to_wkt(simplify(parse(wkt), 0.1, "TOPOLOGY_PRESERVING")) == tp


def test_topology_is_kept():
    # flattening the outer bulge would cross the inner spike
    shape = parse("MULTILINESTRING ((0 0, 5 1, 10 0), (5 -3, 5 0.5))")
    assert to_wkt(simplify(shape, 2, "DOUGLAS_PEUCKER")).startswith("MULTILINESTRING ((0 0, 10 0)")
    assert to_wkt(simplify(shape, 2, "TOPOLOGY_PRESERVING")) == to_wkt(shape)


def test_empty_and_vanished():
    assert is_empty(parse("POINT EMPTY")) and not is_empty(parse("POINT (0 0)"))
    assert simplify_or_point(parse("POLYGON ((3 1, 3.01 1, 3 1.01, 3 1))"), 1, "DOUGLAS_PEUCKER") == ((POINT, (3, 1)), True)


coordinate = st.floats(-170, 170).map(lambda v: round(v, 4))
points = st.lists(st.tuples(coordinate, st.floats(-80, 80).map(lambda v: round(v, 4))), min_size=3, max_size=25, unique=True)


@settings(deadline=None, max_examples=60)
@given(points)
def test_cleaning_keeps_the_measures(ring):
    closed = [*ring, ring[0]]
    shape = (POLYGON, [closed])
    lons = [x for x, _ in ring]
    out = clean(shape)
    if max(lons) - min(lons) <= 180:
        assert out[0] == POLYGON and signed_area(out[1][0]) >= 0
        assert measures.area(out) == pytest.approx(measures.area(shape), abs=1e-9)
        assert measures.length(out) == pytest.approx(measures.length(shape))
        assert sorted(set(vertices(out))) == sorted(set(closed))
    assert decode_wkb(encode_wkb(out)) == out
    assert dedup(dedup(shape)) == dedup(shape)


@settings(deadline=None, max_examples=60)
@given(points, st.floats(0, 20))
def test_reduced_lines(line, tolerance):
    small = reduce_line(line, tolerance)
    assert small[0] == line[0] and small[-1] == line[-1] and set(small) <= set(line)
    xs, ys = np.array(small).T
    for p in line:  # no vertex is further from the result than the tolerance
        best = min(
            math.dist(p, (ax + t * (bx - ax), ay + t * (by - ay)))
            for (ax, ay), (bx, by) in zip(small, small[1:])
            for t in [max(0, min(1, ((p[0] - ax) * (bx - ax) + (p[1] - ay) * (by - ay)) / (((bx - ax) ** 2 + (by - ay) ** 2) or 1)))]
        )
        assert best <= tolerance + 1e-9
    assert simplify((LINE, line), tolerance, "DOUGLAS_PEUCKER")[1] == small


@settings(deadline=None, max_examples=60)
@given(st.lists(points, min_size=1, max_size=4), st.floats(0, 30))
def test_loops_and_arrays_agree(lines, tolerance):
    shape = (MULTI_LINE, [*lines, [*lines[0], lines[0][0]]])
    for algorithm in ("DOUGLAS_PEUCKER", "TOPOLOGY_PRESERVING"):
        with mock.patch.object(kernel_simplify, "SMALL", 0):
            arrays = simplify(shape, tolerance, algorithm)
        assert simplify(shape, tolerance, algorithm) == arrays


def test_drop_repeats():
    assert drop_repeats([(0, 0), (0, 0), (1, 1), (0, 0)]) == [(0, 0), (1, 1), (0, 0)] and drop_repeats([]) == []


@settings(deadline=None, max_examples=40)
@given(st.floats(1, 100_000), st.floats(-500, 500), st.booleans())
def test_area_does_not_depend_on_the_span(width, start, hole):
    rings = [[(start, 0.0), (start + width, 0.0), (start + width, 8.0), (start, 8.0), (start, 0.0)]]
    if hole:
        low, high = start + width / 4, start + width / 2
        rings.append([(low, 2.0), (high, 2.0), (high, 4.0), (low, 4.0), (low, 2.0)])
    shape = (POLYGON, rings)
    out = clean(shape)
    assert measures.area(out) == pytest.approx(measures.area(shape), rel=1e-9)
    assert all(-180 <= x <= 180 for x, _ in vertices(out))
    sheets = math.floor((start + width + 180) / 360) - math.floor((start + 180) / 360)
    # a hole as wide as a sheet leaves two pieces of it
    assert len(out[1] if out[0] == MULTI_POLYGON else [out]) <= (sheets + 1) * (1 + hole)


def test_long_lines_are_cut_too():
    out = clean(parse("LINESTRING (0 0, 100000 10)"))
    assert out[0] == MULTI_LINE and len(out[1]) == 279
    assert all(-180 <= x <= 180 for x, _ in vertices(out))
    assert sum(b[0] - a[0] for a, b in out[1]) == pytest.approx(100_000)


def test_holes_find_their_shell():
    # the hole's first vertex lies on the cut, and the shells of both sides touch it
    shape = clean(parse("POLYGON ((170 0, 190 0, 190 10, 170 10, 170 0), (180 4, 182 5, 180 6, 178 5, 180 4))"))
    assert measures.area(shape) == pytest.approx(200 - 4)
    # folding turns the rings round; holes stay holes
    shape = clean(parse("POLYGON ((170 95, 190 95, 190 105, 170 105, 170 95), (172 97, 173 97, 173 98, 172 98, 172 97))"))
    assert measures.area(shape) == pytest.approx(199) and sorted(map(len, shape[1])) == [1, 2]


@pytest.mark.parametrize("text", ["POLYGON ((170 0, 190 0, 190 10, 170 10, 170 0), (150 4, 152 5, 150 6, 150 4))", "LINESTRING (0 0, 1e300 0)",
                                  "POLYGON ((0 0, 1e300 0, 0 1, 0 0))", "POINT (1e999 0)", "POLYGON ((0 0, 1e999 0, 0 1, 0 0))"])
def test_shapes_that_cannot_be_cleaned(text):
    with pytest.raises(ShapeError):
        clean(parse(text))
