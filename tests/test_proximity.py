import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from geoloom.operators import proximity
from geoloom.operators.proximity import contains, near_points, point_pairs, points_inside, region_rings, usable_points


def frame(spark, lat, lon):
    rows = [(int(i), float(a), float(b)) for i, (a, b) in enumerate(zip(lat, lon))]
    return spark.createDataFrame(rows, "id long, lat double, lon double")


def brute(lat, lon, radius):
    out = set()
    for k in range(len(lat)):
        d = np.abs(lon[k + 1 :] - lon[k])
        d = np.minimum(d, 360 - d)
        hits = np.flatnonzero(np.sqrt((lat[k + 1 :] - lat[k]) ** 2 + d**2) <= radius)
        out |= {(k, int(k + 1 + m)) for m in hits}
    return out


@pytest.mark.parametrize("radius, most_in_tile", [(0.3, 30), (0.3, 10**6), (2.0, 100)])
def test_pairs(spark, radius, most_in_tile):
    rng = np.random.default_rng(0)
    # a cluster over the dateline, a third of all points on one latitude, the rest anywhere
    lat = np.concatenate([rng.normal(10, 0.5, 400), np.full(400, 5.0), rng.uniform(-90, 90, 400)]).clip(-90, 90)
    lon = np.concatenate([rng.uniform(178, 182, 400), rng.uniform(-180, 180, 800)])
    lon = np.where(lon > 180, lon - 360, lon)
    lat[:6], lon[:6] = [7, 7, 7, 7, 7, 7.1], [180, -180, 180, -180, 179.9, 180]
    got = [tuple(r) for r in point_pairs(near_points(frame(spark, lat, lon), radius, most_in_tile)).collect()]
    assert len(got) == len(set(got)) and set(got) == brute(lat, lon, radius)


def test_ties_count(spark):
    got = point_pairs(near_points(frame(spark, [0.0, 0.5, 1.25], [10.0, 10.0, 10.0]), 0.5)).collect()
    assert [tuple(r) for r in got] == [(0, 1)]


def test_usable_points(spark):
    nan = float("nan")
    rows = [(1, 1.0, 1.0, "x"), (1, 1.0, 1.0, "y"), (2, None, 1.0, "x"), (3, 91.0, 0.0, "x"), (4, 0.0, 181.0, "x"), (5, 0.0, 0.0, "x"),
            (6, nan, 1.0, "x"), (None, 1.0, 1.0, "x"), (7, 0.0, 1.0, None), (8, -90.0, -180.0, "x")]
    df = spark.createDataFrame(rows, "sid long, a double, o double, id string")
    got = usable_points(df, "sid", F.col("a"), F.col("o"))
    assert sorted(r.id for r in got.collect()) == [1, 7, 8]


def test_empty(spark):
    none = frame(spark, [1.0], [1.0]).limit(0)
    near = near_points(none, 0.1)
    assert near.links.count() == 0 and near.members.count() == 0 and point_pairs(near).count() == 0
    regions = spark.createDataFrame([(1, "POLYGON ((0 0, 1 0, 1 1, 0 0))")], "rid long, shape string")
    assert points_inside(none, regions, "rid", "shape").count() == 0
    assert points_inside(frame(spark, [1.0], [1.0]), regions.limit(0), "rid", "shape").count() == 0
    with pytest.raises(ValueError):
        near_points(none, 0)


SHAPES = [
    (1, "POLYGON ((0 0, 10 0, 10 10, 0 10, 0 0), (4 4, 6 4, 6 6, 4 6, 4 4))"),
    (2, "MULTIPOLYGON (((175 0, 180 0, 180 5, 175 5, 175 0)), ((-180 0, -175 0, -175 5, -180 5, -180 0)))"),
    (3, "POLYGON ((170 20, 190 20, 190 30, 170 30, 170 20))"),
    (4, None), (5, "nonsense"), (6, "POINT (1 1)"), (7, "POLYGON EMPTY"), (None, "POLYGON ((0 0, 10 0, 10 10, 0 10, 0 0))"),
    (1, "POLYGON ((0 0, 10 0, 10 10, 0 10, 0 0), (4 4, 6 4, 6 6, 4 6, 4 4))"),
]


@pytest.mark.parametrize("most_in_tile", [1, 1 << 20])
def test_inside(spark, most_in_tile):
    regions = spark.createDataFrame([*SHAPES, (9, "POLYGON ((-1 -1, 3 -1, 3 3, -1 3, -1 -1))"), (9, "POLYGON ((1 1, 8 1, 8 8, 1 8, 1 1))")], "rid long, shape string")
    points = frame(spark, [5, 2, 1, 1, 25, 25, 50, 2, 2], [5, 2, 178, -178, 175, -175, 0, 2, 2])
    got = points_inside(points, regions, "rid", "shape", most_in_tile).collect()
    nine = [(0, 9), (1, 9), (7, 9), (8, 9)]
    assert sorted(map(tuple, got)) == sorted([(1, 1), (2, 2), (3, 2), (4, 3), (5, 3), (7, 1), (8, 1), *nine])


@pytest.mark.parametrize("most_in_tile, edges", [(40, 8), (1 << 20, 1 << 16)])
def test_inside_as_by_brute_force(spark, monkeypatch, most_in_tile, edges):
    monkeypatch.setattr(proximity, "EDGES", edges)
    rng = np.random.default_rng(1)
    shapes = []
    for i in range(30):
        turn, far = np.sort(rng.uniform(0, 2 * np.pi, 12)), rng.uniform(1, 30, 12)
        x, y = rng.uniform(-150, 150), rng.uniform(-60, 60)
        ring = [f"{x + d * np.cos(t)} {y + d * np.sin(t)}" for t, d in zip(turn, far)]
        shapes.append((i, f"POLYGON (({', '.join([*ring, ring[0]])}), ({x} {y}, {x + 0.5} {y}, {x} {y + 0.5}, {x} {y}))"))
    lat = np.concatenate([rng.uniform(-80, 80, 500), rng.normal(20, 0.001, 300)])
    lon = np.concatenate([rng.uniform(-180, 180, 500), rng.normal(10, 20, 300)])
    want = {(int(p), i) for i, t in shapes for ring in region_rings(t) for p in np.flatnonzero(contains(ring, lon, lat))}
    got = points_inside(frame(spark, lat, lon), spark.createDataFrame(shapes, "rid long, shape string"), "rid", "shape", most_in_tile).collect()
    assert len(got) == len(want) and set(map(tuple, got)) == want


def test_hot_cells_are_cut(spark):
    rng = np.random.default_rng(2)
    n, most = 60_000, 5000
    lat, lon = rng.uniform(10, 10.004, n), rng.uniform(20, 20.3, n)
    lat[:10], lon[:10] = rng.uniform(-80, 80, 10), rng.uniform(-180, 180, 10)
    lat[10:20] = rng.uniform(9.996, 9.9999, 10)  # the rows beneath, which also get the full one
    at = proximity.places_of(spark.createDataFrame(pd.DataFrame({"id": np.arange(n), "lat": lat, "lon": lon})))
    tiles = proximity.plan_tiles(at.places, 1e-5, most)
    held = np.bincount(tiles.place(lat, lon)[0], minlength=tiles.count)
    assert held.max() <= 1.6 * most and 2 * n / most / 2 <= tiles.count <= 8 * n / most
    got = {tuple(r) for r in point_pairs(near_points(at, 1e-5, most)).collect()}
    order = np.argsort(lon)
    want = set()
    for k in range(1, 40):  # no point has 40 others within the radius of its longitude
        i, j = order[:-k], order[k:]
        near = np.hypot(lat[i] - lat[j], lon[i] - lon[j]) <= 1e-5
        want |= {(int(min(a, b)), int(max(a, b))) for a, b in zip(i[near], j[near])}
    assert got == want


@pytest.mark.parametrize("most", [0, 100_000])
def test_hot_places(spark, monkeypatch, most):
    monkeypatch.setattr(proximity, "MOST_BROADCAST", most)
    lat, lon = [5.0] * 40 + [5.1, -0.0, 0.0, 60.0], [5.0] * 40 + [5.0, 7.0, 7.0, 60.0]
    points = frame(spark, lat, lon)
    got = [tuple(r) for r in point_pairs(near_points(points, 0.2)).collect()]
    assert len(got) == len(set(got)) and set(got) == brute(np.array(lat), np.array(lon), 0.2)
    members = {r.id: r.place for r in near_points(points, 0.2).members.collect()}
    assert [members[i] for i in (0, 39, 40, 41, 42, 43)] == [0, 0, 40, 41, 41, 43]
    regions = spark.createDataFrame([(1, "POLYGON ((4 4, 6 4, 6 6, 4 6, 4 4))")], "rid long, shape string")
    assert {r.a_id for r in points_inside(points, regions, "rid", "shape").collect()} == set(range(41))


def test_ids_of_any_kind(spark):
    points = spark.createDataFrame([("a", 1.0, 1.0), ("b", 1.0, 1.1), ("c", 1.0, 1.0)], "id string, lat double, lon double")
    got = {tuple(r) for r in point_pairs(near_points(points, 0.2)).collect()}
    assert got == {("a", "b"), ("a", "c"), ("b", "c")}
    regions = spark.createDataFrame([(1, "POLYGON ((0 0, 2 0, 2 1.05, 0 1.05, 0 0))")], "rid long, shape string")
    assert {r.a_id for r in points_inside(points, regions, "rid", "shape").collect()} == {"a", "b", "c"}


def test_neighbours_share_no_point():
    left, right = (region_rings(f"POLYGON (({x} 0, {x + 1} 0, {x + 1} 1, {x} 1, {x} 0))")[0] for x in (0, 1))
    x, y = np.array([1.0, 0.5, 1.0]), np.array([0.5, 0.0, 1.0])
    assert (contains(left, x, y).astype(int) + contains(right, x, y)).max() == 1
