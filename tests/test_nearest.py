import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from furrow.functions.wkt import with_centroid
from furrow.operators import spatial as S
from furrow.operators import workspace as WS
from furrow.operators.nearest import nearest_sites, places_of

BOX = "season_id long, min_lon double, min_lat double, max_lon double, max_lat double, center_lon double, center_lat double"


def some_boxes(n, seed=1):
    r = np.random.default_rng(seed)
    lon, lat, w, h = r.uniform(-60, -50, n), r.uniform(-30, -20, n), r.choice([0.0, 0.001, 0.02, 0.5], n), r.uniform(0, 0.03, n)
    return [(i, *map(float, (a, b, a + c, b + d, a + c / 2, b + d / 2))) for i, (a, b, c, d) in enumerate(zip(lon, lat, w, h))]


def test_twenty_thousand_boxes_equal_brute_force(spark):
    boxes = some_boxes(20_000)
    r = random.Random(2)
    points = [(i, r.uniform(-62, -48), r.uniform(-33, -17)) for i in range(400)] + [(1000, None, -20.0), (1001, -55.0, None), (1002, boxes[7][1], boxes[7][2]), (1003, 100.0, 80.0)] + [(2000 + i, -55.25, -25.5) for i in range(50)]
    table = np.array([b[1:] for b in boxes])
    got = {x.i: (x.season_id, x.assignment_method) for x in S.assign_points(spark.createDataFrame(points, "i long, x double, y double"), spark.createDataFrame(boxes, BOX), "x", "y").collect()}
    for i, x, y in points:
        if x is None or y is None:
            expected = (None, "missing_coordinates")
        else:
            inside = np.flatnonzero((table[:, 0] <= x) & (x <= table[:, 2]) & (table[:, 1] <= y) & (y <= table[:, 3]))
            near = np.argmin((table[:, 4] - x) ** 2 + (table[:, 5] - y) ** 2)
            expected = (int(inside[0]), "bbox_contains") if len(inside) else (int(near), "nearest_center")
        assert got[i] == expected, i
    assert len(got) == len(points)


def test_places_meet_no_boxes_after_those_that_hold_them(spark, monkeypatch):
    from furrow.operators import nearest as N

    boxes = [(i, 0.0, 0.0, 1.0 + i % 7, 1.0, 0.5, 0.5) for i in range(20_000)] + [(20_000, 50.0, 0.0, 51.0, 1.0, 50.5, 0.5)]
    places = spark.createDataFrame([(0.5, 0.5), (6.5, 0.5), (50.5, 0.5), (70.0, 0.5)], "lon double, lat double")
    met, real = [], N.staged

    def counted(df, name):
        met.append((name, df.count()))
        return real(df, name)

    monkeypatch.setattr(N, "staged", counted)
    out = {(r.lon, r.box) for r in N.containing_boxes(places, spark.createDataFrame(boxes, BOX), "season_id").collect()}
    assert out == {(0.5, 0), (6.5, 6), (50.5, 20_000)}
    assert [n for name, n in met if name == "left"] == [2, 2, 2]


def test_few_boxes_by_either_way(spark):
    boxes, points = some_boxes(40, 3), [(i, -60 + i * 0.37 % 10, -30 + i * 0.73 % 10) for i in range(200)]
    df, held = spark.createDataFrame(points, "i long, centroid_lon double, centroid_lat double"), spark.createDataFrame(boxes, BOX)
    for assign in (lambda most: S.assign_points(df, held, "centroid_lon", "centroid_lat", max_boxes=most), lambda most: WS.assign_to_polygons(df, held, max_boxes=most)):
        one, two = ({r.i: (r.season_id, r.assignment_method) for r in assign(most).collect()} for most in (10_000, 0))
        assert one == two and len(one) == len(points)


def geodesic(x, y, sites):
    n = len(sites)
    return S.geodesic_m(np.full(n, x), np.full(n, y), np.array([s[1] for s in sites]), np.array([s[2] for s in sites]))


@pytest.mark.parametrize("most", [10_000, 0])
def test_nearest_on_the_ellipsoid_over_the_date_line_and_at_the_poles(spark, most):
    r = random.Random(4)
    sites = [(i, r.uniform(-180, 180), r.uniform(-89, 89)) for i in range(150)] + [(200 + i, 179.9 - i * 0.01, 10.0) for i in range(80)] + [(300, -179.99, 10.0), (301, 179.0, 89.9), (302, 0.0, -89.9), (400, None, 1.0)]
    places = [(r.uniform(-180, 180), r.uniform(-89, 89)) for _ in range(60)] + [(-179.95, 10.0), (179.95, 10.0), (10.0, 89.95), (-170.0, -89.99), (0.0, 0.0)]
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(places)] + [(99, None, 0.0)], "i long, lon double, lat double")
    got = {x.i: x.nearest for x in S.k_nearest(df, spark.createDataFrame([(*s, None) for s in sites], "site long, s_lon double, s_lat double, plot string"), 3, most).collect()}
    known = [s for s in sites if s[1] is not None]
    for i, (x, y) in enumerate(places):
        d = geodesic(x, y, known)
        order = sorted(range(len(known)), key=lambda j: (d[j], known[j][0]))[:3]
        assert [n.site for n in got[i]] == [known[j][0] for j in order], (i, x, y)
        assert np.allclose([n.distance_m for n in got[i]], d[order])
    assert got[99] == []


def test_ties_dense_sites_fewer_than_k_and_none(spark):
    places = places_of(spark.createDataFrame([(0.0, 0.0), (0.0, 0.0), (50.0, 50.0)], "lon double, lat double"), "lon", "lat")
    sites = spark.createDataFrame([(i, 1.0, 1.0) for i in range(500)] + [(-1, -1.0, -1.0)], "site long, s_lon double, s_lat double")
    got = {(r.lon, r.lat): [n.site for n in r.nearest] for r in nearest_sites(places, sites, 4, geodesic=False).collect()}
    assert got == {(0.0, 0.0): [-1, 0, 1, 2], (50.0, 50.0): [0, 1, 2, 3]}
    assert [len(r.nearest) for r in nearest_sites(places, sites.limit(2), 5).collect()] == [2, 2]
    assert nearest_sites(places, sites.limit(0)).count() == 0 and nearest_sites(places.limit(0), sites).count() == 0


def test_no_pair_of_all_places_and_sites_in_the_plan(spark):
    df, held = spark.range(10).select(F.col("id").cast("double").alias("x"), F.col("id").cast("double").alias("y")), spark.createDataFrame(some_boxes(30), BOX)
    plan = S.assign_points(df, held, "x", "y", max_boxes=0)._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


_NUMBERS = re.compile(r"-?\d+(?:\.\d+)?(?:[eE][+-]?\d+)?")


def plain_centroid(text):
    """Area and length sums ring by ring, with NumPy."""
    m = re.match(r"\s*(?:SRID=\d+;)?\s*([A-Za-z]+?)\s*(?:ZM|Z|M)?\s*(\(.*\))\s*$", text, re.S)
    if not m:
        return None
    kind, polygons, rings = m[1].upper(), [], []
    for before, ring in re.findall(r"(\(*)\(([^()]*)\)", m[2]):
        rings.append(np.array([[float(v) for v in _NUMBERS.findall(p)][:2] for p in ring.split(",")]))
        polygons.append(bool(before))
    if kind in ("POINT", "MULTIPOINT"):
        return tuple(np.concatenate(rings).mean(0))
    middle, weight = [], []
    for r, outer in zip(rings, polygons):
        a, b = r[:-1], r[1:]
        if "LINE" in kind:
            length = np.hypot(*(b - a).T)
            middle.append(((a + b) / 2 * length[:, None]).sum(0))
            weight.append(length.sum())
        else:
            o = r[0]
            cross = (a - o)[:, 0] * (b - o)[:, 1] - (b - o)[:, 0] * (a - o)[:, 1]
            area = cross.sum() / 2
            if area:
                size = abs(area) * (1 if outer else -1)
                middle.append((((a - o) + (b - o)) * cross[:, None]).sum(0) / (6 * area) * size + o * size)
                weight.append(size)
    return tuple(sum(middle) / sum(weight)) if weight and sum(weight) else tuple(np.concatenate(rings).mean(0))


def test_wkt_centroids_equal_plain_sums_without_python_in_the_plan(spark):
    r = random.Random(5)

    def ring(x, y, size, n):
        angles = sorted(r.uniform(0, 6.28) for _ in range(n))
        points = [f"{x + size * np.cos(a):.9f} {y + size * np.sin(a):.9f}" for a in angles]
        return "(" + ", ".join([*points, points[0]]) + ")"

    texts = ["POINT (1 2)", "point(-1.5e1 2)", "POINT Z (1 2 3)", "MULTIPOINT (1 2, 3 4)", "LINESTRING (0 0, 4 0, 4 0)", "MULTILINESTRING ((0 0, 2 0), (5 5, 5 9, 5 10))", "POLYGON ((0 0, 4 0, 4 4, 0 4, 0 0), (0 0, 2 0, 2 4, 0 4, 0 0))",
             "SRID=4326; MULTIPOLYGON (((0 0, 2 0, 2 2, 0 2, 0 0)), ((4 0, 6 0, 6 2, 4 2, 4 0)))", "POLYGON ((1 1, 1 1, 1 1))", "LINESTRING (3 3, 3 3)"]
    texts += [f"POLYGON ({ring(-50, -25, 0.01, 20)}, {ring(-50, -25, 0.002, 9)})" for _ in range(10)]
    texts += [f"MULTIPOLYGON (({ring(-50, -25, 0.01, 7)}), ({ring(-49, -25, 0.02, 300)}, {ring(-49, -25, 0.003, 5)}, {ring(-49.001, -25, 0.001, 5)}))" for _ in range(10)]
    df = with_centroid(spark.createDataFrame(list(enumerate(texts)), "i int, geometry string"))
    assert "Python" not in df._jdf.queryExecution().toString() and "Arrow" not in df._jdf.queryExecution().toString()
    for row in df.collect():
        assert (row.centroid_lon, row.centroid_lat) == pytest.approx(plain_centroid(texts[row.i]), rel=1e-9), texts[row.i]
    bad = ["junk", None, "", "POINT EMPTY", "POINT (1)", "POLYGON ((a b, c d))", "GEOMETRYCOLLECTION (POINT (1 2))", "POINT (1 2"]
    got = with_centroid(spark.createDataFrame([(t, "clash") for t in bad], "geometry string, centroid_lon string")).collect()
    assert [(x.centroid_lon, x.centroid_lat) for x in got] == [(None, None)] * len(bad)
