"""Cases that lost data before: rings, missing coordinates, categories, sizes, distance bounds; plans of the joins."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from catchment.functions import geo
from catchment.operators import features as feat
from catchment.operators import profile as prof
from catchment.operators import spatial_join as sj

SQUARE = "POLYGON ((0 0, 10 0, 10 10, 0 10, 0 0), (4 4, 6 4, 6 6, 4 6, 4 4))"
PARTS = "MULTIPOLYGON (((0 0, 1 0, 1 1, 0 1, 0 0)), ((5 5, 5 6, 6 6, 6 5, 5 5)))"


def polygons(spark, *wkts):
    rows = list(enumerate(wkts))
    return spark.createDataFrame(rows, "pid int, geometry string").withColumn("ring", geo.wkt_ring("geometry"))


def test_holes_and_parts(spark):
    p = polygons(spark, SQUARE, PARTS, "POLYGON EMPTY", "nonsense", None, "POLYGON ((0 0, x 1, 1 1, 0 0))", "multipolygon(((0 0,2 0,2 2,0 0)))")
    got = p.select("pid", F.size("ring").alias("n"), geo.area("ring").alias("a"), geo.contains("ring", F.lit(5.2), F.lit(5.5)).alias("mid"),
                   geo.contains("ring", F.lit(2.0), F.lit(2.5)).alias("low"), geo.centroid("ring").alias("c")).collect()
    assert [(r.n, r.a) for r in got[:2]] == [(2, 96.0), (2, 2.0)]
    assert [(r.mid, r.low) for r in got[:2]] == [(False, True), (True, False)]
    assert abs(got[0].c.lng - 5) < 1e-12 and abs(got[1].c.lng - 3) < 1e-12
    assert [r.a for r in got[2:6]] == [None] * 4 and got[6].a == 2.0


def test_points_in_polygons_of_all_sizes(spark):
    rng = np.random.default_rng(0)
    boxes = [(0.0, 0.0, 30.0, 30.0)] + [(x, y, x + s, y + s) for x, y, s in zip(rng.random(60) * 29, rng.random(60) * 29, rng.random(60) * 0.5 + 0.01)]
    wkts = [f"POLYGON (({a} {b}, {c} {b}, {c} {d}, {a} {d}, {a} {b}))" for a, b, c, d in boxes]
    polys = polygons(spark, *wkts).select("pid", "ring")
    xy = rng.random((800, 2)) * 34 - 2
    pts = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(xy)] + [(9000, None, 1.0)], "id int, lng double, lat double")
    want = {(i, p) for i, (x, y) in enumerate(xy) for p, (a, b, c, d) in enumerate(boxes) if a < x < c and b < y < d}
    pairs = {(r.id, r.pid) for r in sj.pip_join(pts, polys).collect()}
    assert pairs == want
    left = sj.pip_join(pts, polys, "left").collect()
    assert {(r.id, r.pid) for r in left if r.pid is not None} == want
    outside = {r.id for r in left if r.pid is None}
    assert outside == {r.id for r in sj.outside(pts, polys).collect()} == set(range(800)) - {i for i, _ in want} | {9000}
    assert {r.id for r in sj.inside(pts, polys).collect()} == {i for i, _ in want}
    assert sj.outside(pts, polys.limit(0)).count() == 801 and sj.inside(pts, polys.limit(0)).count() == 0


def test_nearest_polygon_with_one_huge_among_small(spark):
    rng = np.random.default_rng(1)

    def square(x, y, h):
        return f"POLYGON (({x - h} {y - h}, {x + h} {y - h}, {x + h} {y + h}, {x - h} {y + h}, {x - h} {y - h}))"

    at = rng.random((80, 2)) * [1.0, 0.4] + [18.8, 50.0]
    polys = polygons(spark, square(22.0, 52.0, 1.0), *[square(x, y, 0.0005) for x, y in at])
    sites = geo.with_xy(spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(rng.random((25, 2)) * [1.2, 0.5] + [18.7, 49.95])] + [(99, 22.0, 52.0)],
                                              "location_id int, lng double, lat double"))
    got = {r.location_id: (r.pid, r.d) for r in sj.nearest_polygon(sites, polys, poly_id="pid").collect()}
    every = sites.crossJoin(polys.select("pid", geo.ring_to_xy("ring").alias("r"))).select("location_id", "pid", geo.polygon_distance("r", "x", "y").alias("d")).toPandas()
    for i, g in every.groupby("location_id"):
        best = g.sort_values(["d", "pid"]).iloc[0]
        assert got[i][0] == best.pid and abs(got[i][1] - best.d) < 1e-6
    assert got[99] == (0, 0.0)


def test_sites_without_coordinates_stay(spark):
    sites = spark.createDataFrame([(1, 19.0, 50.0), (2, None, None), (3, 19.5, 50.2)], "location_id int, lng double, lat double")
    poi = spark.createDataFrame([(1, "a", 19.001, 50.001), (2, "b", 19.5, 50.2), (3, None, 19.0, 50.0), (4, "a", None, 50.0)],
                                "poi_id int, category string, lng double, lat double")
    comp = poi.select(F.col("poi_id").alias("comp_id"), "lng", "lat")
    got = {r.location_id: r for r in feat.site_features(sites, comp, poi, addresses=poi.withColumn("total", F.lit(2))).collect()}
    assert set(got) == {1, 2, 3}
    assert (got[2].competitor_count_1500m, got[2].nearest_competitor_m, got[2].poi_a_count_1500m, got[2].nearest_poi_m, got[2].population_1500m) == (0, None, 0, None, 0)
    # categories come from the data; one without a category counts in the totals
    assert (got[1].poi_count_1500m, got[1].poi_a_count_1500m, got[1].poi_b_count_1500m) == (2, 1, 0)
    assert got[1].nearest_poi_m == 0 and 0 < got[1].nearest_poi_a_m < 200 and got[3].nearest_poi_b_m == 0


def test_nearest_by_a_group_that_can_be_null(spark):
    sites = geo.with_xy(spark.createDataFrame([(1, 19.0, 50.0)], "location_id int, lng double, lat double"))
    pts = geo.with_xy(spark.createDataFrame([(1, "a", 19.1, 50.0), (2, None, 19.2, 50.0)], "pid int, kind string, lng double, lat double"))
    got = {r.kind: r.pid for r in sj.nearest_join(sites, pts, "location_id", "pid", by=["kind"]).collect()}
    assert got == {"a": 1, None: 2}
    asked = {r.kind: r.pid for r in sj.nearest_join(sites, pts, "location_id", "pid", by=["kind"], by_values=["a", "zz"]).collect()}
    assert asked == {"a": 1, "zz": None}


@pytest.mark.parametrize("lng0", [14.2, 19.0, 24.1, 29.0])
def test_geodesic_join_misses_nothing_far_from_the_meridian(spark, lng0):
    rng = np.random.default_rng(3)
    sites = [(i, lng0 + float(a), 50 + float(b)) for i, (a, b) in enumerate(rng.random((15, 2)) * 0.2)]
    pts = [(i, str(lng0 + a), str(50 + b), "2024-01-02 03:04:05") for i, (a, b) in enumerate(rng.random((1500, 2)) * 0.2)]
    s = spark.createDataFrame(sites, "location_id int, lng double, lat double")
    t = spark.createDataFrame(pts, "trace_id int, longitude string, latitude string, occured_at string")
    got = {(r.location_id, r.trace_id) for r in sj.dwithin_join(s, t, 1500.0).collect()}

    def hav(a, b, c, d):
        p, q = math.radians(b), math.radians(d)
        h = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(c - a) / 2) ** 2
        return 2 * geo.EARTH_RADIUS_M * math.asin(math.sqrt(h))

    want = {(i, j) for i, a, b in sites for j, c, d, _ in pts if hav(a, b, float(c), float(d)) <= 1500.0}
    assert got == want and len(want) > 100


def test_projection_against_literals(spark):
    """Distances of three sites to their nearest competitor, as published in the reference's feature table."""
    # Site, competitor and distance in metres.
    known = [
        ("LOC_001", 50.226272, 19.072973, 50.223909, 19.073091, 262.79537097022853),
        ("LOC_002", 50.299999, 18.674625, 50.276959, 18.672083, 2567.458931881972),
        ("LOC_003", 50.042894, 19.968676, 50.048424, 19.967636, 619.1988049416403),
    ]
    df = spark.createDataFrame(known, "id string, lat double, lng double, clat double, clng double, d double")
    xy = geo.with_xy(geo.with_xy(df), "clng", "clat", "cx", "cy")
    assert xy.select(F.max(F.abs(geo.planar_distance("x", "y", "cx", "cy") - F.col("d")))).first()[0] < 1e-6


def test_joins_project_once(spark):
    pts = spark.createDataFrame([(i, 19.0 + i / 1000, 50.0) for i in range(50)], "pid int, lng double, lat double")
    sites = spark.createDataFrame([(1, 19.0, 50.0)], "location_id int, lng double, lat double")
    plan = sj.radius_join(sj.ensure_xy(sites, keep_nulls=True), sj.ensure_xy(pts), 1500.0)._jdf.queryExecution().optimizedPlan().toString()
    # no filter or join key holds the projection, and no select expands it twice
    for line in plan.splitlines():
        if "Filter" in line or "Join" in line:
            assert "SINH" not in line, line
        assert line.count("SINH") <= 8, line


def test_quantiles_are_exact_without_a_single_buffer(spark):
    v = np.random.default_rng(5).normal(size=5001)
    df = spark.createDataFrame([(float(x),) for x in v] + [(None,)], "v double").repartition(7)
    got = prof.quantiles(df, ["v"], [0.0, 0.25, 0.5, 0.9, 1.0])["v"]
    assert np.allclose(got, np.quantile(v, [0.0, 0.25, 0.5, 0.9, 1.0]), atol=1e-12)
    assert prof.quantiles(df.limit(0), ["v"], [0.5]) == {"v": [None]}


def test_no_join_plans_as_nested_loops(spark):
    a = spark.createDataFrame([(float(i),) for i in range(40)], "total double")
    plan = prof.tail_bins(a, "total", 10, [15, 20, 30])._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_polygons_of_catchments_by_box_and_by_vertex(spark):
    """A box inside the catchment decides; others, and those with a vertex that isn't known, go by their vertices."""
    pts = lambda *v: [([{"x": x, "y": y} for x, y in v],)]
    rows = [(1, pts((0.0, 0.0), (10.0, 0.0), (10.0, 10.0))), (2, pts((0.0, 0.0), (99.0, 0.0), (0.0, 99.0))), (3, pts((0.0, 0.0), (101.0, 0.0))),
            (4, pts((0.0, 0.0), (None, 1.0))), (5, pts((0.0, 0.0), (float("nan"), 1.0))), (6, None), (8, pts((70.7, 70.7)))]
    polys = spark.createDataFrame(rows, "pid int, ring_xy array<struct<pts:array<struct<x:double,y:double>>>>")
    sites = spark.createDataFrame([(1, 0.0, 0.0), (2, None, 0.0)], "location_id int, x double, y double")
    for shape in sj.SHAPES:
        got = sj.radius_join_polygons(sites, polys, 100.0, shape=shape)
        assert sorted(r.pid for r in got.collect()) == [1, 2, 8]
    assert "array_min" in sj.radius_join_polygons(sites, polys, 100.0)._jdf.queryExecution().optimizedPlan().toString()
