"""The quadtree search: exactness on uneven layers, and how few objects a site meets."""
import numpy as np
import pytest
from pyspark.sql import functions as F

from catchment.operators import nearest, spatial_join as sj


def city_and_country(n, seed=3):
    """Nine tenths of the points in one town of 2 km, the others over 600 km."""
    rng = np.random.default_rng(seed)
    town = rng.normal([300_000.0, 300_000.0], 700.0, size=(n * 9 // 10, 2))
    return np.concatenate([town, rng.uniform(0, 600_000.0, size=(n - len(town), 2))])


def brute(sites, pts):
    d = np.sqrt(((sites[:, None, :] - pts[None, :, :]) ** 2).sum(-1))
    at = np.where(np.isclose(d, d.min(1, keepdims=True), atol=1e-9), np.arange(len(pts))[None, :], len(pts)).min(1)
    return at, d.min(1)


def frames(spark, sites, pts):
    s = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(sites)], "location_id int, x double, y double")
    p = spark.createDataFrame([(i, float(x), float(y), "abc"[i % 3]) for i, (x, y) in enumerate(pts)], "pid int, x double, y double, kind string")
    return s, p.repartition(4)


def test_search_equals_brute_force_on_one_city(spark):
    pts = city_and_country(4000)
    pts = np.concatenate([pts, np.repeat(pts[:1], 1500, 0), np.round(pts[:200], -3)])  # one hot spot; a lattice with ties
    rng = np.random.default_rng(9)
    sites = np.concatenate([rng.uniform(-500_000, 1_200_000, size=(60, 2)), pts[:20], np.round(pts[100:130], -3), rng.normal([300_000, 300_000], 3000, size=(40, 2))])
    s, p = frames(spark, sites, pts)
    got = {r.location_id: r for r in sj.nearest_join(s, p, "location_id", "pid").collect()}
    want = brute(sites, pts)
    for i in range(len(sites)):
        assert abs(got[i].d - want[1][i]) < 1e-6 and got[i].pid == want[0][i], i
    by = {(r.location_id, r.kind): r.d for r in sj.nearest_join(s, p, "location_id", "pid", by=["kind"]).collect()}
    for j, kind in enumerate("abc"):
        d = brute(sites, pts[j::3])[1]
        assert all(abs(by[i, kind] - d[i]) < 1e-6 for i in range(len(sites)))
    assert len(by) == 3 * len(sites)


@pytest.mark.parametrize("n", [2000, 20_000])
def test_far_sites_meet_a_bounded_number_of_objects(spark, monkeypatch, n):
    """A site 2,000 km from the layer meets about as many objects of a layer of 20,000 as of one of 2,000."""
    pts = city_and_country(n)
    rng = np.random.default_rng(1)
    sites = np.concatenate([rng.uniform(2_000_000, 2_600_000, size=(30, 2)), rng.uniform(0, 600_000, size=(30, 2)), rng.normal([300_000, 300_000], 700, size=(30, 2))])
    s, p = frames(spark, sites, pts)
    landed = []
    checkpoint = nearest.checkpoint

    def record(df, *args, **kw):
        out = checkpoint(df, *args, **kw)
        landed.append(out[0])
        return out

    monkeypatch.setattr(nearest, "checkpoint", record)
    sj.nearest_join(s, p, "location_id", "pid").collect()
    front = next(f for f in reversed(landed) if "__sx" in f.columns)
    sizes = {}
    for t in landed:
        if "__up" in t.columns:
            sizes |= {r["__node"]: r["n"] for r in t.collect()}
    per_site = {}
    for r in front.collect():
        per_site[r.location_id] = per_site.get(r.location_id, 0) + sizes[r["__node"]]
    assert len(per_site) == len(sites)
    assert max(per_site.values()) <= 20 * nearest.LEAF


def test_polygons_of_all_sizes_and_empty_layers(spark):
    rng = np.random.default_rng(4)
    rows = [(0, "POLYGON ((17 50, 17 53, 22 53, 22 50, 17 50), (18 51, 21 51, 21 52, 18 52, 18 51))")]
    for i in range(1, 200):
        x, y, w = rng.uniform(18, 21), rng.uniform(51, 52), rng.uniform(1e-4, 5e-3)
        rows.append((i, f"POLYGON (({x} {y}, {x + w} {y}, {x + w} {y + w}, {x} {y}))"))
    from catchment.functions import geo
    polys = spark.createDataFrame(rows, "pid int, wkt string").withColumn("ring", geo.wkt_ring(F.col("wkt")))
    sites = geo.with_xy(spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(rng.uniform([17.5, 50.5], [21.5, 52.5], size=(40, 2)))] + [(99, None, None)],
                                              "location_id int, lng double, lat double"), keep_nulls=True)
    got = {r.location_id: r for r in sj.nearest_polygon(sites, polys.select("pid", "ring"), poly_id="pid").collect()}
    xy = polys.withColumn("rxy", geo.ring_to_xy(F.col("ring")))
    want = sites.where("x is not null").join(xy, F.lit(True)).select("location_id", "pid", geo.polygon_distance(F.col("rxy"), F.col("x"), F.col("y")).alias("d"))
    best = {r.location_id: (r.m.pid, r.m.d) for r in want.groupBy("location_id").agg(F.min(F.struct("d", "pid")).alias("m")).collect()}
    for i, (pid, d) in best.items():
        assert got[i].pid == pid and abs(got[i].d - d) < 1e-6
    assert got[99].pid is None and got[99].d is None
    none = sj.nearest_polygon(sites, polys.limit(0).select("pid", "ring"), poly_id="pid").collect()
    assert len(none) == 41 and all(r.pid is None for r in none)
