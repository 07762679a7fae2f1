"""Grid rewrites equal brute force on random layers."""
import math

import numpy as np
from pyspark.sql import functions as F

from catchment.functions import geo
from catchment.operators import spatial_join as sj
from catchment.operators import whitespot as ws


def _layer(spark, n, seed, name):
    rng = np.random.default_rng(seed)
    lng = 18.54 + rng.random(n) * 1.58
    lat = 49.96 + rng.random(n) * 0.52
    rows = [(int(i), float(a), float(b)) for i, (a, b) in enumerate(zip(lng, lat))]
    return geo.with_xy(spark.createDataFrame(rows, f"{name} long, lng double, lat double"))


def test_radius_join_equals_brute_force(spark):
    sites, pts = _layer(spark, 40, 1, "location_id"), _layer(spark, 3000, 2, "pid")
    for r in (500.0, 3000.0, 9000.0):
        got = {(a, b) for a, b in sj.radius_join(sites, pts, r).select("location_id", "pid").collect()}
        s, p = sites.toPandas(), pts.toPandas()
        want = {(int(i), int(j)) for i, sx, sy in zip(s.location_id, s.x, s.y)
                for j, px, py in zip(p.pid, p.x, p.y) if (px - sx) ** 2 + (py - sy) ** 2 < r * r}
        assert got == want


def test_nearest_join_equals_brute_force(spark):
    sites, pts = _layer(spark, 60, 3, "location_id"), _layer(spark, 25, 4, "pid")
    got = {a: (b, d) for a, b, d in sj.nearest_join(sites, pts, "location_id", "pid").select("location_id", "pid", "d").collect()}
    s, p = sites.toPandas(), pts.toPandas()
    for i, sx, sy in zip(s.location_id, s.x, s.y):
        d = [(math.hypot(px - sx, py - sy), j) for j, px, py in zip(p.pid, p.x, p.y)]
        dmin, jmin = min(d)
        assert got[i][0] == jmin and abs(got[i][1] - dmin) < 1e-6


def test_nearest_join_empty_layer_gives_null(spark):
    sites = _layer(spark, 5, 5, "location_id")
    empty = sites.where("false").withColumnRenamed("location_id", "pid")
    rows = sj.nearest_join(sites, empty, "location_id", "pid").collect()
    assert len(rows) == 5 and all(r["d"] is None for r in rows)


def test_count_monotone_in_radius(spark):
    sites, pts = _layer(spark, 20, 6, "location_id"), _layer(spark, 500, 7, "pid")
    prev = None
    for r in (1000.0, 2000.0, 4000.0):
        c = dict(sj.radius_join(sites, pts, r).groupBy("location_id").count().collect())
        if prev is not None:
            assert all(c.get(k, 0) >= v for k, v in prev.items())
        prev = c


def test_point_in_polygon_square(spark):
    poly = spark.createDataFrame([(1, "POLYGON ((19 50, 19.5 50, 19.5 50.3, 19 50.3, 19 50))")], "pid int, geometry string")
    poly = poly.withColumn("ring", geo.wkt_ring("geometry"))
    pts = spark.createDataFrame([(1, 19.2, 50.1), (2, 19.6, 50.1), (3, 18.9, 50.2)], "id int, lng double, lat double")
    inside = {r.id for r in sj.inside(pts, poly.select("ring")).collect()}
    assert inside == {1}


def test_score_range(spark):
    df = spark.range(50).select(F.col("id").alias("cell_id"), (F.col("id") * 7 % 13).cast("double").alias("prediction"))
    s = ws.score(df).agg(F.min("score"), F.max("score")).first()
    assert s[0] == 0.0 and s[1] == 100.0


def test_inverse_projection_roundtrip(spark):
    pts = _layer(spark, 200, 8, "pid")
    back = geo.with_lnglat(pts.select("pid", "x", "y").withColumnRenamed("pid", "id"), lng="lng2", lat="lat2")
    j = back.join(pts.withColumnRenamed("pid", "id"), "id")
    err = j.agg(F.max(F.abs(F.col("lng") - F.col("lng2"))), F.max(F.abs(F.col("lat") - F.col("lat2")))).first()
    assert err[0] < 1e-9 and err[1] < 1e-9
