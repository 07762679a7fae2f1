"""Catchment sums through cells give the sums over the pairs, and stay far from their number."""

import random

import pytest
from pyspark.sql import functions as F

from catchment.operators import features as feat
from catchment.operators import spatial_join as sj
from catchment.operators import sums


def _points(spark, n, seed, extra=()):
    rnd = random.Random(seed)
    rows = [(i, rnd.gauss(0, 900) if i % 2 else rnd.uniform(-4000, 4000), rnd.uniform(-4000, 4000), "ab"[i % 2] if i % 5 else None) for i in range(n)]
    return spark.createDataFrame([*rows, *extra], "id int, x double, y double, category string").repartition(3)


ODD = [(-1, None, 0.0, "a"), (-2, float("nan"), 0.0, "a"), (-3, 0.0, float("inf"), "b")] + [(-4 - i, 10.0, 20.0, "a") for i in range(200)]


@pytest.mark.parametrize("shape", ["circle", "polygon64"])
def test_sums_equal_those_of_pairs(spark, shape):
    # ids come twice, one site lies at a point, one has no place
    sites = spark.createDataFrame([(1, 0.0, 0.0), (1, 500.0, 0.0), (2, 10.0, 20.0), (3, 1010.0, 20.0), (4, None, 1.0), (5, 1e6, 1e6), (None, 0.0, 0.0)],
                                  "location_id int, x double, y double")
    points = _points(spark, 3000, 7, ODD)
    got = sums.radius_sums(sites, points, 1000.0, {"n": F.lit(1), "total": F.col("id")}, by=["category"], shape=shape)
    want = sj.radius_join(sites, points, 1000.0, shape=shape).groupBy("location_id", "category").agg(F.count("*").alias("n"), F.sum("id").alias("total"))
    key = lambda r: str(tuple(r))
    assert sorted(got.collect(), key=key) == sorted(want.collect(), key=key)


def test_polygon_sums_equal_those_of_pairs(spark):
    sites = _points(spark, 40, 3).select(F.col("id").alias("location_id"), "x", "y")
    corners = [(-1, -1), (1, -1), (1, 1), (-1, 1), (-1, -1)]
    side = 5 + F.col("id") % 300
    pts = F.array(*[F.struct((F.col("x") + i * side).alias("x"), (F.col("y") + j * side).alias("y")) for i, j in corners])
    polys = _points(spark, 2000, 5, ODD[:1]).select("category", F.array(F.struct(F.lit(False).alias("hole"), pts.alias("pts"))).alias("ring_xy"))
    got = sums.polygon_sums(sites, polys, 1200.0, {"n": F.lit(1), "a": (F.col("category") == "a").cast("int")})
    want = sj.radius_join_polygons(sites, polys, 1200.0).groupBy("location_id").agg(F.count("*").alias("n"), F.sum((F.col("category") == "a").cast("int")).alias("a"))
    assert sorted(got.collect()) == sorted(want.collect())


def test_inner_objects_are_not_tested_one_by_one(spark, monkeypatch):
    """Only objects in cells on the edge meet the exact test: a third of the pairs at most."""
    met = spark.sparkContext.accumulator(0)
    seen = F.udf(lambda x: met.add(1) or True, "boolean")
    sites = spark.createDataFrame([(i, 100.0 * i, 0.0) for i in range(5)], "location_id int, x double, y double")
    points = spark.range(40_000).select(((F.col("id") % 200) * 20 - 2000.0).alias("x"), (F.floor(F.col("id") / 200) * 20 - 2000.0).alias("y"))
    monkeypatch.setattr(sums, "in_catchment", lambda dx, dy, r, shape: sj.in_catchment(dx, dy, r, shape) & seen(dx))
    got = sums.radius_sums(sites, points, 1000.0, {"n": F.lit(1)}).agg(F.sum("n")).first()[0]
    assert got == sj.radius_join(sites, points, 1000.0).count()
    assert met.value < got / 3


def test_layer_in_one_split_is_parsed_by_all_cores(spark):
    one = spark.createDataFrame([(i, f"POLYGON (({i % 5} 50, 19 50, 19 51, {i % 5} 50))") for i in range(100)], "id int, geometry string").coalesce(1)
    assert feat.prepare_buildings(one, land=False).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism


def test_a_polygon_is_parsed_once(spark):
    """The parsed rings are used by several tests, but each text is split into rings in one place of the plan only."""
    from catchment.functions import geo

    texts = ["POLYGON ((1 2, 3 4, 5 6, 1 2))", None, "POINT (1 2)", " multipolygon  (((1 2,3 4,1 2),(0 0, 1 1,0 0)),((5 5,6 6,5 5)))", "POLYGON ((1 x, 2 3))", "POLYGON EMPTY"]
    df = spark.createDataFrame([(t,) for t in texts], "g string").select(geo.wkt_ring("g").alias("ring"))
    assert df._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract_all") == 1
    assert [None if r.ring is None else [(x.hole, len(x.pts)) for x in r.ring] for r in df.collect()] == [
        [(False, 4)], None, None, [(False, 3), (True, 3), (False, 3)], None, None]


def test_points_of_one_split_are_landed_for_all_cores(spark, tmp_path):
    """A radius join's tasks follow the splits of the points, so one split must not become one task."""
    from catchment.plans.layers import Layers

    parts = spark.range(400).select(F.col("id").alias("p_partkey"), F.lit("A").alias("p_type"), F.lit("b").alias("p_name"))
    parts.coalesce(1).write.parquet(str(tmp_path / "part.parquet"))
    landed = Layers(spark, str(tmp_path)).poi_xy
    assert len(landed.inputFiles()) >= spark.sparkContext.defaultParallelism
    assert sorted(r[0] for r in landed.select("poi_id").collect()) == list(range(400))


def test_only_sums_stay_on_disk(spark):
    """Objects, cells and fronts of the levels are deleted once the next level stands."""
    import os

    from catchment.session import ensure_checkpoint_dir

    folder = ensure_checkpoint_dir(spark).removeprefix("file:") + "/tables"
    before = set(os.listdir(folder)) if os.path.isdir(folder) else set()
    points = spark.range(900).select((F.col("id") % 30 * 20.0).alias("x"), (F.floor(F.col("id") / 30) * 20.0).alias("y"))
    sites = spark.createDataFrame([(i, 40.0 * i, 300.0) for i in range(12)], "location_id int, x double, y double")
    got = sums.radius_sums(sites, points, 250.0, {"n": F.lit(1)})
    landed = [spark.read.parquet(f"{folder}/{d}").columns for d in set(os.listdir(folder)) - before]
    assert len(landed) > 1 and all(c == ["__site", "n"] for c in landed)
    want = {i: sum((20.0 * a - 40.0 * i) ** 2 + (20.0 * b - 300.0) ** 2 < 250.0**2 for a in range(30) for b in range(30)) for i in range(12)}
    assert {r.location_id: r.n for r in got.collect()} == want
