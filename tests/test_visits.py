"""Signals and users of catchments through tiles equal those of the pairs, which no shuffle carries."""

import random

from pyspark.sql import functions as F

from catchment.operators import features as feat
from catchment.operators import spatial_join as sj
from catchment.operators import visits


def _sites(spark, extra=()):
    rnd = random.Random(1)
    rows = [(i, rnd.uniform(18.9, 19.3), rnd.uniform(50.0, 50.2)) for i in range(60)]
    return spark.createDataFrame([*rows, *extra], "location_id int, lng double, lat double")


def _traces(spark, n, seed=2):
    rnd = random.Random(seed)
    rows = [(i, str(rnd.gauss(50.1, 0.02)), str(rnd.gauss(19.1, 0.04)), "2024-01-05 10:00:00", None if i % 50 == 0 else rnd.randrange(90)) for i in range(n)]
    rows += [(-1, "bad", "19.1", None, 1), (-2, None, "19.1", None, 1)]
    return spark.createDataFrame(rows, "trace_id int, latitude string, longitude string, occured_at string, proxi_user_id int")


def test_visits_equal_those_of_pairs(spark, monkeypatch):
    monkeypatch.setattr(visits, "PART", 300)
    monkeypatch.setattr(visits, "SLICE", 7)
    monkeypatch.setattr(visits, "PAIRS", 1000)
    # ids that come twice at one place, at two places, null ids and places
    sites = _sites(spark, [(1, 19.1, 50.1), (2, 19.1, 50.1), (2, 19.1, 50.1), (90, 19.1, 50.1), (90, 19.1, 50.1), (None, 19.1, 50.1), (91, None, 50.0), (92, 10.0, 40.0)])
    traces = _traces(spark, 4000)
    got = feat.footfall_features(sites, traces, 1500)
    pairs = sj.dwithin_join(sites, traces, 1500).groupBy("location_id").agg(F.count("*").alias("n"), F.count_distinct("proxi_user_id").alias("u"))
    want = sites.select("location_id").join(pairs, "location_id", "left").select("location_id", F.coalesce("n", F.lit(0)), F.coalesce("u", F.lit(0)))
    key = lambda r: str(tuple(r))
    assert sorted(map(tuple, got.collect()), key=key) == sorted(map(tuple, want.collect()), key=key)


def test_no_shuffle_holds_the_pairs(spark):
    """The plan meets pairs only inside the tasks of the tiles: the one join on cells is gone."""
    plan = feat.footfall_features(_sites(spark), _traces(spark, 500), 1500)._jdf.queryExecution().optimizedPlan().toString()
    assert "FlatMapCoGroupsInArrow" in plan and "__cx" not in plan


def test_rollup_equals_that_of_pairs_and_no_shuffle_holds_them(spark, monkeypatch):
    monkeypatch.setattr(visits, "PART", 300)
    monkeypatch.setattr(visits, "PERIOD_SLICE", 7)
    monkeypatch.setattr(visits, "PAIRS", 1000)
    joins = []
    pairs_of = sj.dwithin_join
    monkeypatch.setattr(feat.sj, "dwithin_join", lambda s, *a, **k: joins.append(s.count()) or pairs_of(s, *a, **k))
    day = F.when(F.col("trace_id") % 7 == 0, F.lit(None)).otherwise(F.timestamp_seconds(1704412800 + F.col("trace_id") % 5 * 40000))
    traces = sj.parse_traces(_traces(spark, 4000)).withColumn("ts", day)
    for extra, named in (([], 0), ([(1, 19.1, 50.1), (2, 19.1, 50.1), (2, 19.1, 50.1), (90, 19.1, 50.1), (90, 19.1, 50.1), (None, 19.1, 50.1), (91, None, 50.0), (92, 10.0, 40.0)], 6)):
        sites = _sites(spark, extra)
        rollup = feat.footfall_rollup(sites, traces, 1500)
        assert joins.pop() == named  # rows of null ids and of ids with several places
        got = rollup.select("location_id", "period", "signals", F.hll_sketch_estimate("users"))
        pairs = pairs_of(sites, traces, 1500).where("ts is not null").groupBy("location_id", F.date_trunc("day", "ts").alias("period"))
        want = pairs.agg(F.count("*"), F.count_distinct("proxi_user_id"))
        key = lambda r: str(tuple(r))
        assert sorted(map(tuple, got.collect()), key=key) == sorted(map(tuple, want.collect()), key=key) and want.count() > 20


def test_empty_layers(spark):
    sites = _sites(spark).limit(3)
    assert {tuple(r)[1:] for r in feat.footfall_features(sites, _traces(spark, 50).limit(0), 1500).collect()} == {(0, 0)}
    assert feat.footfall_features(sites.limit(0), _traces(spark, 50), 1500).count() == 0


def test_users_of_the_rollup_meet_no_join(spark):
    """How often a site's signals count goes with the site, so the users of all sites and days aren't shuffled to look it up."""
    import re

    plan = feat.footfall_rollup(_sites(spark), sj.parse_traces(_traces(spark, 200)), 1500)._jdf.queryExecution().optimizedPlan().toString()
    assert "FlatMapCoGroupsInArrow" in plan and not re.search(r"Join Inner, .*location_id", plan)
