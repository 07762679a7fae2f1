"""Landed layers follow the input files."""
import os
import shutil

import pytest

import __spark_entry__ as E
from catchment.sources import io
from tests.oracle_harness import compare, duck

ROOT = "/root/testdata"
pytestmark = pytest.mark.skipif(not os.path.exists(ROOT), reason="driver test data not present")


def test_answers_follow_files_replaced_within_a_session(spark, tmp_path):
    d = str(tmp_path / "sf")
    shutil.copytree(f"{ROOT}/sf0.001", d)
    run, sql = E.queries()["radius_join"], E.oracle_sql()["radius_join"]
    first = compare(spark, duck(d), "radius_join", run, sql, d)
    for t in ("customer", "part", "supplier"):
        os.chmod(f"{d}/{t}.parquet", 0o644)
        shutil.copyfile(f"{ROOT}/sf0.01/{t}.parquet", f"{d}/{t}.parquet")
    second = compare(spark, duck(d), "radius_join", run, sql, d)
    assert first["ok"] and second["ok"], (first, second)
    assert second["rows"] > first["rows"]


def test_materialize_builds_once_and_again_after_a_change(spark, tmp_path):
    src, out = str(tmp_path / "src"), str(tmp_path / "out")
    spark.range(3).write.parquet(src)
    built = []

    def build():
        built.append(1)
        return spark.read.parquet(src)

    assert io.materialize(spark, build, out, [src]).count() == 3
    assert io.materialize(spark, build, out, [src]).count() == 3 and len(built) == 1
    spark.range(5).write.mode("overwrite").parquet(src)
    assert io.materialize(spark, build, out, [src]).count() == 5 and len(built) == 2


def test_trace_files_hold_compact_patches(spark, tmp_path):
    import datetime
    import numpy as np
    import pyarrow.parquet as pq
    from pyspark.sql import functions as F

    rng = np.random.default_rng(2)
    n = 6000
    rows = [(i, float(a), float(b), datetime.datetime(2024, 1 + i % 2, 5)) for i, (a, b) in enumerate(rng.uniform([18.0, 50.0], [20.0, 52.0], size=(n, 2)))]
    df = spark.createDataFrame([*rows, (n, None, None, None)], "id int, lng double, lat double, ts timestamp").repartition(5)
    out = str(tmp_path / "traces")
    io.write_traces(df, out, {"lng_min": 18.0, "lat_min": 50.0, "lng_max": 20.0, "lat_max": 52.0}, 32)
    back = spark.read.parquet(out)
    assert back.count() == n + 1 and back.where("month is null").count() == 1
    files = [f for f in tmp_path.rglob("*.parquet") if "month=2024" in str(f)]
    assert len(files) >= 30
    hit = 0
    for f in files:
        meta = pq.ParquetFile(f).metadata
        stats = {meta.row_group(0).column(c).path_in_schema: meta.row_group(0).column(c).statistics for c in range(meta.num_columns)}
        hit += stats["lng"].min <= 18.4 and stats["lat"].min <= 50.4
    # the box is 4 % of the plane; a file's patch reaches beyond it, most files don't
    assert hit <= len(files) * 0.25
    box = back.where("lng <= 18.4 and lat <= 50.4 and month = 202401")
    assert box.count() == sum(1 for r in rows if r[1] <= 18.4 and r[2] <= 50.4 and r[3].month == 1)
    plan = box._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(lng), IsNotNull(lat), LessThanOrEqual(lng,18.4)" in plan and "PartitionFilters: [isnotnull(month" in plan


def test_hilbert_neighbours_are_one_step_apart(spark):
    from pyspark.sql import functions as F
    from catchment.sources.io import hilbert

    grid = spark.range(256).select((F.col("id") % 16).alias("x"), F.floor(F.col("id") / 16).alias("y"))
    cells = sorted((r.d, r.x, r.y) for r in grid.withColumn("d", hilbert(F.col("x"), F.col("y"), 4)).collect())
    assert [d for d, _, _ in cells] == list(range(256))
    assert all(abs(a[1] - b[1]) + abs(a[2] - b[2]) == 1 for a, b in zip(cells, cells[1:]))
