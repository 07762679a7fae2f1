"""Scans and sinks (A1-A12): Spark readers and writers with fixed schemas.

Schemas are explicit (an inferred schema costs an extra scan). Scratch output
goes to the shared checkpoint folder named by the session, never a
machine-local temporary folder.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions import geo
from ..session import ensure_checkpoint_dir, own_shuffles


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared checkpoint folder."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/scratch/{name}-{uuid.uuid4().hex}"


def read_points(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """A1: point-layer CSV with header, UTF-8, doubled-quote escapes."""
    return (spark.read.schema(schema).option("header", True).option("escape", '"')
            .option("encoding", "UTF-8").option("mode", "PERMISSIVE").csv(path))


def read_polygons(spark: SparkSession, path: str, schema: StructType | str, geometry: str = "geometry") -> DataFrame:
    """A2: polygon-layer CSV; the WKT column is parsed to a ring."""
    return read_points(spark, path, schema).withColumn("ring", geo.wkt_ring(F.col(geometry)))


def read_csv_gz(spark: SparkSession, uri: str, schema: StructType | str, partitions: int | None = None,
                land_to: str | None = None) -> DataFrame:
    """A3: gzip CSV from an object store (s3a://, gs://, abfs:// or file:).

    gzip does not split, so each file is one task: repartition after the scan
    and, with ``land_to``, land it once as Parquet and read that back.
    """
    df = read_points(spark, uri, schema)
    if partitions:
        df = df.repartition(partitions)
    if land_to:
        df.write.mode("overwrite").parquet(land_to)
        df = spark.read.parquet(land_to)
    return df


def list_objects(spark: SparkSession, glob: str) -> DataFrame:
    """A4: objects under a glob with their sizes; file contents are pruned."""
    return spark.read.format("binaryFile").load(glob).select("path", "length", "modificationTime")


def read_warehouse(spark: SparkSession, table: str | None = None, query: str | None = None,
                   options: dict | None = None) -> DataFrame:
    """A5: a warehouse table or query as a DataFrame.

    ``options['format']`` selects the connector (``jdbc`` by default; a
    warehouse's own Spark connector name also works). Credentials come from the
    caller's options or the environment (``WAREHOUSE_URL``, ``WAREHOUSE_USER``,
    ``WAREHOUSE_PASSWORD``). ``format='parquet'`` reads a landed copy at
    ``options['path']`` (offline stand-in). Filters and projections applied to
    the result are pushed into the source by Spark.
    """
    opts = dict(options or {})
    fmt = opts.pop("format", "jdbc")
    if fmt == "parquet":
        return spark.read.parquet(opts["path"])
    r = spark.read.format(fmt)
    if fmt == "jdbc":
        opts.setdefault("url", os.environ.get("WAREHOUSE_URL", ""))
        if os.environ.get("WAREHOUSE_USER"):
            opts.setdefault("user", os.environ["WAREHOUSE_USER"])
        if os.environ.get("WAREHOUSE_PASSWORD"):
            opts.setdefault("password", os.environ["WAREHOUSE_PASSWORD"])
    if query is not None:
        opts["query"] = query
    elif table is not None:
        opts["dbtable"] = table
    return r.options(**opts).load()


def read_layer(spark: SparkSession, path: str) -> DataFrame:
    """Parquet layer (column pruning and row-group skipping come free)."""
    return spark.read.parquet(path)


def write_layer(df: DataFrame, path: str, partition_by: list[str] | None = None, mode: str = "overwrite") -> None:
    """Parquet layer, optionally partitioned (e.g. traces by date)."""
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)


def hilbert(x: Column, y: Column, bits: int = 16) -> Column:
    """Place on the Hilbert curve of two cell numbers of ``bits`` bits: near places on the curve are near in the plane."""
    n = 1 << bits

    def step(state: Column, i: Column) -> Column:
        s = F.element_at(F.array(*[F.lit(n >> (k + 1)).cast("long") for k in range(bits)]), i)
        right, up = (state["x"].bitwiseAND(s) > 0), (state["y"].bitwiseAND(s) > 0)
        quarter = F.when(right, F.when(up, 2).otherwise(3)).otherwise(F.when(up, 1).otherwise(0)).cast("long")
        flip = right & ~up
        fx, fy = F.when(flip, n - 1 - state["x"]).otherwise(state["x"]), F.when(flip, n - 1 - state["y"]).otherwise(state["y"])
        return F.struct(F.when(up, fx).otherwise(fy).alias("x"), F.when(up, fy).otherwise(fx).alias("y"), (state["d"] + s * s * quarter).alias("d"))

    start = F.struct(x.cast("long").alias("x"), y.cast("long").alias("y"), F.lit(0).cast("long").alias("d"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(bits)), start, step)["d"]


def write_traces(traces: DataFrame, path: str, bbox: dict, files: int, lng: str = "lng", lat: str = "lat", ts: str = "ts") -> None:
    """Typed traces partitioned by month, in each month ranged and sorted along a Hilbert curve over ``bbox``.

    A month predicate prunes folders, and a bbox or catchment filter skips files
    and row groups by their statistics, since a file covers a compact patch. About ``files`` files in all;
    a hot month is ranged over many tasks like any other. Traces without a place come first, those without a time are in a month of NULL.
    """
    def cell(c: str, low: float, high: float) -> Column:
        v = F.floor((F.col(c) - low) / (high - low) * 65536)
        return F.coalesce(F.least(F.greatest(v, F.lit(0)), F.lit(65535)), F.lit(0))

    key = hilbert(cell(lng, bbox["lng_min"], bbox["lng_max"]), cell(lat, bbox["lat_min"], bbox["lat_max"]))
    month = (F.year(ts) * 100 + F.month(ts)).alias("month")
    keyed = traces.withColumns({"month": month, "__h": key})
    keyed.repartitionByRange(files, "month", "__h").sortWithinPartitions("month", "__h").drop("__h").write.mode("overwrite").partitionBy("month").parquet(path)


def write_csv(df: DataFrame, path: str, mode: str = "overwrite", compression: str | None = None) -> None:
    """CSV with header."""
    w = df.write.mode(mode).option("header", True).option("escape", '"')
    if compression:
        w = w.option("compression", compression)
    w.csv(path)


def save_bbox(df_bbox: DataFrame, path: str) -> None:
    """One-row bbox (lng_min, lat_min, lng_max, lat_max) as JSON."""
    df_bbox.coalesce(1).write.mode("overwrite").json(path)


def load_bbox(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("lng_min double, lat_min double, lng_max double, lat_max double").json(path)


def files_state(spark: SparkSession, *paths: str) -> str:
    """A name for the present state of all files under ``paths``: changes with any path, size or time of change.

    One aggregate over the file listing; contents are not read.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(list(paths))
    h = F.xxhash64("path", "length", "modificationTime").cast("decimal(38,0)")
    n, total = files.agg(F.count("*"), F.coalesce(F.sum(h), F.lit(0))).first()
    return f"{n}-{int(total) % (1 << 64):016x}"


def _complete(spark: SparkSession, path: str) -> bool:
    """Whether a finished table lies at ``path`` (Spark's readers fail on a missing folder instead)."""
    done = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path + "/_SUCCESS")
    return done.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(done)


def materialize(spark: SparkSession, build: Callable[[], DataFrame], path: str, inputs: Sequence[str] = ()) -> DataFrame:
    """A10: compute once: read what was built at ``path``, else build, write, read.

    Each build is written to a folder of its own below ``path`` and becomes
    valid by a one-row table that names it, written last; a build that was cut
    off is never read. With ``inputs`` (paths of the files that the build
    reads) it is valid only while their paths, sizes and times of change stay
    as they were.
    """
    state = files_state(spark, *inputs) if inputs else "any"
    mark = f"{path}/valid-{state}"
    if _complete(spark, mark):
        part = spark.read.schema("part string").parquet(mark).first()["part"]
    else:
        part = f"{path}/{uuid.uuid4().hex}"
        table = build()
        with own_shuffles(spark):
            table.write.parquet(part)
        spark.createDataFrame([(part,)], "part string").coalesce(1).write.mode("overwrite").parquet(mark)
    return spark.read.parquet(part)


def preview(df: DataFrame, n: int = 5, order_by: list[str] | None = None) -> DataFrame:
    """First n rows (ordered, so the result is deterministic)."""
    return (df.orderBy(*order_by) if order_by else df).limit(n)


def save_model(model, path: str) -> None:
    """Persist a fitted Spark ML model / pipeline."""
    model.write().overwrite().save(path)


def load_model(path: str):
    from pyspark.ml import PipelineModel
    return PipelineModel.load(path)
