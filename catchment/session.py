"""Session helpers: builder defaults and the shared checkpoint folder."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

def build_session(master: str | None = None, shuffle_partitions: int | None = None, app: str = "catchment") -> SparkSession:
    """A session with AQE (coalesce + skew join) on and a UTC clock.

    On a cluster the master and sizes come from spark-submit; only the local
    fallback sets them here.
    """
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    b = (
        b.config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    The cluster's setting always wins. Only a local-mode session without one
    (tests) gets a fresh temporary folder.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    conf = spark.conf.get("spark.checkpoint.dir", None)
    if conf:
        sc.setCheckpointDir(conf)
        return sc.getCheckpointDir()
    if not sc.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
    path = tempfile.mkdtemp(prefix="catchment-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
    sc.setCheckpointDir(path)
    return sc.getCheckpointDir()


def deal(df: DataFrame) -> DataFrame:
    """``df`` dealt to all cores if it comes in few splits: what follows takes longer than the read."""
    tasks = 2 * df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(tasks) if df.rdd.getNumPartitions() < tasks else df


@contextmanager
def own_shuffles(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of what is written inside go once it is written; the session's setting comes back after it."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def discard(df: DataFrame) -> None:
    """Delete the files of a table from ``checkpoint`` that nothing reads any more."""
    path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._landed)
    path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def checkpoint(df: DataFrame, observe: dict | None = None) -> tuple[DataFrame, dict]:
    """Cut lineage by writing ``df`` as Parquet under the shared checkpoint folder.

    One job (``DataFrame.checkpoint`` runs two and recomputes the plan for the
    second); the result survives executor loss because it is a file in the
    shared folder. ``observe`` maps names to aggregate Columns evaluated on the
    same pass (``DataFrame.observe``), returned as a dict.
    """
    from pyspark.sql import Observation

    spark = df.sparkSession
    base = ensure_checkpoint_dir(spark).rstrip("/")
    path = f"{base}/tables/{uuid.uuid4().hex}"
    metrics: dict = {}
    if observe:
        obs = Observation(f"ckpt_{uuid.uuid4().hex[:8]}")
        df = df.observe(obs, *[c.alias(k) for k, c in observe.items()])
    with own_shuffles(spark):
        df.write.mode("overwrite").parquet(path)
    if observe:
        metrics = obs.get
    out = spark.read.parquet(path)
    out._landed = path  # for ``discard``
    return out, metrics
