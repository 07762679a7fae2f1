"""Typed layers for one scale-factor directory, built lazily from the driver tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import cached_property

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geo
from ..operators import features as feat
from ..operators import spatial_join as sj
from ..session import deal, ensure_checkpoint_dir
from ..sources import fixtures as fx
from ..sources import io

BBOX = fx.BBOX
# Traces of the driver data span January 2024 (the reference filters July 2020).
YEAR, MONTH = 2024, 1
RADIUS = 1500.0


class Layers:
    """All layers of one scale factor.

    Layers that joins read more than once (projected points, parsed polygons)
    are landed in the checkpoint folder under the state of the input files
    (their paths, sizes and times of change), so that joins read stored
    columns: a query finds what an earlier one landed, and lands anew once a
    file has changed. They are dealt to all cores, since a join's tasks follow
    the splits of the larger side. Nothing is kept in the Python process.
    """

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return fx.table(self.spark, self.sf_dir, name)

    @cached_property
    def folder(self) -> str:
        """The folder of what is landed from the present state of the input files."""
        return f"{ensure_checkpoint_dir(self.spark).rstrip('/')}/layers/{io.files_state(self.spark, self.sf_dir)}"

    def land(self, name: str, build: Callable[[], DataFrame]) -> DataFrame:
        return io.materialize(self.spark, build, f"{self.folder}/{name}")

    def result(self, name: str, build: Callable[[], DataFrame]) -> DataFrame:
        """As ``land``, for what queries compute from the layers; `catchment.run` keeps runs apart (bench.py)."""
        return self.land(f"results-{self.spark.conf.get('catchment.run', 'all')}/{name}", build)

    def model(self, name: str, fit: Callable[[], PipelineModel]) -> PipelineModel:
        """A model fitted and saved once for the present state of the input files."""

        def saved() -> DataFrame:
            path = f"{self.folder}/models/{name}-{uuid.uuid4().hex}"
            io.save_model(fit(), path)
            return self.spark.createDataFrame([(path,)], "path string")

        return io.load_model(self.result(name, saved).first()["path"])

    @cached_property
    def stores(self) -> DataFrame:
        return fx.stores(self.spark, self.sf_dir)

    @cached_property
    def stores_xy(self) -> DataFrame:
        return self.land("stores_xy", lambda: geo.with_xy(self.stores, keep_nulls=True))

    @cached_property
    def poi(self) -> DataFrame:
        return fx.poi(self.spark, self.sf_dir)

    @cached_property
    def poi_xy(self) -> DataFrame:
        return self.land("poi_xy", lambda: geo.with_xy(deal(self.poi)))

    @cached_property
    def competitors(self) -> DataFrame:
        return fx.competitors(self.spark, self.sf_dir)

    @cached_property
    def competitors_xy(self) -> DataFrame:
        return self.land("competitors_xy", lambda: geo.with_xy(deal(self.competitors)))

    @cached_property
    def addresses(self) -> DataFrame:
        return fx.addresses(self.spark, self.sf_dir)

    @cached_property
    def addresses_xy(self) -> DataFrame:
        return self.land("addresses_xy", lambda: geo.with_xy(deal(self.addresses)))

    @cached_property
    def traces(self) -> DataFrame:
        return fx.traces(self.spark, self.sf_dir)

    @cached_property
    def traces_xy(self) -> DataFrame:
        """Typed traces: parsed coordinates and time next to the text columns, projected once."""
        return self.land("traces_xy", lambda: geo.with_xy(sj.parse_traces(deal(self.traces))))

    @cached_property
    def buildings(self) -> DataFrame:
        return self.land("buildings", lambda: feat.prepare_buildings(fx.buildings(self.spark, self.sf_dir), land=False))

    @cached_property
    def districts(self) -> DataFrame:
        return self.land("districts", lambda: fx.districts(self.spark, self.sf_dir).withColumn("ring", geo.wkt_ring(F.col("geometry"))))

    @cached_property
    def area(self) -> DataFrame:
        return fx.area(self.spark).withColumn("ring", geo.wkt_ring(F.col("geometry")))
