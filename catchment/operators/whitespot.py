"""Whitespot filtering, scoring and ranking."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import spatial_join as sj
from .features import catchment_count


def whitespot_filter(cells: DataFrame, stores: DataFrame, competitors: DataFrame, min_own_m: float = 3000.0,
                     r: float = 1500.0, max_competitors: int = 0, cell_id: str = "cell_id",
                     store_id: str = "location_id", comp_id: str = "comp_id") -> DataFrame:
    """Cells at least ``min_own_m`` from every own store and with at most
    ``max_competitors`` competitors inside radius r.

    Returns every cell with its nearest own-store distance, competitor count and
    the two stage flags, so before/after counts come from one pass
    (``whitespot_counts``).
    """
    cx = sj.ensure_xy(cells, keep_nulls=True)
    name = f"competitor_count_{int(r)}m"
    near = sj.nearest_join(cx, sj.ensure_xy(stores), cell_id, store_id, dist_col="nearest_store_m").drop(store_id)
    out = cells.join(near, cell_id, "left")
    if name not in cells.columns:  # a feature matrix has it already
        out = out.join(catchment_count(cx, competitors, r, name, cell_id), cell_id, "left")
    own_ok = F.coalesce(F.col("nearest_store_m") >= F.lit(float(min_own_m)), F.lit(True))
    return out.withColumns({
        "far_from_own": own_ok,
        "whitespot": own_ok & (F.col(name) <= F.lit(max_competitors)),
    })


def whitespot_counts(flagged: DataFrame) -> DataFrame:
    """Cells before filtering, after the own-store filter, after both."""
    return flagged.agg(
        F.count("*").alias("cells"),
        F.count_if("far_from_own").alias("after_own_filter"),
        F.count_if("whitespot").alias("after_both"),
    )


def score(df: DataFrame, col: str = "prediction", name: str = "score") -> DataFrame:
    """Min-max score 0-100 over the given set, 1 dp half-even; NULL when max = min."""
    st = df.agg(F.min(col).alias("lo"), F.max(col).alias("hi"))
    lo, hi = st.select("lo").scalar(), st.select("hi").scalar()
    return df.withColumn(name, F.bround(F.try_divide((F.col(col) - lo) * 100.0, hi - lo), 1))


def rank_candidates(df: DataFrame, k: int = 10, by: str = "score", tie: str = "cell_id") -> DataFrame:
    """Top-k candidates (ties keep the lowest id) with all their columns."""
    return df.orderBy(F.desc(by), F.asc(tie)).limit(k)
