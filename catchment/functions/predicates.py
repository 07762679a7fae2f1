"""Predicates and scalar functions (B7-B22) as Columns.

Filters are Columns, never interpolated SQL text, so Catalyst can push them
into the scan (and prune partitions when traces are landed by date).
"""

from __future__ import annotations

import datetime as _dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _c(v) -> Column:
    return v if isinstance(v, Column) else F.col(v)


def bbox_filter(df: DataFrame, bbox: dict, lng="lng", lat="lat") -> DataFrame:
    """Points of a layer inside the bbox (inclusive)."""
    return df.where(in_bbox(bbox, lng, lat))


def in_bbox(bbox: dict, lng="lng", lat="lat") -> Column:
    return _c(lat).between(F.lit(bbox["lat_min"]), F.lit(bbox["lat_max"])) & _c(lng).between(
        F.lit(bbox["lng_min"]), F.lit(bbox["lng_max"]))


def overlaps_bbox(bounds: dict[str, Column], bbox: dict) -> Column:
    """A polygon's bounds (``geo.ring_bounds``) and the bbox have a point in common."""
    return ((bounds["min_lng"] <= F.lit(bbox["lng_max"])) & (bounds["max_lng"] >= F.lit(bbox["lng_min"]))
            & (bounds["min_lat"] <= F.lit(bbox["lat_max"])) & (bounds["max_lat"] >= F.lit(bbox["lat_min"])))


def bbox_pred(bbox: dict, lat="latitude", lng="longitude") -> Column:
    """Bbox on text coordinates; unparseable text is NULL and falls out."""
    return in_bbox(bbox, _c(lng).try_cast("double"), _c(lat).try_cast("double"))


def month_pred(year: int, month: int, ts="occured_at") -> Column:
    """Half-open month range on a text timestamp (NULL on bad text, T2).

    The range form (not ``year(ts) = y AND month(ts) = m``) lets a typed,
    date-partitioned landing table prune partitions.
    """
    start = _dt.datetime(year, month, 1)
    end = _dt.datetime(year + (month == 12), month % 12 + 1, 1)
    t = F.try_to_timestamp(_c(ts))
    # Bounds are parsed like the data (session time zone), not converted from Python.
    lo = F.to_timestamp(F.lit(start.strftime("%Y-%m-%d %H:%M:%S")))
    hi = F.to_timestamp(F.lit(end.strftime("%Y-%m-%d %H:%M:%S")))
    return (t >= lo) & (t < hi)


def base_filter(bbox: dict, year: int, month: int) -> Column:
    """Bbox AND month."""
    return bbox_pred(bbox) & month_pred(year, month)


def flag_in(col, values: Sequence) -> Column:
    """1 if col in values else 0; NULL -> 0."""
    return F.coalesce(_c(col).isin(list(values)).cast("int"), F.lit(0))


def flag_eq(col, value) -> Column:
    return F.coalesce((_c(col) == F.lit(value)).cast("int"), F.lit(0))


def isclose(a, b, atol: float = 1e-8, rtol: float = 1e-5) -> Column:
    """|a - b| <= atol + rtol*|b|; NULL/NaN compare false."""
    a, b = _c(a), _c(b)
    ok = F.abs(a - b) <= F.lit(atol) + F.lit(rtol) * F.abs(b)
    return F.coalesce(ok & ~F.isnan(a) & ~F.isnan(b), F.lit(False))


def isclose_audit(df: DataFrame, a, b, atol: float, rtol: float = 1e-5) -> DataFrame:
    """Matches / mismatches / share of rows where a is close to b (one pass)."""
    ok = isclose(a, b, atol, rtol)
    return df.agg(
        F.count_if(ok).alias("matches"),
        F.count_if(~ok).alias("mismatches"),
        F.count("*").alias("total"),
    ).withColumn("match_pct", F.bround(F.col("matches") * 100.0 / F.col("total"), 1))


def count_violations(df: DataFrame, pred: Column, name: str = "violations") -> DataFrame:
    """Rows violating an identity (e.g. total != male + female)."""
    return df.agg(F.count_if(pred).alias(name))


def log_target(col) -> Column:
    """B17."""
    return F.log(_c(col))


def signals_per_user(signals, users) -> Column:
    """Signals / users; 0/0 is NULL (documented divergence from NaN)."""
    return F.try_divide(_c(signals).cast("double"), _c(users).cast("double"))


def date_parts(ts) -> dict[str, Column]:
    """Year, month, hour, weekday with Sunday = 0, three-letter day name."""
    ts = _c(ts)
    return {
        "year": F.year(ts),
        "month": F.month(ts),
        "hour": F.hour(ts),
        "day_num": F.dayofweek(ts) - 1,
        "day_of_week": F.date_format(ts, "EEE"),
    }
