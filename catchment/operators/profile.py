"""Table profiling (D6-D28, E1-E5) on built-in aggregates.

Global parameters (min/max, quartiles, totals) are scalar subqueries
(``DataFrame.scalar()``): Spark evaluates them once and inlines the value, so
no cross join and no driver round trip. Skewness and kurtosis are converted
from Spark's population forms to pandas' bias-corrected ones (T5).
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import predicates as P
from ..operators import overlay
from ..operators import spatial_join as sj
from ..session import checkpoint


def row_count(df: DataFrame, pred: Column | None = None, name: str = "n") -> DataFrame:
    """D6."""
    return (df.where(pred) if pred is not None else df).agg(F.count("*").alias(name))


def distinct_count(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Exact distinct count per column, one pass."""
    return df.agg(*[F.count_distinct(c).alias(f"distinct_{c}") for c in cols])


def time_extent(df: DataFrame, ts: Column) -> DataFrame:
    """Earliest and latest parseable timestamp."""
    return df.agg(F.min(ts).alias("earliest"), F.max(ts).alias("latest"))


def monthly_counts(df: DataFrame, ts: Column) -> DataFrame:
    """Signals per (year, month), most first."""
    return df.groupBy(F.year(ts).alias("year"), F.month(ts).alias("month")).agg(
        F.count("*").alias("signals")).orderBy(F.desc("signals"), "year", "month")


def hourly_counts(df: DataFrame, ts: Column) -> DataFrame:
    """D11."""
    return df.groupBy(F.hour(ts).alias("hour")).agg(F.count("*").alias("signals")).orderBy(F.desc("signals"), "hour")


def weekday_counts(df: DataFrame, ts: Column) -> DataFrame:
    """Sunday = 0, three-letter names (T4)."""
    p = P.date_parts(ts)
    return df.groupBy(p["day_num"].alias("day_num"), p["day_of_week"].alias("day_of_week")).agg(
        F.count("*").alias("signals")).orderBy("day_num")


def source_counts(df: DataFrame, col: str = "app_id") -> DataFrame:
    """D13."""
    return df.groupBy(col).agg(F.count("*").alias("signals")).orderBy(F.desc("signals"), col)


def top_share(df: DataFrame, col: str = "app_id") -> DataFrame:
    """Share of rows from the most frequent value (max(cnt) / sum(cnt))."""
    c = df.groupBy(col).agg(F.count("*").alias("cnt"))
    return c.agg((F.max("cnt") / F.sum("cnt")).alias("top_share"), F.count("*").alias("sources"))


def null_counts(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """NULL count per column in one pass, returned as (column, nulls) rows."""
    cols = list(cols or df.columns)
    wide = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in cols])
    return _to_rows(wide, cols, "column", "nulls")


def _to_rows(wide: DataFrame, cols: Sequence[str], key: str, val: str) -> DataFrame:
    stack = ", ".join(f"'{c}', `{c}`" for c in cols)
    return wide.selectExpr(f"stack({len(cols)}, {stack}) as ({key}, {val})")


def value_counts(df: DataFrame, col: str, denom: Column | None = None, min_count: int = 0) -> DataFrame:
    """Count and percentage (1 dp, half-even) per value.

    ``denom`` defaults to the row count; the reference divides name counts by
    the number of distinct names, so it is a parameter (a scalar subquery).
    """
    d = denom if denom is not None else df.agg(F.count("*")).scalar()
    out = df.groupBy(col).agg(F.count("*").alias("count"))
    if min_count:
        out = out.where(F.col("count") > min_count)
    return out.withColumn("percentage", F.bround(F.col("count") * 100.0 / d, 1)).orderBy(F.desc("count"), col)


def repeated_values(df: DataFrame, col: str) -> DataFrame:
    """Values that occur more than once (having count > 1)."""
    return value_counts(df, col, df.agg(F.count_distinct(col)).scalar(), min_count=1)


FETCH = 1 << 14  # values of one interval that are read instead of counted once more
DIGIT = 16  # bits by which a pass narrows every interval


def _sortable(v: np.ndarray) -> np.ndarray:
    """Doubles as unsigned integers in the same order (-0 as 0; NaN last)."""
    v = np.where(np.isnan(v), np.nan, v + 0.0)
    u = v.view(np.uint64)
    return np.where(u >> np.uint64(63) == 1, ~u, u | np.uint64(1 << 63))


def _double(u: int) -> float:
    u = u ^ (1 << 63) if u >> 63 else ~u & ((1 << 64) - 1)
    return float(np.array([u], np.uint64).view(float)[0])


def exact_ranks(df: DataFrame, wanted: dict[str, Sequence[int]]) -> dict[tuple[str, int], float]:
    """The values of the given ranks (from 0, in ascending order; NULLs don't count) of several columns, exactly.

    Selection by counting, all columns and ranks in the same passes: a pass
    counts the values of every interval still open by their next 16 bits (in
    each task first, then added up), and every rank moves into the bin that
    holds it. Four passes settle any double; an interval of few values is read
    as it is. Nothing is sorted or landed, and no task holds a column.
    """
    cols = list(wanted)
    rows = df.select(*[F.col(c).cast("double").alias(f"c{i}") for i, c in enumerate(cols)])
    # rank -> (column, prefix of the sortable bits, rank within the interval)
    open_ = {(c, k): (i, 0, k) for i, c in enumerate(cols) for k in wanted[c]}
    found: dict[tuple[str, int], float] = {}
    shift = 64
    few: dict[tuple[int, int], bool] = {}
    while open_:
        shift -= DIGIT
        spans = sorted({(i, prefix) for i, prefix, _ in open_.values()})
        read = {s for s in spans if few.get(s)}

        def run(batches, spans=spans, read=read, shift=shift):
            hist = np.zeros((len(spans), 1 << DIGIT), np.int64)
            top = np.uint64(shift + DIGIT)
            for b in batches:
                keys = {i: _sortable(b.column(i).drop_null().to_numpy(zero_copy_only=False)) for i in {i for i, _ in spans}}
                for at, (i, prefix) in enumerate(spans):
                    u = keys[i] if top == 64 else keys[i][keys[i] >> top == np.uint64(prefix)]
                    if (i, prefix) in read:
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(u), at), pa.int32()), pa.array(u.view(np.int64)), pa.array(np.ones(len(u), np.int64))], names=["span", "v", "n"])
                    else:
                        hist[at] += np.bincount(((u >> np.uint64(shift)) & np.uint64((1 << DIGIT) - 1)).astype(np.int64), minlength=1 << DIGIT)
            at, digit = np.nonzero(hist)
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(digit, pa.int64()), pa.array(hist[at, digit])], names=["span", "v", "n"])

        counted = rows.mapInArrow(run, "span int, v long, n long").groupBy("span", "v").agg(F.sum("n").alias("n"))
        # unsigned order of whole keys: flip the sign bit
        order = F.col("v").bitwiseXOR(F.lit(-(1 << 63)))
        below = F.sum("n").over(Window.partitionBy("span").orderBy(order).rowsBetween(Window.unboundedPreceding, -1))
        ranked = counted.withColumn("below", F.coalesce(below, F.lit(0)))
        ranks: dict[int, set[int]] = {}
        for i, prefix, r in open_.values():
            ranks.setdefault(spans.index((i, prefix)), set()).add(r)
        hit = F.lit(False)
        for at, some in ranks.items():
            for r in some:
                hit = hit | ((F.col("span") == at) & (F.col("below") <= r) & (F.col("below") + F.col("n") > r))
        bins = ranked.where(hit).collect()
        few = {}
        for key, (i, prefix, r) in list(open_.items()):
            at = spans.index((i, prefix))
            b = next(b for b in bins if b["span"] == at and b["below"] <= r < b["below"] + b["n"])
            if (i, prefix) in read:
                found[key] = _double(b["v"] & ((1 << 64) - 1))
            else:
                value = (prefix << DIGIT) | b["v"]
                if shift:
                    open_[key] = (i, value, r - b["below"])
                    few[i, value] = b["n"] <= FETCH
                    continue
                found[key] = _double(value)
            del open_[key]
    return found


def quantiles(df: DataFrame, cols: Sequence[str], qs: Sequence[float]) -> dict[str, list[float | None]]:
    """Exact quantiles of several columns with linear interpolation between ranks; NULL for columns without values."""
    counts = df.agg(*[F.count(F.col(c).cast("double")).alias(f"n{i}") for i, c in enumerate(cols)]).first()
    place = {c: [q * (counts[f"n{i}"] - 1) for q in qs] if counts[f"n{i}"] else [] for i, c in enumerate(cols)}
    ranks = {c: sorted({k for x in at for k in (int(x), min(int(x) + 1, counts[f"n{i}"] - 1))}) for i, (c, at) in enumerate(place.items())}
    value = exact_ranks(df, {c: r for c, r in ranks.items() if r})

    def at(c: str, x: float, last: int) -> float:
        low = value[c, int(x)]
        return low + (x - int(x)) * (value[c, min(int(x) + 1, last)] - low) if x > int(x) else low

    return {c: [at(c, x, counts[f"n{i}"] - 1) for x in place[c]] or [None] * len(qs) for i, c in enumerate(cols)}


def describe(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Count, mean, sample std, min, exact quartiles, max per column."""
    aggs, rows = [], []
    quartiles = quantiles(df, cols, [0.25, 0.5, 0.75])
    for c in cols:
        v = F.col(c).cast("double")
        aggs += [F.count(v).alias(f"{c}__count"), F.avg(v).alias(f"{c}__mean"), F.stddev_samp(v).alias(f"{c}__std"),
                 F.min(v).alias(f"{c}__min"), F.max(v).alias(f"{c}__max")]
        q = [F.lit(x).cast("double") for x in quartiles[c]]
        rows.append(F.struct(
            F.lit(c).alias("column"), F.col(f"{c}__count").alias("count"), F.col(f"{c}__mean").alias("mean"),
            F.col(f"{c}__std").alias("std"), F.col(f"{c}__min").alias("min"),
            q[0].alias("q25"), q[1].alias("q50"), q[2].alias("q75"), F.col(f"{c}__max").alias("max")))
    return df.agg(*aggs).select(F.inline(F.array(*rows)))


def schema_profile(df: DataFrame) -> DataFrame:
    """Type and non-null count per column (``info``)."""
    types = dict(df.dtypes)
    nn = df.agg(*[F.count(F.col(c)).alias(c) for c in df.columns])
    rows = _to_rows(nn, df.columns, "column", "non_null")
    tmap = F.create_map(*[x for c in df.columns for x in (F.lit(c), F.lit(types[c]))])
    return rows.withColumn("dtype", F.element_at(tmap, F.col("column")))


def domain_checks(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Sum, mean, max, negatives and non-integers per numeric column."""
    rows = []
    aggs = []
    for c in cols:
        v = F.col(c).cast("double")
        aggs += [F.sum(v).alias(f"{c}__sum"), F.avg(v).alias(f"{c}__mean"), F.max(v).alias(f"{c}__max"),
                 F.count_if(v < 0).alias(f"{c}__neg"), F.count_if(F.pmod(v, F.lit(1.0)) != 0).alias(f"{c}__nonint")]
        rows.append(F.struct(F.lit(c).alias("column"), F.col(f"{c}__sum").alias("sum"), F.col(f"{c}__mean").alias("mean"),
                             F.col(f"{c}__max").alias("max"), F.col(f"{c}__neg").alias("negatives"),
                             F.col(f"{c}__nonint").alias("non_integers")))
    return df.agg(*aggs).select(F.inline(F.array(*rows)))


def skew_kurt(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Bias-corrected sample skewness G1 and excess kurtosis G2."""
    aggs = []
    rows = []
    for c in cols:
        v = F.col(c).cast("double")
        aggs += [F.count(v).alias(f"{c}__n"), F.skewness(v).alias(f"{c}__g1"), F.kurtosis(v).alias(f"{c}__g2")]
        n, g1, g2 = F.col(f"{c}__n").cast("double"), F.col(f"{c}__g1"), F.col(f"{c}__g2")
        skew = g1 * F.sqrt(n * (n - 1)) / (n - 2)
        kurt = (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * g2 + 6)
        rows.append(F.struct(F.lit(c).alias("column"), skew.alias("skewness"), kurt.alias("kurtosis")))
    return df.agg(*aggs).select(F.inline(F.array(*rows)))


def histogram(df: DataFrame, col: str, bins: int = 10, edges: Sequence[float] | None = None) -> DataFrame:
    """Histogram over ``edges``, or ``bins`` equal widths over [min, max]; last bin closed, empty bins kept."""
    v = F.col(col).cast("double")
    if edges is not None:
        cuts = [float(e) for e in edges]
        bins, width = len(cuts) - 1, None
        idx = sum(((v >= c).cast("int") for c in cuts[1:-1]), F.lit(0))
        counts = df.where(v.between(cuts[0], cuts[-1])).groupBy(idx.alias("bin")).agg(F.count("*").alias("count"))
        lower = F.element_at(F.array(*[F.lit(c) for c in cuts]), F.col("bin") + 1)
        upper = F.element_at(F.array(*[F.lit(c) for c in cuts]), F.col("bin") + 2)
    else:
        st = df.agg(F.min(v).alias("lo"), F.max(v).alias("hi"))
        lo, hi = st.select("lo").scalar(), st.select("hi").scalar()
        width = (hi - lo) / F.lit(float(bins))
        idx = F.least(F.floor(F.try_divide((v - lo) * F.lit(float(bins)), hi - lo)), F.lit(bins - 1)).cast("int")
        counts = df.where(v.isNotNull()).groupBy(F.coalesce(idx, F.lit(0)).alias("bin")).agg(F.count("*").alias("count"))
        lower, upper = lo + F.col("bin") * width, lo + (F.col("bin") + 1) * width
    grid = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    out = grid.join(counts, "bin", "left").select(
        "bin", lower.alias("lower"), upper.alias("upper"), F.coalesce("count", F.lit(0)).cast("bigint").alias("count"))
    return out.orderBy("bin")


def dense_histogram(df: DataFrame, col: str, lo: int = 0, hi: int = 10) -> DataFrame:
    """Counts of floor(value) for every integer lo..hi, missing values as 0."""
    v = F.floor(F.col(col).cast("double")).cast("bigint")
    counts = df.where(v.between(lo, hi)).groupBy(v.alias("value")).agg(F.count("*").alias("count"))
    grid = df.sparkSession.range(lo, hi + 1).withColumnRenamed("id", "value")
    return grid.join(counts, "value", "left").select(
        "value", F.coalesce("count", F.lit(0)).cast("bigint").alias("count")).orderBy("value")


def tail_bins(df: DataFrame, col: str, cutoff: float, edges: Sequence[float]) -> DataFrame:
    """[a, b) bins over values > cutoff; the edge list is clipped to the max.

    Edges = {cutoff} U {e in edges: cutoff < e < max_tail} U {max_tail + 1},
    labelled ``[a, b-1]``; empty bins are kept.
    """
    v = F.col(col).cast("double")
    tail = df.where(v > F.lit(float(cutoff)))
    mx = F.floor(tail.agg(F.max(v)).scalar()).cast("bigint") + 1
    cand = sorted(set(float(e) for e in edges if e > cutoff))
    lowers = F.array(F.lit(float(cutoff)), *[F.lit(e) for e in cand])
    uppers = F.array(*[F.lit(e) for e in cand], F.lit(None).cast("double"))
    spark = df.sparkSession
    grid = spark.range(len(cand) + 1).select(
        F.element_at(lowers, (F.col("id") + 1).cast("int")).alias("lower"),
        F.element_at(uppers, (F.col("id") + 1).cast("int")).alias("upper_raw"))
    grid = grid.where(F.col("lower") < mx).withColumn(
        "upper", F.when(F.col("upper_raw").isNull() | (F.col("upper_raw") >= mx), mx.cast("double"))
        .otherwise(F.col("upper_raw"))).drop("upper_raw")
    # the bin of a value is the last edge not above it: plain comparisons, no range join
    at = F.lit(float(cutoff))
    for e in cand:
        at = F.when(v >= F.lit(e), F.lit(e)).otherwise(at)
    counts = tail.groupBy(at.alias("lower")).agg(F.count("*").alias("count"))
    return grid.join(counts, "lower", "left").select(
        F.format_string("[%d, %d]", F.col("lower").cast("bigint"), (F.col("upper") - 1).cast("bigint")).alias("bin"),
        F.col("lower"), F.col("upper"), F.coalesce("count", F.lit(0)).cast("bigint").alias("count"),
    ).orderBy("lower")


def pearson(a: str, b: str) -> Column:
    """Pearson's r over the rows that have both values; NULL for a column without spread (where ``corr`` fails)."""
    x, y = F.col(a).cast("double"), F.col(b).cast("double")
    both = x.isNotNull() & y.isNotNull()
    return F.try_divide(F.covar_pop(x, y), F.stddev_pop(F.when(both, x)) * F.stddev_pop(F.when(both, y)))


def corr_with_target(df: DataFrame, target: str, cols: Sequence[str], threshold: float = 0.0) -> DataFrame:
    """Pearson r of each feature with the target, |r| > threshold, strongest first; features without spread are left out."""
    wide = df.agg(*[pearson(c, target).alias(c) for c in cols])
    rows = _to_rows(wide, cols, "feature", "r")
    return rows.where(F.abs("r") > threshold).orderBy(F.desc(F.abs("r")), "feature")


def corr_matrix(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Lower triangle (i >= j) of the correlation matrix, one aggregate pass."""
    pairs = [(a, b) for i, a in enumerate(cols) for b in cols[: i + 1]]
    wide = df.agg(*[pearson(a, b).alias(f"{a}__{b}") for a, b in pairs])
    rows = F.array(*[F.struct(F.lit(a).alias("row"), F.lit(b).alias("col"), F.col(f"{a}__{b}").alias("r"))
                     for a, b in pairs])
    return wide.select(F.inline(rows))


def district_summary(polys: DataFrame, layers: dict[str, DataFrame], poly_id="district_id",
                     name="name", ring="ring") -> DataFrame:
    """Per-polygon counts of several point layers, plus a 'None' row for points in none.

    One left join per layer over the landed polygons; points in no polygon are its NULL group.
    """
    polys, _ = checkpoint(polys.select(poly_id, name, ring))
    spark = polys.sparkSession
    none_row = spark.range(1).select(F.lit(None).cast(polys.schema[poly_id].dataType).alias(poly_id), F.lit("None").alias(name))
    out = polys.select(poly_id, name).unionByName(none_row)
    for lname, pts in layers.items():
        pairs = sj.pip_join(pts.select("lng", "lat"), polys.select(poly_id, ring), "left", ring=ring)
        cnt = pairs.groupBy(F.col(poly_id).alias("__id")).agg(F.count("*").alias(lname))
        out = out.join(cnt, F.col(poly_id).eqNullSafe(F.col("__id")), "left").drop("__id")
    return out.fillna(0, list(layers))


def coverage(polys: DataFrame, area: DataFrame, ring="ring") -> DataFrame:
    """Area of the polygons' union, the part of it outside ``area`` (deg^2), and that part's share, exactly."""
    found = overlay.overlay_areas(polys.select(ring), area.select(ring), ring)
    return found.withColumn("outside_share", F.try_divide("outside_area", "union_area"))


def geo_bounds(polys: DataFrame, ring="ring") -> DataFrame:
    """Total bounds of a polygon layer (one row)."""
    from ..functions import geo
    b = geo.ring_bounds(F.col(ring))
    return polys.agg(F.min(b["min_lng"]).alias("minx"), F.min(b["min_lat"]).alias("miny"),
                     F.max(b["max_lng"]).alias("maxx"), F.max(b["max_lat"]).alias("maxy"))


def compare_groups(a: DataFrame, b: DataFrame, cols: Sequence[str], names=("group_a", "group_b")) -> DataFrame:
    """Mean of each feature in two groups, side by side."""
    ma = _to_rows(a.agg(*[F.avg(c).alias(c) for c in cols]), cols, "feature", names[0])
    mb = _to_rows(b.agg(*[F.avg(c).alias(c) for c in cols]), cols, "feature", names[1])
    return ma.join(mb, "feature")


def iqr_outliers(df: DataFrame, col: str, k: float = 1.5) -> DataFrame:
    """Rows outside [Q1 - k*IQR, Q3 + k*IQR], with deviation (v - median) / IQR (2 dp)."""
    q1, q2, q3 = (F.lit(q).cast("double") for q in quantiles(df, [col], [0.25, 0.5, 0.75])[col])
    iqr = q3 - q1
    v = F.col(col)
    return df.where((v < q1 - F.lit(k) * iqr) | (v > q3 + F.lit(k) * iqr)).withColumn(
        "deviation", F.bround((v - q2) / iqr, 2))


def top_k(df: DataFrame, col: str, k: int, tie: str) -> DataFrame:
    """K largest by ``col`` (ties: lowest ``tie`` first) -> TakeOrderedAndProject."""
    return df.orderBy(F.desc(col), F.asc(tie)).limit(k)


def top_bottom(df: DataFrame, col: str, k: int, tie: str) -> DataFrame:
    """Top k and bottom k of a ranking, tagged."""
    top = df.orderBy(F.desc(col), F.asc(tie)).limit(k).withColumn("end", F.lit("top"))
    bottom = df.orderBy(F.asc(col), F.asc(tie)).limit(k).withColumn("end", F.lit("bottom"))
    return top.unionByName(bottom)
