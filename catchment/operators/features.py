"""Catchment features per site.

Each feature family is one grid radius join (or ring search) and one
partial+final hash aggregate keyed by the site id; families are then
left-joined onto the site list, so a site with no match gets 0 (T9).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import geo
from ..sources.fixtures import RESIDENTIAL_CATEGORIES, RETAIL_CATEGORY
from ..session import checkpoint, deal
from . import spatial_join as sj
from .sums import polygon_sums, radius_sums
from .visits import period_visits, site_visits

RADIUS_M = 1500


def fill0(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Missing group after a left join -> 0 as BIGINT."""
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(0)).cast("bigint") for c in cols})


def safe_ratio(a, b) -> Column:
    """A / b, 0 when b is 0 or NULL."""
    a = a if isinstance(a, Column) else F.col(a)
    b = b if isinstance(b, Column) else F.col(b)
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def _ids(sites: DataFrame, site_id: str) -> DataFrame:
    return sites.select(site_id)


def catchment_count(sites, points, r=RADIUS_M, name=None, site_id="location_id", shape="circle") -> DataFrame:
    """Number of points strictly inside each site's catchment, 0-filled."""
    name = name or f"count_{int(r)}m"
    sites_xy, pts = sj.ensure_xy(sites, keep_nulls=True), sj.ensure_xy(points)
    agg = radius_sums(sites_xy, pts.select("x", "y"), r, {name: F.lit(1)}, site_id, shape=shape)
    return fill0(_ids(sites, site_id).join(agg, site_id, "left"), [name])


def catchment_sum(sites, points, col, r=RADIUS_M, name=None, site_id="location_id", shape="circle") -> DataFrame:
    """Sum of ``col`` over points in the catchment (population), 0-filled."""
    name = name or f"{col}_{int(r)}m"
    sites_xy, pts = sj.ensure_xy(sites, keep_nulls=True), sj.ensure_xy(points)
    agg = radius_sums(sites_xy, pts.select("x", "y", col), r, {name: F.col(col)}, site_id, shape=shape)
    return fill0(_ids(sites, site_id).join(agg, site_id, "left"), [name])


def nearest_distance(sites, points, point_id, name, site_id="location_id", by=(), by_values=None) -> DataFrame:
    """Nearest-point distance per site (left semantics: NULL for an empty layer)."""
    out = sj.nearest_join(sj.ensure_xy(sites, keep_nulls=True), sj.ensure_xy(points), site_id, point_id, by, by_values, dist_col=name)
    return out.drop(point_id)


def competitor_features(sites, competitors, r=RADIUS_M, site_id="location_id", shape="circle",
                        point_id="comp_id") -> DataFrame:
    cnt = catchment_count(sites, competitors, r, f"competitor_count_{int(r)}m", site_id, shape)
    near = nearest_distance(sites, competitors, point_id, "nearest_competitor_m", site_id)
    return cnt.join(near, site_id, "left")


def poi_features(sites, poi, r=RADIUS_M, categories: Sequence[str] | None = None, site_id="location_id",
                 shape="circle", point_id="poi_id") -> DataFrame:
    """Overall and per-category counts and nearest distances in one radius pass.

    One radius join and one aggregate give all counts; one search keyed by
    (site, category) gives all distances. The categories, which name the
    output columns, are those in the data unless given; a point without a
    category counts in the totals only.
    """
    sites_xy, pts = sj.ensure_xy(sites, keep_nulls=True), sj.ensure_xy(poi)
    if categories is None:
        categories = sorted(r[0] for r in pts.select("category").where("category is not null").distinct().collect())
    categories = list(categories)
    rr = int(r)
    found = radius_sums(sites_xy, pts.select("x", "y", "category"), r, {"__n": F.lit(1)}, site_id, ["category"], shape)
    counts = found.groupBy(site_id).agg(
        F.sum("__n").alias(f"poi_count_{rr}m"),
        *[F.sum(F.when(F.col("category") == c, F.col("__n"))).alias(f"poi_{c}_count_{rr}m") for c in categories])
    # one search keyed by category, NULL among them; the nearest of all is the least over the categories
    near = sj.nearest_join(sites_xy, pts.select(point_id, "x", "y", "category"), site_id, point_id, ["category"], dist_col="d")
    near = near.groupBy(site_id).agg(
        F.min("d").alias("nearest_poi_m"), *[F.min(F.when(F.col("category") == c, F.col("d"))).alias(f"nearest_poi_{c}_m") for c in categories])
    out = _ids(sites, site_id).join(counts, site_id, "left").join(near, site_id, "left")
    out = fill0(out, [f"poi_count_{rr}m"] + [f"poi_{c}_count_{rr}m" for c in categories])
    order = [site_id, f"poi_count_{rr}m", "nearest_poi_m"]
    for c in categories:
        order += [f"poi_{c}_count_{rr}m", f"nearest_poi_{c}_m"]
    return out.select(*order)


def prepare_buildings(buildings: DataFrame, geometry: str = "geometry", land: bool = True) -> DataFrame:
    """Parse WKT once and project the ring to metres (B3 + B2 for polygons).

    With ``land`` the prepared layer is written once to the shared checkpoint
    folder, so joins and ring-search rounds read stored rings instead of
    re-running the (interpreted) per-vertex projection. That takes longer than
    any read, so a layer that comes in few splits is dealt to all cores first.
    """
    out = deal(buildings).withColumn("ring", geo.wkt_ring(F.col(geometry))).withColumn(
        "ring_xy", geo.ring_to_xy(F.col("ring")))
    return checkpoint(out)[0] if land else out


def building_features(sites, buildings, r=RADIUS_M, site_id="location_id", shape="circle",
                      category="funogolnabudynku_desc") -> DataFrame:
    """Buildings wholly inside the catchment, and the residential share."""
    rr = int(r)
    b = buildings if "ring_xy" in buildings.columns else prepare_buildings(buildings)
    agg = polygon_sums(sj.ensure_xy(sites, keep_nulls=True), b.select(category, "ring_xy"), r, {
        f"building_count_{rr}m": F.lit(1),
        f"residential_count_{rr}m": F.col(category).isin(RESIDENTIAL_CATEGORIES).cast("int"),
    }, site_id, shape=shape)
    out = fill0(_ids(sites, site_id).join(agg, site_id, "left"),
                [f"building_count_{rr}m", f"residential_count_{rr}m"])
    return out.select(
        site_id, f"building_count_{rr}m",
        safe_ratio(f"residential_count_{rr}m", f"building_count_{rr}m").alias(f"residential_ratio_{rr}m"),
    )


def population_features(sites, addresses, r=RADIUS_M, site_id="location_id", shape="circle") -> DataFrame:
    return catchment_sum(sites, addresses, "total", r, f"population_{int(r)}m", site_id, shape)


def footfall_features(sites, traces, r=RADIUS_M, predicate: Column | None = None,
                      site_id="location_id", approx: bool = False) -> DataFrame:
    """D3: signals and distinct users per site within geodesic distance r.

    Exact counts come from ``site_visits``, which shuffles traces and sites but
    no pairs. Sites that share an id count as one: rows of one place by their
    number, rows of several places by their pairs. ``approx=True`` swaps in HyperLogLog over the pairs.
    """
    rr = int(r)
    names = [f"signals_{rr}m", f"unique_users_{rr}m"]
    if approx:
        agg = _pair_visits(sites, traces, r, predicate, site_id, F.approx_count_distinct("proxi_user_id"), names)
    else:
        one, several, t, planar = _by_places(sites, traces, r, predicate, site_id)
        agg = site_visits(one, t, r, planar, site_id, "proxi_user_id").select(site_id, F.col("signals").alias(names[0]), F.col("users").alias(names[1]))
        if several is not None:
            agg = agg.unionByName(_pair_visits(several, traces, r, predicate, site_id, F.count_distinct("proxi_user_id"), names))
    return fill0(_ids(sites, site_id).join(agg, site_id, "left"), names)


def _by_places(sites, traces, r, predicate, site_id) -> tuple[DataFrame, DataFrame | None, DataFrame, float]:
    """The ids of one place with the number of their rows, the sites whose ids have several places (None without any), and the traces and radius of ``geodesic_sides``."""
    s, t, planar = sj.geodesic_sides(sites, traces, r, site_id, predicate)
    # -0.0 would be another place than 0.0
    at = [(F.col(c) + 0.0).alias(n) for c, n in (("x", "__sx"), ("y", "__sy"), ("__slng", "__slng"), ("__slat", "__slat"))]
    places = s.where(F.col(site_id).isNotNull()).select(site_id, *at).groupBy(site_id, "__sx", "__sy", "__slng", "__slat").agg(F.count("*").alias("__rows"))
    places = places.withColumn("__places", F.count("*").over(Window.partitionBy(site_id)))
    places, seen = checkpoint(places, observe={"several": F.count_if(F.col("__places") > 1)})
    several = sites.join(places.where("__places > 1").select(site_id).distinct(), site_id, "left_semi") if seen["several"] else None
    return places.where("__places = 1"), several, t, planar


def _pair_visits(sites, traces, r, predicate, site_id, users: Column, names: Sequence[str]) -> DataFrame:
    return sj.dwithin_join(sites, traces, r, site_id, predicate).groupBy(site_id).agg(F.count("*").alias(names[0]), users.alias(names[1]))


SKETCH_BITS = 14  # registers of a user sketch as a power of two: a relative error of about 0.8 %


def footfall_rollup(sites, traces, r=RADIUS_M, predicate: Column | None = None, site_id="location_id", ts: str = "ts", unit: str = "day") -> DataFrame:
    """D3 as a rollup: (site, period, signals, users) per ``unit`` of time, ``users`` a mergeable sketch of the distinct users.

    Land it once; ``footfall_period`` then answers for any span of periods
    without the traces. Traces without a time are in no period. Users reach the
    sketches once a site and period, from the tasks that met their traces (``period_visits``).
    """
    period = F.date_trunc(unit, F.col(ts))
    one, several, t, planar = _by_places(sites, traces, r, predicate, site_id)
    # signals of rows that share an id at one place count once a row, their users once
    rows = period_visits(one, t.where(F.col(ts).isNotNull()), r, planar, site_id, "proxi_user_id", period).withColumnRenamed("user", "proxi_user_id")
    unnamed = sites.where(F.col(site_id).isNull())
    pairs = sj.dwithin_join(unnamed if several is None else unnamed.unionByName(several), traces, r, site_id, predicate).where(F.col(ts).isNotNull())
    rows = rows.unionByName(pairs.select(site_id, period.alias("period"), F.lit(1).cast("long").alias("signals"), "proxi_user_id"))
    return rows.groupBy(site_id, "period").agg(F.sum("signals").alias("signals"), F.hll_sketch_agg(F.col("proxi_user_id").cast("string"), SKETCH_BITS).alias("users"))


def footfall_period(sites, rollup, since: str, until: str, r=RADIUS_M, site_id="location_id") -> DataFrame:
    """Signals (exact) and estimated distinct users of every site from ``since`` up to but without ``until``; sites without any get 0.

    Sketches of up to some thousand users hold them one by one, so their estimates are exact; larger ones are off by about 1 %.
    """
    rr = int(r)
    span = rollup.where((F.col("period") >= F.lit(since).cast("timestamp")) & (F.col("period") < F.lit(until).cast("timestamp")))
    agg = span.groupBy(site_id).agg(F.sum("signals").alias(f"signals_{rr}m"), F.hll_sketch_estimate(F.hll_union_agg("users")).alias(f"users_estimate_{rr}m"))
    return fill0(_ids(sites, site_id).join(agg, site_id, "left"), [f"signals_{rr}m", f"users_estimate_{rr}m"])


def store_building(sites, buildings, site_id="location_id", poly_id="lokalnyid",
                   category="funogolnabudynku_desc") -> DataFrame:
    """C9 features: area of the building containing (or nearest to) each store, retail flag."""
    b = buildings if "ring_xy" in buildings.columns else prepare_buildings(buildings)
    near = sj.containing_or_nearest(sj.ensure_xy(sites, keep_nulls=True), b, site_id, poly_id, attrs=["area", category])
    return near.select(
        site_id,
        F.col("area").alias("store_building_area"),
        F.coalesce((F.col(category) == RETAIL_CATEGORY).cast("int"), F.lit(0)).alias("is_retail_building"),
    )


def assemble(sites: DataFrame, *features: DataFrame, site_id: str = "location_id") -> DataFrame:
    """Left-join feature frames (one row per site each) onto the site table."""
    out = sites
    for f in features:
        out = out.join(f, site_id, "left")
    return out


def point_features(sites, competitors=None, poi=None, addresses=None, r=RADIUS_M, categories=None, site_id="location_id", shape="circle") -> DataFrame:
    """Competitor, POI and population features of one site set in one pass.

    The layers are one table with a tag: sites are replicated to their cells
    once, one radius join and one aggregate give all counts and sums, and one
    search keyed by (layer, category) gives all distances. Columns and values are those of
    ``competitor_features``, ``poi_features`` and ``population_features``.
    """
    rr = int(r)
    sites_xy = sj.ensure_xy(sites, keep_nulls=True)
    layers = {"competitor": competitors, "poi": poi, "address": addresses}
    parts = []
    for name, df in layers.items():
        if df is not None:
            xy = sj.ensure_xy(df)
            parts.append(xy.select(
                "x", "y", F.lit(name).alias("layer"), (F.col("category") if name == "poi" else F.lit(None)).cast("string").alias("category"),
                (F.col("total") if name == "address" else F.lit(None)).cast("bigint").alias("total")))
    pts = parts[0]
    for p in parts[1:]:
        pts = pts.unionByName(p)
    if poi is not None and categories is None:
        categories = sorted(x[0] for x in poi.select("category").where("category is not null").distinct().collect())
    is_layer = {name: F.col("layer") == name for name in layers}
    counts, near, order = [], [], [site_id]
    if competitors is not None:
        counts.append(F.sum(F.when(is_layer["competitor"], F.col("__n"))).alias(f"competitor_count_{rr}m"))
        near.append(F.min(F.when(is_layer["competitor"], F.col("d"))).alias("nearest_competitor_m"))
        order += [f"competitor_count_{rr}m", "nearest_competitor_m"]
    if poi is not None:
        counts.append(F.sum(F.when(is_layer["poi"], F.col("__n"))).alias(f"poi_count_{rr}m"))
        near.append(F.min(F.when(is_layer["poi"], F.col("d"))).alias("nearest_poi_m"))
        order += [f"poi_count_{rr}m", "nearest_poi_m"]
        for c in categories:
            mine = is_layer["poi"] & (F.col("category") == c)
            counts.append(F.sum(F.when(mine, F.col("__n"))).alias(f"poi_{c}_count_{rr}m"))
            near.append(F.min(F.when(mine, F.col("d"))).alias(f"nearest_poi_{c}_m"))
            order += [f"poi_{c}_count_{rr}m", f"nearest_poi_{c}_m"]
    if addresses is not None:
        counts.append(F.sum(F.when(is_layer["address"], F.col("total"))).alias(f"population_{rr}m"))
        order.append(f"population_{rr}m")
    found = radius_sums(sites_xy, pts, r, {"__n": F.lit(1), "total": F.col("total")}, site_id, ["layer", "category"], shape)
    agg = found.groupBy(site_id).agg(*counts)
    out = fill0(_ids(sites, site_id).join(agg, site_id, "left"), [c for c in agg.columns if c != site_id])
    if near:
        objects = pts.where(~is_layer["address"]).select("x", "y", "layer", "category", F.lit(0).alias("__id"))
        found = sj.nearest_join(sites_xy, objects, site_id, "__id", ["layer", "category"], dist_col="d")
        out = out.join(found.groupBy(site_id).agg(*near), site_id, "left")
    return out.select(*order)


def site_features(sites, competitors=None, poi=None, buildings=None, addresses=None, traces=None,
                  r=RADIUS_M, predicate: Column | None = None, categories=None, site_id="location_id",
                  shape="circle") -> DataFrame:
    """The full catchment feature matrix for any site set (stores or grid cells): point layers in one pass, then buildings, then traces."""
    sites_xy = sj.ensure_xy(sites, keep_nulls=True)
    parts = []
    if competitors is not None or poi is not None or addresses is not None:
        parts.append(point_features(sites_xy, competitors, poi, addresses, r, categories, site_id, shape))
    if buildings is not None:
        parts.append(building_features(sites_xy, buildings, r, site_id, shape))
    if traces is not None:
        parts.append(footfall_features(sites_xy, traces, r, predicate, site_id))
    return assemble(sites, *parts, site_id=site_id)
