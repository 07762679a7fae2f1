"""Spatial joins re-expressed as partitioned equi-joins on grid cells.

Spark has no distance or containment join, and a theta join on ``distance < r``
plans as a nested-loop join. Every join here instead keys both sides by a grid
cell, replicates the *small* side into the neighbouring cells it can reach,
equi-joins on the cell and applies the exact geometric predicate as a
post-filter inside the same codegen stage. No side is hinted: Spark broadcasts
one whose size in bytes is below its threshold, known from the files or, with
AQE, from the finished shuffle, and otherwise shuffles both and splits hot cells.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import geo
from ..session import checkpoint
from . import nearest

SHAPES = ("circle", "polygon64")
# Fixed value: the reference buffers with 16 segments per quarter circle (a 64-gon).
BUFFER_SEGMENTS = 64


def geodesic_prefilter(max_easting_m: float, r: float) -> float:
    """Upper bound of planar / haversine distance for sites within ``max_easting_m`` of the central meridian.

    The scale of the projection grows with the offset E from the meridian at
    most as 0.9993 * cosh(E / (0.9993 R_min)), with R_min = 6335 km, the
    smallest radius of curvature of the ellipsoid; its largest, 6400 km, is
    1.0046 times the radius of the haversine sphere. A margin of 0.05 % covers
    the curvature of the grid lines over the radius.
    """
    return 0.9993 * math.cosh((max_easting_m + 2.0 * r) / (0.9993 * 6.335e6)) * 1.0046 * 1.0005


def ensure_xy(df: DataFrame, lng="lng", lat="lat", keep_nulls: bool = False) -> DataFrame:
    """Metric ``x, y`` if missing. Sites pass ``keep_nulls``: one without coordinates stays, with NULL ``x, y``."""
    return df if "x" in df.columns and "y" in df.columns else geo.with_xy(df, lng, lat, keep_nulls=keep_nulls)


def _key(c: str, cell) -> Column:
    """Cell number, never NULL: a row without a coordinate goes to cell 0 and fails the distance test there."""
    return F.coalesce(F.floor(F.col(c) / cell).cast("long"), F.lit(0))


def _number(c: str) -> Column:
    """A coordinate that is never NULL (NaN fails every distance test), so that no ``isnotnull`` of it is inferred and pushed down."""
    return F.coalesce(F.col(c), F.lit(float("nan")))


def in_catchment(dx: Column, dy: Column, r: float, shape: str = "circle") -> Column:
    """Strict containment of offset (dx, dy) in the catchment of radius r.

    ``circle`` is the disc; ``polygon64`` is the inscribed 64-gon the
    reference's buffer produces (inside iff the projection on the nearest
    edge normal is below r*cos(pi/64)).
    """
    if shape == "circle":
        return dx * dx + dy * dy < F.lit(float(r) ** 2)
    if shape != "polygon64":
        raise ValueError(f"shape must be one of {SHAPES}")
    step = 2 * math.pi / BUFFER_SEGMENTS
    theta = F.pmod(F.atan2(dy, dx), F.lit(step))
    d = F.sqrt(dx * dx + dy * dy)
    return d * F.cos(theta - F.lit(step / 2)) < F.lit(float(r) * math.cos(step / 2))


def _neighbour_offsets(k: int) -> Column:
    return F.array(*[F.struct(F.lit(i).alias("dx"), F.lit(j).alias("dy"))
                     for i in range(-k, k + 1) for j in range(-k, k + 1)])


def _cells_around(df: DataFrame, x: str, y: str, cell: float, k: int, prefix: str = "__c") -> DataFrame:
    """Replicate each row into the (2k+1)^2 cells around its own cell."""
    off = F.explode(_neighbour_offsets(k)).alias("__off")
    return (
        df.select("*", off)
        .withColumn(prefix + "x", _key(x, cell) + F.col("__off.dx"))
        .withColumn(prefix + "y", _key(y, cell) + F.col("__off.dy"))
        .drop("__off")
    )


def _cell_of(df: DataFrame, x: str, y: str, cell: float, prefix: str = "__c") -> DataFrame:
    return df.withColumns({prefix + "x": _key(x, cell), prefix + "y": _key(y, cell)})


def radius_join(
    sites: DataFrame,
    points: DataFrame,
    r: float,
    site_id: str = "location_id",
    shape: str = "circle",
    dist_col: str = "d",
    cell: float | None = None,
    site_attrs: Sequence[str] = (),
) -> DataFrame:
    """All (site, point) pairs with the point strictly inside the site's catchment.

    Both inputs carry metric ``x, y``. Sites are replicated to the 3x3 cells of
    side ``r`` around them (9 rows per site, the small side); each point keeps
    its single cell, so every pair meets exactly once. Rows without coordinates
    match nothing. Output: the point's columns, ``site_id``, ``site_attrs`` and
    the planar distance ``dist_col``.
    """
    cell = float(cell or r)
    k = max(1, math.ceil(r / cell))
    s = sites.select(F.col(site_id), *site_attrs, _number("x").alias("__sx"), _number("y").alias("__sy"))
    s = _cells_around(s, "__sx", "__sy", cell, k)
    p = _cell_of(points.where(F.col("x").isNotNull()), "x", "y", cell)
    dx, dy = F.col("x") - F.col("__sx"), F.col("y") - F.col("__sy")
    return (
        p.join(s, ["__cx", "__cy"])
        .where(in_catchment(dx, dy, r, shape))
        .withColumn(dist_col, F.sqrt(dx * dx + dy * dy))
        .drop("__cx", "__cy", "__sx", "__sy")
    )


def radius_join_polygons(
    sites: DataFrame,
    polys: DataFrame,
    r: float,
    site_id: str = "location_id",
    ring_xy: str = "ring_xy",
    shape: str = "circle",
) -> DataFrame:
    """(site, polygon) pairs where the whole polygon lies in the catchment.

    The catchment is convex, so a polygon is inside iff all its vertices are.
    The first vertex must then be within r, so it serves as the join point.
    """
    first = F.col(ring_xy).getItem(0)["pts"].getItem(0)
    keyed = polys.where(F.col(ring_xy).isNotNull()).withColumns({"x": first["x"], "y": first["y"]})
    keyed = keyed.withColumns({f"__b{i}": c for i, c in enumerate(_whole_box(ring_xy))})
    named = sites.withColumns({"__jx": F.col("x"), "__jy": F.col("y")})
    pairs = radius_join(named, keyed, r, site_id, shape, dist_col="__d", site_attrs=["__jx", "__jy"])
    x0, y0, x1, y1 = (F.col(f"__b{i}") for i in range(4))
    dx = F.greatest(F.abs(x0 - F.col("__jx")), F.abs(x1 - F.col("__jx")))
    dy = F.greatest(F.abs(y0 - F.col("__jy")), F.abs(y1 - F.col("__jy")))
    # the disc that every catchment holds; a null box says nothing, and its rounding is that of the vertices' test
    inner = float(r) ** 2 if shape == "circle" else (float(r) * math.cos(math.pi / BUFFER_SEGMENTS)) ** 2 * (1 - 1e-9)
    inside = F.forall(
        geo.vertices(F.col(ring_xy)),
        lambda v: in_catchment(v["x"] - F.col("__jx"), v["y"] - F.col("__jy"), r, shape),
    )
    return pairs.where(F.coalesce(dx * dx + dy * dy < F.lit(inner), F.lit(False)) | inside).drop("x", "y", "__d", "__jx", "__jy", *[f"__b{i}" for i in range(4)])


def _whole_box(ring_xy: str) -> list[Column]:
    """Least x and y and greatest x and y over all vertices; NULL if a vertex has no coordinates or there is none."""
    pts = geo.vertices(F.col(ring_xy))
    xs, ys = F.transform(pts, lambda v: v["x"]), F.transform(pts, lambda v: v["y"])
    known = ~F.exists(pts, lambda v: v["x"].isNull() | v["y"].isNull())
    return [F.when(known, c) for c in (F.array_min(xs), F.array_min(ys), F.array_max(xs), F.array_max(ys))]


def nearest_join(
    sites: DataFrame,
    points: DataFrame,
    site_id: str = "location_id",
    point_id: str = "poi_id",
    by: Sequence[str] = (),
    by_values: Sequence | None = None,
    attrs: Sequence[str] = (),
    dist_col: str = "d",
) -> DataFrame:
    """Nearest point per site (left join semantics: NULL when the layer is empty)."""
    return nearest.search(sites, points, site_id, point_id, by, by_values, attrs, dist_col=dist_col)


def _poly_keyed(polys: DataFrame, ring: str, ring_xy: str = "ring_xy") -> DataFrame:
    """Bounding box, its centre and the size class (a power of two of its half-diagonal) of polygons."""
    if ring_xy not in polys.columns:
        polys = polys.withColumn(ring_xy, geo.ring_to_xy(F.col(ring)))
    b = geo.ring_bounds(F.col(ring_xy), "x", "y")
    polys = polys.where(F.col(ring_xy).isNotNull()).withColumns({f"__{k}": v for k, v in b.items()})
    half = F.sqrt((F.col("__max_x") - F.col("__min_x")) ** 2 + (F.col("__max_y") - F.col("__min_y")) ** 2) / 2
    return polys.withColumns({
        "x": (F.col("__min_x") + F.col("__max_x")) / 2,
        "y": (F.col("__min_y") + F.col("__max_y")) / 2,
        "__class": F.ceil(F.log2(F.greatest(half, F.lit(1.0)))).cast("int"),
    })


def nearest_polygon(
    sites: DataFrame,
    polys: DataFrame,
    site_id: str = "location_id",
    poly_id: str = "lokalnyid",
    ring: str = "ring",
    attrs: Sequence[str] = (),
    dist_col: str = "d",
) -> DataFrame:
    """Nearest polygon per site, 0 when the site is inside it (lowest id on ties).

    A search over the polygons' boxes within classes of like size, so that one
    huge polygon doesn't widen the boxes of small ones. All classes share one
    bound; edges are measured only for polygons whose box isn't beyond it.
    Polygon ids are unique.
    """
    keyed = _poly_keyed(polys, ring).select(poly_id, "x", "y", "ring_xy", "__class", "__min_x", "__min_y", "__max_x", "__max_y", *attrs)
    dist = lambda sx, sy: geo.polygon_distance(F.col("ring_xy"), sx, sy)
    return nearest.search(sites, keyed, site_id, poly_id, by=["__class"], attrs=attrs, dist=dist, carry=["ring_xy"],
                          box=["__min_x", "__min_y", "__max_x", "__max_y"], best_of_all=True, dist_col=dist_col)


def containing_or_nearest(sites, polys, site_id="location_id", poly_id="lokalnyid", ring="ring", attrs=(), dist_col="d"):
    """The polygon containing each site, or the nearest one when none does."""
    return nearest_polygon(sites, polys, site_id, poly_id, ring, attrs, dist_col)


def pip_join(
    points: DataFrame,
    polys: DataFrame,
    how: str = "inner",
    ring: str = "ring",
    lng: str = "lng",
    lat: str = "lat",
) -> DataFrame:
    """Point-in-polygon join in lng/lat (strict, even-odd rule).

    Polygons fall into levels by the larger side of their bbox, a power of two
    in degrees; one of level l covers at most four cells of side 2^l, whatever
    its size, and a point has one cell for each level in use (a literal list,
    at most a few dozen). The equi-join on (level, cell) plus a bbox prefilter
    leaves the ray cast for the few candidate pairs. ``how`` is inner, left,
    left_semi or left_anti; left keeps a point once for every polygon around it,
    or once with NULLs.
    """
    b = geo.ring_bounds(F.col(ring))
    boxed = polys.where(F.col(ring).isNotNull()).withColumns(
        {"__bminx": b["min_lng"], "__bmaxx": b["max_lng"], "__bminy": b["min_lat"], "__bmaxy": b["max_lat"]})
    side = F.greatest(F.col("__bmaxx") - F.col("__bminx"), F.col("__bmaxy") - F.col("__bminy"), F.lit(1e-6))
    boxed = boxed.withColumn("__lv", F.ceil(F.log2(side)).cast("int"))
    levels = sorted(r[0] for r in boxed.select("__lv").distinct().collect()) or [0]  # powers of two of a degree: a few dozen at most
    if how != "inner" and len(levels) > 1:
        return _pip_by_row(points, polys, how, ring, lng, lat)
    cell = F.pow(F.lit(2.0), F.col("__lv"))

    def span(lo: str, hi: str) -> Column:
        return F.explode(F.sequence(F.floor(F.col(lo) / cell).cast("long"), F.floor(F.col(hi) / cell).cast("long")))

    pc = boxed.select("*", span("__bminx", "__bmaxx").alias("__cx")).select("*", span("__bminy", "__bmaxy").alias("__cy"))
    cells = [F.struct(F.lit(v).alias("lv"), F.floor(F.col(lng) / 2.0**v).cast("long").alias("cx"),
                      F.floor(F.col(lat) / 2.0**v).cast("long").alias("cy")) for v in levels]
    key = cells[0] if len(cells) == 1 else F.explode(F.array(*cells))
    p = points.select("*", key.alias("__k")).select(
        *points.columns, F.col("__k.lv").alias("__plv"), F.col("__k.cx").alias("__pcx"), F.col("__k.cy").alias("__pcy"))
    cond = (
        (p["__plv"] == pc["__lv"]) & (p["__pcx"] == pc["__cx"]) & (p["__pcy"] == pc["__cy"])
        & p[lng].between(pc["__bminx"], pc["__bmaxx"]) & p[lat].between(pc["__bminy"], pc["__bmaxy"])
        & geo.contains(pc[ring], p[lng], p[lat])
    )
    out = p.join(pc, cond, how)
    added = [c for c in polys.columns if c not in points.columns] if how in ("inner", "left") else []
    return out.select(*[p[c] for c in points.columns], *[pc[c] for c in added])


def _pip_by_row(points: DataFrame, polys: DataFrame, how: str, ring: str, lng: str, lat: str) -> DataFrame:
    """Left, semi and anti joins over several levels: land numbered points, join inner, then join by number."""
    numbered, _ = checkpoint(points.withColumn("__pid", F.monotonically_increasing_id()))
    added = [c for c in polys.columns if c not in points.columns] if how == "left" else []
    pairs = pip_join(numbered.select("__pid", lng, lat), polys, "inner", ring, lng, lat).select(F.col("__pid").alias("__hit"), *added)
    return numbered.join(pairs, numbered["__pid"] == pairs["__hit"], how).select(*points.columns, *added)


def inside(points: DataFrame, poly: DataFrame, **kw) -> DataFrame:
    """Points strictly inside the polygon(s)."""
    return pip_join(points, poly, "left_semi", **kw)


def outside(points: DataFrame, poly: DataFrame, **kw) -> DataFrame:
    """Points not inside any polygon of ``poly``."""
    return pip_join(points, poly, "left_anti", **kw)


def unassigned(points: DataFrame, polys: DataFrame, **kw) -> DataFrame:
    """Points in no polygon of the layer (anti join to the union)."""
    return pip_join(points, polys, "left_anti", **kw)


def boundary_distance(points: DataFrame, polys: DataFrame, ring: str = "ring") -> DataFrame:
    """C11: distance in metres from each point to the boundary of each named area.

    The result has a row for every point and area, so points are replicated by
    the number of areas and joined to the landed areas by number; Spark
    broadcasts them if their bytes are few. For a whole polygon layer the
    nearest boundary is ``nearest_polygon``. Points need metric ``x, y``.
    """
    names = [c for c in polys.columns if c != ring]
    numbered = F.row_number().over(Window.orderBy(F.lit(0))).alias("__a")
    areas, seen = checkpoint(polys.select(*names, geo.ring_to_xy(F.col(ring)).alias("__rxy"), numbered), observe={"n": F.count("*")})
    if not seen["n"]:
        return points.join(areas, F.lit(False)).select(*points.columns, *names, F.lit(None).cast("double").alias("boundary_m"))
    areas = areas.select(*[F.col(c).alias(f"__n{i}") for i, c in enumerate(names)], "__rxy", "__a")
    pairs = points.withColumn("__k", F.explode(F.sequence(F.lit(1), F.lit(seen["n"])))).join(areas, F.col("__k") == F.col("__a"))
    return pairs.select(*points.columns, *[F.col(f"__n{i}").alias(c) for i, c in enumerate(names)],
                        geo.segment_distance_min(F.col("__rxy"), F.col("x"), F.col("y")).alias("boundary_m"))


def parse_traces(traces: DataFrame) -> DataFrame:
    """Typed view of text traces: unparseable text becomes NULL."""
    return traces.withColumns({
        "lat": F.col("latitude").try_cast("double"),
        "lng": F.col("longitude").try_cast("double"),
        "ts": F.try_to_timestamp(F.col("occured_at")),
    })


def geodesic_sides(sites: DataFrame, traces: DataFrame, r: float, site_id: str, predicate: Column | None) -> tuple[DataFrame, DataFrame, float]:
    """Sites with ``x, y, __slng, __slat``, the filtered traces with ``lat, lng, x, y``, and a planar radius that no match within ``r`` exceeds."""
    t = traces.where(predicate) if predicate is not None else traces
    if not {"lat", "lng", "x", "y"} <= set(t.columns):
        t = geo.with_xy(parse_traces(t))
    s = ensure_xy(sites, keep_nulls=True).select(site_id, "x", "y", F.col("lng").alias("__slng"), F.col("lat").alias("__slat"))
    widest = s.agg(F.max(F.abs(F.col("x") - F.lit(geo.CS92_FALSE_EASTING)))).first()[0]
    return s, t, r * geodesic_prefilter(float(widest or 0.0), r)


def dwithin_join(
    sites: DataFrame,
    traces: DataFrame,
    r: float,
    site_id: str = "location_id",
    predicate: Column | None = None,
) -> DataFrame:
    """Geodesic within-distance join (inclusive <= r), as in ST_DWITHIN on geography.

    Traces are filtered first (caller's predicate on the text columns), parsed,
    projected, and joined on grid cells with a planar radius that no geodesic
    match can exceed (``geodesic_prefilter``, from the sites' own extent); the
    exact haversine test then keeps d <= r. Sites keep ``lng, lat``. Traces that
    already have ``lat, lng, x, y`` are joined as they are.
    """
    s, t, rp = geodesic_sides(sites, traces, r, site_id, predicate)
    s = s.withColumns({"__sx": _number("x"), "__sy": _number("y")}).drop("x", "y")
    s9 = _cells_around(s, "__sx", "__sy", rp, 1)
    p = _cell_of(t.where(F.col("x").isNotNull()), "x", "y", rp)
    dx, dy = F.col("x") - F.col("__sx"), F.col("y") - F.col("__sy")
    j = p.join(s9, ["__cx", "__cy"]).where(dx * dx + dy * dy <= F.lit(rp * rp))
    j = j.withColumn("geo_d", geo.haversine_m("lng", "lat", "__slng", "__slat")).where(F.col("geo_d") <= F.lit(float(r)))
    return j.drop("__cx", "__cy", "__sx", "__sy", "__slng", "__slat")


def semi_keys(df: DataFrame, keys: DataFrame, on: str | Sequence[str]) -> DataFrame:
    """Rows of ``df`` whose key is in ``keys`` (left semi join)."""
    return df.join(keys, on, "left_semi")
