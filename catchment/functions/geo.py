"""Geometry as Column expressions (B1-B6, C11 helpers).

Everything here returns a ``Column`` so it stays inside whole-stage codegen:
no UDF, no geometry object. Points are ``lng, lat`` (EPSG:4326, degrees) or
``x, y`` (EPSG:2180, metres). A polygon ring is ``ARRAY<STRUCT<lng, lat>>``
(or ``<x, y>`` once projected) with the closing vertex repeated, as in WKT.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# EPSG:2180 (Poland CS92) transverse Mercator on GRS80.
# These must equal the published CRS definition for distances to match.
GRS80_A = 6378137.0
GRS80_F = 1.0 / 298.257222101
CS92_LON0_DEG = 19.0
CS92_K0 = 0.9993
CS92_FALSE_EASTING = 500000.0
CS92_FALSE_NORTHING = -5300000.0
# Mean earth radius (IUGG) used for geodesic (haversine) distances.
EARTH_RADIUS_M = 6371008.8
# ---------------------------------------------------------------------------

_N = GRS80_F / (2.0 - GRS80_F)
_E2 = GRS80_F * (2.0 - GRS80_F)
_E = math.sqrt(_E2)
_RECT_A = GRS80_A / (1.0 + _N) * (1.0 + _N**2 / 4.0 + _N**4 / 64.0)
_KA = CS92_K0 * _RECT_A

# Krueger series coefficients to order n^4 (forward alpha, inverse beta, latitude delta).
_ALPHA = (
    _N / 2 - 2 * _N**2 / 3 + 5 * _N**3 / 16 + 41 * _N**4 / 180,
    13 * _N**2 / 48 - 3 * _N**3 / 5 + 557 * _N**4 / 1440,
    61 * _N**3 / 240 - 103 * _N**4 / 140,
    49561 * _N**4 / 161280,
)
_BETA = (
    _N / 2 - 2 * _N**2 / 3 + 37 * _N**3 / 96 - _N**4 / 360,
    _N**2 / 48 + _N**3 / 15 - 437 * _N**4 / 1440,
    17 * _N**3 / 480 - 37 * _N**4 / 840,
    4397 * _N**4 / 161280,
)
_DELTA = (
    2 * _N - 2 * _N**2 / 3 - 2 * _N**3 + 116 * _N**4 / 45,
    7 * _N**2 / 3 - 8 * _N**3 / 5 - 227 * _N**4 / 45,
    56 * _N**3 / 15 - 136 * _N**4 / 35,
    4279 * _N**4 / 630,
)


def _c(v) -> Column:
    return v if isinstance(v, Column) else F.col(v)


def point(lng="lng", lat="lat") -> Column:
    """B1: a point struct, NULL when either coordinate is NULL."""
    lng, lat = _c(lng), _c(lat)
    return F.when(lng.isNotNull() & lat.isNotNull(), F.struct(lng.alias("lng"), lat.alias("lat")))


def _tm_terms(lng: Column, lat: Column):
    phi = F.radians(lat)
    lam = F.radians(lng - F.lit(CS92_LON0_DEG))
    sin_phi = F.sin(phi)
    t = F.sinh(F.atanh(sin_phi) - F.lit(_E) * F.atanh(F.lit(_E) * sin_phi))
    xi = F.atan2(t, F.cos(lam))
    eta = F.atanh(F.sin(lam) / F.sqrt(F.lit(1.0) + t * t))
    return xi, eta


def _tm_xy(xi: Column, eta: Column):
    sx = xi
    sy = eta
    for j, a in enumerate(_ALPHA, start=1):
        sx = sx + F.lit(a) * F.sin(F.lit(2.0 * j) * xi) * F.cosh(F.lit(2.0 * j) * eta)
        sy = sy + F.lit(a) * F.cos(F.lit(2.0 * j) * xi) * F.sinh(F.lit(2.0 * j) * eta)
    x = F.lit(CS92_FALSE_EASTING) + F.lit(_KA) * sy
    y = F.lit(CS92_FALSE_NORTHING) + F.lit(_KA) * sx
    return x, y


def with_xy(df: DataFrame, lng="lng", lat="lat", x="x", y="y", keep_nulls: bool = False) -> DataFrame:
    """B2: add metric ``x, y`` (EPSG:2180) to a point layer.

    Staged so the conformal latitude terms are evaluated once per row. Rows
    without coordinates are dropped, which is right for points; site layers
    pass ``keep_nulls`` and keep such rows with NULL ``x, y``. Without
    ``keep_nulls`` the outputs are non-nullable (``coalesce`` with NaN), so no
    ``isnotnull`` over the whole projection is inferred on join keys.
    """
    if not keep_nulls:
        df = df.where(_c(lng).isNotNull() & _c(lat).isNotNull())
    tmp_xi, tmp_eta = "__tm_xi", "__tm_eta"
    xi, eta = _tm_terms(_c(lng), _c(lat))
    df = df.withColumns({tmp_xi: xi, tmp_eta: eta})
    px, py = _tm_xy(F.col(tmp_xi), F.col(tmp_eta))
    if not keep_nulls:
        px, py = F.coalesce(px, F.lit(float("nan"))), F.coalesce(py, F.lit(float("nan")))
    return df.withColumns({x: px, y: py}).drop(tmp_xi, tmp_eta)


def with_lnglat(df: DataFrame, x="x", y="y", lng="lng", lat="lat") -> DataFrame:
    """Inverse of ``with_xy`` (used by the hexagonal grid to place cell centres)."""
    xi = (_c(y) - F.lit(CS92_FALSE_NORTHING)) / F.lit(_KA)
    eta = (_c(x) - F.lit(CS92_FALSE_EASTING)) / F.lit(_KA)
    df = df.withColumns({"__ixi": xi, "__ieta": eta})
    xi, eta = F.col("__ixi"), F.col("__ieta")
    xp, ep = xi, eta
    for j, b in enumerate(_BETA, start=1):
        xp = xp - F.lit(b) * F.sin(F.lit(2.0 * j) * xi) * F.cosh(F.lit(2.0 * j) * eta)
        ep = ep - F.lit(b) * F.cos(F.lit(2.0 * j) * xi) * F.sinh(F.lit(2.0 * j) * eta)
    df = df.withColumns({"__ixp": xp, "__iep": ep})
    xp, ep = F.col("__ixp"), F.col("__iep")
    chi = F.asin(F.sin(xp) / F.cosh(ep))
    df = df.withColumn("__chi", chi)
    chi = F.col("__chi")
    phi = chi
    for j, d in enumerate(_DELTA, start=1):
        phi = phi + F.lit(d) * F.sin(F.lit(2.0 * j) * chi)
    lam = F.lit(CS92_LON0_DEG) + F.degrees(F.atan2(F.sinh(ep), F.cos(xp)))
    return df.withColumns({lng: lam, lat: F.degrees(phi)}).drop("__ixi", "__ieta", "__ixp", "__iep", "__chi")


def planar_distance(x1, y1, x2, y2) -> Column:
    return F.sqrt((_c(x1) - _c(x2)) ** 2 + (_c(y1) - _c(y2)) ** 2)


def haversine_m(lng1, lat1, lng2, lat2) -> Column:
    """Great-circle distance in metres on the mean-radius sphere."""
    p1, p2 = F.radians(_c(lat1)), F.radians(_c(lat2))
    dphi = p2 - p1
    dlam = F.radians(_c(lng2) - _c(lng1))
    h = F.sin(dphi / 2) ** 2 + F.cos(p1) * F.cos(p2) * F.sin(dlam / 2) ** 2
    return F.lit(2.0 * EARTH_RADIUS_M) * F.asin(F.sqrt(F.least(h, F.lit(1.0))))


# --------------------------------------------------------------------- WKT / rings

def wkt_ring(wkt) -> Column:
    """The rings of a POLYGON or MULTIPOLYGON WKT text.

    ARRAY<STRUCT<hole: BOOLEAN, pts: ARRAY<STRUCT<lng, lat>>>>: every ring of
    every part, holes marked. All geometry functions below take this type, so
    courtyards and further parts count. A text that doesn't parse is NULL.
    """
    def pair(xy):
        return F.struct(
            F.get(xy, F.lit(0)).try_cast("double").alias("lng"),
            F.get(xy, F.lit(1)).try_cast("double").alias("lat"),
        )

    def ring(r):
        body = F.regexp_replace(r, r"[()]", "")
        corners = F.transform(F.split(body, ","), lambda s: F.split(F.trim(s), " "))
        return F.struct(
            (~r.rlike(r"^\( ?\(")).alias("hole"),
            F.transform(corners, pair).alias("pts"),
        )

    def whole(parsed):
        broken = F.exists(parsed, lambda r: F.exists(r["pts"], lambda v: v["lng"].isNull() | v["lat"].isNull()))
        return F.when((F.size(parsed) > 0) & ~broken, parsed)

    def parse(text):
        rings = F.regexp_extract_all(text, F.lit(r"(\(? ?\([^()]+\))"), 1)
        return F.when(text.rlike(r"^ ?(?i:MULTI)?(?i:POLYGON)"), _once(F.transform(rings, ring), whole))

    return _once(F.regexp_replace(_c(wkt), r"\s+", " "), parse)


def _once(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then(value)`` with the value computed once, however often it occurs there."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def vertices(ring) -> Column:
    """All vertices of all rings."""
    return F.flatten(F.transform(_c(ring), lambda r: r["pts"]))


def ring_to_xy(ring) -> Column:
    """Project every vertex of lng/lat rings to EPSG:2180 metres.

    Lambdas of higher-order functions are evaluated without codegen, so the
    projection is staged over three ``transform`` passes and each term is
    computed once per vertex instead of once per reference.
    """
    def stage1(v):
        sin_phi = F.sin(F.radians(v["lat"]))
        t = F.sinh(F.atanh(sin_phi) - F.lit(_E) * F.atanh(F.lit(_E) * sin_phi))
        return F.struct(F.radians(v["lng"] - F.lit(CS92_LON0_DEG)).alias("lam"), t.alias("t"))

    def stage2(w):
        xi = F.atan2(w["t"], F.cos(w["lam"]))
        eta = F.atanh(F.sin(w["lam"]) / F.sqrt(F.lit(1.0) + w["t"] * w["t"]))
        return F.struct(xi.alias("xi"), eta.alias("eta"))

    def stage3(u):
        x, y = _tm_xy(u["xi"], u["eta"])
        return F.struct(x.alias("x"), y.alias("y"))

    def project(r):
        return F.struct(r["hole"].alias("hole"), F.transform(F.transform(F.transform(r["pts"], stage1), stage2), stage3).alias("pts"))

    return F.transform(_c(ring), project)


def _ring_edges(pts: Column) -> Column:
    n = F.size(pts)
    return F.arrays_zip(F.slice(pts, 1, n - 1).alias("a"), F.slice(pts, 2, n - 1).alias("b"))


def edges(ring: Column) -> Column:
    """All edges of all rings, as structs of two vertices."""
    return F.flatten(F.transform(ring, lambda r: _ring_edges(r["pts"])))


def ring_bounds(ring, u="lng", v="lat") -> dict[str, Column]:
    """Per-polygon bounds as four columns."""
    pts = vertices(ring)
    us = F.transform(pts, lambda p: p[u])
    vs = F.transform(pts, lambda p: p[v])
    return {
        "min_" + u: F.array_min(us), "min_" + v: F.array_min(vs),
        "max_" + u: F.array_max(us), "max_" + v: F.array_max(vs),
    }


def contains(ring, px, py, u="lng", v="lat") -> Column:
    """Even-odd ray cast over the edges of all rings: TRUE when (px, py) is inside.

    ``try_divide`` keeps ANSI mode from raising on horizontal edges, which the
    crossing test excludes anyway.
    """
    ring, px, py = _c(ring), _c(px), _c(py)

    def crosses(e):
        a, b = e["a"], e["b"]
        straddles = (a[v] > py) != (b[v] > py)
        x_at = F.try_divide((b[u] - a[u]) * (py - a[v]), b[v] - a[v]) + a[u]
        return straddles & (px < x_at)

    flags = F.transform(edges(ring), crosses)
    return F.aggregate(flags, F.lit(False), lambda acc, f: acc != f)


def segment_distance_min(ring, px, py, u="x", v="y") -> Column:
    """Minimum distance from (px, py) to the boundary segments of all rings (C11)."""
    ring, px, py = _c(ring), _c(px), _c(py)

    def seg(e):
        a, b = e["a"], e["b"]
        dx, dy = b[u] - a[u], b[v] - a[v]
        t = F.coalesce(F.try_divide((px - a[u]) * dx + (py - a[v]) * dy, dx * dx + dy * dy), F.lit(0.0))
        t = F.least(F.greatest(t, F.lit(0.0)), F.lit(1.0))
        return F.sqrt((px - (a[u] + t * dx)) ** 2 + (py - (a[v] + t * dy)) ** 2)

    return F.array_min(F.transform(edges(ring), seg))


def polygon_distance(ring_xy, px, py) -> Column:
    """0 when the point is inside the polygon, else the distance to its boundary."""
    return F.when(contains(ring_xy, px, py, "x", "y"), F.lit(0.0)).otherwise(
        segment_distance_min(ring_xy, px, py, "x", "y")
    )


def _cross(e: Column, u: str, v: str) -> Column:
    return e["a"][u] * e["b"][v] - e["b"][u] * e["a"][v]


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, t: acc + t)


def _weight(r: Column, u: str, v: str) -> Column:
    """+1 or -1 that makes a ring's shoelace sum positive for outer rings and negative for holes."""
    s = _total(F.transform(_ring_edges(r["pts"]), lambda e: _cross(e, u, v)))
    return F.signum(s) * F.when(r["hole"], F.lit(-1.0)).otherwise(F.lit(1.0))


def area(ring, u="lng", v="lat") -> Column:
    """Polygon area in the ring's units squared (deg^2 for lng/lat, m^2 for x/y); holes subtract."""
    def one(r):
        return _weight(r, u, v) * _total(F.transform(_ring_edges(r["pts"]), lambda e: _cross(e, u, v))) / 2.0

    return _total(F.transform(_c(ring), one))


def centroid(ring, u="lng", v="lat") -> Column:
    """Area centroid over all rings as struct(u, v)."""
    ring = _c(ring)

    def moment(w):
        def one(r):
            return _weight(r, u, v) * _total(F.transform(_ring_edges(r["pts"]), lambda e: (e["a"][w] + e["b"][w]) * _cross(e, u, v)))

        return _total(F.transform(ring, one))

    a6 = area(ring, u, v) * 6.0
    return F.struct((moment(u) / a6).alias(u), (moment(v) / a6).alias(v))
