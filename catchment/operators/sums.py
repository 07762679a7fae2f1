"""Sums over the objects in each site's catchment without a row for each pair.

Objects fall into cells of side ``r``; cells with more than ``LEAF`` objects at
different places are halved along both axes, until none is left. A cell keeps
the tight boxes of its objects and their sums by group. Sites go down together:
a cell whose box lies in the catchment gives its sums as they are, one out of
reach is dropped, and only the cells on the edge are replaced by their children
or, at a leaf, by their objects, which take the exact test. So a site's work
grows with the edge of its catchment, not with what lies within. Every level
is an equi-join on the cell; its sums are landed, and its other tables are deleted
once the next level stands, so the disk holds the objects of two levels at
most. Only counts reach the driver.

The box tests round as the exact test does, so that both agree on every object.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geo
from ..session import checkpoint, discard
from .spatial_join import BUFFER_SEGMENTS, SHAPES, in_catchment

LEAF = 32
LEVELS = 24  # a cell of the last level has a side of r / 2^24
BOX = ("__x0", "__y0", "__x1", "__y1")
KEYS = ("__kx0", "__ky0", "__kx1", "__ky1")


def _cell(side: float) -> dict[str, Column]:
    """Cell numbers at a side of ``r`` over a power of two: doubled, plus 0 or 1, they are those of the next level."""
    return {"__cx": F.floor(F.col("x") / side), "__cy": F.floor(F.col("y") / side)}


def _offsets(low: int, high: int) -> Column:
    return F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in range(low, high) for j in range(low, high)]))


def _reach(names: Sequence[str], far: bool) -> Column:
    """Squared distance from a site to the farthest corner or the nearest point of a box."""
    sx, sy, (x0, y0, x1, y1) = F.col("__sx"), F.col("__sy"), map(F.col, names)
    if far:
        dx, dy = F.greatest(F.abs(x0 - sx), F.abs(x1 - sx)), F.greatest(F.abs(y0 - sy), F.abs(y1 - sy))
    else:
        dx, dy = F.greatest(x0 - sx, sx - x1, F.lit(0.0)), F.greatest(y0 - sy, sy - y1, F.lit(0.0))
    return dx * dx + dy * dy


def radius_sums(
    sites: DataFrame,
    objects: DataFrame,
    r: float,
    measures: dict[str, Column],
    site_id: str = "location_id",
    by: Sequence[str] = (),
    shape: str = "circle",
    box: Sequence[str] | None = None,
    exact: Callable[[Column, Column], Column] | None = None,
    carry: Sequence[str] = (),
) -> DataFrame:
    """(site_id, by..., measures...): sums of ``measures`` over the objects strictly inside each site's catchment, by ``by``.

    Objects are points ``x, y``, or shapes that hold the point ``x, y`` and lie
    in the box ``box`` (columns: least x, least y, greatest x, greatest y; a
    null or NaN there means unknown); ``exact(sx, sy)`` then says whether the
    whole shape is inside, from the columns ``carry``. Sites and groups without any object have no row.
    """
    if shape not in SHAPES:
        raise ValueError(f"shape must be one of {SHAPES}")
    by, names, inf = list(by), list(measures), float("inf")
    point = box is None
    at = ["x", "y", "x", "y"] if point else list(box)
    unknown = [F.lit(-inf), F.lit(-inf), F.lit(inf), F.lit(inf)]
    # nothing without finite coordinates is in any catchment
    finite = lambda c: F.abs(F.col(c)) < F.lit(inf)
    rest = objects.where(finite("x") & finite("y")).select(
        "x", "y", *by, *carry, *[v.alias(n) for n, v in measures.items()],
        *([] if point else [F.when(finite(c), F.col(c)).otherwise(u).alias(n) for c, n, u in zip(at, BOX, unknown)]))
    inner = float(r) ** 2 if shape == "circle" else (float(r) * math.cos(math.pi / BUFFER_SEGMENTS)) ** 2 * (1 - 1e-9)
    outer = float(r) ** 2 * (1.0 if shape == "circle" else 1 + 1e-9)
    around = [F.min("x"), F.min("y"), F.max("x"), F.max("y")]
    boxes = KEYS if point else KEYS + BOX
    front = sites.where(finite("x") & finite("y")).select(F.col(site_id).alias("__site"), F.col("x").alias("__sx"), F.col("y").alias("__sy"))
    front = front.select("*", *[v.alias(n) for n, v in {"__cx": F.floor(F.col("__sx") / float(r)), "__cy": F.floor(F.col("__sy") / float(r))}.items()])
    front = front.select("__site", "__sx", "__sy", "__cx", "__cy", _offsets(-1, 2).alias("__o"))
    front = front.withColumns({"__cx": F.col("__cx") + F.col("__o.i"), "__cy": F.col("__cy") + F.col("__o.j")}).drop("__o")
    state = F.when(_reach(KEYS, False) >= F.lit(outer), F.lit(0)).when(_reach(KEYS if point else BOX, True) < F.lit(inner), F.lit(1)).when(F.col("__deep"), 3).otherwise(2)

    parts, spent = [], []
    total = lambda df: df.groupBy("__site", *by).agg(*[F.sum(n).alias(n) for n in names])
    for level in range(LEVELS + 1):
        rest = rest.withColumns(_cell(float(r) / 2**level))
        groups = rest.groupBy("__cx", "__cy", *by).agg(
            F.count("*").alias("__count"), *[c.alias(n) for c, n in zip(around, KEYS)],
            *([] if point else [f(n).alias(n) for f, n in zip((F.min, F.min, F.max, F.max), BOX)]), *[F.sum(n).alias(n) for n in names])
        nodes = groups.groupBy("__cx", "__cy").agg(
            F.sum("__count").alias("__count"), *[(F.min if n[-1] == "0" else F.max)(n).alias(n) for n in boxes],
            F.collect_list(F.struct(*by, *names)).alias("__sums"))
        spread = (F.col("__kx0") < F.col("__kx1")) | (F.col("__ky0") < F.col("__ky1"))
        deep = (F.col("__count") > LEAF) & spread if level < LEVELS else F.lit(False)
        nodes, seen = checkpoint(nodes.withColumn("__deep", deep), observe={"deep": F.count_if("__deep")})
        met = front.join(nodes, ["__cx", "__cy"]).withColumn("__state", state).where("__state > 0")
        met, _ = checkpoint(met.select("__site", "__sx", "__sy", "__cx", "__cy", "__state", F.when(F.col("__state") == 1, F.col("__sums")).alias("__sums")))
        whole = met.where("__state = 1").select("__site", F.explode("__sums").alias("__s")).select("__site", "__s.*")
        leaves, held = rest, [met]
        if seen["deep"]:
            split = nodes.where("__deep").select("__cx", "__cy", F.lit(True).alias("__split"))
            rest, _ = checkpoint(rest.join(split, ["__cx", "__cy"], "left"))
            held.append(rest)
            leaves, rest = rest.where("__split is null").drop("__split"), rest.where("__split").drop("__split")
        edge = met.where("__state = 2").select("__site", "__sx", "__sy", "__cx", "__cy").join(leaves, ["__cx", "__cy"])
        edge = edge.where(in_catchment(F.col("x") - F.col("__sx"), F.col("y") - F.col("__sy"), r, shape))
        if exact is not None:
            edge = edge.where((_reach(BOX, True) < F.lit(inner)) | exact(F.col("__sx"), F.col("__sy")))
        parts.append(checkpoint(total(whole).unionByName(total(edge.select("__site", *by, *names))))[0])
        for table in [*spent, nodes]:  # nothing reads the level before now
            discard(table)
        spent = held
        if not seen["deep"]:
            break
        front = met.where("__state = 3").select("__site", "__sx", "__sy", "__cx", "__cy", _offsets(0, 2).alias("__o"))
        front = front.withColumns({"__cx": F.col("__cx") * 2 + F.col("__o.i"), "__cy": F.col("__cy") * 2 + F.col("__o.j")}).drop("__o")

    for table in spent:
        discard(table)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy(F.col("__site").alias(site_id), *by).agg(*[F.sum(n).alias(n) for n in names])


def polygon_sums(
    sites: DataFrame,
    polys: DataFrame,
    r: float,
    measures: dict[str, Column],
    site_id: str = "location_id",
    ring_xy: str = "ring_xy",
    shape: str = "circle",
) -> DataFrame:
    """Sums over the polygons wholly inside each site's catchment, the pairs of ``radius_join_polygons``."""
    pts, first = F.col("__pts"), F.col("__pts").getItem(0)
    # one step a time, so that the lists are built once a polygon
    keyed = polys.where(F.col(ring_xy).isNotNull()).withColumn("__pts", geo.vertices(F.col(ring_xy)))
    keyed = keyed.withColumns({"__xs": F.transform(pts, lambda v: v["x"]), "__ys": F.transform(pts, lambda v: v["y"])})
    # a vertex without coordinates is in no catchment, so the box says nothing
    whole = ~F.array_contains(F.transform(F.concat("__xs", "__ys"), lambda v: v.isNull()), True)
    corners = ["__min_x", "__min_y", "__max_x", "__max_y"]
    bounds = [F.array_min("__xs"), F.array_min("__ys"), F.array_max("__xs"), F.array_max("__ys")]
    keyed = keyed.select("*", first["x"].alias("x"), first["y"].alias("y"), whole.alias("__whole"), *[b.alias(c) for b, c in zip(bounds, corners)])
    keyed = keyed.withColumns({c: F.when(F.col("__whole"), F.col(c)) for c in corners}).select("x", "y", *corners, "__pts", *[v.alias(n) for n, v in measures.items()])
    keyed, _ = checkpoint(keyed)
    inside = lambda sx, sy: F.forall(pts, lambda v: in_catchment(v["x"] - sx, v["y"] - sy, r, shape))
    sums = radius_sums(sites, keyed, r, {n: F.col(n) for n in measures}, site_id, shape=shape, box=corners, exact=inside, carry=["__pts"])
    discard(keyed)
    return sums
