"""Exact areas of overlaid polygon layers (D26): unions and differences by strips, tile by tile.

Edges are dealt to the tiles of a grid; tiles that hold more than
``TILE_EDGES`` edges are split 4 x 4 until none does (or for ``ROUNDS``
rounds), so a dense town gets small tiles. A tile takes an edge if the edge's columns meet
it and the edge isn't above it: what lies below tells which polygons a column
enters from below. In a tile the ends of edges and their crossings cut the
columns into strips in which no two edges cross; from bottom to top every edge
opens or closes its polygon (even-odd, so holes and parts count), and the gaps
between neighbouring edges are trapezoids under a known number of polygons of each layer.

No sample and no polygon library; the result is exact but for rounding.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geo
from ..session import checkpoint

TILE_EDGES = 256
ROUNDS = 6
SPLIT = 4
CELLS = 1 << 22


def _edges(polys: DataFrame, ring: str, layer: int, u: str, v: str) -> DataFrame:
    """(layer, poly, x1, y1, x2, y2, top): edges from left to right, with the highest point of their polygon; vertical ones have no area."""
    p = polys.where(F.col(ring).isNotNull()).select(F.monotonically_increasing_id().alias("poly"), F.col(ring).alias("r"))
    top = F.array_max(F.transform(geo.vertices(F.col("r")), lambda w: w[v]))
    e = p.select("poly", top.alias("top"), F.explode(geo.edges(F.col("r"))).alias("e")).where(F.col(f"e.a.{u}") != F.col(f"e.b.{u}"))
    a, b = F.struct(F.col(f"e.a.{u}").alias("x"), F.col(f"e.a.{v}").alias("y")), F.struct(F.col(f"e.b.{u}").alias("x"), F.col(f"e.b.{v}").alias("y"))
    e = e.select("poly", "top", F.least(a, b).alias("l"), F.greatest(a, b).alias("r"))
    return e.select(F.lit(layer).alias("layer"), "poly", "top", F.col("l.x").alias("x1"), F.col("l.y").alias("y1"), F.col("r.x").alias("x2"), F.col("r.y").alias("y2"))


def _deal(edges: DataFrame, x0: float, y0: float, w: float, h: float, columns: tuple[Column, Column], rows: tuple[Column, Column]) -> DataFrame:
    """Edges once for every tile of side (w, h) that they meet or lie below of, within the given tile numbers."""
    def cell(c: Column, low: float, side: float) -> Column:
        return F.floor((c - F.lit(low)) / F.lit(side)).cast("long")

    def between(low: Column, high: Column, limits: tuple[Column, Column]) -> Column:
        a, b = F.greatest(low, limits[0]), F.least(high, limits[1])
        return F.explode(F.when(a <= b, F.sequence(a, b)).otherwise(F.array().cast("array<bigint>")))

    return edges.select("*", between(cell(F.col("x1"), x0, w), cell(F.col("x2"), x0, w), columns).alias("cx")).select(
        "*", between(cell(F.least("y1", "y2"), y0, h), cell(F.col("top"), y0, h), rows).alias("cy"))


def tile_areas(layer: np.ndarray, poly: np.ndarray, x1, y1, x2, y2, left: float, right: float, low: float, high: float) -> tuple[float, float]:
    """(area under layer 0, area of it outside layer 1) within a tile."""
    keep = (x1 < right) & (x2 > left)
    layer, poly, x1, y1, x2, y2 = (a[keep] for a in (layer, poly, x1, y1, x2, y2))
    if not len(x1):
        return 0.0, 0.0
    slope = (y2 - y1) / (x2 - x1)
    a, b = np.maximum(x1, left), np.minimum(x2, right)
    cuts = [a, b]
    with np.errstate(divide="ignore", invalid="ignore"):
        for level in (low, high):
            cuts.append(x1 + (level - y1) / slope)
        for i in range(len(x1) - 1):
            x = ((y1[i + 1 :] - slope[i + 1 :] * x1[i + 1 :]) - (y1[i] - slope[i] * x1[i])) / (slope[i] - slope[i + 1 :])
            cuts.append(x[(x > np.maximum(a[i], a[i + 1 :])) & (x < np.minimum(b[i], b[i + 1 :]))])
    x = np.concatenate(cuts)
    x = np.unique(x[(x >= left) & (x <= right)])
    mid, width = (x[1:] + x[:-1]) / 2, np.diff(x)
    inside = outside = 0.0
    step = max(1, CELLS // len(x1))
    for at in range(0, len(mid), step):
        m, w = mid[at : at + step], width[at : at + step]
        s, e = np.nonzero((a[None, :] < m[:, None]) & (b[None, :] > m[:, None]))
        y = np.clip(y1[e] + (m[s] - x1[e]) * slope[e], low, high)
        # every second edge of a polygon closes it again
        by_poly = np.lexsort((y, poly[e], layer[e], s))
        new = np.ones(len(s), bool)
        p = by_poly
        new[1:] = (s[p[1:]] != s[p[:-1]]) | (poly[e[p[1:]]] != poly[e[p[:-1]]]) | (layer[e[p[1:]]] != layer[e[p[:-1]]])
        rank = np.arange(len(s)) - np.maximum.accumulate(np.where(new, np.arange(len(s)), 0))
        turn = np.empty(len(s), np.int64)
        turn[p] = np.where(rank % 2 == 0, 1, -1)
        up = np.lexsort((y, s))
        s, y, turn, of = s[up], y[up], turn[up], layer[e[up]]
        first = np.searchsorted(s, s)
        depth = []
        for k in (0, 1):
            c = np.concatenate([[0], np.cumsum(np.where(of == k, turn, 0))])
            depth.append(c[1:] - c[first])
        last = np.ones(len(s), bool)
        last[:-1] = s[1:] != s[:-1]
        gap = np.where(last, high, np.concatenate([y[1:], [high]])) - y
        area = w[s] * gap
        inside += float(area[depth[0] > 0].sum())
        outside += float(area[(depth[0] > 0) & (depth[1] <= 0)].sum())
    return inside, outside


def overlay_areas(polys: DataFrame, other: DataFrame, ring: str = "ring", u: str = "lng", v: str = "lat") -> DataFrame:
    """One row: ``union_area`` of ``polys`` and ``outside_area``, the part of it outside all polygons of ``other``.

    Areas are in the units of the rings' coordinates (``u, v``). Polygons that
    overlap count once, touching ones share no area; null rings are left out;
    an empty layer has an area of 0.
    """
    edges, seen = checkpoint(_edges(polys, ring, 0, u, v).unionByName(_edges(other, ring, 1, u, v)), observe={
        "n": F.count("*"), "x0": F.min(F.when(F.col("layer") == 0, F.col("x1"))), "x1": F.max(F.when(F.col("layer") == 0, F.col("x2"))),
        "y0": F.min(F.when(F.col("layer") == 0, F.least("y1", "y2"))), "y1": F.max(F.when(F.col("layer") == 0, F.greatest("y1", "y2")))})
    spark = polys.sparkSession
    if seen["x0"] is None:
        return spark.createDataFrame([(0.0, 0.0)], "union_area double, outside_area double")
    # tiles cover the first layer alone
    x0, y0 = seen["x0"], seen["y0"]
    grid = min(1024, max(1, math.ceil(math.sqrt(seen["n"] / TILE_EDGES))))
    w, h = (seen["x1"] - x0) / grid, max((seen["y1"] - y0) / grid, 1e-300)
    every = (F.lit(0).cast("long"), F.lit(grid - 1).cast("long"))
    tiles = _deal(edges, x0, y0, w, h, every, every).withColumn("level", F.lit(0))
    done = None
    for level in range(ROUNDS + 1):
        size = h / SPLIT**level
        tiles, _ = checkpoint(tiles)
        meets = F.floor((F.greatest("y1", "y2") - F.lit(y0)) / F.lit(size)) >= F.col("cy")
        dense, many = checkpoint(tiles.groupBy("cx", "cy").agg(F.count_if(meets).alias("n")).where(F.col("n") > TILE_EDGES).select("cx", "cy"), observe={"n": F.count("*")})
        if not many["n"] or level == ROUNDS:
            done = tiles if done is None else done.unionByName(tiles)
            break
        light = tiles.join(dense, ["cx", "cy"], "left_anti").select(tiles.columns)
        done = light if done is None else done.unionByName(light)
        split = tiles.join(dense, ["cx", "cy"]).withColumnsRenamed({"cx": "px", "cy": "py"})
        inner = [(F.col(c) * SPLIT, F.col(c) * SPLIT + SPLIT - 1) for c in ("px", "py")]
        tiles = _deal(split, x0, y0, w / SPLIT ** (level + 1), size / SPLIT, *inner).drop("px", "py").withColumn("level", F.lit(level + 1)).select(tiles.columns)

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        level, cx, cy = key
        tw, th = w / SPLIT**level, h / SPLIT**level
        found = tile_areas(*(rows[c].to_numpy() for c in ("layer", "poly", "x1", "y1", "x2", "y2")), x0 + cx * tw, x0 + (cx + 1) * tw, y0 + cy * th, y0 + (cy + 1) * th)
        return pd.DataFrame([found], columns=["a", "o"])

    areas = done.groupBy("level", "cx", "cy").applyInPandas(run, "a double, o double")
    return areas.agg(F.coalesce(F.sum("a"), F.lit(0.0)).alias("union_area"), F.coalesce(F.sum("o"), F.lit(0.0)).alias("outside_area"))
