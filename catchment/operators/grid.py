"""G1: hexagonal tiling of an area into candidate sites.

Planar axial hexagons in EPSG:2180 (pointy-top, ``flat_to_flat_m`` apart) so
the cells have equal size in metres; cells are generated per polygon from its
projected bounds (an ``explode(sequence)`` per row, distributed by polygon and
by hex row), kept when their centre lies inside the polygon, and placed back
in lng/lat with the inverse projection. Re-aimed from the H3 library, so cell
ids are (q, r) axial coordinates, not H3 indexes.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geo


def hex_grid(area: DataFrame, flat_to_flat_m: float, ring: str = "ring", area_id: str | None = None) -> DataFrame:
    """Cells (cell_id, q, r, x, y, lng, lat) whose centre is strictly inside the polygon(s)."""
    w = float(flat_to_flat_m)
    h = w * math.sqrt(3.0) / 2.0  # distance between hex rows
    b = geo.ring_bounds(geo.ring_to_xy(F.col(ring)), "x", "y")
    b = area.select(*([area_id] if area_id else []), ring, b["min_x"].alias("__x0"), b["max_x"].alias("__x1"),
                    b["min_y"].alias("__y0"), b["max_y"].alias("__y1"))
    rows = b.select("*", F.explode(F.sequence(F.floor(F.col("__y0") / h).cast("long"),
                                              F.ceil(F.col("__y1") / h).cast("long"))).alias("r"))
    rows = rows.repartition("r")  # a single area's cells are made in many tasks
    # centre x = (q + r/2) * w  =>  q in [x0/w - r/2, x1/w - r/2]
    q0 = F.floor(F.col("__x0") / w - F.col("r") / 2.0).cast("long")
    q1 = F.ceil(F.col("__x1") / w - F.col("r") / 2.0).cast("long")
    cells = rows.select("*", F.explode(F.sequence(q0, q1)).alias("q")).select(
        *([area_id] if area_id else []), ring, "q", "r",
        ((F.col("q") + F.col("r") / 2.0) * w).alias("x"), (F.col("r") * h).alias("y"))
    cells = geo.with_lnglat(cells)
    cells = cells.where(geo.contains(F.col(ring), F.col("lng"), F.col("lat")))
    cells = cells.dropDuplicates(["q", "r"]) if area_id is None else cells
    return cells.select(
        F.concat_ws(":", F.col("q").cast("string"), F.col("r").cast("string")).alias("cell_id"),
        *([area_id] if area_id else []), "q", "r", "x", "y", "lng", "lat")
