"""Overlay areas against closed forms and against rectangles on a compressed grid."""
import math

import numpy as np
import pytest

from catchment.functions import geo
from catchment.operators import overlay
from pyspark.sql import functions as F


def layer(spark, texts):
    return spark.createDataFrame([(t,) for t in texts], "wkt string").select(geo.wkt_ring(F.col("wkt")).alias("ring"))


def wkt(*rings):
    return "POLYGON (" + ", ".join("(" + ", ".join(f"{x!r} {y!r}" for x, y in [*r, r[0]]) + ")" for r in rings) + ")"


def box(x0, y0, x1, y1):
    return [(x0, y0), (x1, y0), (x1, y1), (x0, y1)]


def turned(cx, cy, half, angle):
    return [(cx + half * math.sqrt(2) * math.cos(angle + k * math.pi / 2), cy + half * math.sqrt(2) * math.sin(angle + k * math.pi / 2)) for k in range(4)]


def areas(spark, a, b):
    r = overlay.overlay_areas(layer(spark, a), layer(spark, b)).first()
    return r.union_area, r.outside_area


@pytest.mark.parametrize("edges", [256, 8])
def test_closed_forms(spark, monkeypatch, edges):
    monkeypatch.setattr(overlay, "TILE_EDGES", edges)
    close = lambda got, want: all(abs(g - w) < 1e-9 for g, w in zip(got, want))
    # touching squares, an overlap, a repeated one
    assert close(areas(spark, [wkt(box(0., 0., 1., 1.)), wkt(box(1., 0., 2., 1.)), wkt(box(1.5, .5, 2.5, 1.5)), wkt(box(0., 0., 1., 1.))], [wkt(box(0., 0., 1., 1.))]), (2.75, 1.75))
    # a square with a hole and an island in it, under a layer that covers its left half
    ring = [wkt(box(0., 0., 8., 8.), box(2., 2., 6., 6.)), wkt(box(3., 3., 5., 5.))]
    assert close(areas(spark, ring, [wkt(box(-1., -1., 4., 9.))]), (64 - 16 + 4, (64 - 16 + 4) / 2))
    # a square and the same one turned by 45 degrees: an eight-pointed star
    s = [wkt(turned(0., 0., 1., math.pi / 4)), wkt(turned(0., 0., 1., 0.))]
    corners = 4 * (math.sqrt(2) - 1) ** 2
    assert close(areas(spark, s, s[:1]), (4 + corners, corners))
    # discs of 400 corners that cross each other
    n = 400
    disc = lambda cx: [(cx + math.cos(2 * math.pi * k / n), math.sin(2 * math.pi * k / n)) for k in range(n)]
    whole = n / 2 * math.sin(2 * math.pi / n)
    apart, outside = areas(spark, [wkt(disc(0.)), wkt(disc(10.))], [wkt(disc(0.))])
    assert close((apart, outside), (2 * whole, whole))
    lens, _ = areas(spark, [wkt(disc(0.)), wkt(disc(1.))], [])
    assert abs(2 * math.pi - lens - (2 * math.pi / 3 - math.sqrt(3) / 2)) < 1e-3


def test_random_boxes_equal_a_compressed_grid(spark, monkeypatch):
    monkeypatch.setattr(overlay, "TILE_EDGES", 16)
    rng = np.random.default_rng(7)
    boxes = [(x, y, x + w, y + h) for x, y, w, h in zip(*rng.uniform(0, 10, (2, 150)), *rng.uniform(.01, 1.5, (2, 150)))]
    boxes += [(5 + x, 5 + y, 5 + x + .02, 5 + y + .02) for x, y in rng.uniform(0, .2, (150, 2))]  # a dense town
    other = boxes[::3]
    xs, ys = (np.unique([b[i] for b in boxes for i in k]) for k in ((0, 2), (1, 3)))
    inside = lambda some: sum(((xs[:-1, None] >= b[0]) & (xs[1:, None] <= b[2]) & (ys[None, :-1] >= b[1]) & (ys[None, 1:] <= b[3])).astype(int) for b in some) > 0
    cell = np.diff(xs)[:, None] * np.diff(ys)[None, :]
    a, b = inside(boxes), inside(other)
    got = areas(spark, [wkt(box(*map(float, x))) for x in boxes], [wkt(box(*map(float, x))) for x in other])
    assert abs(got[0] - cell[a].sum()) < 1e-9 and abs(got[1] - cell[a & ~b].sum()) < 1e-9


def test_empty_layers_and_null_rings(spark):
    one = wkt(box(0., 0., 2., 1.))
    assert areas(spark, [], [one]) == (0.0, 0.0)
    assert areas(spark, [one, None], []) == (2.0, 2.0)
