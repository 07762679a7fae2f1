"""Exact nearest search on a density-adaptive quadtree.

Objects have a Morton key. Cells of the tree are counted exactly, two levels a
step: the first count is at a depth at which cells of an even layer would hold
about ``LEAF`` objects, its ancestors are rolled up from it, and only cells
with more objects are counted again one step deeper, until none is left. So a
dense city gets small cells and the country large ones. A node keeps the tight
bounding box of its objects.

Sites go down the tree together. At each step every node a site still holds is
replaced by its children (an equi-join on the node's key), the smallest of
their farthest corners bounds the site's distance from above, and nodes whose
nearest point is farther than the bound are dropped. What stays are the leaves
around the site's circle, however far its objects are. Their objects are
measured the same way: first by their boxes, then exactly.

The number of joins grows with the logarithm of the layer, no join pairs a
site with a constant share of it, and only counts of nodes reach the driver.
Objects of one group at one place are one entry (the lowest id), so a third of
all objects at one spot costs nothing.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import checkpoint

LEAF = 32
AXIS_BITS = 28
STEPS = AXIS_BITS // 2  # a step is two levels of the tree, 16 children
BOX = ("x0", "y0", "x1", "y1")


def _spread(v: Column) -> Column:
    """The bits of a number of 28 bits, each followed by a zero bit."""
    for shift, mask in ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555)):
        v = v.bitwiseOR(F.shiftleft(v, shift)).bitwiseAND(F.lit(mask))
    return v


def _morton(x: Column, y: Column, x0: float, y0: float, span: float) -> Column:
    def cell(v: Column, low: float) -> Column:
        return F.least(F.greatest(F.floor((v - F.lit(low)) / F.lit(span) * float(1 << AXIS_BITS)), F.lit(0)), F.lit((1 << AXIS_BITS) - 1)).cast("long")

    return _spread(cell(x, x0)).bitwiseOR(F.shiftleft(_spread(cell(y, y0)), 1))


def _node(step: int) -> Column:
    """The key of the node that holds an object at a depth of ``step``: its prefix of the Morton key behind a marking bit."""
    return F.shiftright("__m", 4 * (STEPS - step)).bitwiseOR(F.lit(1 << (4 * step)))


def _gap(sx: Column, sy: Column, far: bool) -> Column:
    """Distance from a site to the nearest point of a box, or to its farthest corner."""
    if far:
        dx = F.greatest(F.abs(sx - F.col("x0")), F.abs(sx - F.col("x1")))
        dy = F.greatest(F.abs(sy - F.col("y0")), F.abs(sy - F.col("y1")))
    else:
        dx = F.greatest(F.col("x0") - sx, sx - F.col("x1"), F.lit(0.0))
        dy = F.greatest(F.col("y0") - sy, sy - F.col("y1"), F.lit(0.0))
    return F.sqrt(dx * dx + dy * dy)


def _box() -> list[Column]:
    return [F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1")]


def build_tree(objects: DataFrame, total: int) -> tuple[list[DataFrame], list[DataFrame]]:
    """Node tables of every step, and the objects by the step of their leaf, keyed by ``__node``.

    ``objects`` have ``__g`` (group), ``__m`` (Morton key) and a box. Nodes are
    (__g, __node, __up, n, box); one with more than ``LEAF`` objects has children in the next table.
    """
    def count(some: DataFrame, step: int) -> tuple[DataFrame, int]:
        nodes = some.groupBy("__g", _node(step).alias("__node")).agg(F.count("*").alias("n"), *_box())
        nodes, seen = checkpoint(nodes.withColumn("__up", F.shiftright("__node", 4)), observe={"heavy": F.count_if(F.col("n") > LEAF)})
        return nodes, seen["heavy"] or 0

    first = min(STEPS, max(1, math.ceil(math.log(max(total, 1) / LEAF, 16)))) if total > LEAF else 1
    tables, leaves = [], []
    nodes, heavy = count(objects, first)
    above = nodes
    for step in range(first - 1, 0, -1):
        above = above.groupBy("__g", F.col("__up").alias("__node")).agg(F.sum("n").alias("n"), *_box()).withColumn("__up", F.shiftright("__node", 4))
        tables.insert(0, above)
    tables.append(nodes)
    rest, step = objects.withColumn("__node", _node(first)), first
    while heavy and step < STEPS:
        dense = nodes.where(F.col("n") > LEAF).select("__g", "__node")
        leaves.append(rest.join(dense, ["__g", "__node"], "left_anti"))
        rest = rest.join(dense, ["__g", "__node"], "left_semi")
        step += 1
        rest = rest.withColumn("__node", _node(step))
        nodes, heavy = count(rest.drop("__node"), step)
        tables.append(nodes)
    leaves.append(rest)
    return tables, leaves


def search(
    sites: DataFrame,
    objects: DataFrame,
    site_id: str,
    object_id: str,
    by: Sequence[str] = (),
    by_values: Sequence | None = None,
    attrs: Sequence[str] = (),
    dist: Callable[[Column, Column], Column] | None = None,
    box: Sequence[str] | None = None,
    carry: Sequence[str] = (),
    best_of_all: bool = False,
    dist_col: str = "d",
) -> DataFrame:
    """The nearest object of every site, in each group of the columns ``by``.

    Objects are points ``x, y``, or have a bounding box (``box``: columns of its
    least x, least y, greatest x, greatest y) and a distance ``dist(sx, sy)``
    that is never below the box's nearest point nor above its farthest corner.
    Ties keep the lowest ``object_id``.

    The result has a row for every site and every value of ``by`` in
    ``by_values`` (default: those in the data, NULL among them); sites without
    coordinates and sites whose group is empty get NULL. With ``best_of_all``
    groups only steer the search, and there is one row a site, the nearest of all groups.
    """
    by = list(by)
    planar = dist is None
    at = list(box) if box else ["x", "y", "x", "y"]
    obj = objects.where(F.col("x").isNotNull() & F.col("y").isNotNull()).select(
        *by, object_id, "x", "y", *[F.col(c).alias(n) for c, n in zip(at, BOX)], *dict.fromkeys([*attrs, *carry]))
    if planar:
        # one entry a place: the lowest id there is all that ties can give
        same = obj.groupBy(*by, "x", "y").agg(F.min(F.struct(object_id, *attrs)).alias("__e"))
        obj = same.select(*by, "__e.*", "x", "y", *[F.col(c).alias(n) for c, n in zip(at, BOX)])
    # landed once, with the extent and the number of objects from the same pass
    obj, e = checkpoint(obj, observe={"n": F.count("*"), "x0": F.min("x"), "y0": F.min("y"), "x1": F.max("x"), "y1": F.max("y")})
    if by:
        if by_values is not None:
            vals = [v if isinstance(v, tuple) else (v,) for v in by_values]
            groups = objects.sparkSession.createDataFrame(vals, ", ".join(f"`{b}` {objects.schema[b].dataType.simpleString()}" for b in by))
        else:
            groups = obj.select(*by).distinct()
        # one row a group, numbered; objects and sites carry the number
        groups, seen = checkpoint(groups.select(*by, F.row_number().over(Window.orderBy(*by)).alias("__g")), observe={"n": F.count("*")})
        n_groups = seen["n"]
        same = F.lit(True)
        named = groups.select(*[F.col(b).alias(f"__b{i}") for i, b in enumerate(by)], "__g")
        for i, b in enumerate(by):
            same = same & F.col(b).eqNullSafe(F.col(f"__b{i}"))
        obj = obj.join(named, same).drop(*by, *named.columns[:-1])
    else:
        n_groups = 1
        obj = obj.withColumn("__g", F.lit(1))
    x0, y0 = float(e["x0"] or 0.0), float(e["y0"] or 0.0)
    span = max(float(e["x1"] or 0.0) - x0, float(e["y1"] or 0.0) - y0, 1e-6) * (1 + 1e-9)
    obj = obj.withColumn("__m", _morton(F.col("x"), F.col("y"), x0, y0, span))
    tables, leaves = build_tree(obj.select("__g", "__m", *BOX, object_id) if not planar else obj, e["n"] or 0)

    sx, sy = F.col("__sx"), F.col("__sy")
    everyone = sites.select(F.col(site_id), F.col("x").alias("__sx"), F.col("y").alias("__sy"))
    rows = everyone.withColumn("__g", F.explode(F.sequence(F.lit(1), F.lit(n_groups)))) if n_groups else everyone.withColumn("__g", F.lit(None).cast("int"))
    front = rows.where(sx.isNotNull() & sy.isNotNull() & F.col("__g").isNotNull()).select(
        "*", F.lit(1).cast("long").alias("__node"), F.lit(float("inf")).alias("__far"))
    whole = Window.partitionBy(site_id, "__sx", "__sy", *([] if best_of_all else ["__g"]))

    def prune(some: DataFrame, near: Column) -> DataFrame:
        """Rows whose nearest point isn't beyond the least of the farthest corners."""
        bound = F.min("__far").over(whole)
        return some.withColumn("__bound", bound).where(near <= F.col("__bound") * (1 + 1e-12) + 1e-9).drop("__bound")

    for nodes in tables:
        below = nodes.select(F.col("__g").alias("__h"), F.col("__up"), F.col("__node").alias("__child"), *BOX)
        front = front.join(below, (F.col("__g") == F.col("__h")) & (F.col("__node") == F.col("__up")), "left")
        # a leaf has no children and stays as it is
        front = front.withColumns({"__near": F.coalesce(_gap(sx, sy, False), F.lit(0.0)), "__far": F.least(F.col("__far"), F.coalesce(_gap(sx, sy, True), F.lit(float("inf"))))})
        front = front.withColumn("__node", F.coalesce("__child", "__node")).drop("__h", "__up", "__child", *BOX)
        front = prune(front, F.col("__near")).drop("__near")
    front, _ = checkpoint(front.drop("__far").where("__node > 1"))

    found = None
    for part in leaves:
        pairs = front.join(part.drop("__m"), ["__g", "__node"])
        found = pairs if found is None else found.unionByName(pairs)
    if planar:
        found = found.withColumn("__d", _gap(sx, sy, False))
    else:
        boxed = found.withColumns({"__near": _gap(sx, sy, False), "__far": _gap(sx, sy, True)})
        chosen = prune(boxed, F.col("__near")).select(site_id, "__sx", "__sy", "__g", F.col(object_id).alias("__o"))
        held = obj.select(F.col("__g").alias("__h"), F.col(object_id), *dict.fromkeys([*attrs, *carry]))
        found = chosen.join(held, (F.col("__o") == F.col(object_id)) & (F.col("__g") == F.col("__h"))).withColumn("__d", dist(sx, sy))
    keys = [site_id] if best_of_all else [site_id, "__g"]
    best = found.groupBy(*keys).agg(F.min(F.struct(F.col("__d").alias("d"), F.col(object_id).alias("id"), *attrs)).alias("__best"))
    best = best.withColumnsRenamed({k: f"__k{i}" for i, k in enumerate(keys)})
    if best_of_all:
        out = everyone.join(best, F.col(site_id) == F.col("__k0"), "left")
    else:
        out = rows.join(best, (F.col(site_id) == F.col("__k0")) & (F.col("__g") == F.col("__k1")), "left")
        if by:
            out = out.join(groups.withColumnRenamed("__g", "__h"), F.col("__g") == F.col("__h"), "left")
    return out.select(site_id, *([] if best_of_all else by), F.col("__best.d").alias(dist_col), F.col("__best.id").alias(object_id),
                      *[F.col(f"__best.{a}").alias(a) for a in attrs])
