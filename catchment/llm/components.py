"""Connected components of an edge table by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import land


def _star(pairs: DataFrame) -> DataFrame:
    """Each pair (a, b) with the least of a and all its partners."""
    least = pairs.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return pairs.join(least, "a")


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node of each node's component, for every node with an edge (columns a, b, long).

    Each round links larger neighbours to the least node around (large star),
    then smaller ones and the node itself (small star). Rounds grow with the
    logarithm of the longest path. A node with very many neighbours is a
    partial aggregate and a join that Spark can split; only a count and a
    checksum reach the driver. Self-loops and null ends count as no edge.
    """
    e = land(edges.filter(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    mark = None
    while True:
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = _star(both).filter(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a != b").distinct()
        small = _star(large)
        e = land(
            small.select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("x"))
            .select("x.a", "x.b").filter("a != b").distinct()
        )
        now = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == mark or not now[0]:
            break
        mark = now
    nodes = e.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return nodes.unionByName(e.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
