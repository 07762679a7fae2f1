"""Merkle manifest of a dataset: per-group hash trees of fan-out 16 under one root, with a proof for every row.

A node's place in its group comes from one range sort and the counts of the
sort's partitions, so no task holds a group. Per level a window over each run
of 16 nodes gives every node its siblings by lags and leads of fixed offset,
masked by the node's slot and the length of its run; the row in slot 0 hashes
itself and its leads into the parent. Levels are landed; each is a sixteenth of the one below.

Defined cases: a null field is encoded as ``-`` and differs from an empty one.
Null groups are a group of their own and come first, as do null order values
within a group. Rows equal in group and order value follow the order of their
leaves; wholly equal rows have equal leaves and a place each. A group of one
row is its own subroot, one group's subroot is the root. An empty table gives
an empty manifest. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import checkpoint
from .common import ascii_lower, land

FAN_OUT = 16
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
PATH = "array<struct<left:string,right:string>>"


def encoded(value: Column) -> Column:
    """``-`` for null, else the number of UTF-8 bytes, a colon and the value as text."""
    s = value.cast("string")
    return F.when(s.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s))


def leaf_hash(fields: Sequence[Column]) -> Column:
    """Lowercase hex SHA-256 of the encoded fields, concatenated."""
    return F.sha2(F.concat(*[encoded(f) for f in fields]), 256)


def _places(nodes: DataFrame, order: Sequence[str]) -> DataFrame:
    """``nodes`` with ``pos`` (0, 1, ... within ``g``, by ``order``, nulls first) and ``cnt`` (nodes of the group).

    A range sort deals even one group to many partitions; a row's place is its
    row number there plus the group's rows in the partitions before.
    """
    ranked = land(nodes.orderBy("g", *[F.asc_nulls_first(c) for c in order]).withColumn("__m", F.monotonically_increasing_id()))
    ranked = ranked.withColumn("__p", F.shiftright("__m", 33))
    parts = ranked.groupBy("g", "__p").agg(F.count("*").alias("__n"), F.min("__m").alias("__first"))
    w = Window.partitionBy("g")
    before = F.coalesce(F.sum("__n").over(w.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = parts.select("g", "__p", (before - F.col("__first")).alias("__shift"), F.sum("__n").over(w).alias("cnt"))
    return ranked.join(parts, ["g", "__p"]).withColumn("pos", F.col("__m") + F.col("__shift")).drop("__m", "__p", "__shift")


def _siblings(nodes: DataFrame) -> DataFrame:
    """Nodes of groups that have several, with ``run``, ``slot`` and the digests ``left`` and ``right`` of them in their run."""
    n = nodes.where("cnt > 1").withColumns({"run": F.floor(F.col("pos") / FAN_OUT), "slot": F.col("pos") % FAN_OUT})
    length = F.least(F.lit(FAN_OUT), F.col("cnt") - F.col("run") * FAN_OUT)
    w = Window.partitionBy("g", "run").orderBy("slot")
    steps = range(1, FAN_OUT)
    lags = [F.when(F.col("slot") >= j, F.lag("digest", j).over(w)) for j in reversed(steps)]
    leads = [F.when(F.col("slot") + j < length, F.lead("digest", j).over(w)) for j in steps]
    return n.withColumns({"left": F.concat_ws("", *lags), "right": F.concat_ws("", *leads)})


def _levels(leaves: DataFrame, keep: Sequence[str]) -> list[DataFrame]:
    """The levels of every group's tree, each (g, keep..., pos, cnt, digest), from the leaves up to one node a group."""
    levels = [leaves]
    most = leaves.agg(F.max("cnt")).first()[0] or 0
    while most > 1:
        parents = _siblings(levels[-1]).where("slot = 0").select(
            "g", *keep, F.col("run").alias("pos"), F.ceil(F.col("cnt") / FAN_OUT).alias("cnt"),
            F.sha2(F.concat("digest", "right"), 256).alias("digest"))
        level, seen = checkpoint(parents, observe={"most": F.max("cnt")})
        most = seen["most"] or 0
        levels.append(level)
    return levels


def _paths(levels: list[DataFrame], tops: DataFrame, carry: Sequence[str], leaf_cols: Sequence[str]) -> DataFrame:
    """Leaves with ``path``: the siblings on the way up, then the path of the group's top.

    ``tops`` has one row a group: (g, path, carry...). Paths are handed down a
    level at a time by joins on (group, run), at most 16 nodes a key.
    """
    above = None
    for level, nodes in reversed(list(enumerate(levels))):
        cols = leaf_cols if level == 0 else ["pos"]
        alone = nodes.where("cnt = 1").select("g", *cols).join(tops, "g")
        if above is None:
            above = alone
            continue
        up = above.withColumnsRenamed({"pos": "run", "path": "__up"})
        step = F.concat(F.array(F.struct("left", "right")), "__up").cast(PATH)
        below = _siblings(nodes).join(up, ["g", "run"]).select("g", *cols, step.alias("path"), *carry)
        above = below.unionByName(alone.select(below.columns))
        if level:  # landed like the levels, so that a task never holds the sorts and joins of all levels at once
            above = land(above)
    return above


def manifest(docs: DataFrame, fields: Sequence[str] = FIELDS, group: str = "source", order: str = "doc_id",
             extra: dict[str, Column] | None = None) -> DataFrame:
    """(order, group, leaf, extra..., subroot, root, path) for every row.

    ``path`` holds, level by level from the row's run to the root, the digests
    of the siblings to the left and to the right as text; folding it over the
    leaf gives the root (``fold``). ``extra`` columns are computed with the leaves and carried along.
    """
    extra = extra or {}
    rows = docs.select(
        encoded(F.col(group)).alias("g"), F.col(group).alias("__group"), F.col(order).alias("__order"),
        leaf_hash([F.col(f) for f in fields]).alias("digest"), *[v.alias(k) for k, v in extra.items()])
    rows = land(rows.withColumn("__u", F.monotonically_increasing_id()))
    leaves = _places(rows, ["__order", "digest", "__u"])
    levels = _levels(leaves.select("g", "__group", "pos", "cnt", "digest"), ["__group"])
    tops = [n.where("cnt = 1").select("__group", F.col("g").alias("__g"), "digest") for n in levels]
    subroots = _places(reduce(DataFrame.unionByName, tops).withColumn("g", F.lit(0)), ["__group"])
    upper = _levels(subroots.select("g", "pos", "cnt", "digest"), [])
    root = reduce(DataFrame.unionByName, [n.where("cnt = 1").select("g", F.col("digest").alias("root")) for n in upper])
    top = root.withColumn("path", F.array().cast(PATH))
    upper[0] = subroots
    tops = _paths(upper, top, ["root"], ["__g", "digest"]).select(
        F.col("__g").alias("g"), "path", F.col("digest").alias("subroot"), "root")
    own = ["__order", "__group", "digest", *extra]
    levels[0] = leaves
    out = _paths(levels, land(tops), ["subroot", "root"], own)
    return out.select(F.col("__order").alias(order), *([F.col("__group").alias(group)] if group != order else []),
                      F.col("digest").alias("leaf"), *extra, "subroot", "root", "path")


def fold(leaf: Column, path: Column) -> Column:
    """The root that ``leaf`` gives under the siblings of ``path``."""
    return F.aggregate(path, leaf, lambda node, p: F.sha2(F.concat(p["left"], node, p["right"]), 256))


def proof_hash(path: Column) -> Column:
    """SHA-256 of all siblings of a path, level by level, left to right."""
    return F.sha2(F.array_join(F.transform(path, lambda p: F.concat(p["left"], p["right"])), ""), 256)


def tampered_leaf(fields: Sequence[str] = FIELDS, order: str = "doc_id", text: str = "text") -> Column:
    """The leaf after A-Z of the text became lower case, for ids whose CRC-32 (of the decimal id) is a multiple of 5; else null."""
    leaf = leaf_hash([ascii_lower(F.col(text)) if f == text else F.col(f) for f in fields])
    return F.when(F.crc32(F.col(order).cast("string").cast("binary")) % 5 == 0, leaf)
