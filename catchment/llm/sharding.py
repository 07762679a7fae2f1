"""Sharding by histogram sort: byte counts under probe keys, refined until the splitters fit, then one exchange."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import land

PROBE_BITS = 12
SLOT_ROWS = 20_000


def row_size(text: Column) -> Column:
    """Stored size of a row: the UTF-8 bytes of its text (null: none) plus 8."""
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 8).cast("long")


def _refine(keys: DataFrame, targets: list[int], tolerance: float) -> list[tuple[tuple[int, ...], int]]:
    """For each target, the splitter: a key prefix path and the exact bytes below it.

    ``keys`` has the columns a, b (order-preserving, non-negative halves of the
    key, up to 63 bits each) and size. A bracket is a prefix of the key's bits;
    each round counts the bytes of the 4096 sub-brackets of every bracket that
    still holds a target outside the tolerance, all targets in one aggregation.
    """
    total_bits = 63
    open_ = {(0, 0, 0): list(range(len(targets)))}  # (level, prefix of a, prefix of b) -> targets inside
    below = {(0, 0, 0): 0}
    found: dict[int, tuple[int, int, int]] = {}
    level = 0
    while open_:
        on_b = level >= total_bits
        bits = min(PROBE_BITS, total_bits - (level - total_bits if on_b else level))
        done = level - total_bits if on_b else level
        shift = total_bits - done - bits
        if not on_b:
            prefix = F.shiftright("a", total_bits - level) if level else F.lit(0).cast("long")
            inside = prefix.isin([p[1] for p in open_]) if level else F.lit(True)
            child = F.shiftright("a", shift)
            counted = keys.filter(inside).groupBy(child.alias("child")).agg(F.sum("size").alias("bytes")).collect()
            rows = sorted((r["child"] >> bits, 0, r["child"], r["bytes"]) for r in counted)
        else:
            groups = sorted({p[1] for p in open_})
            prefix = F.shiftright("b", total_bits - done) if done else F.lit(0).cast("long")
            wanted = None
            for _, a, b in open_:
                c = (F.col("a") == a) & (prefix == b)
                wanted = c if wanted is None else wanted | c
            child = F.shiftright("b", shift)
            counted = keys.filter(F.col("a").isin(groups) & wanted).groupBy("a", child.alias("child")).agg(F.sum("size").alias("bytes")).collect()
            rows = sorted((r["a"], r["child"] >> bits, r["child"], r["bytes"]) for r in counted)
        next_open: dict[tuple[int, int, int], list[int]] = {}
        next_below: dict[tuple[int, int, int], int] = {}
        for (lv, a, b), inside_targets in open_.items():
            bins = [(c, n) for pa, pb, c, n in rows if pa == a and pb == b]
            for t in inside_targets:
                at, last = below[(lv, a, b)], None
                for c, n in bins:
                    if at + n <= targets[t]:
                        at, last = at + n, c
                        continue
                    # the target lies in this bin; its near edge may be close enough
                    low, high = targets[t] - at, at + n - targets[t]
                    exhausted = on_b and shift == 0
                    if min(low, high) <= tolerance or exhausted:
                        edge = c if low <= high else c + 1
                        found[t] = (edge << shift, 0, at if low <= high else at + n) if not on_b else (a, edge << shift, at if low <= high else at + n)
                    else:
                        key = (level + bits, c, 0) if not on_b else (level + bits, a, c)
                        next_open.setdefault(key, []).append(t)
                        next_below[key] = at
                    break
                else:
                    edge = (last + 1 if last is not None else 0) << shift
                    found[t] = (edge, 0, at) if not on_b else (a, edge, at)
        open_, below, level = next_open, next_below, level + bits
    return [((found[t][0], found[t][1]), found[t][2]) for t in range(len(targets))]


def splitters(keys: DataFrame, shards: int, tolerance: float = 0.002) -> list[tuple[int, int]]:
    """``shards - 1`` splitter keys (a, b); shard i holds the keys from splitter i-1 up to, not including, splitter i."""
    total = keys.agg(F.sum("size")).first()[0] or 0
    targets = [total * i // shards for i in range(1, shards)]
    return [k for k, _ in _refine(keys, targets, tolerance * total / shards)]


def assign_shards(docs: DataFrame, shards: int = 24, id_col: str = "doc_id", text_col: str = "text",
                  tolerance: float = 0.002, order_col: str | None = None) -> DataFrame:
    """``docs`` plus shard (0 .. shards-1), slot (gapless from 0 in its shard) and size.

    The law is `bytes`: shards hold nearly equal bytes. The sort key is (hash of
    the text, id), so equal texts lie together and mostly share a shard, while
    a group larger than the tolerance is cut between two of its ids. Only
    counts per probe bracket reach the driver (4096 per open splitter and
    round); the rows move once, to their slots. A null text is a group of rows
    of size 8; null ids sort as -2**62. Equal (text, id) rows can't be told
    apart and stay in one shard. An empty table gives no rows.

    With ``order_col``, a column that numbers the rows from 0, the slots of a
    shard follow that order.

    Columns of ``docs`` named shard, slot or size are replaced.
    """
    spark = docs.sparkSession
    a = F.shiftrightunsigned(F.xxhash64(text_col), 1)
    b = F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 62)))
    b = F.shiftrightunsigned(b.bitwiseXOR(F.lit(-(1 << 63))), 1)  # order-preserving, without the lowest bit
    keyed = docs.drop("shard", "slot", "size").withColumns({"__a": a, "__b": b, "size": row_size(F.col(text_col))})
    keys = land(keyed.select(F.col("__a").alias("a"), F.col("__b").alias("b"), "size"))
    cuts = sorted(splitters(keys, shards, tolerance))
    shard = F.lit(0)
    for x, y in cuts:
        past = (F.col("__a") > x) | ((F.col("__a") == x) & (F.col("__b") >= y))
        shard = shard + past.cast("int")
    n = keys.count()
    bins = max(1, -(-n // (shards * SLOT_ROWS)))
    if order_col is None:
        bin_ = F.pmod(F.xxhash64(F.lit(17), "__b", "__a"), F.lit(bins))
    else:
        step = max(1, -(-n // bins))
        bin_ = F.floor(F.col(order_col) / step)
    placed = keyed.withColumns({"shard": shard.cast("int"), "__bin": bin_.cast("int")})
    # slots: exact counts of the bins before, plus the place in the bin, so that no shard is one task
    before = F.sum("n").over(Window.partitionBy("shard").orderBy("__bin").rowsBetween(Window.unboundedPreceding, -1))
    starts = (
        placed.groupBy("shard", "__bin").agg(F.count("*").alias("n"))
        .select("shard", "__bin", F.coalesce(before, F.lit(0)).alias("__before"))
    )
    inner = Window.partitionBy("shard", "__bin").orderBy(*(["__a", "__b"] if order_col is None else [order_col]))
    return (
        placed.withColumn("__rn", F.row_number().over(inner)).join(starts, ["shard", "__bin"])
        .withColumn("slot", (F.col("__before") + F.col("__rn") - 1).cast("long"))
        .select(*[c for c in docs.columns if c not in ("shard", "slot", "size")], "size", "shard", "slot")
    )
