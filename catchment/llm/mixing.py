"""Mixing sources to target weights by Pfair scheduling: releases, deadlines, earliest deadline first."""

from __future__ import annotations

import heapq
from array import array
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import land

BIN_ROWS = 20_000


def source_plan(docs: DataFrame, weights: dict[str, float] | None = None, alpha: float = 0.5,
                hyperperiod: int = 1000, source_col: str = "source") -> DataFrame:
    """(src, n, a, h): rows per source and its ``a`` slots of every ``h``; the ``a`` add up to ``h``. Weights are rounded.

    Weights are given by source (sources not named get 0, hence one slot) or
    are proportional to ``n ** alpha``. ``h`` is the given hyperperiod, or four
    times the number of sources if that is more. Every source has a slot at
    least; the rest is dealt by largest remainder, ties to the smaller name.
    Null is a source of its own.
    """
    n = docs.groupBy(F.col(source_col).alias("src")).agg(F.count("*").alias("n"))
    if weights is None:
        w = F.pow(F.col("n"), F.lit(float(alpha)))
    else:
        given = F.create_map(*[F.lit(x) for kv in weights.items() for x in kv]) if weights else None
        w = F.coalesce(given[F.coalesce("src", F.lit(""))], F.lit(0.0)) if weights else F.lit(1.0)
    every = Window.partitionBy(F.lit(0))
    shared = (
        n.withColumn("w", w)
        .withColumns({"k": F.count("*").over(every), "all": F.sum("w").over(every)})
        .withColumn("h", F.greatest(F.lit(hyperperiod), 4 * F.col("k")).cast("long"))
        .withColumn("part", F.when(F.col("all") > 0, F.col("w") / F.col("all")).otherwise(1.0 / F.col("k")) * (F.col("h") - F.col("k")))
        .withColumn("base", F.floor("part"))
    )
    left = F.col("h") - F.col("k") - F.sum("base").over(every)
    order = F.row_number().over(every.orderBy((F.col("base") - F.col("part")), F.col("src").asc_nulls_first()))
    return shared.withColumns({"left": left, "ord": order}).select(
        "src", "n", (1 + F.col("base") + (F.col("ord") <= F.col("left")).cast("long")).cast("long").alias("a"), "h")


def slot_template(plan: DataFrame) -> DataFrame:
    """(src, k, t, counts): the slot ``t`` of block ``k`` of each source within one hyperperiod.

    Block k of a source with a slots of h is released at floor(k*h/a) and due by
    ceil((k+1)*h/a). Each slot goes to the released block with the earliest
    deadline (ties: the first source). One processor under full load meets all
    deadlines, so every source is less than one block away from its share at
    any time. ``counts`` has, for every source in order, its blocks before
    slot t. The table has h rows, whatever the corpus.
    """
    one = plan.groupBy("h").agg(F.array_sort(F.collect_list(F.struct(F.coalesce("src", F.lit("")).alias("name"), F.col("src").isNotNull().alias("named"), "a"))).alias("s"))
    one = one.withColumn("zero", F.transform("s", lambda x: F.lit(0).cast("long")))

    def step(state, t):
        def due(x, i):
            k = F.get(state["done"], i)
            late = F.ceil((k + 1) * F.col("h") / x["a"]).cast("long")
            released = F.floor(k * F.col("h") / x["a"]).cast("long") <= t
            return F.struct(F.when(released, late).otherwise(F.lit(1 << 60)).alias("due"), i.alias("i"))

        first = F.array_min(F.transform("s", due))["i"]
        done = F.transform(state["done"], lambda d, i: d + (i == first).cast("long"))
        row = F.struct(first.alias("i"), F.get(state["done"], first).alias("k"), state["done"].alias("counts"))
        return F.struct(done.alias("done"), F.concat(state["out"], F.array(row)).alias("out"))

    empty = F.array().cast("array<struct<i:int,k:bigint,counts:array<bigint>>>")
    run = F.aggregate(F.sequence(F.lit(0).cast("long"), F.col("h") - 1), F.struct(F.col("zero").alias("done"), empty.alias("out")), step)
    return (
        one.withColumn("run", run["out"]).select("s", F.posexplode("run").alias("t", "x"))
        .withColumn("who", F.get("s", F.col("x.i")))
        .select(F.when(F.col("who.named"), F.col("who.name")).alias("src"), F.col("x.k").alias("k"), F.col("t").cast("long").alias("t"), F.col("x.counts").alias("counts"))
    )


def schedule(blocks: list[int], weights: list[float]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(source, block, slot) of every block in the order of the slots, for sources with so many ``blocks`` and such ``weights``.

    With the share w of the weights, in exact fractions, block b of a source is
    released at floor(b/w) and due by ceil((b+1)/w); each slot goes to the
    released block with the earliest deadline (ties: the first source). One
    processor under full load meets all deadlines, so every source is less than
    one block away from w*t at any time t until it runs out. Slots for which
    nothing is released stay empty. Sources of weight 0 follow after all
    others, in equal shares; if no source has a weight, all have the same.
    """
    exact = [max(Fraction(w), Fraction(0)) for w in weights]
    out = array("i"), array("q"), array("q")
    at = 0
    for turn in ([i for i, w in enumerate(exact) if w], [i for i, w in enumerate(exact) if not w]):
        share = {i: exact[i] or Fraction(1) for i in turn}
        total = sum(share.values())
        every = {i: (total / w).as_integer_ratio() for i, w in share.items()}  # slots a block
        pending, ready, done = [(0, i) for i in turn if blocks[i]], [], dict.fromkeys(turn, 0)
        t = 0
        while pending or ready:
            if not ready:
                t = max(t, pending[0][0])
            while pending and pending[0][0] <= t:
                _, i = heapq.heappop(pending)
                up, down = every[i]
                heapq.heappush(ready, (-(-(done[i] + 1) * up // down), i))
            _, i = heapq.heappop(ready)
            for column, x in zip(out, (i, done[i], at + t)):
                column.append(x)
            done[i] += 1
            t += 1
            if done[i] < blocks[i]:
                up, down = every[i]
                heapq.heappush(pending, (done[i] * up // down, i))
        at += t
    return tuple(np.frombuffer(x, x.typecode) if len(x) else np.zeros(0, x.typecode) for x in out)


def _placed(numbered: DataFrame, sources: list, weights: dict[str, float] | None, alpha: float, block_rows: int, made: list[str]) -> DataFrame:
    """``numbered`` with the slots of ``schedule``; ``sources`` are the rows (src, n) in order."""
    spark = numbered.sparkSession
    n = np.array([r["n"] for r in sources], np.int64)
    if weights is None:
        target = [float(r["n"]) ** alpha for r in sources]
    else:
        target = [weights.get(r["src"] if r["src"] is not None else "", 0.0) for r in sources]
    source, block, slot = schedule([-(-r["n"] // block_rows) for r in sources], target)
    held = np.minimum(block_rows, n[source] - block * block_rows)
    made_slots = pa.table({"__i": pa.array(source, pa.int32()), "__block": pa.array(block), "mix_slot": pa.array(slot), "__start": pa.array(np.cumsum(held) - held)})
    slots = land(spark.createDataFrame(made_slots))
    index = spark.createDataFrame([(r["src"], i) for i, r in enumerate(sources)], numbered.select(F.col("__src").alias("__s3"), F.lit(0).alias("__i0")).schema)
    return (
        numbered.join(F.broadcast(index), F.col("__src").eqNullSafe(F.col("__s3")))  # one row a source
        .join(slots, (F.col("__i0") == F.col("__i")) & (F.col("mix_block") == F.col("__block")))
        .withColumn("mix_offset", F.pmod("__row", F.lit(block_rows)).cast("int"))
        .withColumn("mix_position", F.col("__start") + F.col("mix_offset"))
        .select(*made)
    )


def mix(docs: DataFrame, weights: dict[str, float] | None = None, alpha: float = 0.5, block_rows: int = 16,
        hyperperiod: int | None = None, id_col: str = "doc_id", source_col: str = "source") -> DataFrame:
    """``docs`` plus mix_block, mix_slot, mix_offset and mix_position (gapless from 0).

    Each source's rows, in the order of a hash of the id, form blocks of
    ``block_rows``. Weights are given by source (others get 0) or are
    proportional to ``n ** alpha``. Slots come from ``schedule``, straight from
    the weights: as long as a source lasts, it is less than one block away from
    its share, however many slots have passed. Slots of a source that has run
    out stay empty or go to blocks that are due later, so no row is lost and
    the others keep their shares. mix_position counts the rows in earlier
    slots. The driver makes the schedule: a step and 28 bytes for every block.

    With a ``hyperperiod``, weights are rounded to slots of it, at least one for
    every source, and block b of a source goes to slot
    ``(b div a) * h + t(b mod a)`` of the repeated template, with mix_position
    in closed form.

    Rows are dealt by (source, hash bin), so a source with a third of all rows
    is many tasks. Ids that repeat keep an arbitrary but fixed order among equal
    rows. An empty table gives no rows. Existing columns named mix_* are
    replaced.
    """
    made = ["mix_block", "mix_slot", "mix_offset", "mix_position"]
    docs = docs.drop(*made)
    if hyperperiod is None:
        sources = docs.groupBy(F.col(source_col).alias("src")).agg(F.count("*").alias("n")).orderBy(F.col("src").asc_nulls_first()).collect()
        total = sum(r["n"] for r in sources)
    else:
        plan = land(source_plan(docs, weights, alpha, hyperperiod, source_col))
        template = land(slot_template(plan))
        total = plan.agg(F.sum("n")).first()[0] or 0
    bits = max(0, (total // BIN_ROWS)).bit_length()
    h64 = F.xxhash64(F.col(id_col))
    rows = docs.withColumns({"__src": F.col(source_col), "__h": h64, "__bin": (F.shiftrightunsigned(h64, 64 - bits) if bits else F.lit(0)).cast("long")})
    sizes = rows.groupBy("__src", "__bin").agg(F.count("*").alias("__n"))
    before = F.sum("__n").over(Window.partitionBy("__src").orderBy("__bin").rowsBetween(Window.unboundedPreceding, -1))
    sizes = sizes.select(F.col("__src").alias("__s2"), F.col("__bin").alias("__b2"), F.coalesce(before, F.lit(0)).alias("__before"))
    numbered = rows.withColumn("__rn", F.row_number().over(Window.partitionBy("__src", "__bin").orderBy("__h", id_col)) - 1)
    numbered = (
        numbered.join(sizes, F.col("__src").eqNullSafe(F.col("__s2")) & (F.col("__bin") == F.col("__b2")))
        .withColumn("__row", F.col("__before") + F.col("__rn"))
        .withColumn("mix_block", F.floor(F.col("__row") / block_rows).cast("long"))
    )
    if hyperperiod is None:
        return _placed(numbered, sources, weights, alpha, block_rows, [*docs.columns, *made])
    # h rows, and one row a source: both bounded by parameters and the number of sources
    order = plan.groupBy(F.col("h").alias("__h6")).agg(F.array_sort(F.collect_list(F.struct(F.coalesce("src", F.lit("")).alias("name"), F.col("src").isNotNull().alias("named"), "n", "a"))).alias("__all"))
    slots = (
        template.join(plan.select(F.col("src").alias("__s4"), "a", "h"), F.col("src").eqNullSafe(F.col("__s4")))
        .join(F.broadcast(order), F.col("h") == F.col("__h6"))  # one row
        .select(F.col("src").alias("__s3"), F.col("k").alias("__k"), F.col("t").alias("__t"), F.col("a").alias("__pa"), F.col("h").alias("__ph"),
                F.zip_with("__all", "counts", lambda s, c: F.struct(s["n"].alias("n"), s["a"].alias("a"), c.alias("c"))).alias("__counts"))
    )
    shares = plan.select(F.col("src").alias("__s5"), F.col("a").alias("__a"))
    out = (
        numbered.join(F.broadcast(shares), F.col("__src").eqNullSafe(F.col("__s5")))
        .withColumn("__cycle", F.floor(F.col("mix_block") / F.col("__a")).cast("long"))
        .join(F.broadcast(slots), F.col("__src").eqNullSafe(F.col("__s3")) & (F.pmod("mix_block", "__a") == F.col("__k")))
        .withColumn("mix_slot", F.col("__cycle") * F.col("__ph") + F.col("__t"))
        .withColumn("mix_offset", F.pmod("__row", F.lit(block_rows)).cast("int"))
    )
    earlier = F.aggregate("__counts", F.lit(0).cast("long"), lambda acc, s: acc + F.least(s["n"], block_rows * (F.col("__cycle") * s["a"] + s["c"])))
    return out.withColumn("mix_position", earlier + F.col("mix_offset")).select(*docs.columns, *made)
