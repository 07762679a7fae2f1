"""Benchmark decontamination: a broadcast hash table of normalised test n-grams against all training token windows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import doc_key, land, null_safe_join, words

PREFIX = 3
#: Largest table of test windows, in bytes of text, that is sent to every executor; a larger one is joined by shuffle.
BROADCAST_BYTES = 32 << 20


def test_windows(benchmark: DataFrame, n: int = 10, item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(w, len, p, ph, items): the distinct windows of all items, keyed by a hash of their first words.

    A window is ``n`` consecutive words, or all words of an item with fewer.
    Items without words (null, empty) have none. ``items`` lists the ids, as
    strings, of the items that hold the window; a null id stays out of it.
    """
    b = benchmark.select(F.col(item_col).cast("string").alias("item"), words(F.col(text_col)).alias("ws")).filter(F.size("ws") > 0)
    b = b.withColumn("len", F.least(F.size("ws"), F.lit(n)))
    b = b.select("item", "len", "ws", F.explode(F.sequence(F.lit(1), F.size("ws") - F.col("len") + 1)).alias("at"))
    b = b.select("item", "len", F.slice("ws", F.col("at"), F.col("len")).alias("w"))
    p = F.least(F.col("len"), F.lit(PREFIX))
    return (
        b.groupBy("w", "len").agg(F.array_sort(F.collect_set("item")).alias("items"))
        .withColumn("p", p).withColumn("ph", F.xxhash64(*[F.get("w", F.lit(i)) for i in range(PREFIX)]))
    )


def hits(docs: DataFrame, benchmark: DataFrame, n: int = 10, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document key with hits: spans (first word, words) and the sorted item ids.

    Every word position looks up the hash of its next three words in the
    table; the few that are in it are verified word by word over the whole
    window, so a hash collision can't give a hit. Windows of one or two words
    are looked up by as many.
    """
    windows = land(test_windows(benchmark, n))
    stats = windows.groupBy("p").agg(F.sum(F.octet_length(F.concat_ws(" ", "w")) + 16 * F.size("items") + 64).alias("bytes")).collect()
    small = sum(r["bytes"] for r in stats) <= BROADCAST_BYTES
    tokens = docs.select(*doc_key(id_col, text_col), words(F.col(text_col)).alias("ws"))
    at = tokens.select(id_col, "__th", "__th2", "ws", F.posexplode("ws").alias("pos", "w0"))
    found = None
    for p in sorted(r["p"] for r in stats):
        ahead = [F.get("ws", F.col("pos") + i) if i < p else F.lit(None).cast("string") for i in range(1, PREFIX)]
        side = windows.filter(F.col("p") == p).select("w", "len", "ph", "items")
        some = (
            at.withColumn("ph", F.xxhash64("w0", *ahead)).join(F.broadcast(side) if small else side, "ph")
            .filter(F.slice("ws", F.col("pos") + 1, F.col("len")) == F.col("w"))
            .select(id_col, "__th", "__th2", F.struct(F.col("pos").alias("pos"), F.col("len").alias("len")).alias("span"), "items")
        )
        found = some if found is None else found.unionByName(some)
    if found is None:
        found = at.select(id_col, "__th", "__th2", F.struct(F.col("pos").alias("pos"), F.lit(0).alias("len")).alias("span"), F.array(F.lit("")).alias("items")).filter(F.lit(False))
    return found.groupBy(id_col, "__th", "__th2").agg(
        F.array_sort(F.collect_set("span")).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("item_ids"))


def contamination(docs: DataFrame, benchmark: DataFrame, n: int = 10, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All rows of ``docs`` with n_words, n_hit (words inside any occurring window), hit_spans and item_ids.

    ``hit_spans`` has merged (first word, words) runs. Null and empty texts
    have no words and no hits; an empty benchmark hits nothing. Identical rows
    get the same figures. Columns of ``docs`` with these names are replaced.
    """
    made = ["n_words", "n_hit", "hit_spans", "item_ids"]
    docs = docs.drop(*made)
    found = hits(docs, benchmark, n, id_col, text_col)
    start = F.struct(F.lit(0).alias("end"), F.array().cast("array<struct<pos:int,len:int>>").alias("out"))

    def merge(acc, s):
        end = s["pos"] + s["len"]
        last = F.get(acc["out"], F.size(acc["out"]) - 1)
        joined = F.concat(F.slice(acc["out"], 1, F.size(acc["out"]) - 1),
                          F.array(F.struct(last["pos"].alias("pos"), (F.greatest(acc["end"], end) - last["pos"]).alias("len"))))
        added = F.concat(acc["out"], F.array(F.struct(s["pos"].alias("pos"), s["len"].alias("len"))))
        touches = (F.size(acc["out"]) > 0) & (s["pos"] <= acc["end"])
        return F.struct(F.greatest(acc["end"], end).alias("end"), F.when(touches, joined).otherwise(added).alias("out"))

    found = found.withColumn("hit_spans", F.aggregate("spans", start, merge)["out"]).drop("spans")
    base = docs.withColumns({"__th": F.xxhash64(text_col), "__th2": F.hash(text_col), "n_words": F.size(words(F.col(text_col))).cast("long")})
    full = null_safe_join(base, found, [id_col, "__th", "__th2"])
    total = F.aggregate("hit_spans", F.lit(0), lambda a, s: a + s["len"])
    return full.withColumns({
        "n_hit": F.coalesce(total, F.lit(0)).cast("long"),
        "hit_spans": F.coalesce("hit_spans", F.array().cast("array<struct<pos:int,len:int>>")),
        "item_ids": F.coalesce("item_ids", F.array().cast("array<string>")),
    }).select(*docs.columns, *made)


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, n: int = 10) -> DataFrame:
    """``docs`` without the documents that hold a test window."""
    return contamination(docs, benchmark, n).filter(F.col("n_hit") == 0).select(*docs.columns)


def remove_spans(docs: DataFrame, benchmark: DataFrame, n: int = 10, text_col: str = "text") -> DataFrame:
    """``docs`` with hit words cut out of the text; the lower-cased words left are joined by one space."""
    full = contamination(docs, benchmark, n)
    ws = words(F.col(text_col))
    kept = F.filter(ws, lambda w, i: ~F.exists("hit_spans", lambda s: (i >= s["pos"]) & (i < s["pos"] + s["len"])))
    return full.withColumn(text_col, F.when(F.col("n_hit") > 0, F.concat_ws(" ", kept)).otherwise(F.col(text_col))).select(*docs.columns)
