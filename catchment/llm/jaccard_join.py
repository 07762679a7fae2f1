"""N-gram Jaccard self-join: a MinHash LSH forest proposes, exact shingle sets decide."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER_BYTE, WORD_BYTE, buffers, land, mix64, null_safe_join, slices, text_batches, token_hashes, token_spans
from .components import components

TREES = 20
DEPTH = 5
BLOCK = 512
_RNG = np.random.default_rng(20260101)
_MULTIPLIERS = (_RNG.integers(0, 1 << 31, TREES * DEPTH, dtype=np.int64) * 2 + 1).astype(np.uint32)
_OFFSETS = _RNG.integers(0, 1 << 32, TREES * DEPTH, dtype=np.int64).astype(np.uint32)


def shingles(data: np.ndarray, offsets: np.ndarray, n: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the word n-grams of every row, and where each row's begin.

    Words are lower-cased (A-Z) runs of digits, letters and non-ASCII
    characters. A row with fewer words than ``n``, but some, has one shingle of
    all of them; a row without words has none.
    """
    data = LOWER_BYTE[data]
    starts, ends, rows = token_spans(data, offsets, WORD_BYTE)
    count = len(offsets) - 1
    words = np.bincount(rows, minlength=count)
    grams = np.where(words > 0, np.maximum(words - n + 1, 1), 0)
    begin = np.concatenate([[0], np.cumsum(grams)])
    if not begin[-1]:
        return np.zeros(0, np.uint64), begin
    hashes = token_hashes(data, starts, ends)
    first_word = np.concatenate([[0], np.cumsum(words)])[:-1]
    row = np.repeat(np.arange(count), grams)
    at = first_word[row] + np.arange(begin[-1]) - begin[:-1][row]
    short = words[row] < n
    padded = np.concatenate([hashes, np.zeros(n, np.uint64)])
    total = np.zeros(len(at), np.uint64)
    with np.errstate(over="ignore"):
        for i in range(n):
            part = padded[at + i]
            if short.any():
                part = np.where(short & (i >= words[row]), np.uint64(0), part)
            total += part * np.uint64(0x9E3779B97F4A7C15 + 2 * 0x5851F42D4C957F2D * i & 0xFFFFFFFFFFFFFFFF | 1)
        return mix64(total), begin


def prefix_depth(threshold: float, recall: float, trees: int = TREES, depth: int = DEPTH) -> int:
    """The longest prefix at which a pair at the threshold shares one in some tree with the target probability.

    The prefix starts at full depth and is shortened step by step.
    """
    while depth > 1 and 1 - (1 - threshold**depth) ** trees < recall:
        depth -= 1
    return depth


def _signatures(n: int, depth: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches):
        for batch in slices(batches, "text"):
            data, offsets = buffers(batch.column(batch.schema.get_field_index("text")))
            hashes, begin = shingles(data, offsets, n)
            full = np.flatnonzero(np.diff(begin))
            sig = np.empty((len(full), TREES * DEPTH), np.uint32)
            if len(full):
                low, at = (hashes >> np.uint64(32)).astype(np.uint32), begin[:-1][full]
                with np.errstate(over="ignore"):
                    for j in range(TREES * DEPTH):
                        sig[:, j] = np.minimum.reduceat(low * _MULTIPLIERS[j] + _OFFSETS[j], at)
            keys = np.zeros((len(full), TREES), np.uint64)
            with np.errstate(over="ignore"):
                for t in range(TREES):
                    for d in range(depth):
                        keys[:, t] = mix64(keys[:, t] + sig[:, t * DEPTH + d].astype(np.uint64) + np.uint64(t * 64 + d + 1))
            lists, bits = [None] * batch.num_rows, [None] * batch.num_rows
            short = (sig & np.uint32(255)).astype(np.uint8)
            for i, row in enumerate(full):
                lists[row], bits[row] = keys[i].view(np.int64), short[i].tobytes()
            columns = [batch.column(batch.schema.get_field_index(c)) for c in ("doc_id", "h1", "h2")]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(lists, pa.list_(pa.int64())), pa.array(bits, pa.binary())], ["doc_id", "h1", "h2", "keys", "bits"])

    return run


def _groups(batches: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[pd.DataFrame]:
    """The frames of equal keys of a sorted stream, whole even where Arrow batches cut them."""
    rest: pd.DataFrame | None = None
    for batch in batches:
        if rest is not None:
            batch = pd.concat([rest, batch], ignore_index=True)
        if not len(batch):
            continue
        values = batch[keys].to_numpy()
        cuts = np.flatnonzero((values[1:] != values[:-1]).any(axis=1)) + 1
        at = 0
        for c in cuts:
            yield batch.iloc[at:c]
            at = c
        rest = batch.iloc[at:]
    if rest is not None and len(rest):
        yield rest


def _lowest(adjacent: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """The least id of each row's component in a symmetric boolean matrix."""
    label = ids.copy()
    while True:
        low = np.minimum(label, np.where(adjacent, label[None, :], np.iinfo(np.int64).max).min(axis=1))
        if (low == label).all():
            return label
        label = low


def _cross(left: np.ndarray, right: np.ndarray, same_block: bool) -> np.ndarray:
    """Which pairs of a block pair count: all distinct ones within a block, else those from one side to the other."""
    if same_block:
        pairs = np.ones((len(left), len(left)), bool)
        np.fill_diagonal(pairs, False)
        return pairs
    return left[:, None] != right[None, :]


def _candidates(least: float):
    """Edges from each node of a bucket to the least node of its cluster by estimated similarity."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        a, b = [], []
        for g in _groups(batches, ["key", "bi", "bj"]):
            ids = g["node"].to_numpy()
            bits = np.frombuffer(b"".join(g["bits"]), np.uint8).reshape(len(g), -1)
            if len(g) == 2:
                if (bits[0] == bits[1]).mean() >= least:
                    a.append(ids[0])
                    b.append(ids[1])
            else:
                block = g["block"].to_numpy()
                adjacent = np.zeros((len(g), len(g)), bool)
                for i in range(len(g)):
                    adjacent[i] = (bits == bits[i]).mean(axis=1) >= least
                adjacent &= _cross(block, block, bool(g["bi"].iat[0] == g["bj"].iat[0]))
                low = _lowest(adjacent, ids)
                some = low != ids
                a.extend(ids[some])
                b.extend(low[some])
            if len(a) >= 100_000:
                yield pd.DataFrame({"a": np.array(a, np.int64), "b": np.array(b, np.int64)}).drop_duplicates()
                a, b = [], []
        yield pd.DataFrame({"a": np.array(a, np.int64), "b": np.array(b, np.int64)}).drop_duplicates()

    return run


def _overlaps(hashes: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sizes of the rows' shingle sets and of all their intersections."""
    n = len(begin) - 1
    row = np.repeat(np.arange(n), np.diff(begin))
    order = np.lexsort((row, hashes))
    hashes, row = hashes[order], row[order]
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (row[1:] != row[:-1])
    hashes, row = hashes[new], row[new]
    sizes = np.bincount(row, minlength=n)
    first = np.ones(len(hashes), bool)
    first[1:] = hashes[1:] != hashes[:-1]
    column = np.cumsum(first) - 1
    shared = np.bincount(column) > 1 if len(column) else np.zeros(0, bool)
    keep = shared[column] if len(column) else np.zeros(0, bool)
    renumber = np.cumsum(shared) - 1
    row, column = row[keep], renumber[column[keep]] if keep.any() else np.zeros(0, np.int64)
    both = np.zeros((n, n), np.float64)
    width = 4096
    for at in range(0, int(shared.sum()), width):  # columns ascend: chunks are slices
        lo, hi = np.searchsorted(column, [at, at + width])
        part = np.zeros((n, width), np.float32)
        part[row[lo:hi], column[lo:hi] - at] = 1
        both += part @ part.T
    return sizes, both


def _verify(n: int, threshold: float):
    """Exact links of a block pair: per node the documents it links to, and the least node linked to it there."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        nodes, links, lows, kept = [], [], [], 0
        for g in _groups(batches, ["comp", "bi", "bj"]):
            g = g.drop_duplicates("node")
            if len(g) < 2:
                continue
            data, offsets = buffers(pa.array(g["text"], pa.string()))
            sizes, both = _overlaps(*shingles(data, offsets, n))
            union = sizes[:, None] + sizes[None, :] - both
            block, ids = g["block"].to_numpy(), g["node"].to_numpy()
            linked = (both >= threshold * union - 1e-9) & (union > 0) & _cross(block, block, bool(g["bi"].iat[0] == g["bj"].iat[0]))
            some = linked.any(axis=1)
            if some.any():
                nodes.append(ids[some])
                links.append((linked @ g["copies"].to_numpy())[some].astype(np.int64))
                lows.append(_lowest(linked, ids)[some])
                kept += int(some.sum())
            if kept >= 50_000:
                yield pd.DataFrame({"node": np.concatenate(nodes), "links": np.concatenate(links), "low": np.concatenate(lows)})
                nodes, links, lows, kept = [], [], [], 0
        if nodes:
            yield pd.DataFrame({"node": np.concatenate(nodes), "links": np.concatenate(links), "low": np.concatenate(lows)})

    return run


def _in_blocks(rows: DataFrame, group: str, size: str) -> DataFrame:
    """Rows of large groups dealt to all pairs of blocks that their own block is in: (group, bi, bj), each pair of rows together once."""
    blocks = F.ceil(F.col(size) / BLOCK).cast("int")
    rows = rows.withColumns({"__k": blocks, "block": F.pmod(F.xxhash64("node"), blocks).cast("int")})
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("__k") - 1)))
    rows = rows.withColumns({"bi": F.least("block", "other"), "bj": F.greatest("block", "other")}).drop("__k", "other")
    return rows.repartition(group, "bi", "bj").sortWithinPartitions(group, "bi", "bj", "node")


def near_duplicates(docs: DataFrame, threshold: float = 0.8, n: int = 5, recall: float = 0.9999,
                    id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, h1, h2 (text hashes), rep_id, class_id, n_links.

    rep_id is the least id with the same text; class_id the least id of the
    connected component of links; n_links the number of other documents whose
    text is equal or whose sets of ``n``-word shingles have a Jaccard
    similarity of ``threshold`` or more. Null ids sort last; a null text counts
    as empty. Texts without words link to equal texts only.

    1. Each text gets a MinHash signature of 20 trees by up to 5 values and its
       prefix keys at the depth that reaches ``recall`` at the threshold.
    2. Texts that share a key are compared by 100 one-byte hashes; those 5
       standard deviations below the threshold or more can't link. Clusters
       of the rest become candidate components.
    3. Within a candidate component all pairs are compared exactly, as matrix
       products of blocks of at most 512 texts; a group of any size is many
       block pairs, and a row per text, not per pair, leaves each.

    Only a pair that shares no prefix is lost: one in 30,000 at the threshold,
    fewer above it.
    """
    text_batches(docs.sparkSession)
    depth = prefix_depth(threshold, recall)
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), text.alias("text")).withColumns(
        {"h1": F.xxhash64("text"), "h2": F.xxhash64(F.lit(11), "text")})
    id_type = dict(rows.dtypes)["doc_id"]
    signed = land(rows.mapInArrow(_signatures(n, depth), f"doc_id {id_type}, h1 long, h2 long, keys array<long>, bits binary"))
    classes = land(
        signed.groupBy("h1", "h2").agg(F.min("doc_id").alias("rep_id"), F.count("*").alias("copies"), F.first("keys").alias("keys"), F.first("bits").alias("bits"))
        .withColumn("node", F.monotonically_increasing_id())
    )
    keyed = classes.select("node", F.explode("keys").alias("key"))
    shared = keyed.groupBy("key").agg(F.count("*").alias("size")).filter("size > 1")
    least = max(0.0, threshold - 5 * (threshold * (1 - threshold) / (TREES * DEPTH)) ** 0.5)
    buckets = keyed.join(shared, "key").join(classes.select("node", "bits"), "node")
    near = _in_blocks(buckets, "key", "size").select("key", "bi", "bj", "block", "node", "bits").mapInPandas(_candidates(least), "a long, b long")
    proposed = land(components(near))
    sizes = proposed.groupBy("root").agg(F.count("*").alias("size"))
    members = proposed.join(sizes, "root").join(classes.select("node", "h1", "h2", "rep_id", "copies"), "node").select(
        F.col("root").alias("comp"), "size", "node", "copies", "rep_id", F.col("h1").alias("g1"), F.col("h2").alias("g2"))
    texts = rows.join(members, F.col("doc_id").eqNullSafe(F.col("rep_id")) & (F.col("h1") == F.col("g1")) & (F.col("h2") == F.col("g2")))
    blocks = _in_blocks(texts.select("comp", "size", "node", "copies", "text"), "comp", "size")
    verified = land(blocks.select("comp", "bi", "bj", "block", "node", "copies", "text").mapInPandas(_verify(n, threshold), "node long, links long, low long"))
    links = verified.groupBy("node").agg(F.sum("links").alias("links"))
    roots = land(components(verified.select(F.col("node").alias("a"), F.col("low").alias("b"))))
    named = classes.select("node", "h1", "h2", "rep_id", "copies").join(roots, "node", "left").join(links, "node", "left")
    named = named.withColumn("root", F.coalesce("root", "node"))
    group = named.groupBy("root").agg(F.min("rep_id").alias("class_id"))
    named = named.join(group, "root").select(
        F.col("h1").alias("g1"), F.col("h2").alias("g2"), "rep_id", "class_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    return (
        signed.select("doc_id", "h1", "h2").join(named, (F.col("h1") == F.col("g1")) & (F.col("h2") == F.col("g2")))
        .select("doc_id", "h1", "h2", "rep_id", "class_id", "n_links")
    )


def keep_one_per_group(docs: DataFrame, threshold: float = 0.8, n: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each connected component of near duplicates: the one with the least id.

    Of rows that share both that id and the text, one stays. Where an id
    repeats with different texts, each of them that is in the group stays; a
    group whose ids are all null keeps one row of each text.
    """
    found = land(near_duplicates(docs, threshold, n, id_col=id_col, text_col=text_col))
    stay = found.filter(F.col("doc_id").eqNullSafe(F.col("class_id")) | (F.col("class_id").isNull() & F.col("rep_id").isNull()))
    stay = stay.groupBy(F.col("doc_id").alias("__id"), F.col("h1").alias("__h1"), F.col("h2").alias("__h2")).agg(F.count("*").alias("times"))
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.withColumns({"__id": F.col(id_col), "__h1": F.xxhash64(text), "__h2": F.xxhash64(F.lit(11), text)})
    kept = null_safe_join(rows, stay.drop("times"), ["__id", "__h1", "__h2"], "left_semi")
    if not stay.filter("times > 1").isEmpty():
        kept = kept.dropDuplicates(["__id", "__h1", "__h2"])
    return kept.select(*docs.columns)
