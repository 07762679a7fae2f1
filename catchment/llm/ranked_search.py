"""Ranked lexical search turned round: the items are the index, the documents stream through it.

The few, short items become an inverted index (term -> items) that goes to
every task; documents, however many, are read once a block of items. A first
pass counts each document's index terms and lands them with the document's
length; from it come the statistics of all documents (number, total length,
document frequencies). A second pass turns the landed counts into scores and
keeps a bounded heap of the best documents for every item; the tasks' heaps are merged by a window.

Items are dealt to blocks of at most ``BLOCK_BYTES`` of text and
``BLOCK_ITEMS`` rows (on average over a hash), so what is broadcast doesn't
grow with their number; more items mean more passes.

Defined cases: null and empty texts have no terms, such items get no rows and
such documents are not counted. Document ids are integers; a null id ranks
after all others among equal scores. Repeated document rows rank each on
their own; repeated rows of an item (same id and text) are one item. Equal ids
with different texts are items of their own under one id. Terms are told apart
by a 64-bit hash and their length in bytes. Empty tables give no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import LOWER_BYTE, buffers, land, slices, small_batches, token_hashes, token_spans

BLOCK_BYTES = 8 << 20
BLOCK_ITEMS = 50_000
CELLS = 1 << 22  # scores and posting entries held at once in a task
NO_ID = np.iinfo(np.int64).max

# Bytes of terms: digits, letters and every byte of a non-ASCII character.
TERM_BYTE = np.ones(256, bool)
TERM_BYTE[0x00:0x30] = TERM_BYTE[0x3A:0x41] = TERM_BYTE[0x5B:0x61] = TERM_BYTE[0x7B:0x80] = False


def _terms(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, byte length and row of every term of a text column."""
    data, offsets = buffers(column)
    data = LOWER_BYTE[data]
    starts, ends, rows = token_spans(data, offsets, TERM_BYTE)
    return token_hashes(data, starts, ends), ends - starts, rows


class ItemIndex:
    """Terms of a block of items, sorted by hash, with the items that hold them and how often."""

    def __init__(self, numbers: list[int], texts: list[str | None]):
        hashes, sizes, rows = _terms(pa.array(texts, pa.large_string()))
        key = np.rec.fromarrays([hashes, sizes])
        terms, which = np.unique(key, return_inverse=True)
        self.hash, self.size = np.array(terms.f0), np.array(terms.f1)
        pairs, times = np.unique(which.astype(np.int64) * max(1, len(texts)) + rows, return_counts=True)
        self.item, self.times = pairs % max(1, len(texts)), times
        self.start = np.searchsorted(pairs // max(1, len(texts)), np.arange(len(terms) + 1))
        self.numbers = np.array(numbers, np.int64)

    def find(self, hashes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Number of each term, -1 where no item holds it."""
        if not len(self.hash):
            return np.full(len(hashes), -1)
        at = np.searchsorted(self.hash, hashes)
        at[at == len(self.hash)] = 0
        found = np.where((self.hash[at] == hashes) & (self.size[at] == sizes), at, -1)
        # the same hash with several lengths: look at the neighbours one by one
        late = np.flatnonzero((self.hash[at] == hashes) & (found < 0))
        for i in late:
            j = at[i]
            while j < len(self.hash) and self.hash[j] == hashes[i]:
                if self.size[j] == sizes[i]:
                    found[i] = j
                j += 1
        return found


def _count_terms(index) -> callable:
    schema = pa.schema([("id", pa.int64()), ("n", pa.int64()), ("terms", pa.list_(pa.int32())), ("tfs", pa.list_(pa.int32()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        idx: ItemIndex = index.value
        for b in slices(batches, "text"):
            hashes, sizes, rows = _terms(b.column(1))
            n = np.bincount(rows, minlength=b.num_rows)
            term = idx.find(hashes, sizes)
            hit = term >= 0
            width = max(1, len(idx.hash))
            pairs, tf = np.unique(rows[hit] * width + term[hit], return_counts=True)
            offsets = pa.array(np.searchsorted(pairs // width, np.arange(b.num_rows + 1)), pa.int32())
            out = pa.RecordBatch.from_arrays([
                b.column(0).cast(pa.int64()), pa.array(n, pa.int64()),
                pa.ListArray.from_arrays(offsets, pa.array(pairs % width, pa.int32())),
                pa.ListArray.from_arrays(offsets, pa.array(tf, pa.int32()))], schema=schema)
            yield out.filter(pa.array(n > 0))

    return run


class _Heaps:
    """The ``k`` best (score, id) of every item: higher scores first, then smaller ids."""

    def __init__(self, items: int, k: int):
        self.k = k
        self.score = np.zeros((items, k), np.int64)
        self.id = np.full((items, k), NO_ID, np.int64)

    def offer(self, scores: np.ndarray, ids: np.ndarray) -> None:
        """Take in the scores of some documents (rows) for every item (columns)."""
        doc, item = np.nonzero(scores >= np.maximum(self.score[:, -1], 1))
        if not len(doc):
            return
        touched, at = np.unique(item, return_inverse=True)
        old = self.score[touched] > 0
        rows = np.nonzero(old)[0]
        s = np.concatenate([scores[doc, item], self.score[touched][old]])
        d = np.concatenate([ids[doc], self.id[touched][old]])
        i = np.concatenate([at, rows])
        order = np.lexsort((d, -s, i))
        i, s, d = i[order], s[order], d[order]
        place = np.arange(len(i)) - np.searchsorted(i, i)
        best = place < self.k
        self.score[touched[i[best]], place[best]] = s[best]
        self.id[touched[i[best]], place[best]] = d[best]


def _score(index, stats, k: int) -> callable:
    """Scores of the landed documents; a task gives its heaps at its end."""
    schema = pa.schema([("item", pa.int64()), ("id", pa.int64()), ("score", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        idx: ItemIndex = index.value
        weight, n_docs, total = stats.value
        items = len(idx.numbers)
        heaps = _Heaps(items, k)
        entries = np.diff(idx.start)
        for b in batches:
            ids = b.column(0).fill_null(NO_ID).to_numpy(zero_copy_only=False)
            m = np.array([75 + 25 * x * n_docs // total for x in b.column(1).to_pylist()], np.int64)
            terms, tf = b.column(2).flatten().to_numpy().astype(np.int64), b.column(3).flatten().to_numpy().astype(np.int64)
            counts = b.column(2).value_lengths().to_numpy(zero_copy_only=False)
            doc = np.repeat(np.arange(b.num_rows), counts)
            part = weight[terms] * ((1_000_000_000 * tf) // (1000 * tf + 12 * m[doc]))
            ends = np.concatenate([[0], np.cumsum(counts)])
            work = np.concatenate([[0], np.cumsum(entries[terms])])[ends]
            first = 0
            while first < b.num_rows:
                last = int(np.searchsorted(work, work[first] + CELLS, "right")) - 1
                last = min(max(last, first + 1), first + max(1, CELLS // max(1, items)), b.num_rows)
                t = slice(ends[first], ends[last])
                size = entries[terms[t]]
                flat = np.repeat(idx.start[terms[t]] - np.concatenate([[0], np.cumsum(size)])[:-1], size) + np.arange(size.sum())
                cell = np.repeat(doc[t] - first, size) * items + idx.item[flat]
                value = np.repeat(part[t], size) * idx.times[flat]
                # exact sums of 64-bit integers: two sums of doubles below 2**53
                cells = (last - first) * items
                high = np.bincount(cell, value >> 30, cells).astype(np.int64)
                low = np.bincount(cell, value & ((1 << 30) - 1), cells).astype(np.int64)
                heaps.offer(((high << 30) + low).reshape(last - first, items), ids[first:last])
                first = last
        item, place = np.nonzero(heaps.score > 0)
        ids = heaps.id[item, place]
        yield pa.RecordBatch.from_arrays([
            pa.array(idx.numbers[item], pa.int64()), pa.array(ids, pa.int64(), mask=ids == NO_ID),
            pa.array(heaps.score[item, place], pa.int64())], schema=schema)

    return run


def search(docs: DataFrame, items: DataFrame, k: int = 20, id_col: str = "doc_id", text_col: str = "text",
           item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """(item, rank, id, score): the ``k`` documents with the highest positive scores for every item, ties by ascending id.

    Score of a document: over the item's terms, repeats included, the sum of
    w * ((10^9 tf) div (1000 tf + 12 m)), with w = floor(1000 ln((2 N + 2) / (2 df + 1)))
    and m = 75 + (25 n N) div L, over the statistics of all documents.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    asked = items.select(F.col(item_col).alias("item_id"), F.col(item_text).cast("string").alias("text")).where("text is not null").distinct()
    asked = land(asked.withColumn("item", F.monotonically_increasing_id()))
    n_items, size = asked.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    blocks = max(1, -(-size // BLOCK_BYTES), -(-n_items // BLOCK_ITEMS))
    found = []
    for block in range(blocks):
        rows = asked.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == block).select("item", "text").collect()
        index = ItemIndex([r["item"] for r in rows], [r["text"] for r in rows])
        shared = spark.sparkContext.broadcast(index)
        with small_batches(spark):
            counted = land(texts.mapInArrow(_count_terms(shared), "id long, n long, terms array<int>, tfs array<int>"))
            n_docs, total = counted.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
            # as many rows at most as the block has terms
            df = counted.select(F.explode("terms").alias("t")).groupBy("t").agg(F.count("*").alias("n")).collect()
            weight = np.zeros(max(1, len(index.hash)), np.int64)
            for r in df:
                weight[r["t"]] = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * r["n"] + 1)))
            stats = spark.sparkContext.broadcast((weight, n_docs, max(1, total)))
            found.append(land(counted.mapInArrow(_score(shared, stats, k), "item long, id long, score long")))
    best = reduce(DataFrame.unionByName, found)
    rank = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("id")))
    best = best.withColumn("rank", rank).where(F.col("rank") <= k)
    return best.join(asked.select("item", "item_id"), "item").select(F.col("item_id").alias(item_col), "rank", F.col("id").alias(id_col), "score")
