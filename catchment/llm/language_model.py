"""Language-model scoring: a hashed maximum-entropy model over n-gram and skip features with a class-factored softmax."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER_BYTE, buffers, land, mix64, slices, text_batches, token_hashes, token_spans
from .toxicity import fold

#: Tokens are runs of bytes other than the space and 0x09-0x0D.
TOKEN_BYTE = np.ones(256, bool)
TOKEN_BYTE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False
END = np.uint64(0xE0D0E0D0E0D0E0D1)
START = np.uint64(0x5151515151515151)

HEAD_ROWS = 1 << 17  # most frequent tokens, sent to every task
SINGLES = 24  # most frequent tokens that are classes of their own
HEAD_CLASSES, TAIL_CLASSES = 32, 7
ENDINGS = HEAD_CLASSES * TAIL_CLASSES  # no common factor: an ending's hash gives both classes by remainder
CLASSES = SINGLES + 1 + HEAD_CLASSES + TAIL_CLASSES  # 64, with the end token's
FEATURES = 1 << 15
SHARDS = 128
CHUNK = 4096
TEMPLATES = 4  # previous token, previous two, token before, token two before


def tokens(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, suffix, row) of every token, one end token after each row's. ``suffix`` hashes a token's last three bytes."""
    data, offsets = buffers(column)
    data = LOWER_BYTE[data]
    starts, ends, row = token_spans(data, offsets, TOKEN_BYTE)
    hashes = token_hashes(data, starts, ends)
    last = data[ends - 1].astype(np.uint64)
    for back in (2, 3):
        at = ends - back
        last = last * np.uint64(257) + np.where(at >= starts, data[np.maximum(at, 0)], 0).astype(np.uint64) if len(ends) else last
    rows = len(offsets) - 1
    n = np.bincount(row, minlength=rows)
    at = np.cumsum(n)
    return (np.insert(hashes, at, END), np.insert(mix64(last), at, np.uint64(0)), np.insert(row, at, np.arange(rows)))


def _held_in(column_batch: pa.RecordBatch) -> np.ndarray:
    return ~column_batch.column(column_batch.schema.get_field_index("held_out")).to_numpy(zero_copy_only=False).astype(bool)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text"):
        hashes, suffix, row = tokens(batch.column(batch.schema.get_field_index("text")))
        own = _held_in(batch)[row]
        h, first, n = np.unique(hashes[own], return_index=True, return_counts=True)
        tail = (suffix[own][first] % np.uint64(ENDINGS)).astype(np.int32)
        yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(tail), pa.array(n.astype(np.int64))], ["h", "ending", "n"])


def token_counts(docs: DataFrame) -> DataFrame:
    """(h, ending, c): every distinct training token (64-bit hash), a hash of its ending and its count, from (text, held_out)."""
    return docs.select("text", "held_out").mapInArrow(_count, "h long, ending int, n long").groupBy("h").agg(F.min("ending").alias("ending"), F.sum("n").alias("c"))


@dataclass
class Model:
    """Head tokens (sorted hashes) with count, class and log10 share of the class; totals; feature weights by class."""

    total: int
    distinct: int
    head: np.ndarray
    count: np.ndarray
    owner: np.ndarray
    share: np.ndarray
    bias: np.ndarray
    weights: np.ndarray

    def classes(self, hashes: np.ndarray, suffix: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(class, head index, whether in the head) of each token."""
        at = np.minimum(np.searchsorted(self.head, hashes), len(self.head) - 1) if len(self.head) else np.zeros(len(hashes), np.int64)
        known = self.head[at] == hashes if len(self.head) else np.zeros(len(hashes), bool)
        tail = CLASSES - TAIL_CLASSES + (suffix % np.uint64(TAIL_CLASSES)).astype(np.int64)
        return np.where(known, self.owner[at] if len(self.head) else 0, tail), at, known


def features(hashes: np.ndarray, row: np.ndarray) -> list[np.ndarray]:
    """Hashed feature rows of every token's context: one array per template. Contexts don't cross documents."""
    def back(k: int) -> np.ndarray:
        out = np.full(len(hashes), START)
        if len(hashes) > k:
            out[k:] = np.where(row[k:] == row[:-k], hashes[:-k], START)
        return out

    one, two, three = back(1), back(2), back(3)
    with np.errstate(over="ignore"):
        keys = [one + np.uint64(1), one * np.uint64(3) + two * np.uint64(5) + np.uint64(2), two + np.uint64(3), three + np.uint64(4)]
        return [(mix64(k * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(49)).astype(np.int64) for k in keys]


def class_probabilities(weights: np.ndarray, bias: np.ndarray, feats: list[np.ndarray]) -> np.ndarray:
    """Softmax over the classes for each context (rows of ``feats``)."""
    logits = np.take(weights, feats[0], axis=0)
    part = np.empty_like(logits)
    for f in feats[1:]:
        np.take(weights, f, axis=0, out=part, mode="clip")
        logits += part
    logits += bias
    logits -= logits.max(axis=1, keepdims=True)
    np.exp(logits, out=logits)
    logits /= logits.sum(axis=1, keepdims=True)
    return logits


def row_sums(grad: np.ndarray, feats: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sparse gradient of the weights: rows in use, how often, and the sums of their contexts' gradients.

    The k-th uses of all rows are added at once, rows used most first; the rest
    of the few rows used very often is summed row by row.
    """
    rows = np.concatenate(feats).astype(np.uint16)  # FEATURES fits, and 16 bits sort by radix
    order = np.argsort(rows, kind="stable")
    rows, source = rows[order], order % len(grad)
    first = np.flatnonzero(np.concatenate([[True], rows[1:] != rows[:-1]]))
    times = np.diff(np.append(first, len(rows)))
    by = np.argsort(-times, kind="stable")
    first, times = first[by], times[by]
    sums = np.take(grad, source[first], axis=0)
    for k in range(1, 16):
        n = int(np.searchsorted(-times, -k, "left"))  # rows used more than k times
        if not n:
            break
        sums[:n] += np.take(grad, source[first[:n] + k], axis=0)
    for i in range(int(np.searchsorted(-times, -16, "left"))):
        sums[i] += np.take(grad, source[first[i] + 16 : first[i] + times[i]], axis=0).sum(axis=0)
    return rows[first].astype(np.int64), times, sums


def _learn(model, rate: float, prior: float):
    """One pass of gradient updates over a task's documents; emits its weights and how often each row was touched, in shards."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Model = model.value
        weights = m.weights.copy()
        power = np.full(FEATURES, prior, np.float32)
        touched = np.zeros(FEATURES, np.float64)
        seen = 0
        for batch in slices(batches, "text"):
            hashes, suffix, row = tokens(batch.column(batch.schema.get_field_index("text")))
            own = np.flatnonzero(_held_in(batch)[row])
            target = m.classes(hashes, suffix)[0]
            feats = features(hashes, row)
            for at in range(0, len(own), CHUNK):
                some = own[at : at + CHUNK]
                f = [x[some] for x in feats]
                grad = class_probabilities(weights, m.bias, f)
                grad[np.arange(len(some)), target[some]] -= 1
                used, times, sums = row_sums(grad, f)
                power[used] += (sums**2).mean(axis=1)
                weights[used] -= rate * sums / np.sqrt(power[used])[:, None]
                touched[used] += times
                seen += len(some)
        if seen:
            step = FEATURES // SHARDS
            for s in range(SHARDS):
                part = slice(s * step, (s + 1) * step)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([s], pa.int32()), pa.array([(weights[part] * touched[part, None]).astype(np.float32).tobytes()], pa.binary()), pa.array([touched[part].tobytes()], pa.binary())],
                    ["shard", "sums", "touched"])

    return run


def _merge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Sums of the tasks' weights, per shard."""
    total: dict[int, list[np.ndarray]] = {}
    for b in batches:
        for s, w, n in zip(b["shard"], b["sums"], b["touched"]):
            w, n = np.frombuffer(w, np.float32).astype(np.float64), np.frombuffer(n, np.float64)
            if s in total:
                total[s][0] += w
                total[s][1] += n
            else:
                total[s] = [w.copy(), n.copy()]
    yield pd.DataFrame({"shard": pd.Series(list(total), dtype="int32"), "sums": [w.tobytes() for w, _ in total.values()], "touched": [n.tobytes() for _, n in total.values()]})


def train(spark: SparkSession, docs: DataFrame, counts: DataFrame, rounds: int = 1, rate: float = 0.2, prior: float = 1.0) -> Model:
    """The model of all rows of ``docs`` (text, held_out) outside the held-out fold.

    The head, at most HEAD_ROWS tokens by count, fixes the classes: the most
    frequent tokens alone, the end token, the rest by a hash of their ending.
    Tokens beyond it fall into classes by their ending too. A round is one pass
    over all documents: every task starts from the shared weights, updates
    them by gradients of mini-batches, and the tasks' weights are averaged row
    by row, by how often each row was used. Sums form in SHARDS parallel
    groups; only the weights (8 MB) reach the driver.
    """
    n, v = counts.agg(F.sum("c"), F.count("*")).first()
    end = int(END.astype(np.int64))
    top = counts.filter(F.col("h") != end).orderBy(F.desc("c"), "h").limit(HEAD_ROWS).toArrow().to_pandas()
    ends = counts.filter(F.col("h") == end).agg(F.sum("c")).first()[0] or 0
    listed = F.broadcast(spark.createDataFrame(pa.table({"h": pa.array(top["h"], pa.int64())})))
    tails = dict(
        (r["k"], r["c"]) for r in counts.join(listed, "h", "left_anti").filter(F.col("h") != end)
        .groupBy((F.col("ending") % TAIL_CLASSES).alias("k")).agg(F.sum("c").alias("c")).collect())
    h = np.append(top["h"].to_numpy(np.int64), END.astype(np.int64)).view(np.uint64)
    c = np.append(top["c"].to_numpy(np.int64), ends)
    owner = np.append(SINGLES + 1 + top["ending"].to_numpy(np.int64) % HEAD_CLASSES, 0)
    owner[:SINGLES] = np.arange(len(owner[:SINGLES]))
    owner[-1] = SINGLES
    mass = np.bincount(owner, c + 0.1, minlength=CLASSES)
    share = np.log10((c + 0.1) / mass[owner])
    for k in range(TAIL_CLASSES):
        mass[CLASSES - TAIL_CLASSES + k] = tails.get(k, 0) + 0.1
    bias = np.log(np.maximum(mass, 0.1) / np.maximum(mass, 0.1).sum()).astype(np.float32)
    order = np.argsort(h)
    model = Model(int(n or 0), int(v), h[order], c[order], owner[order], share[order], bias, np.zeros((FEATURES, CLASSES), np.float32))
    for _ in range(rounds):
        shared = spark.sparkContext.broadcast(model)  # head and weights: bounded by constants
        got = docs.select("text", "held_out").mapInArrow(_learn(shared, rate, prior), "shard int, sums binary, touched binary")
        rows = got.repartition(SHARDS, "shard").mapInPandas(_merge, "shard int, sums binary, touched binary").collect()
        step = FEATURES // SHARDS
        for r in rows:
            w, t = np.frombuffer(r["sums"], np.float64).reshape(step, CLASSES), np.frombuffer(r["touched"], np.float64)
            part = slice(r["shard"] * step, (r["shard"] + 1) * step)
            model.weights[part] = np.where(t[:, None] > 0, w / np.maximum(t, 1)[:, None], model.weights[part])
        shared.unpersist()
    return model


def _score(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Model = model.value
        floor = np.log10(m.total + 0.1 * (m.distinct + 1))
        logc = np.log10(m.count + 0.1)
        for batch in slices(batches, "text"):
            hashes, suffix, row = tokens(batch.column(batch.schema.get_field_index("text")))
            rows = batch.num_rows
            owner, at, known = m.classes(hashes, suffix)
            feats = features(hashes, row)
            score = np.empty(len(hashes))
            for i in range(0, len(hashes), CHUNK):
                p = class_probabilities(m.weights, m.bias, [f[i : i + CHUNK] for f in feats])
                score[i : i + CHUNK] = np.log10(np.maximum(p[np.arange(len(p)), owner[i : i + CHUNK]], 1e-30))
            n = np.bincount(row, minlength=rows)
            base = np.bincount(row, np.where(known, logc[at], 0.0), minlength=rows) - n * floor
            total = np.bincount(row, score + np.where(known, m.share[at], 0.0), minlength=rows)
            seen = np.bincount(row, known & (m.count[at] > 0), minlength=rows)
            # tokens beyond the head: per row, distinct token and times
            rest = np.flatnonzero(~known)
            order = np.lexsort((hashes[rest], row[rest]))
            r, h, k = row[rest][order], hashes[rest][order], owner[rest][order]
            first = np.flatnonzero(np.concatenate([[True], (r[1:] != r[:-1]) | (h[1:] != h[:-1])])) if len(r) else np.zeros(0, np.int64)
            times = np.diff(np.append(first, len(r)))
            offsets = np.searchsorted(r[first], np.arange(rows + 1))
            tails = pa.ListArray.from_arrays(
                pa.array(offsets, pa.int32()),
                pa.StructArray.from_arrays([pa.array(h[first].view(np.int64)), pa.array(k[first] - (CLASSES - TAIL_CLASSES), pa.int32()), pa.array(times, pa.int32())], ["h", "k", "times"]))
            keep = [batch.column(batch.schema.get_field_index(c)) for c in ("doc_id", "held_out")]
            yield pa.RecordBatch.from_arrays(
                [*keep, pa.array(n, pa.int64()), pa.array(seen.astype(np.int64)), pa.array(base), pa.array(total), tails],
                ["doc_id", "held_out", "n_tokens", "seen", "base", "total", "tails"])

    return run


def score_documents(docs: DataFrame, held_out: tuple[int, int] = (10, 0), id_col: str = "doc_id", text_col: str = "text", rounds: int = 1) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Learns from all rows outside the held-out fold. A null text is empty: its
    only token is the end. ``score`` is log10 of the product over tokens of
    P(class | context) * P(token | class). Within a head class a token has its
    share of the class's counts; within a tail class unseen tokens as a whole
    have the Good-Turing share (tokens seen once / tokens) and the seen ones
    divide the rest by count, so that each distribution adds up to 1 over the
    known tokens and one unseen.

    The head of the vocabulary goes to every task; the counts of all other
    tokens stay distributed and meet the documents' rare tokens in a join.
    """
    spark = docs.sparkSession
    text_batches(spark)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), (fold(id_col, held_out[0]) == held_out[1]).alias("held_out"))
    counts = land(token_counts(rows))
    model = train(spark, rows, counts, rounds)
    shared = spark.sparkContext.broadcast(model)
    id_type = dict(rows.dtypes)["doc_id"]
    parts = land(
        rows.mapInArrow(_score(shared), f"doc_id {id_type}, held_out boolean, n_tokens long, seen long, base double, total double, tails array<struct<h:long,k:int,times:int>>")
        .withColumn("row", F.monotonically_increasing_id()))
    head = F.broadcast(spark.createDataFrame(pa.table({"h": pa.array(model.head.view(np.int64))})))  # HEAD_ROWS + 1
    rare = counts.join(head, "h", "left_anti")
    mass = {r["k"]: (r["n"], r["once"]) for r in rare.groupBy((F.col("ending") % TAIL_CLASSES).alias("k")).agg(F.sum("c").alias("n"), F.sum((F.col("c") == 1).cast("long")).alias("once")).collect()}
    unseen, known = [], []
    for k in range(TAIL_CLASSES):
        n, once = mass.get(k, (0, 0))
        theta = (once + 0.5) / (n + 1.0) if n else 1.0
        unseen.append(float(np.log10(theta)))
        known.append(float(np.log10(max(1 - theta, 1e-12) / n)) if n else 0.0)
    rest = parts.select("row", F.explode("tails").alias("x")).select("row", "x.h", "x.k", "x.times").join(rare.select("h", "c"), "h", "left")
    seen = F.col("c").isNotNull()
    pick = lambda values: F.get(F.array(*[F.lit(x) for x in values]), F.col("k"))
    rest = rest.groupBy("row").agg(
        F.sum(F.when(seen, F.col("times")).otherwise(0)).alias("more"),
        F.sum(F.col("times") * F.log10(F.coalesce("c", F.lit(0)) + 0.1)).alias("base_more"),
        F.sum(F.col("times") * F.when(seen, F.log10("c") + pick(known)).otherwise(pick(unseen))).alias("total_more"),
    )
    zero = F.lit(0.0)
    return parts.drop("tails").join(rest, "row", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("seen") + F.coalesce("more", F.lit(0))).cast("long").alias("n_known"),
        F.lit(model.total).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("base_more", zero)).alias("base_score"), (F.col("total") + F.coalesce("total_more", zero)).alias("score"))
