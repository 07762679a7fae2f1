"""Toxicity: a bidirectional GRU with attention pooling over word and character inputs, trained and run in numpy."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .common import LOWER_BYTE, WORD_BYTE, buffers, slices, text_batches, token_hashes, token_spans

WINDOW, STRIDE = 64, 48  # words; windows overlap by 16
HIDDEN, ATTENTION = 12, 8
WORD_ROWS, WORD_DIM = 1 << 13, 6
CHAR_ROWS, CHAR_DIM = 1 << 12, 8
PREFIXES, PREFIX_DIM = (4, 5, 6, 8), 6  # bytes from the start of a word
INPUT = WORD_DIM + CHAR_DIM + PREFIX_DIM + 1
TOP = 3  # windows that decide about a text

#: Bounds of the training sample: labelled rows of each class, bytes of a sampled text, windows drawn from one.
SAMPLE_ROWS, SAMPLE_BYTES, SAMPLE_WINDOWS = 1500, 100_000, 128


@dataclass
class Words:
    """Words of some rows: for each word the index of its distinct form; per distinct form its hash and character rows."""

    row: np.ndarray
    form: np.ndarray
    hashes: np.ndarray
    chars: np.ndarray
    char_begin: np.ndarray
    prefixes: np.ndarray


def read_words(data: np.ndarray, offsets: np.ndarray) -> Words:
    """Lower-cased words; the characters of a form are its byte trigrams, one around each byte, and its first bytes, hashed to rows."""
    data = LOWER_BYTE[data]
    starts, ends, row = token_spans(data, offsets, WORD_BYTE)
    hashes, first, form = np.unique(token_hashes(data, starts, ends), return_index=True, return_inverse=True)
    s, lengths = starts[first], (ends - starts)[first]
    begin = np.concatenate([[0], np.cumsum(lengths)])
    if not len(s):
        return Words(row, form, hashes, np.zeros(0, np.int64), begin, np.zeros((0, len(PREFIXES)), np.int64))
    at = np.arange(begin[-1]) + np.repeat(s - begin[:-1], lengths)
    padded = np.concatenate([[0], data, [0]]).astype(np.uint32)
    left, mid, right = padded[at], padded[at + 1], padded[at + 2]
    left[begin[:-1]] = 0
    right[begin[1:] - 1] = 0
    key = (left * np.uint32(0x9E3779B1) + mid * np.uint32(0x85EBCA6B) + right * np.uint32(0xC2B2AE35)) * np.uint32(0x27D4EB2F)
    prefixes = np.empty((len(s), len(PREFIXES)), np.int64)
    part = np.zeros(len(s), np.uint32)
    for i in range(max(PREFIXES)):
        part = (part + np.where(i < lengths, padded[np.minimum(s + i, len(data) - 1) + 1], 0)) * np.uint32(0x9E3779B1)
        part ^= part >> np.uint32(15)
        if i + 1 in PREFIXES:
            prefixes[:, PREFIXES.index(i + 1)] = (part * np.uint32(0x85EBCA6B)) >> np.uint32(20)
    return Words(row, form, hashes, (key >> np.uint32(20)).astype(np.int64) & (CHAR_ROWS - 1), begin, prefixes & (CHAR_ROWS - 1))


def read_many(texts: pa.Array, limit: int = 1 << 20) -> Words:
    """``read_words`` of a longer column, piece by piece: the work arrays stay small and equal forms are merged."""
    data, offsets = buffers(texts)
    parts, start = [], 0
    while start < len(texts):
        end = max(start + 1, int(np.searchsorted(offsets, offsets[start] + limit, "right")) - 1)
        w = read_words(data[offsets[start] : offsets[end]], offsets[start : end + 1] - offsets[start])
        parts.append((w, start))
        start = end
    if not parts:
        return read_words(data, offsets)
    sizes = np.cumsum([0, *(len(w.hashes) for w, _ in parts)])
    hashes, first, number = np.unique(np.concatenate([w.hashes for w, _ in parts]), return_index=True, return_inverse=True)
    lengths = np.concatenate([np.diff(w.char_begin) for w, _ in parts])
    every = Words(
        np.concatenate([w.row + at for w, at in parts]), np.concatenate([number[w.form + n] for (w, _), n in zip(parts, sizes)]),
        np.concatenate([w.hashes for w, _ in parts]), np.concatenate([w.chars for w, _ in parts]),
        np.concatenate([[0], np.cumsum(lengths)]), np.concatenate([w.prefixes for w, _ in parts]))
    return _subset(every, first)


def window_starts(row: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First word, words and row of all windows; the last of a row ends with it, a row without words has an empty one."""
    n = np.bincount(row, minlength=rows)
    begin = np.concatenate([[0], np.cumsum(n)])[:-1]
    last = np.maximum(n - WINDOW, 0)
    count = 1 + -(-last // STRIDE)
    of = np.repeat(np.arange(rows), count)
    k = np.arange(len(of)) - np.repeat(np.concatenate([[0], np.cumsum(count)])[:-1], count)
    return begin[of] + np.minimum(k * STRIDE, last[of]), np.minimum(n[of], WINDOW), of


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


@dataclass
class Network:
    """Parameters of the classifier. ``odds`` gives known word hashes (sorted) a log-odds input; other words have 0."""

    known: np.ndarray
    odds: np.ndarray
    p: dict[str, np.ndarray] = field(default_factory=dict)
    top: np.ndarray = field(default_factory=lambda: np.array([1.0, 0, 0, 0]))  # weights of the TOP windows, constant

    @staticmethod
    def fresh(known: np.ndarray, odds: np.ndarray, seed: int = 7) -> Network:
        rng = np.random.default_rng(seed)

        def draw(*shape, scale):
            return (rng.standard_normal(shape) * scale).astype(np.float32)

        p = {"words": draw(WORD_ROWS, WORD_DIM, scale=0.02), "chars": draw(CHAR_ROWS, CHAR_DIM, scale=0.1), "prefixes": draw(CHAR_ROWS, PREFIX_DIM, scale=0.02),
             "va": draw(ATTENTION, scale=0.3), "wa": draw(2 * HIDDEN, ATTENTION, scale=0.3), "ba": np.zeros(ATTENTION, np.float32),
             "wo": draw(2 * HIDDEN, scale=0.3), "bo": np.full(1, -1.0, np.float32)}
        for d in "fb":
            p["x" + d] = draw(INPUT, 3 * HIDDEN, scale=INPUT**-0.5)
            p["u" + d] = draw(HIDDEN, 3 * HIDDEN, scale=HIDDEN**-0.5)
            p["b" + d] = np.zeros(3 * HIDDEN, np.float32)
        return Network(known, odds, p)

    def inputs(self, words: Words) -> np.ndarray:
        """Input vector of each distinct form: word row, mean of its character rows, log-odds."""
        x = np.zeros((len(words.hashes) + 1, INPUT), np.float32)  # the last row pads
        if len(words.hashes):
            x[:-1, :WORD_DIM] = self.p["words"][(words.hashes & np.uint64(WORD_ROWS - 1)).astype(np.int64)]
            sums = np.add.reduceat(self.p["chars"][words.chars], words.char_begin[:-1])
            x[:-1, WORD_DIM : WORD_DIM + CHAR_DIM] = sums / np.diff(words.char_begin)[:, None]
            for i in range(len(PREFIXES)):
                x[:-1, WORD_DIM + CHAR_DIM : -1] += self.p["prefixes"][words.prefixes[:, i]]
            x[:-1, -1] = self.log_odds(words.hashes)
        return x

    def log_odds(self, hashes: np.ndarray) -> np.ndarray:
        if not len(self.known):
            return np.zeros(len(hashes), np.float32)
        at = np.minimum(np.searchsorted(self.known, hashes), len(self.known) - 1)
        return np.where(self.known[at] == hashes, self.odds[at], 0).astype(np.float32)

    def forward(self, gates: dict[str, np.ndarray], index: np.ndarray, mask: np.ndarray | None, keep: dict | None = None) -> np.ndarray:
        """Logits of windows. ``gates`` has each form's share of the gate inputs, ``index`` (windows, WINDOW) the forms."""
        n, steps = index.shape
        h = HIDDEN
        states = np.empty((steps, n, 2 * h), np.float32)
        for d in "fb":
            now, u = np.zeros((n, h), np.float32), self.p["u" + d]
            for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
                x, hu = gates[d][index[:, t]], now @ u
                zr = _sigmoid(x[:, : 2 * h] + hu[:, : 2 * h])
                z, r = zr[:, :h], zr[:, h:]
                c = np.tanh(x[:, 2 * h :] + r * hu[:, 2 * h :])
                new = c + z * (now - c)
                if mask is not None:
                    new = np.where(mask[:, t, None], new, now)
                if keep is not None:
                    keep[d, t] = (now, hu, z, r, c)
                now = new
                states[t, :, slice(0, h) if d == "f" else slice(h, None)] = new
        hidden = np.tanh(states @ self.p["wa"] + self.p["ba"])
        e = (hidden @ self.p["va"]).T
        if mask is not None:
            e = np.where(mask, e, np.float32(-30))
        e = np.exp(e - e.max(axis=1, keepdims=True))
        share = e / e.sum(axis=1, keepdims=True)
        pooled = np.einsum("nt,tnd->nd", share, states)
        if keep is not None:
            keep["rest"] = (states, hidden, share, pooled)
        return pooled @ self.p["wo"] + self.p["bo"][0]

    def gates(self, x: np.ndarray) -> dict[str, np.ndarray]:
        return {d: x @ self.p["x" + d] + self.p["b" + d] for d in "fb"}

    def score_windows(self, words: Words, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        gates = self.gates(self.inputs(words))
        out = np.empty(len(starts), np.float32)
        full = np.flatnonzero(lengths == WINDOW)
        for at in range(0, len(full), 4096):
            some = full[at : at + 4096]
            out[some] = self.forward(gates, words.form[starts[some, None] + np.arange(WINDOW)], None)
        short = np.flatnonzero(lengths < WINDOW)
        pad = len(words.hashes)
        for at in range(0, len(short), 4096):
            some = short[at : at + 4096]
            index, mask = _padded(words.form, starts[some], lengths[some], pad)
            out[some] = self.forward(gates, index, mask)
        return out

    def score(self, column: pa.Array) -> np.ndarray:
        """Probability of each text, from its highest windows."""
        data, offsets = buffers(column)
        words = read_words(data, offsets)
        starts, lengths, of = window_starts(words.row, len(column))
        if not len(column):
            return np.zeros(0)
        logits = self.score_windows(words, starts, lengths)
        return _sigmoid(highest(logits, of, len(column)) @ self.top[:TOP] + self.top[TOP])


def highest(logits: np.ndarray, of: np.ndarray, rows: int) -> np.ndarray:
    """The TOP highest window logits of each row, limited to +-8; a row with fewer windows has -8 in the places left."""
    ranked = np.lexsort((-logits, of))
    place = np.arange(len(ranked)) - np.searchsorted(of[ranked], of[ranked])
    out = np.full((rows, TOP), -8.0)
    some = place < TOP
    out[of[ranked][some], place[some]] = np.clip(logits[ranked][some], -8, 8)
    return out


def _padded(form: np.ndarray, starts: np.ndarray, lengths: np.ndarray, pad: int) -> tuple[np.ndarray, np.ndarray]:
    steps = np.arange(WINDOW)
    mask = steps < lengths[:, None]
    at = np.where(mask, starts[:, None] + steps, 0)
    forms = form if len(form) else np.zeros(1, np.int64)
    # a window without words reads the padding once
    mask[lengths == 0, 0] = True
    return np.where(steps < lengths[:, None], forms[at], pad), mask


def _backward(net: Network, x: np.ndarray, index: np.ndarray, mask: np.ndarray, keep: dict, error: np.ndarray) -> dict[str, np.ndarray]:
    """Gradients of the summed loss whose derivative by the logits is ``error``; 'x' is that by the input vectors."""
    h, p = HIDDEN, net.p
    states, hidden, share, pooled = keep["rest"]
    g = {k: np.zeros_like(v) for k, v in p.items()}
    g["wo"], g["bo"] = pooled.T @ error, error.sum(keepdims=True)
    d_pooled = error[:, None] * p["wo"]
    d_states = share.T[:, :, None] * d_pooled
    d_share = np.einsum("nd,tnd->nt", d_pooled, states)
    d_e = share * (d_share - (share * d_share).sum(axis=1, keepdims=True))
    g["va"] = np.einsum("nt,tna->a", d_e, hidden)
    d_hidden = d_e.T[:, :, None] * p["va"] * (1 - hidden**2)
    g["wa"] = np.einsum("tnd,tna->da", states, d_hidden)
    g["ba"] = d_hidden.sum(axis=(0, 1))
    d_states += d_hidden @ p["wa"].T
    d_x = np.zeros_like(x)
    order = np.argsort(index.T.ravel(), kind="stable")
    sorted_forms = index.T.ravel()[order]
    first = np.flatnonzero(np.concatenate([[True], sorted_forms[1:] != sorted_forms[:-1]]))
    for d in "fb":
        carried = np.zeros((len(index), h), np.float32)
        by_step = np.empty((WINDOW, len(index), 3 * h), np.float32)
        for t in range(WINDOW - 1, -1, -1) if d == "f" else range(WINDOW):
            now, hu, z, r, c = keep[d, t]
            d_new = carried + d_states[t][:, :h] if d == "f" else carried + d_states[t][:, h:]
            m = mask[:, t, None]
            d_in = np.where(m, d_new, 0)
            d_c = d_in * (1 - z) * (1 - c**2)
            d_z = d_in * (now - c) * z * (1 - z)
            d_r = d_c * hu[:, 2 * h :] * r * (1 - r)
            d_hu = np.concatenate([d_z, d_r, d_c * r], axis=1)
            by_step[t, :, :h], by_step[t, :, h : 2 * h], by_step[t, :, 2 * h :] = d_z, d_r, d_c
            g["u" + d] += now.T @ d_hu
            carried = np.where(m, d_in * z + d_hu @ p["u" + d].T, d_new)
        d_gate = np.zeros((len(x), 3 * h), np.float32)
        d_gate[sorted_forms[first]] = np.add.reduceat(by_step.reshape(-1, 3 * h)[order], first)
        g["x" + d] = x.T @ d_gate
        g["b" + d] = d_gate[:-1].sum(axis=0)
        d_x += d_gate @ p["x" + d].T
    g["x"] = d_x
    return g


def train(texts: pa.Array, toxic: np.ndarray, clean_weight: float = 1.0, epochs: int = 8, batch: int = 256, rate: float = 0.01, seed: int = 7) -> Network:
    """Fit the network to labelled texts, in any but a meaningful order.

    Four fifths of the texts train it: a toxic text teaches through its two
    highest windows, a clean one through its two highest and two drawn at
    random, all chosen anew in every epoch. On the last fifth a logistic
    regression fits how the highest windows make up the score of a text; each
    clean text counts ``clean_weight`` times there.
    """
    part = np.random.default_rng(seed).random(len(toxic)) < 0.8
    if not (0 < toxic[part].sum() < part.sum() and 0 < toxic[~part].sum() < (~part).sum()):
        return _train(texts, toxic, epochs, batch, rate, seed)
    net = _train(texts.filter(pa.array(part)), toxic[part], epochs, batch, rate, seed)
    words = read_many(texts.filter(pa.array(~part)))
    starts, lengths, of = window_starts(words.row, int((~part).sum()))
    x = np.column_stack([highest(net.score_windows(words, starts, lengths), of, int((~part).sum())), np.ones((~part).sum())])
    y, weight = toxic[~part], np.where(toxic[~part] == 1, 1.0, clean_weight)
    w = np.zeros(TOP + 1)
    ridge = np.diag([1.0] * TOP + [1e-3])
    for _ in range(30):  # Newton steps
        p = _sigmoid(x @ w)
        w += np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + ridge, x.T @ (weight * (y - p)) - ridge @ w)
    net.top = w
    return net


def _train(texts: pa.Array, toxic: np.ndarray, epochs: int, batch: int, rate: float, seed: int) -> Network:
    rng = np.random.default_rng(seed)
    words = read_many(texts)
    pairs = np.unique(words.form.astype(np.int64) * len(toxic) + words.row)
    form, row = pairs // max(1, len(toxic)), pairs % max(1, len(toxic))
    bad = np.bincount(form, toxic[row] == 1, minlength=len(words.hashes))
    seen = np.bincount(form, minlength=len(words.hashes))
    rate_bad = (toxic == 1).mean() if len(toxic) else 0.5
    odds = np.log((bad + 8 * rate_bad) / (seen - bad + 8 * (1 - rate_bad)) * (1 - rate_bad) / max(rate_bad, 1e-9)) if len(seen) and 0 < rate_bad < 1 else np.zeros(len(seen))
    some = seen >= 5
    net = Network.fresh(words.hashes[some], odds[some].astype(np.float32), seed)
    starts, lengths, of = window_starts(words.row, len(toxic))
    if len(starts) == 0 or not 0 < rate_bad < 1:  # nothing to tell apart
        return net
    drawn = rng.permutation(len(starts))
    order = drawn[np.argsort(of[drawn], kind="stable")]
    place = np.arange(len(order)) - np.searchsorted(of[order], of[order])
    order = np.sort(order[place < SAMPLE_WINDOWS])
    starts, lengths, of = starts[order], lengths[order], of[order]
    prefix = np.concatenate([[0], np.cumsum(np.maximum(net.log_odds(words.hashes)[words.form], 0))])
    logits = prefix[starts + lengths] - prefix[starts]
    moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in net.p.items()}
    step = 0
    for _ in range(epochs):
        ranked = np.lexsort((-logits, of))
        place = np.arange(len(ranked)) - np.searchsorted(of[ranked], of[ranked])
        chosen = ranked[place < 2]
        clean = np.flatnonzero(toxic[of] != 1)
        chosen = np.concatenate([chosen, rng.choice(clean, min(len(clean), 2 * int((toxic != 1).sum())), replace=False)])
        rng.shuffle(chosen)
        for at in range(0, len(chosen), batch):
            b = chosen[at : at + batch]
            index, mask = _padded(words.form, starts[b], lengths[b], len(words.hashes))
            used, inverse = np.unique(index, return_inverse=True)
            if used[-1] != len(words.hashes):
                used = np.append(used, len(words.hashes))
            part = _subset(words, used[:-1])
            x, keep = net.inputs(part), {}
            index = inverse.reshape(index.shape)
            error = (_sigmoid(net.forward(net.gates(x), index, mask, keep)) - (toxic[of[b]] == 1)).astype(np.float32) / len(b)
            g = _backward(net, x, index, mask, keep, error)
            d_x = g.pop("x")[:-1]
            widths = np.diff(part.char_begin)
            _add_rows(g["words"], (part.hashes & np.uint64(WORD_ROWS - 1)).astype(np.int64), d_x[:, :WORD_DIM])
            _add_rows(g["chars"], part.chars, np.repeat(d_x[:, WORD_DIM : WORD_DIM + CHAR_DIM] / widths[:, None], widths, axis=0))
            for i in range(len(PREFIXES)):
                _add_rows(g["prefixes"], part.prefixes[:, i], d_x[:, WORD_DIM + CHAR_DIM : -1])
            step += 1
            for k, (m, v) in moments.items():
                grad = g[k] + (1e-4 * net.p[k] if k in ("words", "chars", "prefixes") else 0)
                m += 0.1 * (grad - m)
                v += 0.01 * (grad**2 - v)
                net.p[k] = (net.p[k] - rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-6)).astype(np.float32)
        logits = net.score_windows(words, starts, lengths)
    return net


def _add_rows(to: np.ndarray, rows: np.ndarray, values: np.ndarray) -> None:
    for j in range(to.shape[1]):
        to[:, j] += np.bincount(rows, values[:, j], minlength=len(to)).astype(np.float32)


def _subset(words: Words, forms: np.ndarray) -> Words:
    lengths = np.diff(words.char_begin)[forms]
    begin = np.concatenate([[0], np.cumsum(lengths)])
    at = np.arange(begin[-1]) + np.repeat(words.char_begin[:-1][forms] - begin[:-1], lengths)
    return Words(words.row, words.form, words.hashes[forms], words.chars[at], begin, words.prefixes[forms])


def fold(id_col: str, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % folds


def fit(docs: DataFrame, labels: DataFrame, held_out: tuple[int, int] = (4, 2), id_col: str = "doc_id", text_col: str = "text",
        label_col: str = "toxic", sample_rows: int = SAMPLE_ROWS) -> Network:
    """Train on a bounded sample of the labelled rows outside the held-out fold.

    Up to ``sample_rows`` rows of each class, those with the least hash of
    their id, with texts of up to SAMPLE_BYTES bytes; null labels and ids are
    left out. Only the text and the label are read. How often each label
    occurs is counted over all labelled rows outside the fold.
    """
    rows = labels.select(F.col(id_col).alias("__id"), F.col(label_col).alias("y")).filter(
        F.col("__id").isNotNull() & F.col("y").isin(0, 1) & (fold("__id", held_out[0]) != held_out[1])).distinct()
    seen = {r["y"]: r["n"] for r in rows.groupBy("y").agg(F.count("*").alias("n")).collect()}
    some = None
    for y in (0, 1):
        part = rows.filter(F.col("y") == y).orderBy(F.xxhash64("__id"), "__id").limit(sample_rows)
        some = part if some is None else some.unionByName(part)
    some = F.broadcast(some)  # 2 * sample_rows ids at most
    texts = docs.select(F.col(id_col).alias("__id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    got = texts.join(some, "__id").filter(F.octet_length("text") <= SAMPLE_BYTES).select("__id", "text", "y").toPandas()
    got = got.sort_values(["__id", "y", "text"])
    y = got["y"].to_numpy(np.int64)
    share = [seen.get(k, 0) / max(1, int((y == k).sum())) for k in (0, 1)]
    return train(pa.array(got["text"], pa.string()), y, share[0] / share[1] if share[0] and share[1] else 1.0)


def scores(docs: DataFrame, net: Network, text_col: str = "text") -> DataFrame:
    """``docs`` plus ``tox_score``, the network's probability for each whole text (null counts as empty); all windows count."""
    text_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(net)  # bounded by the sample and the table sizes
    names = [c for c in docs.columns if c != "tox_score"]
    docs = docs.select(*names)
    at = names.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text_col):
            got = shared.value.score(batch.column(at))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(got, pa.float64())], [*names, "tox_score"])

    schema = StructType([*docs.schema.fields, StructField("tox_score", DoubleType())])
    return docs.mapInArrow(run, schema)


def score_documents(docs: DataFrame, labels: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """``docs`` plus tox_score of a network trained on the labels."""
    return scores(docs, fit(docs, labels, id_col=id_col, text_col=text_col), text_col)


def remove_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the rows whose text scores ``threshold`` or more."""
    return score_documents(docs, labels, text_col, id_col).filter(F.col("tox_score") < threshold).select(*docs.columns)
