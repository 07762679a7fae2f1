"""Removal of repeated byte strings across documents: winnowed candidates, decided on suffix arrays."""

from __future__ import annotations

from collections.abc import Iterator

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import buffers, mix64, slices, text_batches
from .suffix_array import suffix_array

LENGTH = 100  # bytes that must repeat
GRAM = 24  # bytes under a fingerprint
NONE = np.uint64(0xFFFFFFFFFFFFFFFF)
#: Bytes of distinct segments per suffix array.
BUNDLE_BYTES = 1 << 20
#: Bytes whose windows are keyed or hashed at a time.
CHUNK_BYTES = 1 << 19
#: Places of a key in the corpus from which its stretches are cut into pieces of at most STEP windows.
HOT = 1 << 14
STEP = 4


def _slide(values: np.ndarray, width: int, pick) -> np.ndarray:
    """``pick`` (minimum or maximum) of every ``width`` neighbours, by doubling."""
    out, have = values, 1
    while have * 2 <= width:
        out = pick(out[:-have], out[have:])
        have *= 2
    if have < width:
        out = pick(out[: len(out) - (width - have)], out[width - have :])
    return out


def gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """A hash of the ``gram`` bytes from every position."""
    base = 0x9E3779B97F4A7C15
    with np.errstate(over="ignore"):
        part, have = data.astype(np.uint64) + np.uint64(0x632BE59B), 1  # hashes of the ``have`` bytes from each position
        out, done = np.zeros(len(data) + 1, np.uint64), 0
        while True:
            shift = np.uint64(pow(base, have, 1 << 64))
            if gram & have:
                n = len(data) - done - have + 1
                out, done = out[:n] * shift + part[done : done + n], done + have
            if done == gram:
                return mix64(out)
            part, have = part[: len(part) - have] * shift + part[have:], have * 2


def window_keys(data: np.ndarray, offsets: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(window starts, their keys, hashes): the key of a window is the least hash of the grams inside, so it depends on its bytes alone."""
    if len(data) < length:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    hashes = gram_hashes(data, gram)
    keys = _slide(hashes, length - gram + 1, np.minimum)
    sizes = np.diff(offsets)
    inside = np.zeros(len(data) + 1, np.int8)
    some = sizes >= length
    inside[offsets[:-1][some]] += 1
    inside[offsets[1:][some] - length + 1] -= 1
    starts = np.flatnonzero(np.cumsum(inside[:-1]) > 0)
    return starts, keys[starts], hashes


def _places(starts: np.ndarray, keys: np.ndarray, hashes: np.ndarray, spread: int) -> np.ndarray:
    """Positions of the grams that give some window over them its key."""
    best = np.zeros(len(hashes) + 2 * spread, np.uint64)
    best[starts + spread - 1] = keys
    return np.flatnonzero(_slide(best, spread, np.maximum)[: len(hashes)] == hashes)


def _fingerprints(length: int, gram: int):
    """(h, k, c): the keys of each document's windows, with how many places of the document gave them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "bytes", 1 << 20):
            data, offsets = buffers(batch.column(batch.schema.get_field_index("bytes")))
            starts, keys, hashes = window_keys(data, offsets, length, gram)
            if not len(starts):
                continue
            at = _places(starts, keys, hashes, length - gram + 1)
            row = np.searchsorted(offsets, at, "right") - 1
            h = hashes[at]
            new = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (row[1:] != row[:-1])]))
            k = batch.column(batch.schema.get_field_index("k")).take(pa.array(row[new]))
            yield pa.RecordBatch.from_arrays([pa.array(h[new].view(np.int64)), k, pa.array(np.diff(np.append(new, len(h))).astype(np.int32))], ["h", "k", "c"])

    return run


def _runs(starts: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First index and number of consecutive windows with one key."""
    cut = np.flatnonzero(np.concatenate([[True], (keys[1:] != keys[:-1]) | (starts[1:] != starts[:-1] + 1)]))
    return cut, np.diff(np.append(cut, len(starts)))


PIECES = pa.schema([("part", pa.int64()), ("key", pa.int64()), ("k", pa.int64()), ("o", pa.int64()), ("th", pa.int64()),
                    ("start", pa.int64()), ("windows", pa.int64()), ("inner", pa.bool_()), ("seg", pa.binary())])
SPANS = pa.schema([("k", pa.int64()), ("th", pa.int64()), ("start", pa.int64()), ("end", pa.int64())])


def _stretches(data: np.ndarray, offsets: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """(begin, windows, key) of every run of windows with one key, and (place, hash) of the grams that give the keys, some rows at a time."""
    found, row = [], 0
    while row < len(offsets) - 1:
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + CHUNK_BYTES, "right")) - 1)
        low = offsets[row]
        starts, keys, hashes = window_keys(data[low : offsets[end]], offsets[row : end + 1] - low, length, gram)
        if len(starts):
            places = _places(starts, keys, hashes, length - gram + 1)
            first, count = _runs(starts, keys)
            found.append((starts[first] + low, count, keys[first], places + low, hashes[places]))
        row = end
    return tuple(map(np.concatenate, zip(*found))) if found else ()


def _listed(column: pa.Array, row: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which (row, key) pairs are in the rows' lists."""
    wanted, of = column.flatten().to_numpy(zero_copy_only=False).view(np.uint64), column.value_lengths().to_numpy(zero_copy_only=False)
    if not len(wanted):
        return np.zeros(len(keys), bool)
    golden = np.uint64(0x9E3779B97F4A7C15)
    listed = np.unique(mix64(wanted + np.repeat(np.arange(len(of)), of).astype(np.uint64) * golden))
    asked = mix64(keys + row.astype(np.uint64) * golden)
    return listed[np.minimum(np.searchsorted(listed, asked), len(listed) - 1)] == asked


def _fine(at: int, windows: int, grams: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
    """(begin, windows, step, core): a stretch of a key in pieces of at most STEP windows.

    ``grams`` are the places of the key's gram. A window's step is the offset of the first of them in it over
    STEP, and the windows of a step share the bytes from ``core`` (the window's length less STEP - 1 of them).
    Equal windows have equal steps and cores.
    """
    s = np.arange(at, at + windows)
    g = grams[np.searchsorted(grams, s)]
    step = (g - s) // STEP
    cut = np.flatnonzero(np.concatenate([[True], (g[1:] != g[:-1]) | (step[1:] != step[:-1])]))
    yield from zip(s[cut].tolist(), np.diff(np.append(cut, windows)).tolist(), step[cut].tolist(), (g - step * STEP)[cut].tolist())


def _segments(length: int, gram: int):
    """The stretches of text under repeated keys. Of equal ones in a batch the earliest goes on with its bytes; the others
    are decided (seg is null) and are dealt by document. Stretches of hot keys go on in pieces, each under its step and core."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "bytes", 2 << 20):
            data, offsets = buffers(batch.column(batch.schema.get_field_index("bytes")))
            col = {c: batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in ("k", "o", "th")}
            found = _stretches(data, offsets, length, gram)
            if not found:
                continue
            begin, count, keys, places, hashes = found
            row = np.searchsorted(offsets, begin, "right") - 1
            repeated, hot = (batch.column(batch.schema.get_field_index(c)) for c in ("repeated", "hot"))
            hit = _listed(repeated, row, keys)
            begin, count, keys, row = begin[hit], count[hit], keys[hit], row[hit]
            # equal windows inside a stretch hold the key's gram at two places of it
            names, number = np.unique(hashes, return_inverse=True)
            by = np.lexsort((places, number))
            place_codes = (number * len(data) + places)[by]
            own = np.minimum(np.searchsorted(names, keys), max(0, len(names) - 1)) * len(data) + begin
            since, until = np.searchsorted(place_codes, own), np.searchsorted(place_codes, own + count + length - gram)
            inner, fine = until - since > 1, _listed(hot, row, keys)
            raw = data.tobytes()
            order = np.lexsort((begin, col["th"][row], col["o"][row]))
            seen: dict[bytes, tuple] = {}
            out: list[tuple] = []  # (row, key, begin, windows, inner, seg)

            def place(i: int, at: int) -> tuple[int, int, int]:
                return int(col["o"][row[i]]), int(col["th"][row[i]]), int(at - offsets[row[i]])

            for i in order.tolist():
                at, n, key = int(begin[i]), int(count[i]), int(keys[i])
                seg, here = raw[at : at + n + length - 1], place(i, at)
                other = seen.setdefault(seg, here)
                if other is not here:
                    if other != here:  # else a place of a row that repeats another row
                        out.append((row[i], key, at, n, False, None))
                elif not fine[i]:
                    out.append((row[i], key, at, n, bool(inner[i]), seg))
                else:
                    decided = -1  # where the last piece ends if it is decided
                    for a, m, step, core in _fine(at, n, places[by[since[i] : until[i]]]):
                        seg, here = raw[a : a + m + length - 1], place(i, a)
                        new = seen.setdefault((key, step, seg), here) is here
                        if new:
                            sub = hashlib.blake2b(b"%d %d " % (key, step) + raw[core : core + length - STEP + 1], digest_size=8).digest()
                            out.append((row[i], int.from_bytes(sub), a, m, False, seg))
                        elif decided == a:  # neighbours in one row
                            last = out.pop()
                            out.append((*last[:3], last[3] + m, False, None))
                        else:
                            out.append((row[i], key, a, m, False, None))
                        decided = -1 if new else a + m
            if not out:
                continue
            at_row, key, at, n, within, segs = zip(*out)
            at_row, key = np.array(at_row, np.int64), np.array(key, np.uint64).view(np.int64)
            part = np.where([s is None for s in segs], mix64(col["k"][at_row].view(np.uint64)).view(np.int64), key)
            columns = [part, key, col["k"][at_row], col["o"][at_row], col["th"][at_row], np.array(at, np.int64) - offsets[at_row], np.array(n, np.int64),
                       np.array(within, bool), pa.array(segs, pa.binary())]
            whole = pa.RecordBatch.from_arrays([pa.array(c) for c in columns], schema=PIECES)
            for start in range(0, whole.num_rows, 20_000):
                yield whole.slice(start, 20_000)

    return run


def repeated_windows(segs: list[bytes], windows: np.ndarray, order: list[np.ndarray], length: int = LENGTH) -> list[np.ndarray]:
    """For each segment, which of its first ``windows`` windows occur in an earlier place of the given segments.

    ``order`` gives the places' sort columns, the most significant first;
    within a segment later windows are later. One suffix array over all
    segments puts equal windows side by side.
    """
    sizes = np.array([len(s) for s in segs], np.int64)
    text = np.frombuffer(b"".join(segs), np.uint8)
    begin = np.concatenate([[0], np.cumsum(sizes)])
    # a separator below all bytes after each segment
    spaced = np.zeros(len(text) + len(segs), np.int64)
    moved = begin[:-1] + np.arange(len(segs))
    spaced[np.arange(len(text)) + np.repeat(np.arange(len(segs)), sizes)] = text.astype(np.int64) + 1
    eligible = np.full(len(spaced), -1, np.int64)  # window start -> segment
    at = np.repeat(moved, windows) + np.arange(windows.sum()) - np.repeat(np.cumsum(windows) - windows, windows)
    eligible[at] = np.repeat(np.arange(len(segs)), windows)
    sa = suffix_array(spaced)
    sa = sa[eligible[sa] >= 0]
    same = np.ones(max(0, len(sa) - 1), bool)
    live = np.arange(len(same))
    width = 8 if length >= 8 else 1  # bytes compared at a time
    raw = np.zeros(len(spaced) + 7, np.uint8)
    raw[: len(spaced)] = np.maximum(spaced - 1, 0)
    words = np.ndarray(len(spaced), f"u{width}", raw, strides=(1,)).copy()
    for j in [*range(0, length - width, width), length - width]:  # most neighbours differ within a few bytes
        live = live[words[sa[live] + j] == words[sa[live + 1] + j]]
        if not len(live):
            break
    same[:] = False
    same[live] = True
    cls = np.concatenate([[0], np.cumsum(~same)]) if len(sa) else np.zeros(0, np.int64)
    seg = eligible[sa]
    rank = np.empty(len(segs), np.int64)
    rank[np.lexsort(tuple(reversed(order)))] = np.arange(len(segs))
    by = np.lexsort((sa, rank[seg], cls))
    later = np.ones(len(sa), bool)
    later[by[np.flatnonzero(np.concatenate([[True], cls[by][1:] != cls[by][:-1]]))]] = False if len(sa) else later
    flags = np.zeros(len(spaced), bool)
    flags[sa] = later
    return [flags[m : m + w] for m, w in zip(moved, windows)]


def _spans(flags: np.ndarray, start: int, length: int) -> list[tuple[int, int]]:
    edge = np.diff(np.concatenate([[0], flags.astype(np.int8), [0]]))
    return [(start + a, start + b - 1 + length) for a, b in zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1))]


def _decide(length: int, bundle_bytes: int):
    """Spans of repeated windows from pieces sorted by key; a bundle holds whole keys."""

    def flush(bundle: dict[bytes, tuple], out: list[tuple]) -> None:
        if not bundle:
            return
        segs, places = list(bundle), list(bundle.values())
        _solve(segs, places, out)

    def _solve(segs: list[bytes], places: list[tuple], out: list[tuple]) -> None:
        """Windows go to suffix arrays by a hash of their bytes, to several arrays where one would be too large.

        A window whose hash is the only one of its kind repeats nothing and
        stays out; neighbours of one part stay together.
        """
        o, th, start, windows, k = (np.array([p[i] for p in places], np.int64) for i in range(5))
        begin, first = np.cumsum([0, *map(len, segs)]), np.cumsum([0, *windows])
        seg = np.repeat(np.arange(len(segs)), windows)
        offset = np.arange(len(seg)) - np.repeat(first[:-1], windows)
        hashes, at = np.empty(len(seg), np.uint64), 0
        while at < len(segs):  # some segments at a time
            end = max(at + 1, int(np.searchsorted(begin, begin[at] + CHUNK_BYTES, "right")) - 1)
            mine = slice(first[at], first[end])
            hashes[mine] = gram_hashes(np.frombuffer(b"".join(segs[at:end]), np.uint8), length)[begin[seg[mine]] - begin[at] + offset[mine]]
            at = end
        _, number, times = np.unique(hashes, return_inverse=True, return_counts=True)
        again = times[number] > 1
        seg, offset, hashes = seg[again], offset[again], hashes[again]
        if not len(seg):
            return
        jump = np.concatenate([[True], (seg[1:] != seg[:-1]) | (offset[1:] != offset[:-1] + 1)])
        parts = np.uint64(max(1, -(-(len(seg) + length * int(jump.sum())) // (4 * bundle_bytes))))
        part = hashes % parts
        for p in range(int(parts)):
            mine = np.flatnonzero(part == p)
            if not len(mine):
                continue
            s, at = seg[mine], offset[mine]
            first = np.flatnonzero(np.concatenate([[True], (s[1:] != s[:-1]) | (at[1:] != at[:-1] + 1)]))
            n = np.diff(np.append(first, len(mine)))
            s, at = s[first], at[first]
            some = [segs[i][a : a + w + length - 1] for i, a, w in zip(s.tolist(), at.tolist(), n.tolist())]
            for flags, i, a in zip(repeated_windows(some, n, [o[s], th[s], start[s] + at], length), s.tolist(), at.tolist()):
                if flags.any():
                    out.extend((int(k[i]), int(th[i]), x, y) for x, y in _spans(flags, int(start[i]) + a, length))

    def emit(out: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], pa.int64()) for i in range(4)], schema=SPANS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bundle: dict[bytes, tuple] = {}  # whole keys whose stretches need a suffix array
        own: dict[bytes, tuple] = {}  # stretches of the present key
        held, last, needed = 0, None, False
        for batch in batches:
            out: list[tuple] = []
            seg_at = batch.schema.get_field_index("seg")
            done = batch.filter(batch.column(seg_at).is_null())
            if done.num_rows:
                k, th, start, windows = (done.column(done.schema.get_field_index(c)).to_numpy() for c in ("k", "th", "start", "windows"))
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in (k, th, start, start + windows - 1 + length)], schema=SPANS)
                batch = batch.filter(batch.column(seg_at).is_valid())
            cols = [batch.column(batch.schema.get_field_index(c)) for c in ("key", "o", "th", "start", "windows", "k", "inner")]
            key, o, th, start, windows, k, inner = (c.to_numpy(zero_copy_only=False).tolist() for c in cols)
            for i, seg in enumerate(batch.column(seg_at).to_pylist()):
                if key[i] != last:
                    if needed or len(own) > 1:  # else one stretch that repeats nothing but itself
                        bundle.update(own)
                        held += sum(map(len, own))
                        if held > bundle_bytes:
                            flush(bundle, out)
                            bundle, held = {}, 0
                    own, last, needed = {}, key[i], False
                needed = needed or bool(inner[i])
                place = (o[i], th[i], start[i], windows[i], k[i])
                other = own.setdefault(seg, place)
                if place[:3] != other[:3]:  # the same stretch from another batch: the earlier place stays
                    early, late = sorted((place, other))
                    own[seg] = early
                    out.append((int(late[4]), int(late[1]), int(late[2]), int(late[2] + late[3] - 1 + length)))
            if out:
                yield emit(out)
        out = []
        if needed or len(own) > 1:
            bundle.update(own)
        flush(bundle, out)
        if out:
            yield emit(out)

    return run


def _merge(spans: list[dict], th: int) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted((s["start"], s["end"]) for s in spans if s["th"] == th):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def _cut(with_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "bytes"):
            rows = []
            for doc_id, data, th, spans in zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("doc_id", "bytes", "th", "spans"))):
                cuts = _merge(spans, th) if spans else []
                kept, at = [], 0
                for a, b in cuts:
                    kept.append(data[at:a])
                    at = b
                kept = b"".join([*kept, data[at:]])
                row = {"doc_id": doc_id, "n_bytes": len(data), "n_removed": len(data) - len(kept), "n_spans": len(cuts), "kept_sha256": hashlib.sha256(kept).hexdigest()}
                rows.append(row | {"kept": kept, "spans": [{"start": a, "end": b} for a, b in cuts]} if with_text else row)
            fields = [("doc_id", batch.schema.field("doc_id").type), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())]
            if with_text:
                fields += [("kept", pa.binary()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))]
            yield pa.RecordBatch.from_pylist(rows, pa.schema(fields))

    return run


def remove_repeats(docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text", with_text: bool = True,
                   bundle_bytes: int = BUNDLE_BYTES, hot: int = HOT) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_bytes, n_removed, n_spans, kept_sha256 and, ``with_text``, kept (bytes) and spans.

    A byte goes if some ``length``-byte string over it also starts earlier:
    in a smaller id, or earlier in the same document. Strings are judged on the
    input. A null text is empty. Null ids come first. Rows that share an id go
    by a hash of the text; identical rows count as one document and get the
    same result. An empty table gives no rows.

    1. The key of a window of ``length`` bytes is the least hash of the
       GRAM-byte strings inside: equal windows have equal keys, and neighbours
       mostly share theirs, so a document has a key for every 39 bytes. Keys
       that occur at one place of the corpus alone can't hold a repeat.
    2. The stretches of text under the other keys meet by key, equal ones
       merged before and after the shuffle. In each bundle of keys, the windows
       whose hash occurs once in it stay out, and a suffix array over the rest
       decides them exactly. A key with one distinct stretch
       that holds the key's gram once has no more to decide and stays out.
       Keys of more than ``hot`` places (a passage of many documents ends there)
       meet in pieces of STEP windows, by the bytes that these share, so that
       no task holds all stretches of such a key.
    3. The spans go back to their documents.

    The three passes over the texts share one shuffle by id. Hot stretches
    leave each batch once, so a passage that a third of all documents hold
    costs a row per batch.
    """
    text_batches(docs.sparkSession)
    gram = min(GRAM, length)
    th = F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))
    rows = docs.select(
        F.col(id_col).alias("doc_id"), F.coalesce(F.col(id_col).cast("long"), th).alias("k"), F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63))).alias("o"),
        th.alias("th"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("bytes"))
    prints = rows.select("k", "bytes").mapInArrow(_fingerprints(length, gram), "h long, k long, c int")
    # one shuffle of the fingerprints counts and lists them
    often = prints.withColumn("c", F.sum("c").over(Window.partitionBy("h"))).filter("c > 1")
    listed = often.groupBy("k").agg(F.collect_set("h").alias("repeated"), F.collect_set(F.when(F.col("c") > hot, F.col("h"))).alias("hot"))
    pieces = rows.join(listed, "k").mapInArrow(
        _segments(length, gram), "part long, key long, k long, o long, th long, start long, windows long, inner boolean, seg binary")
    spans = (
        pieces.repartition("part").sortWithinPartitions("key")
        .mapInArrow(_decide(length, bundle_bytes), "k long, th long, start long, end long")
        .groupBy("k").agg(F.collect_list(F.struct("th", "start", "end")).alias("spans"))
    )
    schema = f"doc_id {dict(rows.dtypes)['doc_id']}, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    if with_text:
        schema += ", kept binary, spans array<struct<start:long,end:long>>"
    # the same columns as above, so that the shuffle of the texts is one and the same
    return rows.join(spans, "k", "left").mapInArrow(_cut(with_text), schema)
