"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import checkpoint, ensure_checkpoint_dir

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# Separators between words: every ASCII character that is neither a digit nor a lower-case letter.
NON_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
# The same set as bytes, for the numpy tokenizers (bytes of non-ASCII characters belong to words).
WORD_BYTE = np.ones(256, bool)
WORD_BYTE[0x00:0x30] = WORD_BYTE[0x3A:0x61] = WORD_BYTE[0x7B:0x80] = False
LOWER_BYTE = np.arange(256, dtype=np.uint8)
LOWER_BYTE[65:91] += 32


def land(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet in the shared checkpoint folder and read it back: cuts lineage, survives lost executors."""
    return checkpoint(df)[0]


def fresh_dir(spark: SparkSession, name: str) -> str:
    """A path of its own in the shared checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def text_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Let Arrow batches hold at most ``rows`` rows, so that batches of long texts stay small in the workers and the JVM."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


@contextmanager
def small_batches(spark: SparkSession, rows: int = 1000) -> Iterator[None]:
    """Arrow batches of at most ``rows`` rows for what is run (landed) inside; the session's setting comes back after it."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only. Texts of ASCII alone take the faster built-in."""
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def words(text: Column) -> Column:
    """Lower-cased words of a text as an array; a null text has none."""
    return F.coalesce(F.array_remove(F.split(ascii_lower(text), NON_WORD), ""), F.array().cast("array<string>"))


def doc_key(id_col: str = "doc_id", text_col: str = "text") -> list[Column]:
    """Columns that tell rows apart by content: the id and two hashes of the text.

    Identical rows share a key (and so a result); rows that share only the id don't.
    """
    return [F.col(id_col), F.xxhash64(text_col).alias("__th"), F.hash(text_col).alias("__th2")]


def null_safe_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "left") -> DataFrame:
    """Join on ``keys`` where null equals null; the right side's keys are dropped."""
    r = right.select(*[F.col(c).alias(f"__r_{c}") if c in keys else F.col(c) for c in right.columns])
    cond = None
    for k in keys:
        c = F.col(k).eqNullSafe(F.col(f"__r_{k}"))
        cond = c if cond is None else cond & c
    return left.join(r, cond, how).drop(*[f"__r_{k}" for k in keys])


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (from 0) of a string or binary array; nulls count as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    big = pa.large_binary() if column.type in (pa.large_string(), pa.large_binary()) else pa.binary()
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    column = column.cast(big)
    kind = np.int64 if big == pa.large_binary() else np.int32
    offsets = np.frombuffer(column.buffers()[1], kind, len(column) + 1, column.offset * kind().itemsize).astype(np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches into runs of whole rows of about ``limit`` bytes of ``column``, so that work arrays stay small."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, off = buffers(batch.column(batch.schema.get_field_index(column)))
        start = 0
        while start < batch.num_rows:
            end = max(start + 1, int(np.searchsorted(off, off[start] + limit, "right")) - 1)
            yield batch.slice(start, end - start)
            start = end


def mix64(x: np.ndarray) -> np.ndarray:
    """Bijective scrambling of uint64 values (multiply and xor-shift rounds)."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def token_spans(data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of every maximal run of word bytes; runs never cross rows."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    w = is_word[data]
    first = np.zeros(n + 1, bool)
    first[offsets[:-1]] = True
    first = first[:n]
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = w[:-1]
    starts = np.flatnonzero(w & (~before | first))
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = w[1:] & ~first[1:]
    ends = np.flatnonzero(w & ~after) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


_POW = None


def token_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte run, from one prefix sum of byte * base**position (mod 2**64)."""
    global _POW
    n = len(data)
    if not len(starts):
        return np.zeros(0, np.uint64)
    base = np.uint64(0x9E3779B97F4A7C15)
    inverse = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
    if _POW is None or len(_POW[0]) < n + 1:
        size = max(n + 1, 1 << 16)
        with np.errstate(over="ignore"):
            up, down = np.full(size, base), np.full(size, inverse)
            up[0] = down[0] = 1
            _POW = np.multiply.accumulate(up), np.multiply.accumulate(down)
    with np.errstate(over="ignore"):
        prefix = np.zeros(n + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _POW[0][:n], out=prefix[1:])
        return mix64((prefix[ends] - prefix[starts]) * _POW[1][starts] + (ends - starts).astype(np.uint64))
