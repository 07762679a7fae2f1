"""Line dedup with a log-template tree: lines of templates that recur across documents are dropped."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator, Sequence
from math import ceil

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import buffers, land, mix64, null_safe_join, slices, token_hashes, token_spans
from .components import components
from .language_model import TOKEN_BYTE

VARIABLE = "<*>"
DEPTH = 3
#: Distinct lines of a leaf from which its work is dealt to several tasks.
SPREAD_LINES = 50_000
#: Templates of a leaf from which they are looked up instead of all compared.
LOOK_UP = 200
SPACE, DIGIT = re.compile(r"[ \t\n\x0b\f\r]+"), re.compile(r"[0-9]")


def line_keys(data: np.ndarray, offsets: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, line, leaf, mh) of every line with a token: the hash of its tree node and of all its tokens, variable fields masked."""
    starts, ends, row = token_spans(data, offsets, TOKEN_BYTE)
    if not len(starts):
        return (np.zeros(0, np.int64),) * 2 + (np.zeros(0, np.uint64),) * 2
    breaks = np.concatenate([[0], np.cumsum(data == 10)])
    digits = np.concatenate([[0], np.cumsum((data >= 48) & (data <= 57))])
    line = breaks[starts] - breaks[offsets[:-1]][row]
    hashes = np.where(digits[ends] > digits[starts], np.uint64(1), token_hashes(data, starts, ends))
    first = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (line[1:] != line[:-1])]))
    count = np.diff(np.append(first, len(starts)))
    with np.errstate(over="ignore"):
        place = np.arange(len(starts)) - np.repeat(first, count)
        salt = mix64(place.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(1)) | np.uint64(1)
        parts = mix64(hashes * salt)
        mh = mix64(np.add.reduceat(parts, first) + count.astype(np.uint64))
        leaf = mix64(np.add.reduceat(np.where(place < depth, parts, np.uint64(0)), first) + count.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))
    return row[first], line[first], leaf, mh


def _scan(depth: int, id_col: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "__text"):
            row, line, leaf, mh = line_keys(*buffers(batch.column(batch.schema.get_field_index("__text"))), depth)
            keys = [batch.column(batch.schema.get_field_index(c)).take(pa.array(row)) for c in (id_col, "__th")]
            yield pa.RecordBatch.from_arrays([*keys, pa.array(line, pa.int32()), pa.array(leaf.view(np.int64)), pa.array(mh.view(np.int64))], [id_col, "__th", "line", "leaf", "mh"])

    return run


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The masked tokens of the listed lines of each text."""
    for batch in batches:
        rows = []
        for text, wanted in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            lines = text.split("\n")
            for w in wanted:
                tokens = [VARIABLE if DIGIT.search(t) else t for t in SPACE.split(lines[w["line"]]) if t]
                rows.append({"leaf": w["leaf"], "mh": w["mh"], "tokens": tokens})
        for at in range(0, len(rows), 5000):
            yield pa.RecordBatch.from_pylist(rows[at : at + 5000], pa.schema([("leaf", pa.int64()), ("mh", pa.int64()), ("tokens", pa.list_(pa.string()))]))


def _node(depth: int) -> Column:
    """Tree node of a line: its token count and first ``depth`` tokens."""
    return F.xxhash64(F.size("tokens"), F.slice("tokens", 1, depth))


def _parts(tokens: Sequence, variable, threshold: float, depth: int) -> int | None:
    """Into how many parts the tokens after the first ``depth`` fall so that lines which may share a template have one in common.

    Lines of a leaf share their first ``depth`` tokens. A template's fixed
    positions are those of the line that started it, so a line that joins it
    agrees with that line on ``threshold`` of all positions; if the positions
    that may differ are fewer than the parts, one part agrees as a whole. None:
    the first tokens alone reach the threshold.
    """
    must = ceil(threshold * len(tokens)) - sum(t != variable for t in tokens[:depth])
    return None if must <= 0 else max(0, len(tokens[depth:]) - must + 1)


def _bonds(threshold: float, depth: int):
    """(leaf, mh, bond): a hash of each part of a line without variable fields; leaves that hold one template have one bond."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            leaf, mh, bond = [], [], []
            for at, line, tokens in zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("leaf", "mh", "tokens"))):
                n = _parts(tokens, VARIABLE, threshold, depth)
                parts = [["", *tokens[depth + i :: n]] for i in range(n)] if n is not None else [[]]
                for i, part in enumerate(parts):
                    if VARIABLE not in part:
                        leaf.append(at)
                        mh.append(line)
                        bond.append(int.from_bytes(hashlib.blake2b("\n".join([str(i), *part]).encode(), digest_size=8).digest(), "little", signed=True))
            for a in range(0, len(bond), 20_000):
                yield pa.RecordBatch.from_arrays([pa.array(x[a : a + 20_000], pa.int64()) for x in (leaf, mh, bond)], ["leaf", "mh", "bond"])

    return run


def _spread(texts: DataFrame, large: DataFrame, threshold: float, depth: int) -> DataFrame:
    """``texts`` with the lines of large leaves under nodes that can't share a template: classes of lines linked by their bonds.

    A leaf's lines are clustered in order, and a line only meets templates
    started by lines with which it shares a bond, so that the classes taken one
    by one give the templates of the whole leaf.
    """
    bonds = land(texts.join(large.select("leaf"), "leaf").select("leaf", "mh", "tokens").mapInArrow(_bonds(threshold, depth), "leaf long, mh long, bond long"))
    least = bonds.groupBy("leaf", "bond").agg(F.min("mh").alias("b"))
    classes = components(bonds.join(least, ["leaf", "bond"]).select(F.col("mh").alias("a"), "b"))
    return (
        texts.join(large.select("leaf", F.lit(1).alias("deep")), "leaf", "left").join(classes.withColumnRenamed("node", "mh"), "mh", "left")
        .withColumn("node", F.when(F.col("deep").isNull(), F.col("node")).otherwise(F.xxhash64("node", F.coalesce("root", "mh")))).drop("deep", "root")
    )


def _cluster(threshold: float, depth: int):
    """Templates of each leaf, greedily in the order of the lines: one row per line with the index of its template."""

    def close(leaf, hashes, owner, out):
        if hashes:
            top, mh = np.array(hashes, np.int64).T
            out.append(pd.DataFrame({"leaf": np.int64(leaf), "top": top, "mh": mh, "template": np.array(owner, np.int64)}))

    def bonds(row: np.ndarray) -> list[tuple[int, bytes]]:
        n = _parts(row, 0, threshold, depth) or 0
        return [(i, row[depth + i :: n].tobytes()) for i in range(n) if row[depth + i :: n].all()]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        leaf = ids = None
        templates, used = np.zeros((0, 0), np.int32), 0
        hashes: list[tuple[int, int]] = []
        owner: list[int] = []
        known: dict[tuple[int, bytes], list[int]] = {}  # part of the line that started a template -> templates
        for batch in batches:
            out: list[pd.DataFrame] = []
            for at, top, mh, tokens in zip(batch["leaf"].to_numpy(), batch["top"].to_numpy(), batch["mh"].to_numpy(), batch["tokens"]):
                if at != leaf:
                    close(leaf, hashes, owner, out)
                    leaf, ids, hashes, owner, used, known = at, {VARIABLE: 0}, [], [], 0, {}
                    templates = np.zeros((4, len(tokens)), np.int32)
                row = np.fromiter((ids.setdefault(t, len(ids)) for t in tokens), np.int32, len(tokens))
                best, keys = -1, None
                if used > LOOK_UP:
                    keys = bonds(row)
                    near = np.unique(np.array([x for k in keys for x in known.get(k, ())], np.int64))
                    same = ((templates[near] == row) & (row > 0)).sum(axis=1)
                    if len(near) and same.max() >= threshold * len(row):
                        best = int(near[same.argmax()])
                elif used:
                    same = ((templates[:used] == row) & (row > 0)).sum(axis=1)
                    best = int(same.argmax())
                    if same[best] < threshold * len(row):
                        best = -1
                if best < 0:
                    if used == len(templates):
                        templates = np.concatenate([templates, np.zeros_like(templates)])
                    templates[used] = row
                    best, used = used, used + 1
                    for k in bonds(row) if keys is None else keys:
                        known.setdefault(k, []).append(best)
                else:
                    templates[best][templates[best] != row] = 0
                hashes.append((top, mh))
                owner.append(best)
            if out:
                yield pd.concat(out)
        out = []
        close(leaf, hashes, owner, out)
        yield from out

    return run


def recurring_lines(docs: DataFrame, min_docs: int = 5, threshold: float = 0.7, depth: int = DEPTH,
                    leaf_lines: int | None = None, id_col: str = "doc_id", text_col: str = "text", spread_lines: int = SPREAD_LINES) -> DataFrame:
    """(key, lines): per document key the numbers (from 0) of its lines whose template occurs in ``min_docs`` documents or more.

    The tree: a line goes by its token count, then by its first ``depth``
    tokens, tokens with a digit generalised to one variable field first. In a
    leaf, distinct lines are taken in the order of their tokens; each joins the template with which it shares most positions, if that is
    ``threshold`` of them, and the positions that differ become variable;
    otherwise it starts a template. Leaves seen in fewer than ``min_docs``
    documents can't hold a recurring template and are left out before any text
    moves: a first scan sends hashes of the lines only. Each distinct line of
    the other leaves is then read from one of its documents, so that only
    distinct lines reach a leaf's task. A leaf with over ``spread_lines`` of
    them is dealt to tasks by classes of lines that may share a template, which
    changes the tasks and not the templates. Only if ``leaf_lines`` is given, a
    node with more distinct lines branches on further tokens, and lines that
    differ there no longer meet. Tokens are runs of bytes other than the space
    and 0x09-0x0D; digits are 0-9.
    """
    key = [id_col, "__th"]
    rows = docs.select(id_col, F.xxhash64(text_col).alias("__th"), F.coalesce(F.col(text_col), F.lit("")).alias("__text"))
    id_type = dict(rows.dtypes)[id_col]
    lines = land(rows.mapInArrow(_scan(depth, id_col), f"`{id_col}` {id_type}, __th long, line int, leaf long, mh long"))
    seen = lines.select("leaf", *key).distinct().groupBy("leaf").agg(F.count("*").alias("n")).filter(F.col("n") >= min_docs)
    place = F.min(F.struct(*key, "line")).alias("at")
    chosen = (
        lines.join(seen.select("leaf"), "leaf").groupBy("leaf", "mh").agg(place)
        .groupBy(F.col(f"at.{id_col}").alias(id_col), F.col("at.__th").alias("__th")).agg(F.collect_list(F.struct("at.line", "leaf", "mh")).alias("wanted"))
    )
    texts = null_safe_join(rows, chosen, key, "inner").select("__text", "wanted").mapInArrow(_read, "leaf long, mh long, tokens array<string>")
    # rows that repeat id and text give their lines again
    texts = land(texts.dropDuplicates(["leaf", "mh"]).withColumn("node", F.col("leaf")))
    level = depth
    while leaf_lines is not None:
        large = texts.groupBy("node").agg(F.count("*").alias("n"), F.max(F.size("tokens")).alias("len")).filter((F.col("n") > leaf_lines) & (F.col("len") > level))
        if large.isEmpty():
            break
        level += 1
        deeper = F.when(F.col("deep").isNotNull(), _node(level)).otherwise(F.col("node"))
        texts = land(texts.join(large.select("node", F.lit(1).alias("deep")), "node", "left").withColumn("node", deeper).drop("deep"))
    large = texts.groupBy("leaf").agg(F.count("*").alias("n")).filter(F.col("n") > spread_lines)
    if not large.isEmpty():
        texts = land(_spread(texts, land(large), threshold, depth))
    by_leaf = texts.select(F.col("node").alias("leaf"), F.col("leaf").alias("top"), "mh", "tokens").repartition("leaf").sortWithinPartitions("leaf", F.size("tokens"), "tokens", "mh")
    owned = land(by_leaf.mapInPandas(_cluster(threshold, depth), "leaf long, top long, mh long, template long").select(F.col("leaf").alias("node"), F.col("top").alias("leaf"), "mh", "template"))
    member = lines.join(owned, ["leaf", "mh"]).select(*key, "line", "node", "template")
    often = member.select("node", "template", *key).distinct().groupBy("node", "template").agg(F.count("*").alias("n")).filter(F.col("n") >= min_docs)
    dropped = member.join(often.select("node", "template"), ["node", "template"])
    return dropped.groupBy(*key).agg(F.array_sort(F.collect_set("line")).alias("lines"))


def drop_recurring_lines(docs: DataFrame, min_docs: int = 5, threshold: float = 0.7, depth: int = DEPTH,
                         id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the recurring lines cut from the text, plus n_lines and n_dropped.

    A null text stays null with 0 lines; lines without tokens are never
    dropped. Identical rows get the same result, and rows that share only the
    id are documents of their own. An empty table gives no rows. Columns named
    n_lines or n_dropped are replaced.
    """
    docs = docs.drop("n_lines", "n_dropped")
    found = recurring_lines(docs, min_docs, threshold, depth, id_col=id_col, text_col=text_col)
    full = null_safe_join(docs.withColumn("__th", F.xxhash64(text_col)), found.withColumnRenamed("lines", "__lines"), [id_col, "__th"])
    all_lines = F.split(F.col(text_col), "\n")
    kept = F.filter(all_lines, lambda x, i: ~F.array_contains("__lines", i))
    return full.select(
        *[F.when(F.col("__lines").isNull(), F.col(text_col)).otherwise(F.array_join(kept, "\n")).alias(c) if c == text_col else F.col(c) for c in docs.columns],
        F.coalesce(F.when(F.col(text_col).isNotNull(), F.size(all_lines)), F.lit(0)).cast("long").alias("n_lines"),
        F.coalesce(F.when(F.col("__lines").isNotNull(), F.size("__lines")), F.lit(0)).cast("long").alias("n_dropped"),
    )
