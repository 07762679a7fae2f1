"""Registered queries: oracle parity, brute-force parity and the pipeline's stages on the smallest tables."""

import os

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from catchment.llm import mixing, queries, sharding, toxicity
from tests.oracle_harness import compare, duck

from . import brute

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.exists(SF), reason="driver test data not present")


def rows(sql):
    return duckdb.sql(sql.format(**{t: f"read_parquet('{SF}/{t}.parquet')" for t in ("documents", "pages", "labels", "benchmark")})).fetchall()


def test_all_are_registered():
    names = set(entry.queries())
    assert set(queries.QUERIES) | {"pipeline"} <= names
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 14))


@pytest.mark.parametrize("key", sorted(queries.ORACLE_SQL))
def test_oracle(spark, key):
    r = compare(spark, duck(SF), key, queries.QUERIES[key], queries.ORACLE_SQL[key], SF)
    assert r["ok"], r


def test_shards(spark):
    got = queries.op2_histogram_shards(spark, SF).collect()
    import zlib

    text = dict(rows("select doc_id, text from {documents}"))
    assert sorted(r.doc_id for r in got) == sorted(text)
    for r in got:
        data = (text[r.doc_id] or "").encode()
        assert (r["size"], r.text_crc32, r.law, r.grown_shard) == (len(data) + 8, zlib.crc32(data), "bytes", None)
    for s in range(24):
        slots = sorted(r.slot for r in got if r.shard == s)
        assert slots == list(range(len(slots)))


def test_repeats(spark):
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in queries.op3_suffix_dedup(spark, SF).collect()}
    assert got == brute.repeats(dict(rows("select doc_id, text from {documents}")), 100)


def test_near_duplicates(spark):
    got = {r.doc_id: (r.rep_id, r.class_id, r.n_links) for r in queries.op4_minhash_forest(spark, SF).collect()}
    assert got == brute.near_duplicates(rows("select doc_id, text from {documents}"))


def test_line_templates(spark):
    import hashlib

    docs = dict(rows("select doc_id, text from {documents}"))
    want = brute.line_drops(docs)
    for r in queries.op8_line_templates(spark, SF).collect():
        lines = (docs[r.doc_id] or "").split("\n")
        kept = "\n".join(x for i, x in enumerate(lines) if i not in want.get(r.doc_id, ()))
        assert (r.n_dropped, r.kept_sha256) == (len(want.get(r.doc_id, ())), hashlib.sha256(kept.encode()).hexdigest())


def test_language_model(spark):
    want = brute.base_scores(dict(rows("select doc_id, text from {documents}")))
    for r in queries.op10_maxent_lm(spark, SF).collect():
        held, n, known, train, base = want[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held, n, known, train) and abs(r.base_score - base) < 1e-6 * abs(base)


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    net = toxicity.fit(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    texts = rows("select doc_id, text from {documents}")
    import pyarrow as pa

    scores = net.score(pa.array([t for _, t in texts]))
    clean = [(d, t) for (d, t), s in zip(texts, scores) if s < corpus_pipeline.TOXIC]
    groups = brute.near_duplicates(clean)
    distinct = [(d, t) for d, t in clean if groups[d][1] == d]
    bench = rows("select item_id, text from {benchmark}")
    windows = {}
    for _, t in bench:
        w = brute.words(t)
        n = min(len(w), 10)
        for i in range(len(w) - n + 1 if n else 0):
            windows.setdefault(n, set()).add(tuple(w[i : i + n]))

    def leaks(text):
        w = brute.words(text)
        return any(tuple(w[i : i + n]) in ws for n, ws in windows.items() for i in range(len(w) - n + 1))

    left = sorted(d for d, t in distinct if not leaks(t))
    got = corpus_pipeline.run(spark, SF).collect()
    assert sorted(r.doc_id for r in got) == left
    for s in range(corpus_pipeline.SHARDS):
        slots = sorted(r.slot for r in got if r.shard == s)
        assert slots == list(range(len(slots)))


def test_stages_keep_the_columns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs.limit(60), SF).columns == docs.columns, name


def test_slots_of_each_shard_follow_the_mix(spark, monkeypatch):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    order = {r.doc_id: r.mix_position for r in mixing.mix(docs).collect()}
    assert len(order) == docs.count()
    for slot_rows in (sharding.SLOT_ROWS, 1):  # one bin of slots a shard, and several
        monkeypatch.setattr(sharding, "SLOT_ROWS", slot_rows)
        got = corpus_pipeline.sharded(spark, docs, SF)
        assert got.columns == [*docs.columns, "size", "shard", "slot"]
        rows_out = got.collect()
        assert len(rows_out) == len(order)
        for s in range(corpus_pipeline.SHARDS):
            mine = sorted((r.slot, order[r.doc_id]) for r in rows_out if r.shard == s)
            assert [x for x, _ in mine] == list(range(len(mine))) and [p for _, p in mine] == sorted(p for _, p in mine)


def test_pipeline_rejects_what_the_query_predicts_toxic(spark, monkeypatch):
    score = (F.col("doc_id") % 20) / 20.0
    monkeypatch.setattr(toxicity, "fit", lambda docs, labels, **kw: None)
    monkeypatch.setattr(toxicity, "scores", lambda docs, net, *a, **kw: docs.withColumn("tox_score", score))
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    predicted = {r.doc_id: r.predicted for r in queries.op6_toxicity(spark, SF).collect()}
    assert set(predicted.values()) == {0, 1}
    assert {r.doc_id for r in corpus_pipeline.clean(spark, docs, SF).collect()} == {d for d, p in predicted.items() if not p}
