"""Search, sharding, mixing, archives, classifier, language model and suffix arrays on small tables."""

import random
import zlib

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from catchment.llm import binary_search, language_model, mixing, sharding, suffix_array, toxicity, warc
from catchment.llm.common import fresh_dir

from . import brute


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


@settings(max_examples=300, deadline=None)
@given(st.binary(max_size=60).map(lambda b: bytes(x % 3 for x in b)) | st.binary(max_size=40))
def test_suffix_array_orders_suffixes(data):
    want = sorted(range(len(data)), key=lambda i: data[i:])
    assert suffix_array.suffix_array(np.frombuffer(data, np.uint8)).tolist() == want


def test_suffix_array_wide_groups(monkeypatch):
    rng = random.Random(2)
    for wide in (1, 3, 160):
        monkeypatch.setattr(suffix_array, "WIDE", wide)
        for _ in range(150):
            data = bytes(rng.choice(b"abc") for _ in range(rng.randint(0, 90))) * rng.choice([1, 1, 3])
            assert suffix_array.suffix_array(np.frombuffer(data, np.uint8)).tolist() == sorted(range(len(data)), key=lambda i: data[i:])


def test_top_k_is_exact(spark):
    rng = np.random.default_rng(1)
    centres = rng.standard_normal((4, 40))
    rows = [(i, (centres[i % 4] + 0.4 * rng.standard_normal(40)).astype(float).tolist()) for i in range(150)]
    rows += [(1000 + i, rows[0][1]) for i in range(30)]  # a code that many rows share
    rows += [(2000, None), (2001, [1.0]), (2002, []), (None, rows[3][1]), (5, rows[5][1])]
    vectors = frame(spark, rows, "vec_id long, embedding array<double>")
    codes = binary_search.sign_code(vectors)
    k = 7
    got = binary_search.top_k(codes, codes.filter("id % 10 = 0 or id is null"), k).collect()
    bits = [(i, tuple(int(j < len(v) and v[j] > 0) for j in range(40))) for i, v in rows if v is not None]
    key = lambda i: (i is not None, i or 0)
    for q, b in {(i, b) for i, b in bits if i is None or i % 10 == 0}:
        best = sorted(((sum(x != y for x, y in zip(b, c)), key(i), i) for i, c in bits), key=lambda t: t[:2])[:k]
        mine = sorted((r.rank, r.distance, r.id) for r in got if r.query_id == q)
        assert [(d, i) for _, d, i in mine] == [(d, i) for d, _, i in best]
    assert binary_search.top_k(codes.limit(0), codes, 3).count() == 0
    assert binary_search.top_k(codes, codes.limit(0), 3).count() == 0
    few = binary_search.top_k(codes.filter("id < 3"), codes.filter("id = 0"), 10)
    assert few.count() == 3


def test_shards_hold_near_equal_bytes(spark):
    rng = random.Random(6)
    rows = [(i, "w" * rng.randint(0, 400) + str(i)) for i in range(3000)] + [(5000 + i, "the same text " * 5) for i in range(1500)]
    rows += [(9000, None), (9001, None), (None, "x"), (9002, ""), (1, "w"), (9000, None)]
    docs = frame(spark, rows, "doc_id long, text string").withColumns({"shard": F.lit("old"), "other": F.lit(1)})
    got = sharding.assign_shards(docs, 24)
    assert got.columns == ["doc_id", "text", "other", "size", "shard", "slot"]
    rows_out = got.collect()
    assert len(rows_out) == len(rows)
    total = sum(len((t or "").encode()) + 8 for _, t in rows)
    by = {s: [r for r in rows_out if r.shard == s] for s in range(24)}
    for s, members in by.items():
        assert sorted(r.slot for r in members) == list(range(len(members)))
        assert abs(sum(r.size for r in members) - total / 24) <= 420 + 0.004 * total / 24
    assert sharding.assign_shards(docs.limit(0), 24).count() == 0
    one = sharding.assign_shards(frame(spark, [(1, "a")] * 5, "doc_id long, text string"), 3).collect()
    assert len({r.shard for r in one}) == 1 and sorted(r.slot for r in one) == list(range(5))


def test_mix_follows_deadlines(spark):
    sizes = {"a": 700, "b": 300, "c": 45, None: 20}
    rows = [(i, s) for i, s in enumerate(s for s, n in sizes.items() for _ in range(n))]
    docs = frame(spark, rows, "doc_id long, source string").withColumn("mix_slot", F.lit("x"))
    weights = {"a": 0.5, "b": 0.3, "c": 0.2}
    got = mixing.mix(docs, weights, block_rows=4, hyperperiod=50).collect()
    assert sorted(r.mix_position for r in got) == list(range(len(rows)))
    order = sorted(got, key=lambda r: r.mix_position)
    assert [(r.mix_slot, r.mix_offset) for r in order] == sorted((r.mix_slot, r.mix_offset) for r in order)
    plan = {r.src: r.a for r in mixing.source_plan(docs, weights, hyperperiod=50).collect()}
    assert sum(plan.values()) == 50 and plan[None] == 1 and plan["a"] > plan["b"] > plan["c"]
    named = {s or "": a for s, a in plan.items()}
    slots = brute.template_slots(named, 50)
    for r in got:
        a = named[r.source or ""]
        assert slots[r.mix_slot % 50] == (r.source or "", r.mix_block % a) and r.mix_slot // 50 == r.mix_block // a
    # less than one block from the target share at every slot, as long as a source lasts
    for s, n in sizes.items():
        mine = sorted({r.mix_slot for r in got if r.source == s})
        share = plan[s] / 50
        for k, slot in enumerate(mine):
            assert abs(k - share * slot) < 1 and abs(k + 1 - share * (slot + 1)) < 1
    assert mixing.mix(docs.limit(0)).count() == 0


def test_mix_position_needs_no_cap_on_sources(spark):
    rows = [(i, f"s{i % 70}") for i in range(500)]
    got = mixing.mix(frame(spark, rows, "doc_id long, source string"), block_rows=2, hyperperiod=10).collect()
    assert sorted(r.mix_position for r in got) == list(range(500))


def test_schedule_keeps_the_target_weights():
    rng = random.Random(21)
    for k, heavy in ((3, 0.5), (40, 0.9), (300, 0.5)):
        w = [heavy, *(rng.random() ** 3 + 1e-3 for _ in range(k - 1))]
        w[1:] = [x * (1 - heavy) / sum(w[1:]) for x in w[1:]]
        blocks = [max(1, round(20_000 * x)) for x in w]
        source, block, slot = mixing.schedule(blocks, w)
        assert len(set(slot.tolist())) == len(slot) == sum(blocks) and (np.diff(slot) > 0).all()
        for i in range(k):
            mine = slot[source == i]
            assert block[source == i].tolist() == list(range(blocks[i]))
            served = np.arange(len(mine))
            assert (abs(served - w[i] * mine) < 1 + 1e-9).all() and (abs(served + 1 - w[i] * (mine + 1)) < 1 + 1e-9).all()
    assert mixing.schedule([], [])[0].tolist() == [] and sorted(mixing.schedule([2, 3], [0.0, 0.0])[0].tolist()) == [0, 0, 1, 1, 1]


def test_mix_keeps_given_weights_with_many_sources(spark):
    small = {f"s{i:03d}": 0.5 / 260 * (0.5 + (i % 3) / 2) for i in range(260)}
    weights = {"big": 1 - sum(small.values()), **small, "zero": 0.0}
    count = {"big": 900, "zero": 5, "left out": 7, None: 3} | dict.fromkeys(small, 4)
    rows = [(i, s) for i, s in enumerate(s for s, n in count.items() for _ in range(n))]
    got = mixing.mix(frame(spark, rows, "doc_id long, source string"), weights, block_rows=2).collect()
    assert sorted(r.mix_position for r in got) == list(range(len(rows)))
    order = sorted(got, key=lambda r: r.mix_position)
    assert [(r.mix_slot, r.mix_offset) for r in order] == sorted((r.mix_slot, r.mix_offset) for r in order)
    # without a weight: after all others
    assert {r.source for r in order[-15:]} == {"zero", "left out", None}
    for s in ("big", *small):
        mine = sorted({r.mix_slot for r in got if r.source == s})
        assert len(mine) == -(-count[s] // 2)
        for k, slot in enumerate(mine):
            assert abs(k - weights[s] * slot) < 1 + 1e-9 and abs(k + 1 - weights[s] * (slot + 1)) < 1 + 1e-9


def test_warc_round_trip(spark):
    pages = {1: "<p>a</p>", 2: "<p>a</p>", 3: None, 4: "", 5: "é" * 5000, 6: "line\r\n\r\nWARC/1.1\r\n", 7: "<p>a</p>", 8: "x" * 2_000_000}
    rows = [(p, None if p == 2 else f"http://h/{p}?a b\r\n", h) for p, h in pages.items()]
    docs = frame(spark, rows, "page_id long, url string, html string").withColumn("payload", F.lit(1))
    path = fresh_dir(spark, "warc-test")
    warc.write_archives(docs, path)
    got = warc.read_archives(spark, path).collect()
    assert {r.page_id: (r.payload_length, r.payload_digest, r.warc_type, r.refers_to) for r in got} == brute.warc(pages)
    for r in got:
        assert r.payload == (None if r.warc_type == "revisit" else (pages[r.page_id] or "").encode())
    some = warc.read_archives(spark, path).filter("warc_type = 'revisit'")
    assert sorted(r.page_id for r in some.collect()) == [1, 2, 3]
    # the source tests the predicate itself: no filter stands above the scan
    assert "Filter (" not in some._jdf.queryExecution().executedPlan().toString()
    uri = warc.read_archives(spark, path).filter(F.col("target_uri").startswith("http://h/5"))
    assert [r.page_id for r in uri.collect()] == [5]
    assert all(r.payload is None for r in warc.read_archives(spark, path, payload=False).collect())
    odd = frame(spark, [(None, None, "q"), (3, None, "q"), (3, None, "q"), (None, None, "z")], "page_id long, url string, html string")
    plan = sorted(str((r.page_id, r.record_type, r.refers_to)) for r in warc.plan_records(odd).collect())
    assert plan == ["(3, 'response', None)", "(3, 'response', None)", "(None, 'response', None)", "(None, 'revisit', 3)"]
    nothing = fresh_dir(spark, "warc-none")
    assert warc.read_archives(spark, nothing).count() == 0


def test_warc_reader_skips_payloads_and_reads_foreign_members(tmp_path):
    import gzip
    import io

    record = warc._record(7, "http://a", b"hello", "D" * 32, "response", None)
    own, foreign = warc._member(record), gzip.compress(record)
    assert gzip.decompress(own) == record
    for data in (own * 3, foreign * 3, own + foreign + own):
        rows = list(warc.read_records(io.BytesIO(data), [], True))
        assert [r["payload"] for r in rows] == [b"hello"] * 3
    broken = bytearray(own)
    broken[-12:] = b"\0" * 12  # the end of the member is never looked at when the headers don't pass
    rows = list(warc.read_records(io.BytesIO(bytes(broken) + own), [lambda h: h["page_id"] is None], True))
    assert rows == []


def toxic_corpus(n, seed=0):
    rng = random.Random(seed)
    plain = [a + b for a in ("ka", "lo", "mi", "ru", "te", "so") for b in ("ba", "do", "fe", "gi", "hu", "le", "na")]
    rows = []
    for i in range(n):
        w = [rng.choice(plain) for _ in range(rng.randint(5, 150))]
        y = int(rng.random() < 0.3)
        if y:
            for _ in range(2 + len(w) // 40):
                w[rng.randrange(len(w))] = "zz" + rng.choice(["ik", "ug", "or"]) + rng.choice(["a", "e"])
        rows.append((i, " ".join(w), y))
    return rows


def test_toxicity_learns_from_the_text_alone(spark):
    rows = toxic_corpus(900)
    docs = frame(spark, [(i, t) for i, t, _ in rows] + [(5000, None), (5001, ""), (5002, "!!"), (None, "zzika " * 40)], "doc_id long, text string").withColumn("tox_score", F.lit("old"))
    labels = frame(spark, [(i, y) for i, _, y in rows] + [(None, 1), (3, None)], "doc_id long, toxic int")
    got = toxicity.score_documents(docs, labels)
    assert got.columns == ["doc_id", "text", "tox_score"]
    scores = {r.doc_id: r.tox_score for r in got.collect()}
    assert len(scores) == 904 and all(0 <= s <= 1 for s in scores.values())
    held = [(scores[i] >= 0.3, y) for i, _, y in rows if zlib.crc32(str(i).encode()) % 4 == 2]
    assert sum(p == bool(y) for p, y in held) / len(held) > 0.95
    assert scores[None] > 0.5 > scores[5000] and scores[5000] == scores[5001] == scores[5002]
    kept = toxicity.remove_toxic(docs.drop("tox_score"), labels)
    assert kept.columns == ["doc_id", "text"]
    assert toxicity.score_documents(docs.limit(0), labels).count() == 0
    assert toxicity.score_documents(docs, labels.limit(0)).count() == 904


def test_toxicity_gradients():
    rng = np.random.default_rng(0)
    words = toxicity.read_words(np.frombuffer(b"aa bb cc dd aa ee", np.uint8), np.array([0, 17]))
    net = toxicity.Network.fresh(words.hashes[:1], np.ones(1, np.float32))
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    net.p = {k: v + 0.1 * rng.standard_normal(v.shape) for k, v in net.p.items()}
    index, mask = toxicity._padded(words.form, np.array([0, 2]), np.array([6, 3]), len(words.hashes))
    x = net.inputs(words).astype(np.float64)
    loss = lambda: float(np.logaddexp(0, -net.forward(net.gates(x), index, mask)).sum())
    keep = {}
    out = net.forward(net.gates(x), index, mask, keep)
    g = toxicity._backward(net, x, index, mask, keep, -1 / (1 + np.exp(out)))
    for name in ("wo", "va", "wa", "ba", "uf", "ub", "xf", "bf", "bb"):
        flat, want = net.p[name].reshape(-1), g[name].reshape(-1)
        for j in rng.choice(len(flat), min(6, len(flat)), replace=False):
            old = flat[j]
            flat[j] = old + 1e-3
            up = loss()
            flat[j] = old - 1e-3
            down = loss()
            flat[j] = old
            assert abs((up - down) / 2e-3 - want[j]) < 2e-3 * max(1, abs(want[j])), name


def test_windows_cover_every_word():
    for n in (0, 1, 63, 64, 65, 112, 113, 500):
        row = np.zeros(n, np.int64)
        starts, lengths, of = toxicity.window_starts(row, 1)
        seen = np.zeros(n, bool)
        for s, k in zip(starts, lengths):
            seen[s : s + k] = True
        assert seen.all() and len(starts) >= 1 and (np.diff(starts) <= toxicity.STRIDE).all()


def test_language_model(spark):
    rng = random.Random(3)
    follow = {w: rng.sample("abcdefghijklmnop", 2) for w in "abcdefghijklmnop"}
    rows = []
    for i in range(400):
        w = [rng.choice("abcdefghijklmnop")]
        for _ in range(rng.randint(0, 120)):
            w.append(rng.choice(follow[w[-1]]))
        rows.append((i, " ".join(w)))
    rows += [(1000, None), (1001, ""), (1002, "Never SEEN\twords é"), (1003, "A  b\n")]
    got = language_model.score_documents(frame(spark, rows, "doc_id long, text string").withColumn("row", F.lit(1)))
    want = brute.base_scores(dict(rows))
    total = [0.0, 0.0]
    for r in got.collect():
        held, n, known, train, base = want[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held, n, known, train)
        assert abs(r.base_score - base) < 1e-6 * max(1, abs(base))
        if held:
            total[0] += r.score
            total[1] += r.base_score
    assert got.count() == len(rows) and total[0] > total[1] * 0.9  # well above the unigram score on held-out rows
    assert language_model.score_documents(frame(spark, [], "doc_id long, text string")).count() == 0


def test_language_model_with_a_tail(spark, monkeypatch):
    monkeypatch.setattr(language_model, "HEAD_ROWS", 30)
    rng = random.Random(8)
    rows = [(i, " ".join(f"w{int(rng.paretovariate(0.7))}" for _ in range(rng.randint(1, 60)))) for i in range(300)] + [(None, "w1 w2")]
    got = language_model.score_documents(frame(spark, rows, "doc_id long, text string")).collect()
    want = brute.base_scores(dict(rows))
    for r in got:
        held, n, known, train, base = want[r.doc_id]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (n, known, train) and abs(r.base_score - base) < 1e-6 * abs(base)


def test_class_probabilities_add_up_to_one():
    rng = np.random.default_rng(0)
    w = rng.standard_normal((language_model.FEATURES, language_model.CLASSES)).astype(np.float32)
    hashes, suffix, row = language_model.tokens(pa.array(["a b c", None, "a"]))
    assert list(row) == [0, 0, 0, 0, 1, 2, 2] and hashes[3] == hashes[4] == hashes[6] == language_model.END and hashes[0] == hashes[5]
    p = language_model.class_probabilities(w, np.zeros(language_model.CLASSES, np.float32), language_model.features(hashes, row))
    assert np.allclose(p.sum(axis=1), 1, atol=1e-5)
