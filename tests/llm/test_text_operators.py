"""Near duplicates, repeated strings, line templates and decontamination against brute force, with odd inputs."""

import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from catchment.llm import components, decontamination, jaccard_join, line_templates, repeats

from . import brute

VOCAB = [a + b for a in ("ka", "lo", "mi", "ru", "te", "so", "na") for b in ("ba", "do", "fe", "gi", "hu", "le")]


def prose(rng, n):
    return " ".join(rng.choice(VOCAB) for _ in range(n))


def edited(rng, text, edits):
    w = text.split()
    for _ in range(edits):
        w[rng.randrange(len(w))] = rng.choice(VOCAB)
    return " ".join(w)


def corpus(seed=3):
    """Ids and texts: prose, exact copies, near copies, shared passages, empty, null and repetitive texts."""
    rng = random.Random(seed)
    texts = [prose(rng, rng.randint(1, 120)) for _ in range(40)]
    base = prose(rng, 90)
    texts += [base] * 3 + [edited(rng, base, k) for k in (1, 1, 1, 2, 3, 4, 9)]
    passage = prose(rng, 30)
    texts += [prose(rng, 20) + "\n" + passage + "\n" + prose(rng, 10) for _ in range(6)]
    texts += ["", None, "!!", "!!", "kaba", "KABA,", "kaba lodo", "a" * 400, "ab" * 300, "é" * 150, passage[:99], passage[:100]]
    rng.shuffle(texts)
    return list(enumerate(texts, 1))


def frame(spark, rows, schema="doc_id long, text string"):
    return spark.createDataFrame(rows, schema)


def test_near_duplicates_match_all_pairs(spark):
    rows = corpus()
    got = {r.doc_id: (r.rep_id, r.class_id, r.n_links) for r in jaccard_join.near_duplicates(frame(spark, rows)).collect()}
    assert got == brute.near_duplicates(rows)
    assert any(v[2] > 3 for v in got.values())


def test_near_duplicates_in_several_blocks(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "BLOCK", 4)
    rng = random.Random(5)
    base = prose(rng, 150)
    rows = list(enumerate([edited(rng, base, rng.randint(0, 3)) for _ in range(30)], 1))
    got = {r.doc_id: (r.rep_id, r.class_id, r.n_links) for r in jaccard_join.near_duplicates(frame(spark, rows)).collect()}
    assert got == brute.near_duplicates(rows)


def test_one_document_per_group_stays(spark):
    rows = corpus()
    docs = frame(spark, rows).withColumns({"class_id": F.lit("x"), "h1": F.lit(1), "__id": F.lit(0)}).drop("__id")
    kept = jaccard_join.keep_one_per_group(docs)
    assert kept.columns == docs.columns
    want = brute.near_duplicates(rows)
    assert sorted(r.doc_id for r in kept.collect()) == sorted({g for _, g, _ in want.values()})
    twice = frame(spark, [(1, "a b c d e f"), (1, "a b c d e f"), (2, "x"), (None, "y"), (None, "y")])
    assert sorted(str(tuple(r)) for r in jaccard_join.keep_one_per_group(twice).collect()) == ["(1, 'a b c d e f')", "(2, 'x')", "(None, 'y')"]


def test_empty_tables(spark):
    none = frame(spark, [])
    assert jaccard_join.near_duplicates(none).count() == 0
    assert repeats.remove_repeats(none).count() == 0
    assert line_templates.drop_recurring_lines(none).count() == 0
    bench = frame(spark, [(1, "a b")], "item_id long, text string")
    assert decontamination.contamination(none, bench).count() == 0
    full = decontamination.contamination(frame(spark, [(1, "a b")]), bench.limit(0)).collect()
    assert [(r.n_words, r.n_hit, r.item_ids) for r in full] == [(2, 0, [])]


def test_components(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(0, 60)] + [(100 + rng.randrange(30), 100 + rng.randrange(30)) for _ in range(25)] + [(7, 7), (500, 900), (900, 500)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        parent[max(find(a), find(b))] = min(find(a), find(b))
    want = {x: find(x) for a, b in edges if a != b for x in (a, b)}
    got = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == want


def test_prefix_is_shortened_until_the_recall_is_met():
    assert jaccard_join.prefix_depth(0.8, 0.5) == jaccard_join.DEPTH
    d = jaccard_join.prefix_depth(0.8, 0.9999)
    assert 1 - (1 - 0.8**d) ** jaccard_join.TREES >= 0.9999 > 1 - (1 - 0.8 ** (d + 1)) ** jaccard_join.TREES


@pytest.mark.parametrize("length", [20, 100])
def test_repeats_match_brute_force(spark, length):
    rows = corpus(7)
    got = repeats.remove_repeats(frame(spark, rows), length).collect()
    want = brute.repeats(dict(rows), length)
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got} == want
    for r in got:
        assert len(r.kept) == r.n_bytes - r.n_removed and len(r.spans) == r.n_spans


def test_repeats_with_bundles_of_one_key_in_parts(spark):
    rows = corpus(9)
    got = repeats.remove_repeats(frame(spark, rows), 40, bundle_bytes=60).collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got} == brute.repeats(dict(rows), 40)


@pytest.mark.parametrize("hot", [0, 4])
@pytest.mark.parametrize("length", [12, 40, 100])
def test_repeats_with_hot_keys_in_pieces(spark, length, hot):
    rows = corpus(11)
    got = repeats.remove_repeats(frame(spark, rows), length, bundle_bytes=500, hot=hot).collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got} == brute.repeats(dict(rows), length)


def test_no_key_holds_all_stretches_around_a_common_passage():
    rng = random.Random(13)
    passage, n = prose(rng, 40).encode(), 400
    texts = [prose(rng, 30).encode() + b" " + passage + b" " + prose(rng, 30).encode() for _ in range(n)]
    _, keys, _ = repeats.window_keys(*repeats.buffers(pa.array(texts, pa.binary())))
    counted = {}
    for k in keys.tolist():
        counted[k] = counted.get(k, 0) + 1
    hot = [k - (1 << 64) if k >= 1 << 63 else k for k, c in counted.items() if c >= n]

    def held(hot):
        lists = {"repeated": pa.array([[*counted_signed]] * n, pa.list_(pa.int64())), "hot": pa.array([hot] * n, pa.list_(pa.int64()))}
        batch = pa.RecordBatch.from_pydict({"k": pa.array(range(n)), "o": pa.array(range(n)), "th": pa.array([0] * n), "bytes": pa.array(texts, pa.binary()), **lists})
        by_key = {}
        for b in repeats._segments(100, repeats.GRAM)(iter([batch])):
            for r in b.to_pylist():
                if r["seg"] is not None:
                    by_key.setdefault(r["key"], set()).add(r["seg"])
        return max(sum(map(len, segs)) for segs in by_key.values())

    counted_signed = [k - (1 << 64) if k >= 1 << 63 else k for k in counted]
    whole, dealt = held([]), held(hot)
    assert whole > n * 100 and dealt < whole / 8


def test_only_windows_that_repeat_reach_the_suffix_array(monkeypatch):
    rng = random.Random(5)
    shared = prose(rng, 12)[:40]  # shorter than a window
    segs = [f"{prose(rng, 30)[:80]}{shared}{prose(rng, 30)[:80]}".encode() for _ in range(50)]
    segs.append(b"ab" + segs[7][20:160])  # one stretch of 140 bytes again
    n = len(segs)
    piece = pa.RecordBatch.from_arrays(
        [pa.array(c) for c in ([1] * n, [1] * n, range(n), range(n), [0] * n, [0] * n, [len(s) - 99 for s in segs], [False] * n)] + [pa.array(segs, pa.binary())],
        schema=repeats.PIECES)
    held = []
    array = repeats.suffix_array
    monkeypatch.setattr(repeats, "suffix_array", lambda data: held.append(len(data)) or array(data))
    spans = [r for b in repeats._decide(100, 1 << 20)(iter([piece])) for r in b.to_pylist()]
    assert spans == [{"k": 50, "th": 0, "start": 2, "end": 142}]
    assert sum(held) == 2 * 141


def test_repeats_rows_that_share_ids(spark):
    long = "x".join(str(i) for i in range(60))
    rows = [(1, long), (1, long), (None, long), (2, None), (None, None), (1, "other " + long)]
    got = repeats.remove_repeats(frame(spark, rows), 100, with_text=False).collect()
    n = len(long)
    # null ids come first, so that row keeps its text; identical rows share their result
    assert sorted((str(r.doc_id), r.n_bytes, r.n_removed) for r in got) == sorted(
        [("1", n, n), ("1", n, n), ("None", n, 0), ("2", 0, 0), ("None", 0, 0), ("1", n + 6, n)])


def test_line_templates_match_brute_force(spark):
    rng = random.Random(4)
    rows = []
    for i in range(30):
        lines = [prose(rng, rng.randint(0, 8)) for _ in range(4)]
        lines.insert(rng.randrange(4), f"Page {i} of 99 printed by kaba lodo mifi on 2020-01-{i:02d}")
        if i % 3 == 0:
            lines.append("All rights kept by " + rng.choice(["kaba", "lodo", "mifi"]) + " and so on for ever")
        rows.append((i, "\n".join(lines)))
    rows += [(100, None), (101, ""), (102, "\n\n"), (103, "short"), (103, "other 1")]
    docs = frame(spark, rows).withColumn("lines", F.lit(7))
    got = line_templates.drop_recurring_lines(docs)
    assert got.columns == ["doc_id", "text", "lines", "n_lines", "n_dropped"]
    want = brute.line_drops({d: t for d, t in rows if d != 103})
    for r in got.filter("doc_id <> 103").collect():
        lines = dict(rows)[r.doc_id]
        kept = None if lines is None else "\n".join(x for i, x in enumerate(lines.split("\n")) if i not in want.get(r.doc_id, ()))
        assert (r.text, r.n_dropped) == (kept, len(want.get(r.doc_id, ())))
    assert sum(map(len, want.values())) >= 40


def test_line_tree_branches_deeper_when_a_leaf_is_large(spark):
    rows = [(i, f"a b c {x} end of line") for i, x in enumerate(["k", "l", "k", "l", "k", "l", "m", "k"])]
    deep = line_templates.recurring_lines(frame(spark, rows), min_docs=3, leaf_lines=1)
    # one level down k, l and m are leaves of their own: the line of m no longer shares a template
    assert sorted(r.doc_id for r in deep.collect()) == [0, 1, 2, 3, 4, 5, 7]
    flat = line_templates.recurring_lines(frame(spark, rows), min_docs=3)
    assert flat.count() == 8


def leaf_of_many_templates(rng, n):
    """Lines under few (count, first three tokens) nodes, many templates each."""
    words = VOCAB[:6] + ["7", "x8"]
    return [(i, "\n".join(" ".join([rng.choice(["a b c", "a 1 c"]), *(rng.choice(words) for _ in range(rng.choice([1, 2, 3, 5, 7])))]) for _ in range(12))) for i in range(n)]


def test_line_templates_of_a_dealt_leaf_are_those_of_the_whole(spark, monkeypatch):
    monkeypatch.setattr(line_templates, "LOOK_UP", 3)
    rows = leaf_of_many_templates(random.Random(12), 60)
    want = {(d, i) for d, ls in brute.line_drops(dict(rows)).items() for i in ls}
    assert 50 < len(want) < 700
    for spread in (1, 10**9):
        got = line_templates.recurring_lines(frame(spark, rows), spread_lines=spread).collect()
        assert {(r.doc_id, i) for r in got for i in r.lines} == want


def test_line_templates_do_not_depend_on_the_size_of_a_leaf(spark):
    name = lambda i: "".join(chr(97 + int(c)) for c in str(i))
    rows = [(0, "\n".join(f"a b c {name(i)} end of line" for i in range(50_100)))] + [(i, f"a b c q{name(i)} end of line") for i in range(1, 9)]
    got = {r.doc_id: len(r.lines) for r in line_templates.recurring_lines(frame(spark, rows)).collect()}
    assert got == {0: 50_100, **{i: 1 for i in range(1, 9)}}


def test_contamination_spans_and_removal(spark):
    bench = frame(spark, [(1, "one two three four five six seven eight nine ten eleven"), (2, "Short item"), (3, None), (4, "!!"), (5, "solo"), (None, "short item")],
                  "item_id long, text string")
    rows = [(1, "zero ONE two three four five six seven eight nine ten x"), (2, "a short, item! b"), (3, "one two three"), (4, None), (5, ""),
            (6, "solo solo"), (6, "clean words"), (None, "short item")]
    docs = frame(spark, rows).withColumn("spans", F.lit("mine"))
    got = decontamination.contamination(docs, bench)
    assert got.columns == ["doc_id", "text", "spans", "n_words", "n_hit", "hit_spans", "item_ids"]
    by = {(r.doc_id, r.text): (r.n_words, r.n_hit, r.item_ids) for r in got.collect()}
    assert by[1, rows[0][1]] == (12, 10, ["1"])
    assert by[2, rows[1][1]] == (4, 2, ["2"])
    assert by[3, rows[2][1]] == (3, 0, [])
    assert by[4, None] == by[5, ""] == (0, 0, [])
    assert by[6, "solo solo"] == (2, 2, ["5"]) and by[6, "clean words"] == (2, 0, [])
    assert by[None, "short item"] == (2, 2, ["2"])
    kept = decontamination.remove_contaminated(docs, bench)
    assert kept.columns == docs.columns and kept.count() == 4
    cut = {(r.doc_id, r.text) for r in decontamination.remove_spans(docs, bench).collect()}
    assert (1, "zero x") in cut and (2, "a b") in cut and (3, "one two three") in cut and (6, "") in cut


def test_decontamination_without_broadcast_gives_the_same(spark, monkeypatch):
    docs = frame(spark, corpus())
    bench = frame(spark, [(i, t) for i, t in corpus() if i % 9 == 0], "item_id long, text string")
    a = decontamination.contamination(docs, bench).select("doc_id", "n_hit", "item_ids").collect()
    monkeypatch.setattr(decontamination, "BROADCAST_BYTES", 0)
    b = decontamination.contamination(docs, bench).select("doc_id", "n_hit", "item_ids").collect()
    assert sorted(a) == sorted(b) and any(r.n_hit for r in a)
