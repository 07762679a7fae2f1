"""Merkle manifest, byte-pair encoding and reversed search against brute force."""
import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from catchment.llm import bpe, merkle, ranked_search
from catchment.llm.queries import op12_word_bpe

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, source string, lang string, n_chars int, text string"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# ---------------------------------------------------------------- Merkle manifest

def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def brute_tree(nodes):
    paths, at, cur = [[] for _ in nodes], list(range(len(nodes))), list(nodes)
    while len(cur) > 1:
        for i, k in enumerate(at):
            run = cur[k // 16 * 16 : k // 16 * 16 + 16]
            paths[i].append(("".join(run[: k % 16]), "".join(run[k % 16 + 1 :])))
            at[i] = k // 16
        cur = [sha("".join(cur[i : i + 16])) for i in range(0, len(cur), 16)]
    return cur[0], paths


def brute_manifest(rows):
    groups = {}
    for r in rows:
        groups.setdefault(r[1], []).append(r)
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees, out = [], []
    for s in order:
        members = sorted(((r[0] is not None, r[0] or 0, sha("".join(map(field, r))), r) for r in groups[s]), key=lambda x: x[:3])
        trees.append((members, *brute_tree([m[2] for m in members])))
    root, upper = brute_tree([t[1] for t in trees])
    for (members, sub, paths), rest in zip(trees, upper):
        for (_, _, leaf, r), path in zip(members, paths):
            node = leaf
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0 and r[4] is not None:
                node = sha("".join(map(field, (*r[:4], re.sub("[A-Z]", lambda m: m[0].lower(), r[4])))))
            for a, b in path + rest:
                node = sha(a + node + b)
            out.append((r[0], leaf, sub, root, sha("".join(a + b for a, b in path + rest)), node, node == root))
    return out


def spark_manifest(df):
    m = merkle.manifest(df, extra={"tampered": merkle.tampered_leaf()})
    m = m.select("doc_id", "leaf", "subroot", "root", merkle.proof_hash(F.col("path")), merkle.fold(F.coalesce("tampered", "leaf"), F.col("path")).alias("f"))
    return [tuple(r) for r in m.withColumn("ok", F.col("f") == F.col("root")).collect()]


def key(rows):
    return sorted(rows, key=repr)


def test_manifest_equals_brute_force(spark):
    rng = random.Random(4)
    rows = [(i, rng.choice(["hot", "hot", "hot", "a", "Ä", "z z", None]), rng.choice(["en", None]), rng.choice([3, None]),
             rng.choice(["", None, "Some Text %d" % i, "ÄB\x00c" * rng.randint(1, 30)])) for i in range(900)]
    rows += [(i, "alone%d" % i, "en", 1, "X") for i in range(5)] + [(None, "a", None, None, None), (7, "a", "en", 1, "B"), (7, "a", "en", 1, "A")]
    df = spark.createDataFrame(rows, SCHEMA).repartition(7)
    got = spark_manifest(df)
    assert key(got) == key(brute_manifest(rows))
    assert {r[6] for r in got} == {True, False}


def test_manifest_of_repeated_rows_other_columns_and_nothing(spark):
    rows = [(1, "s", "en", 3, "Abc")] * 40 + [(2, None, None, None, "x" * 200_000)]
    df = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("clash") for c in ("g", "pos", "cnt", "digest", "path", "leaf", "root", "run", "slot")})
    assert key(spark_manifest(df)) == key(brute_manifest(rows))
    assert spark_manifest(spark.createDataFrame([], SCHEMA)) == []
    one = [(5, "s", "en", 3, "Abc")]
    got = spark_manifest(spark.createDataFrame(one, SCHEMA))
    assert key(got) == key(brute_manifest(one)) and got[0][1] == got[0][2] == got[0][3]


# ---------------------------------------------------------------- byte-pair encoding

@pytest.fixture(scope="module")
def library():
    tokenizers = pytest.importorskip("tokenizers")
    path = pytest.importorskip("public_tokenizers").path("word_bpe_49k.json")
    return path, tokenizers.Tokenizer.from_file(path)


def same(encoder, tokenizer, texts):
    got = encoder(texts)
    want = tokenizer.encode_batch(texts, add_special_tokens=False)
    for t, g, w in zip(texts, got, want):
        assert g.tolist() == w.ids, ascii(t)


def test_encoder_equals_the_library(library):
    path, tokenizer = library
    encoder = bpe.Encoder(bpe.WordBpe(path))
    rng = random.Random(3)
    points = [chr(c) for c in range(0x3100)]
    everywhere = [chr(c) for c in range(0x3000, 0x110000, 7) if not 0xD800 <= c < 0xE000]
    same(encoder, tokenizer, [f"a{c}b {c}1{c}" for c in points + everywhere])
    same(encoder, tokenizer, ["".join(rng.choice(points) for _ in range(rng.randint(1, 40))) for _ in range(3000)])
    same(encoder, tokenizer, ["".join(rng.choice("aabh!'s ") for _ in range(rng.randint(1, 80))) for _ in range(3000)])
    same(encoder, tokenizer, ["", " ", "x<|endoftext|>Y <|startoftext|><|ENDOFTEXT|>''s", "ΟΔΟΣ İ", "é", "a" * 5000, "ab" * 4000, "9" * 300, "퟿"])


def test_a_full_cache_starts_anew(library, monkeypatch):
    path, tokenizer = library
    monkeypatch.setattr(bpe, "WORD_CACHE", 10)
    encoder = bpe.Encoder(bpe.WordBpe(path))
    for i in range(5):
        same(encoder, tokenizer, [f"word{chr(97 + j)} {chr(97 + i)}{j} <|endoftext|> again" for j in range(20)])


def test_merges_whose_product_has_a_lower_pair_go_one_by_one(tmp_path, library):
    """A table in which (a, bc) makes `abc` late, while (abc, a) ranks early: places merged at once would differ."""
    import json
    from tokenizers import Tokenizer

    spec = json.load(open(library[0], encoding="utf-8"))
    merges = [["b", "c"], ["abc", "a"], ["a", "bc"], ["abca", "bc"]]
    vocab = {t: i for t, i in spec["model"]["vocab"].items() if i < 512}
    for t in ("bc", "abc", "abca", "abcabc", "bc</w>", "abc</w>"):
        vocab[t] = len(vocab)
    spec["model"].update(vocab=vocab, merges=merges)
    for i, t in enumerate(spec["added_tokens"]):
        t["id"] = len(vocab) + i
    path = str(tmp_path / "own.json")
    json.dump(spec, open(path, "w", encoding="utf-8"))
    table = bpe.WordBpe(path)
    assert table.alone.any()
    rng = random.Random(8)
    same(bpe.Encoder(table), Tokenizer.from_file(path), ["".join(rng.choice(["abc", "a", "bc", "b"]) for _ in range(rng.randint(1, 9))) for _ in range(2000)])


def test_query_equals_the_library(spark, library):
    _, tokenizer = library
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    got = {r.doc_id: r for r in op12_word_bpe(spark, SF).collect()}
    assert len(got) == len(docs)
    for d in docs:
        ids = tokenizer.encode(d.text or "", add_special_tokens=False).ids
        r = got[d.doc_id]
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == sha(tokenizer.decode(ids, skip_special_tokens=False))


def test_encoding_of_nulls_long_texts_repeats_and_nothing(spark, library):
    path, tokenizer = library
    rows = [(1, None), (1, None), (None, ""), (2, "Hello  World's " * 50_000), (3, "<|endoftext|>")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"ids": F.lit(1), "id": F.lit(2)})
    out = bpe.decode(bpe.encode(df, path), path).collect()
    assert len(out) == 5
    for r in out:
        text = dict(rows)[r.doc_id] or ""
        want = tokenizer.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(r.ids, "<u4").tolist() == want and r.text == tokenizer.decode(want, skip_special_tokens=False)
    assert bpe.encode(df.limit(0), path).count() == 0


# ---------------------------------------------------------------- reversed search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute_search(docs, items, k):
    held = [(i, Counter(terms(t))) for i, t in docs if terms(t)]
    n, total = len(held), sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    out = []
    for item, text in dict.fromkeys(items):
        found = []
        for i, c in held:
            m, s = 75 + 25 * sum(c.values()) * n // total, 0
            for t in terms(text):
                if c[t]:
                    s += math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 12 * m))
            if s > 0:
                found.append((-s, i is None, i or 0, i))
        out += [(item, rank, i, -s) for rank, (s, _, _, i) in enumerate(sorted(found)[:k], 1)]
    return out


def both(spark, docs, items, k):
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(5).withColumns({c: F.lit(0) for c in ("n", "terms", "score", "rank", "item")})
    b = spark.createDataFrame(items, "item_id string, text string").withColumn("item", F.lit("x"))
    got = [tuple(r) for r in ranked_search.search(d, b, k).collect()]
    assert key(got) == key(brute_search(docs, items, k))
    return got


def test_search_equals_brute_force(spark, monkeypatch):
    rng = random.Random(5)
    words = ["common", "Der", "naïve", "x1", "Ω", *("w%d" % i for i in range(60))]
    text = lambda n: " ".join(rng.choice(words[: rng.choice([5, 65])]) for _ in range(n))
    docs = [(i, text(rng.choice([1, 5, 40]))) for i in range(400)] + [(900 + i, "common w1 common") for i in range(60)]
    docs += [(None, "w1 w2"), (None, None), (1000, ""), (1001, "--- !!"), (5, "common w1 common"), (5, "common w1 common"), (2000, "common w3 " * 20_000)]
    items = [(str(i), text(6)) for i in range(30)] + [("again", "common common w1"), ("again", "common common w1"), ("again", "w2"), (None, "w5"), ("n", None), ("e", "?"), ("none", "zzz")]
    first = both(spark, docs, items, 20)
    monkeypatch.setattr(ranked_search, "BLOCK_ITEMS", 4)  # many blocks, small work arrays
    monkeypatch.setattr(ranked_search, "CELLS", 16)
    assert key(both(spark, docs, items, 20)) == key(first)


def test_search_of_nothing(spark):
    assert both(spark, [], [("a", "b")], 3) == [] and both(spark, [(1, "b")], [], 3) == []
    assert both(spark, [(1, None)], [("a", "b")], 3) == []


def test_manifest_result_holds_one_level_of_siblings(spark):
    """Paths above the leaves are landed, so the result's plan doesn't hold the windows of every level."""
    docs = spark.range(5000).select(F.col("id").alias("doc_id"), F.lit("s").alias("source"), F.lit("en").alias("lang"), F.lit(1).alias("n_chars"),
                                    F.col("id").cast("string").alias("text"))
    plan = merkle.manifest(docs)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Window [") <= 4  # 7 with every level in it
