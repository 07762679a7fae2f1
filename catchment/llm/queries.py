"""The registered queries of this subpackage, one per operator, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    binary_search, bpe, decontamination, jaccard_join, language_model, line_templates, merkle, mixing, ranked_search, repeats, sharding, toxicity,
    warc)
from .common import fresh_dir, land, small_batches, table

SHARDS = 24
TOP_K = 10


def op1_mih_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes = binary_search.sign_code(table(spark, sf_dir, "embeddings"))
    found = binary_search.top_k(codes, codes.filter(F.col("id") % 50 == 0), TOP_K)
    return found.withColumnRenamed("id", "vec_id")


def op2_histogram_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    crc = F.crc32(F.coalesce("text", F.lit("")).cast("binary")).cast("long")
    placed = sharding.assign_shards(docs.withColumn("text_crc32", crc), SHARDS)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"), with_text=False)


def op4_minhash_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = jaccard_join.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "rep_id", "class_id", "n_links")


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_dir(spark, "warc")
    warc.write_archives(table(spark, sf_dir, "pages").select("page_id", "url", "html"), path)
    records = warc.read_archives(spark, path).filter(F.col("warc_type").isin("response", "revisit"))
    whole = F.col("payload").isNotNull()
    return records.select(
        "page_id",
        F.when(whole, F.octet_length("payload").cast("long")).otherwise(F.col("payload_length")).alias("payload_bytes"),
        F.when(whole, warc.sha1_base32(F.col("payload"))).otherwise(F.col("payload_digest")).alias("payload_digest"),
        F.col("warc_type").alias("record_type"), "refers_to")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = toxicity.score_documents(docs, table(spark, sf_dir, "labels"))
    return scored.select(
        "doc_id", (toxicity.fold("doc_id", 4) == 2).alias("held_out"), F.col("tox_score").alias("score"),
        (F.col("tox_score") >= 0.3).cast("int").alias("predicted"))


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontamination.contamination(docs, table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "item_ids"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op8_line_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_templates.drop_recurring_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


def op9_pfair_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    return mixing.mix(docs)


def op10_maxent_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_model.score_documents(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(*merkle.FIELDS)
    rows = merkle.manifest(docs, extra={"tampered": merkle.tampered_leaf()})
    return rows.select(
        "doc_id", "leaf", "subroot", "root", merkle.proof_hash(F.col("path")).alias("proof_sha256"),
        merkle.fold(F.coalesce("tampered", "leaf"), F.col("path")).alias("folded_root"),
    ).withColumn("verified", F.col("folded_root") == F.col("root"))


def op12_word_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = public_tokenizers.path("word_bpe_49k.json")
    with small_batches(spark):
        texts = bpe.decode(bpe.encode(table(spark, sf_dir, "documents").select("doc_id", "text"), path), path)
        return land(texts.select(
            "doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"),
            F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256")))


def op13_reversed_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search.search(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (
        op1_mih_topk, op2_histogram_shards, op3_suffix_dedup, op4_minhash_forest, op5_warc, op6_toxicity, op7_decontaminate,
        op8_line_templates, op9_pfair_mix, op10_maxent_lm, op11_merkle_manifest, op12_word_bpe, op13_reversed_search)
}

_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

_CHUNKS = " || ".join(
    f"substr('{warc.BASE32}', (('0x' || substr(h, {5 * i + 1}, 5))::INTEGER // {32 ** (3 - j)}) % 32 + 1, 1)" for i in range(8) for j in range(4))

_TERMS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"


def _crc32_sql(text: str) -> str:
    """Unsigned CRC-32 of an ASCII text, over the column ``crc`` (see ``_CRC_TABLE``)."""
    step = "xor(c >> 8, crc[xor(c & 255, b) + 1])"
    return f"xor(list_reduce([CAST(ord(x) AS BIGINT) for x in string_split({text}, '')], lambda c, b: {step}, CAST(4294967295 AS BIGINT)), 4294967295)"


_CRC_TABLE = "SELECT i, CAST(i AS BIGINT) AS v FROM range(256) r(i)"
for _ in range(8):
    _CRC_TABLE = f"SELECT i, CASE WHEN v % 2 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END AS v FROM ({_CRC_TABLE})"


def _merkle_sql(levels: int = 8) -> str:
    """Groups of up to 16**levels rows, and as many groups: each level gathers the runs of the one below."""
    def field(c: str) -> str:
        return f"CASE WHEN {c} IS NULL THEN '-' ELSE strlen(CAST({c} AS VARCHAR)) || ':' || {c} END"

    low = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    leaf = "sha256(" + " || ".join(field(c) for c in merkle.FIELDS) + ")"
    bad = "sha256(" + " || ".join(field(low if c == "text" else c) for c in merkle.FIELDS) + ")"
    fold = "list_reduce(p, lambda node, s: sha256(s.l || node || s.r), {})"

    def tree(name: str, leaves: str) -> str:
        """Levels n0 (g, pos, cnt, h), n1, ...; then paths q<i> (g, pos, p), p without its first entry being the top's."""
        out = [f"{name}0 AS ({leaves})"]
        for i in range(levels):
            out.append(
                f"{name}{i + 1} AS (SELECT g, pos // 16 AS pos, (cnt + 15) // 16 AS cnt, list(h ORDER BY pos) AS kids, "
                f"sha256(string_agg(h, '' ORDER BY pos)) AS h FROM {name}{i} WHERE cnt > 1 GROUP BY g, pos // 16, cnt)")
        out.append(f"{name}q{levels} AS (SELECT g, pos, [{{'l': '', 'r': ''}}][2:] AS p FROM {name}{levels})")
        for i in reversed(range(levels)):
            out.append(
                f"{name}q{i} AS (SELECT n.g, n.pos, CASE WHEN n.cnt = 1 THEN [{{'l': '', 'r': ''}}][2:] ELSE list_concat([{{'l': array_to_string(k.kids[1:n.pos % 16], ''), "
                f"'r': array_to_string(k.kids[n.pos % 16 + 2:], '')}}], q.p) END AS p FROM {name}{i} n "
                f"LEFT JOIN {name}{i + 1} k ON k.g = n.g AND k.pos = n.pos // 16 AND n.cnt > 1 "
                f"LEFT JOIN {name}q{i + 1} q ON q.g = n.g AND q.pos = n.pos // 16 AND n.cnt > 1)")
        top = " UNION ALL ".join(f"SELECT g, h FROM {name}{i} WHERE cnt = 1" for i in range(levels + 1))
        return ", ".join([*out, f"{name}top AS ({top})"])

    return f"""
        WITH crc AS (SELECT list(v ORDER BY i) AS crc FROM ({_CRC_TABLE})),
        d AS (SELECT doc_id, source, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS g, {leaf} AS h, {bad} AS bad FROM documents),
        r AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, h) - 1 AS pos, count(*) OVER (PARTITION BY g) AS cnt FROM d),
        {tree("n", "SELECT g, pos, cnt, h FROM r")},
        {tree("m", "SELECT 0 AS g, g AS pos, count(*) OVER () AS cnt, h FROM ntop")},
        f AS (SELECT r.doc_id, r.h AS leaf, t.h AS subroot, mt.h AS root, list_concat(a.p, b.p) AS p,
                     CASE WHEN {_crc32_sql("CAST(r.doc_id AS VARCHAR)")} % 5 = 0 THEN bad ELSE r.h END AS start
              FROM r JOIN nq0 a ON a.g = r.g AND a.pos = r.pos JOIN ntop t ON t.g = r.g JOIN mq0 b ON b.pos = r.g CROSS JOIN mtop mt CROSS JOIN crc)
        SELECT doc_id, leaf, subroot, root, sha256(array_to_string([s.l || s.r for s in p], '')) AS proof_sha256,
               {fold.format("start")} AS folded_root, {fold.format("start")} = root AS verified FROM f"""


ORACLE_SQL: dict[str, str] = {
    "op11_merkle_manifest": _merkle_sql(),
    "op13_reversed_search": f"""
        WITH d AS (SELECT row_number() OVER () AS row, doc_id, {_TERMS} AS ts FROM documents WHERE text IS NOT NULL),
        n AS (SELECT row, doc_id, CAST(len(ts) AS BIGINT) AS n, ts FROM d WHERE len(ts) > 0),
        s AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS total FROM n),
        b AS (SELECT row_number() OVER () AS item, item_id, ts FROM (SELECT DISTINCT item_id, {_TERMS} AS ts, text FROM benchmark WHERE text IS NOT NULL)),
        bt AS (SELECT item, item_id, t, count(*) AS times FROM (SELECT item, item_id, unnest(ts) AS t FROM b) GROUP BY ALL),
        dt AS (SELECT row, t, count(*) AS tf FROM (SELECT row, unnest(ts) AS t FROM n) WHERE t IN (SELECT t FROM bt) GROUP BY ALL),
        w AS (SELECT t, CAST(floor(1000 * ln((2.0::DOUBLE * docs + 2) / (2 * df + 1))) AS BIGINT) AS w FROM (SELECT t, count(*) AS df FROM dt GROUP BY t), s),
        sc AS (SELECT item, item_id, doc_id, row, sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * docs) // total)))) AS score
               FROM bt JOIN w USING (t) JOIN dt USING (t) JOIN n USING (row), s GROUP BY ALL),
        r AS (SELECT *, row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id) AS rank FROM sc WHERE score > 0)
        SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, CAST(score AS BIGINT) AS score FROM r WHERE rank <= 20""",
    "op1_mih_topk": f"""
        WITH e AS (SELECT vec_id, [CASE WHEN x > 0 THEN 1 ELSE 0 END for x in embedding] AS b FROM embeddings WHERE embedding IS NOT NULL),
        q AS (SELECT DISTINCT vec_id, b FROM e WHERE vec_id % 50 = 0),
        p AS (SELECT q.vec_id AS query_id, e.vec_id, q.b AS qb,
                     CAST(list_sum([CASE WHEN z[1] = z[2] THEN 0 ELSE 1 END for z in list_zip(q.b, e.b)]) AS INTEGER) AS distance FROM q, e)
        SELECT query_id, CAST(rn AS INTEGER) AS rank, vec_id, distance
        FROM (SELECT *, row_number() OVER (PARTITION BY query_id, qb ORDER BY distance, vec_id) AS rn FROM p) WHERE rn <= {TOP_K}""",
    "op5_warc": f"""
        WITH p AS (SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS n, sha1(coalesce(html, '')) AS h FROM pages),
        t AS (SELECT *, max(page_id) OVER (PARTITION BY h, n) AS top FROM p)
        SELECT page_id, n AS payload_bytes, {_CHUNKS} AS payload_digest,
               CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> top THEN top END AS refers_to
        FROM t""",
    "op7_decontaminate": f"""
        WITH d AS (SELECT doc_id, {_WORDS} AS ws FROM documents),
        b AS (SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS} AS ws FROM benchmark),
        bw AS (SELECT DISTINCT item, least(len(ws), 10) AS l, ws[i : i + least(len(ws), 10) - 1] AS w
               FROM (SELECT item, ws, unnest(range(1, len(ws) - least(len(ws), 10) + 2)) AS i FROM b WHERE len(ws) > 0)),
        lens AS (SELECT DISTINCT l FROM bw),
        dw AS (SELECT doc_id, l, unnest(range(1, len(ws) - l + 2)) AS i, ws FROM d, lens WHERE len(ws) >= l),
        h AS (SELECT doc_id, i, dw.l, item FROM (SELECT doc_id, l, i, ws[i : i + l - 1] AS w FROM dw) dw JOIN bw ON dw.l = bw.l AND dw.w = bw.w),
        words AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + l)) AS p FROM h) GROUP BY doc_id),
        items AS (SELECT doc_id, count(DISTINCT item) AS n, string_agg(DISTINCT item, ',' ORDER BY item) AS s FROM h GROUP BY doc_id)
        SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(words.n, 0) AS n_hit, coalesce(items.n, 0) AS n_items,
               sha256(coalesce(items.s, '')) AS items_sha256, coalesce(words.n, 0) > 0 AS contaminated
        FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)""",
}
