"""The operators as queries over whole tables, with SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glossaflow.llm import (
    decontamination,
    fill_middle,
    minhash,
    mixing,
    pii,
    preferences,
    quality,
    secrets,
    sharding,
    simhash,
    url_filter,
    warc_zip,
    whitening,
)
from glossaflow.llm.common import cut, prepare, table


RULES = [
    ("block", "net", "/"),
    ("allow", "example.net", "/en/"),
    ("block", "example.com", "/de/"),
    ("allow", "org", "/fr/"),
]


def op1_preference_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """Each conversation is chosen over itself with the last answer of its neighbour (number ^ 1)."""
    turns = table(prepare(spark), folder, "conversations").select(
        F.col("conv_id").alias("pair_id"), F.col("turn").cast("bigint").alias("turn"), "role", "text"
    )
    answers = (
        turns.where("role = 'assistant'")
        .groupBy("pair_id")
        .agg(F.max(F.struct("turn", "text")).alias("last"))
    )
    other = answers.select(F.col("pair_id").bitwiseXOR(F.lit(1)).alias("pair_id"), F.col("last.text").alias("_other"))
    given = answers.join(other, "pair_id").select("pair_id", F.col("last.turn").alias("_at"), "_other")
    rejected = turns.join(given, "pair_id", "left").select(
        "pair_id",
        "turn",
        "role",
        F.when((F.col("role") == "assistant") & (F.col("turn") == F.col("_at")), F.col("_other"))
        .otherwise(F.col("text"))
        .alias("text"),
    )
    return preferences.format_pairs(turns, rejected)


def op2_zip_archives(spark: SparkSession, folder: str) -> DataFrame:
    pages = table(prepare(spark), folder, "pages")
    records = warc_zip.read(warc_zip.write(pages))
    whole = F.col("payload").isNotNull()
    return records.select(
        F.col("page_id").cast("bigint").alias("page_id"),
        F.when(whole, F.octet_length("payload").cast("bigint")).otherwise(F.col("declared_bytes")).alias("payload_bytes"),
        F.when(whole, F.sha2("payload", 256)).otherwise(F.col("declared_digest")).alias("payload_digest"),
        "record_type",
        F.col("refers_to").cast("bigint").alias("refers_to"),
    )


def op3_simhash_pivots(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(prepare(spark), folder, "documents")
    return simhash.near_duplicates(docs).select(
        "doc_id", simhash.fingerprint_hex(F.col("fp")).alias("fingerprint"), "component_id"
    )


def op4_assignment_secrets(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(prepare(spark), folder, "documents")
    return docs.select("doc_id", secrets.scan(F.col("text")).alias("s")).select(
        "doc_id", "s.n_assign", "s.n_access", "s.n_hex", F.sha2("s.base", 256).alias("base_sha256"), "s.spans"
    )


def op5_hypergeometric_shards(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(prepare(spark), folder, "documents")
    text = F.col("text")
    rows = docs.select("doc_id", sharding.size_of(text).alias("size"), sharding.crc_of(text).alias("text_crc32"))
    return sharding.shuffle_into(rows, 24).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op6_boosted_pii(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(prepare(spark), folder, "documents")
    found = pii.spans(docs)
    base = F.filter("spans", lambda s: s["kind"] < len(pii.BASE))
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("bigint")
    return found.select(
        "doc_id",
        *[count(k).alias(f"n_{kind}") for k, kind in enumerate(pii.BASE)],
        F.sha2(pii.said(base), 256).alias("base_sha256"),
        pii.said(F.col("spans")).alias("spans"),
    )


def op7_sorted_digests(spark: SparkSession, folder: str) -> DataFrame:
    pages = table(prepare(spark), folder, "pages")
    return url_filter.judge(pages, RULES).select("page_id", "host", "path", "rule", "verdict")


def op8_robust_quality(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(prepare(spark), folder, "documents")
    counted = cut(
        docs.select("doc_id", "lang", "source", quality.text_counts(F.col("text")).alias("counts")),
        "counts",
    )
    by = ["lang", "source"]
    rows = quality.judged(counted, quality.fitted(counted, by, "counts"), by, "counts")
    shown = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    return rows.select("doc_id", *[F.col(f"counts.{c}") for c in shown], "base_failed", "kept")


def op9_broadcast_ngrams(spark: SparkSession, folder: str) -> DataFrame:
    docs, items = (table(prepare(spark), folder, name) for name in ("documents", "benchmark"))
    return decontamination.judged(docs, items).select(
        "doc_id",
        "n_words",
        "n_hit",
        "n_items",
        F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"),
        "contaminated",
    )


def op10_source_mixing(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(prepare(spark), folder, "documents")
    sized = cut(
        docs.select(
            "doc_id", "source", mixing.key_of("doc_id", "text").alias("key"), mixing.n_words(F.col("text")).alias("size")
        ),
        "sizes",
    )
    found = mixing.rates(sized, "source", "size").withColumnRenamed("source", "_source")
    taken = mixing.copies(F.col("key"), F.col("rate")) * F.col("size")
    return sized.join(found, F.col("source").eqNullSafe(F.col("_source"))).select(
        "doc_id", "size", "source_size", "target", taken.cast("bigint").alias("taken")
    )


def op11_fill_in_middle(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(prepare(spark), folder, "documents").select("doc_id", "text")
    digest = lambda text: F.sha2(text.cast("binary"), 256)
    return fill_middle.transform(docs).select(
        "doc_id",
        "n",
        "form",
        "prefix_chars",
        "middle_chars",
        digest(F.col("output")).alias("output_sha256"),
        digest(fill_middle.restored(F.col("output"), F.col("form"))).alias("restored_sha256"),
    )


def op12_minhash_postings(spark: SparkSession, folder: str) -> DataFrame:
    return minhash.near_duplicates(table(prepare(spark), folder, "documents"))


def op13_whitened_embeddings(spark: SparkSession, folder: str) -> DataFrame:
    rows = whitening.whiten(table(prepare(spark), folder, "embeddings"))
    return rows.withColumn("deviation", F.col("deviation").cast("bigint"))


OP1_SQL = r"""
WITH t AS (SELECT conv_id AS pair_id, CAST(turn AS BIGINT) AS turn, coalesce(role, '') AS role, coalesce(text, '') AS text
           FROM conversations WHERE conv_id IS NOT NULL),
     a AS (SELECT pair_id, max(turn) AS at_turn, arg_max(text, turn) AS last FROM t WHERE role = 'assistant' GROUP BY pair_id),
     g AS (SELECT a.pair_id, a.at_turn, o.last AS other FROM a JOIN a o ON o.pair_id = xor(a.pair_id, 1)),
     j AS (SELECT t.pair_id, turn, role, text AS c, CASE WHEN role = 'assistant' AND turn = at_turn THEN other ELSE text END AS r
           FROM t LEFT JOIN g USING (pair_id)),
     f AS (SELECT pair_id, coalesce(min(turn) FILTER (WHERE c <> r), 1000000) AS broken FROM j GROUP BY pair_id),
     s AS (SELECT j.*, broken, length(role) + 5 AS head, '<|' || role || '|>' || chr(10) || c || '<|end|>' || chr(10) AS cr,
                  '<|' || role || '|>' || chr(10) || r || '<|end|>' || chr(10) AS rr FROM j JOIN f USING (pair_id)),
     k AS (SELECT *, sum(length(cr)) OVER w AS ce, sum(length(rr)) OVER w AS re FROM s WHERE turn >= broken
           WINDOW w AS (PARTITION BY pair_id ORDER BY turn)),
     m AS (SELECT pair_id, string_agg((ce - length(cr) + head) || ':' || ce, ',' ORDER BY turn) AS chosen_mask,
                  string_agg((re - length(rr) + head) || ':' || re, ',' ORDER BY turn) AS rejected_mask
           FROM k WHERE role = 'assistant' GROUP BY pair_id)
SELECT pair_id, CAST(0 AS BIGINT) AS part, CAST(count(*) FILTER (WHERE turn < broken) AS INTEGER) AS n_prompt_turns,
       coalesce(string_agg(cr, '' ORDER BY turn) FILTER (WHERE turn < broken), '') AS prompt,
       coalesce(string_agg(cr, '' ORDER BY turn) FILTER (WHERE turn >= broken), '') AS chosen,
       coalesce(any_value(chosen_mask), '') AS chosen_mask,
       coalesce(string_agg(rr, '' ORDER BY turn) FILTER (WHERE turn >= broken), '') AS rejected,
       coalesce(any_value(rejected_mask), '') AS rejected_mask
FROM s LEFT JOIN m USING (pair_id) GROUP BY pair_id"""

OP2_SQL = """
SELECT page_id, CAST(strlen(h) AS BIGINT) AS payload_bytes, sha256(h) AS payload_digest,
       CASE WHEN strlen(h) >= 100 AND first <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN strlen(h) >= 100 AND first <> page_id THEN first END AS refers_to
FROM (SELECT page_id, h, min(page_id) OVER (PARTITION BY h) AS first
      FROM (SELECT page_id, coalesce(html, '') AS h FROM pages))"""

OP7_SQL = r"""
WITH rules(verdict, host, path) AS (VALUES ('block', 'net', '/'), ('allow', 'example.net', '/en/'),
                                           ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')),
     p AS (SELECT row_number() OVER () AS n, page_id,
                  translate(regexp_extract(coalesce(url, ''), '(?s)://([^/?#]*)', 1),
                            'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                  regexp_extract(coalesce(url, ''), '(?s)://[^/?#]*([^?#]*)', 1) AS path FROM pages),
     m AS (SELECT n, arg_max(r.host || r.path, length(r.host || r.path)) AS rule, arg_max(verdict, length(r.host || r.path)) AS verdict
           FROM p JOIN rules r ON (p.host = r.host OR ends_with(p.host, '.' || r.host)) AND starts_with(p.path, r.path) GROUP BY n)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM p LEFT JOIN m USING (n)"""

OP9_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id,
                  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                     '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
           FROM documents),
     b AS (SELECT item_id,
                  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                     '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
           FROM benchmark),
     g AS (SELECT item_id, least(len(w), 10) AS n, w[i:i + least(len(w), 10) - 1] AS win
           FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
     lengths AS (SELECT DISTINCT n FROM g),
     dw AS (SELECT r, i, n, w[i:i + n - 1] AS win
            FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d CROSS JOIN lengths WHERE len(w) >= n)),
     hit AS (SELECT dw.r, dw.i, dw.n, g.item_id FROM dw JOIN g ON dw.n = g.n AND dw.win = g.win),
     marked AS (SELECT r, count(DISTINCT p) AS n_hit
                FROM (SELECT r, unnest(range(i, i + n)) AS p FROM hit) GROUP BY r),
     named AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
               FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS item FROM hit WHERE item_id IS NOT NULL) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN marked USING (r) LEFT JOIN named USING (r)"""

OP11_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n,
                  sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
     r AS (SELECT *, CAST('0x' || h[1:8] AS BIGINT) AS h1, CAST('0x' || h[9:16] AS BIGINT) AS h2,
                  CAST('0x' || h[17:24] AS BIGINT) AS h3, CAST('0x' || h[25:32] AS BIGINT) AS h4 FROM d),
     c AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
                  CASE WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain'
                       WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM r),
     p AS (SELECT *, substr(t, 1, a) AS pre, substr(t, a + 1, b - a) AS mid, substr(t, b + 1) AS suf FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
       sha256(CASE form WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid
                        WHEN 'spm' THEN '<S>' || suf || '<P>' || pre || '<M>' || mid ELSE t END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM p"""

OP12_SQL = r"""
WITH RECURSIVE w AS (SELECT row_number() OVER () AS r, doc_id,
                  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                     '[^\x20\x09-\x0D]+') AS w FROM documents),
     g AS (SELECT r, doc_id, CASE WHEN len(w) < 2 THEN w ELSE list_sort(list_distinct([w[i] || ' ' || w[i + 1] for i in range(1, len(w))])) END AS g FROM w),
     k AS (SELECT g, row_number() OVER () AS k, len(g) AS n, min(doc_id) AS first FROM g WHERE len(g) > 0 GROUP BY g),
     s AS (SELECT k, n, hash(x) AS x FROM (SELECT k, n, unnest(g) AS x FROM k)),
     l AS (SELECT a.k AS a, b.k AS b FROM s a JOIN s b ON a.x = b.x AND a.k < b.k AND least(a.n, b.n) * 100 >= greatest(a.n, b.n) * 80
           GROUP BY a.k, b.k, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
     e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
     reach(a, b) AS (SELECT a, b FROM e UNION SELECT reach.a, e.b FROM reach JOIN e ON reach.b = e.a),
     c AS (SELECT k.k, least(k.first, (SELECT min(o.first) FROM reach JOIN k o ON o.k = reach.b WHERE reach.a = k.k)) AS c FROM k)
SELECT doc_id, CAST(len(g.g) AS BIGINT) AS n_shingles, CASE WHEN len(g.g) = 0 THEN doc_id ELSE c END AS component_id,
       doc_id IS NOT DISTINCT FROM (CASE WHEN len(g.g) = 0 THEN doc_id ELSE c END) AS kept
FROM g LEFT JOIN k ON k.g = g.g LEFT JOIN c USING (k)"""

QUERIES = {
    q.__name__: q
    for q in (
        op1_preference_pairs,
        op2_zip_archives,
        op3_simhash_pivots,
        op4_assignment_secrets,
        op5_hypergeometric_shards,
        op6_boosted_pii,
        op7_sorted_digests,
        op8_robust_quality,
        op9_broadcast_ngrams,
        op10_source_mixing,
        op11_fill_in_middle,
        op12_minhash_postings,
        op13_whitened_embeddings,
    )
}
ORACLES: dict[str, str] = {
    "op1_preference_pairs": OP1_SQL,
    "op2_zip_archives": OP2_SQL,
    "op7_sorted_digests": OP7_SQL,
    "op9_broadcast_ngrams": OP9_SQL,
    "op11_fill_in_middle": OP11_SQL,
    "op12_minhash_postings": OP12_SQL,
}
