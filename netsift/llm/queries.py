"""The queries of this subpackage and their SQL twins."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netsift.llm import bpe, exact_dedup, factorization, line_dedup, line_rules, packing, resampling, sharding, simhash, string_kernel, topk, warc, whitening
from netsift.llm.common import LOWER, UPPER, table

TOKENIZERS = os.environ.get("TOKENIZERS_DIR", "/opt/tokenizers")  # the folder of the public vocabulary files

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


@query("op1_quality")
def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return factorization.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), threshold=0.3)


@query("op2_top_k", """
    WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
               WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    s AS (SELECT q.vec_id AS query_id, c.vec_id,
                 CAST(list_sum(list_transform(range(1, len(c.v) + 1), lambda i: q.v[i] * c.v[i])) AS BIGINT) AS score
          FROM v q JOIN v c ON q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id)
    SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
    FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 20""")
def op2_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(topk.quantised(table(spark, sf_dir, "embeddings")), F.col("vec_id") % 20 == 0, k=20)


@query("op4_exact_dedup", f"""
    WITH d AS (SELECT doc_id, sha256(translate(coalesce(text, ''), '{UPPER}', '{LOWER}')) AS text_sha256 FROM documents)
    SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
           doc_id = max(doc_id) OVER g AS kept, text_sha256
    FROM d WINDOW g AS (PARTITION BY text_sha256)""")
def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(table(spark, sf_dir, "documents"))


@query("op6_sharding")
def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.sharded(table(spark, sf_dir, "documents"), shards=8)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
                         F.col("position").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), F.col("slot").alias("virtual_slot"))


@query("op5_simhash")
def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"), radius=4, words=4)
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


@query("op8_bpe")
def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"), f"{TOKENIZERS}/word_bpe_49k.json")


@query("op3_packing")
def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(table(spark, sf_dir, "documents"), f"{TOKENIZERS}/byte_bpe_50k.json", capacity=1024)


@query("op7_warc", """
    WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages),
    g AS (SELECT *, min(page_id) OVER (PARTITION BY h) AS least FROM p)
    SELECT page_id, strlen(html) AS payload_bytes,
           list_aggregate(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
               ((CAST('0x' || substr(h, CAST(5 * (i // 4) + 1 AS BIGINT), 5) AS BIGINT) >> CAST(15 - 5 * (i % 4) AS BIGINT)) & 31) + 1, 1)), 'string_agg', '') AS payload_digest,
           CASE WHEN page_id = least THEN 'response' ELSE 'revisit' END AS record_type,
           CASE WHEN page_id <> least THEN least END AS refers_to
    FROM g""")
def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archived(table(spark, sf_dir, "pages"), least_bytes=0).drop("url")


@query("op9_toxicity")
def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return string_kernel.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), threshold=0.3)


@query("op10_line_dedup")
def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("bytes_before"))
    left = line_dedup.without_repeats(docs)
    return left.withColumn("bytes_after", F.octet_length(F.coalesce("text", F.lit(""))).cast("long"))


@query("op11_whitening")
def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = whitening.whitened(table(spark, sf_dir, "embeddings"), components=8, scale=1024, shift=100_000)
    return found.withColumn("deviation", F.col("deviation").cast("long"))  # an error where a long does not hold it


@query("op12_line_rules", f"""
    WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
    w AS (SELECT r, doc_id, t, list_filter(string_split_regex(t, '{line_rules.SPACES}'), lambda x: x <> '') AS w FROM d),
    l AS (SELECT r, unnest(string_split(t, chr(10))) AS line FROM d),
    lw AS (SELECT r, line, list_filter(string_split_regex(line, '{line_rules.SPACES}'), lambda x: x <> '') AS w FROM l),
    j AS (SELECT r, line, len(w) AS n,
                 len(w) > 0 AND (regexp_matches(line, '{line_rules.BOILERPLATE_LINE}')
                   OR len(list_filter(w, lambda x: x IN ({', '.join(f"'{c}'" for c in line_rules.SEPARATORS)}))) >= 3
                   OR regexp_matches(line, '{line_rules.LAST_SEPARATOR}') OR (len(w) <= 3 AND regexp_matches(line, '{line_rules.MENU_LINE}'))
                   OR 2 * length(regexp_replace(line, '[^{line_rules.SYMBOLS}]', '', 'g')) > len(w)
                   OR 4 * len(list_filter(w, lambda x: regexp_matches(x, '{line_rules.SHOUTED}'))) > len(w)
                   OR (len(w) >= {line_rules.LIST_WORDS} AND NOT regexp_matches(line, '{line_rules.SENTENCE_END.replace("'", "''")}'))) AS failed FROM lw),
    per AS (SELECT r, sum(CASE WHEN failed THEN n ELSE 0 END) AS lost, count(*) FILTER (n > 0) - count(DISTINCT line) FILTER (n > 0) AS dup FROM j GROUP BY r),
    i AS (SELECT r, unnest(range(1, CAST(len(w) AS BIGINT) - 6)) AS i FROM w),
    g AS (SELECT r, i, array_to_string(w[i:i + 7], ' ') AS g FROM i JOIN w USING (r)),
    c AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS n FROM g) WHERE n > 1),
    v AS (SELECT r, least(8, coalesce(lead(i) OVER (PARTITION BY r ORDER BY i) - i, 8)) AS v FROM c),
    rep AS (SELECT r, sum(v) AS rep FROM v GROUP BY r),
    f AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
                 CAST(length(regexp_replace(t, '[^{line_rules.SYMBOLS}]', '', 'g')) AS BIGINT) AS n_symbols, CAST(dup AS BIGINT) AS n_dup_lines,
                 CAST(coalesce(rep, 0) AS BIGINT) AS n_repeat_words, CAST(lost AS BIGINT) AS lost_words
          FROM w JOIN per USING (r) LEFT JOIN rep USING (r)),
    b AS (SELECT *, n_words < {line_rules.LEAST_WORDS} OR 100 * n_repeat_words > {line_rules.REPEATED} * n_words AS base_failed FROM f)
    SELECT *, NOT base_failed AND 100 * lost_words <= {line_rules.LOST} * n_words AS kept FROM b""")
def op12_line_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_rules.judged(table(spark, sf_dir, "documents"))


@query("op13_resampling", f"""
    WITH crc AS (SELECT list_transform(range(256), lambda n: list_reduce([n, 0, 0, 0, 0, 0, 0, 0, 0],
                   lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS tab),
    d AS (SELECT row_number() OVER () AS r, doc_id,
                 regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
    x AS (SELECT r, unnest(w) AS w FROM d),
    y AS (SELECT unnest(regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')) AS w FROM benchmark),
    u AS (SELECT w, hex(encode(w)) AS h FROM (SELECT DISTINCT w FROM (SELECT w FROM x UNION ALL SELECT w FROM y))),
    k AS (SELECT w, xor(list_reduce(list_prepend(4294967295, list_transform(range(1, length(h) + 1, 2), lambda i: CAST('0x' || substr(h, i, 2) AS BIGINT))),
                                    lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1])), 4294967295) % 10000 AS b FROM u, crc),
    s AS (SELECT b, count(*) AS s FROM x JOIN k USING (w) GROUP BY b),
    t AS (SELECT b, count(*) AS t FROM y JOIN k USING (w) GROUP BY b),
    a AS (SELECT (SELECT count(*) FROM x) AS sa, (SELECT count(*) FROM y) AS ta),
    gain AS (SELECT b, CAST(floor(1000 * ln((coalesce(t, 0) + 1.0::DOUBLE) * (sa + 10000.0::DOUBLE) / ((s + 1.0::DOUBLE) * (ta + 10000.0::DOUBLE)))) AS BIGINT) AS g
             FROM s LEFT JOIN t USING (b), a),
    o AS (SELECT r, sum(g) AS weight FROM x JOIN k USING (w) JOIN gain USING (b) GROUP BY r),
    z AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_features, CAST(coalesce(weight, 0) AS BIGINT) AS weight,
                 CAST('0x' || substr(sha256('2024:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) AS h FROM d LEFT JOIN o USING (r)),
    e AS (SELECT doc_id, n_features, weight, weight + CAST(floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296))) AS BIGINT) AS score FROM z),
    q AS (SELECT *, CASE WHEN n_features >= 20 THEN row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id) END AS p,
                 count(*) FILTER (n_features >= 20) OVER () AS n FROM e)
    SELECT doc_id, n_features, weight, score, CASE WHEN p <= 10 * n // 100 THEN p END AS rank FROM q""")
def op13_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resampled(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), percent=10, grams=1, buckets=10_000, least_words=20, seed="2024")
