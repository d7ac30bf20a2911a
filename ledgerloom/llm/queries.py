"""The queries over the shared test tables, and the SQL of those that SQL can express."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import fingerprints, language, licenses, mixing, packing, quality, simhash, toxicity, urlfilter, warc


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op2_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.compare_with_edits(table(spark, sf_dir, "documents"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_counts(table(spark, sf_dir, "documents"))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.link_documents(table(spark, sf_dir, "documents"))


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.judge(table(spark, sf_dir, "pages"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return language.identify(docs, language.learn(docs))


def packing_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The operator of op1 on instruction data, where its limit on loss-bearing tokens binds."""
    return packing.pack_turns(table(spark, sf_dir, "conversations"), public_tokenizers.path("byte_bpe_50k.json"))


QUERIES = {f.__name__: f for f in (op1_packing, op2_fingerprints, op3_quality_rules, op4_mixing, op5_simhash, op6_url_filter, op7_toxicity, op8_warc, op9_licenses, op10_language, packing_conversations)}

_WORDS = r"string_split_regex(trim(coalesce(text, ''), chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' '), '[\x20\x09-\x0D]+')"
_BLANKS = "chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' '"


def _quality_sql() -> str:
    stop = ", ".join(f"'{w}'" for w in dict.fromkeys(quality.STOP_WORDS))
    least = {r.measure: (r.least, r.most) for r in quality.RULES}
    shares = {
        "n_words": "n_words",
        "mean_word_chars": "CASE WHEN n_words = 0 THEN 0 ELSE word_chars / n_words END",
        "symbols_per_word": "CASE WHEN n_words = 0 THEN 0 ELSE n_symbols / n_words END",
        "stop_word_share": "CASE WHEN n_words = 0 THEN 0 ELSE n_stop / n_words END",
        "bullet_line_share": "CASE WHEN n_lines = 0 THEN 0 ELSE n_bullet / n_lines END",
        "ellipsis_line_share": "CASE WHEN n_lines = 0 THEN 0 ELSE n_ellipsis / n_lines END",
        "dup_line_share": "CASE WHEN n_lines = 0 THEN 0 ELSE n_dup_lines / n_lines END",
    }
    rules = " AND ".join(f"({shares[m]}) {op} {v}" for m, (a, b) in least.items() for op, v in ((">=", a), ("<=", b)) if v is not None)
    return rf"""
WITH base AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text,
         list_filter({_WORDS}, lambda x: x <> '') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: trim(x, {_BLANKS}) <> '') AS l
  FROM documents),
tri AS (
  SELECT rid, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS t
  FROM (SELECT rid, w, unnest(range(1, len(w) - 1)) AS i FROM base WHERE len(w) >= 3)),
rep AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, t) AS n FROM tri) WHERE n > 1),
cov AS (
  SELECT rid, count(*) AS n FROM (SELECT DISTINCT rid, i + k AS p FROM rep, (SELECT unnest([0, 1, 2]) AS k)) GROUP BY rid),
m AS (
  SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
         CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(cov.n, 0) AS BIGINT) AS n_repeat_words,
         len(list_filter(w, lambda x: lower(x) IN ({stop}))) AS n_stop, len(l) AS n_lines,
         len(list_filter(l, lambda x: regexp_matches(ltrim(x), '^[-*•]'))) AS n_bullet,
         len(list_filter(l, lambda x: regexp_matches(trim(x, {_BLANKS}), '(\.\.\.|…)$'))) AS n_ellipsis
  FROM base LEFT JOIN cov USING (rid))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed,
       (NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words)) AND {rules} AS kept
FROM m"""


def _url_sql() -> str:
    rules = ", ".join(f"('{a}', '{h}', '{p}')" for a, h, p in urlfilter.RULES)
    return rf"""
WITH p AS (
  SELECT page_id,
         translate(coalesce(regexp_extract(url, '^(?s:.*?)://([^/?#]*)([^?#]*)', 1), ''), '{urlfilter.UPPER}', '{urlfilter.LOWER}') AS host,
         coalesce(regexp_extract(url, '^(?s:.*?)://([^/?#]*)([^?#]*)', 2), '') AS path
  FROM pages),
r(action, h, q) AS (VALUES {rules}),
best AS (
  SELECT page_id, host, path, arg_max(h || q, length(h || q)) AS rule, arg_max(action, length(h || q)) AS action
  FROM p LEFT JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, q)
  GROUP BY page_id, host, path)
SELECT page_id, host, path, rule, coalesce(action, '{urlfilter.DEFAULT}') AS verdict FROM best"""


def _license_sql() -> str:
    t = ", ".join(f"({i}, '{name}', [{', '.join(repr(g) for g in licenses.grams(text))}])" for i, (name, text) in enumerate(licenses.TEMPLATES))
    low, high = licenses.THRESHOLD / (2 - licenses.THRESHOLD), (2 - licenses.THRESHOLD) / licenses.THRESHOLD
    return rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
u AS (
  SELECT rid, unnest(string_split(text, chr(10))) AS unit FROM d
  UNION ALL SELECT rid, text FROM d WHERE contains(text, chr(10))),
w AS (SELECT rid, string_split(trim(regexp_replace(lower(unit), '[^\p{{L}}\p{{N}}]+', ' ', 'g')), ' ') AS w FROM u),
g AS (SELECT rid, list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS g FROM w WHERE len(w) > 1),
t(i, name, b) AS (VALUES {t}),
s AS (
  SELECT row_number() OVER () AS unit, rid, g FROM g),
h AS (
  SELECT unit, rid, i, name, 2.0::DOUBLE * len(list_intersect(g, b)) / (len(g) + len(b)) AS score
  FROM s JOIN t ON len(g) >= {low!r} * len(b) AND len(g) <= {high!r} * len(b)),
k AS (SELECT unit, rid, arg_max(name, score * 1000 - i) AS name, max(score) AS score, max(score * 1000 - i) AS o FROM h WHERE score >= {licenses.THRESHOLD} GROUP BY unit, rid),
b AS (SELECT rid, arg_max(name, o) AS license, max(score) AS score, count(*) AS n FROM k GROUP BY rid)
SELECT doc_id, license, coalesce(score, 0.0::DOUBLE) AS score, CAST(coalesce(n, 0) AS BIGINT) AS n_matches FROM d LEFT JOIN b USING (rid)"""


def _warc_sql() -> str:
    return f"""
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
q AS (SELECT page_id, CAST(octet_length(b) AS BIGINT) AS payload_bytes, sha256(b) AS payload_digest FROM p),
f AS (SELECT payload_digest, min(page_id) AS first FROM q WHERE payload_bytes >= {warc.LEAST} GROUP BY payload_digest)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN page_id > first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id > first THEN first END AS refers_to
FROM q LEFT JOIN f USING (payload_digest)"""


ORACLE_SQL = {"op3_quality_rules": _quality_sql(), "op6_url_filter": _url_sql(), "op8_warc": _warc_sql(), "op9_licenses": _license_sql()}
