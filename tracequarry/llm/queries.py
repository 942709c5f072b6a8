"""The queries opN_<name> and their SQL: thin digests over the operators with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import cap_filters, divergence, html_extract, kk_sharding, merkle, mil_quality, mixing, ngram_jaccard, quality_rules, sentencepiece_codec, suffix_dedup, token_counts, url_filters
from .audit_sql import OP12_SQL, OP13_SQL
from .common import table


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))


def op2_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_jaccard.near_components(table(spark, sf_dir, "documents"))


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_codec.encoding_digest(table(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model"))


def op4_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filters.judge_urls(table(spark, sf_dir, "pages"))


def op5_cap_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cap_filters.near_vectors(table(spark, sf_dir, "embeddings"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge_quality(table(spark, sf_dir, "documents"))


def op7_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract_main_text(table(spark, sf_dir, "pages"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.rate_table(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.removal_digest(table(spark, sf_dir, "documents"))


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kk_sharding.shard_groups(table(spark, sf_dir, "documents"))


def op11_mil_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mil_quality.score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.tamper_audit(table(spark, sf_dir, "documents"))


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.diverging_sources(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_token_counts, op2_ngram_jaccard, op3_sentencepiece, op4_url_filters, op5_cap_filters, op6_quality_rules, op7_html_extraction, op8_mixing, op9_suffix_dedup, op10_sharding, op11_mil_quality, op12_merkle_manifest, op13_source_divergence)}

# Of character references only &amp; is decoded here.
OP4_SQL = r"""
WITH RECURSIVE tags AS (
  SELECT url, regexp_extract(html, '(?is)<base\s[^<>]*>') AS own, unnest(regexp_extract_all(html, '(?is)<(?:link|meta)\s[^<>]*>')) AS tag FROM pages WHERE url IS NOT NULL),
hrefs AS (
  SELECT url, replace(trim(regexp_extract(own, '(?is)\shref\s*=\s*["'']?([^"''\s>]+)', 1)), '&amp;', '&') AS own, trim(replace(CASE
      WHEN regexp_matches(tag, '(?is)\srel\s*=\s*["'']?[^"''>]*canonical') THEN regexp_extract(tag, '(?is)\shref\s*=\s*["'']?([^"''\s>]+)', 1)
      WHEN regexp_matches(tag, '(?is)\shttp-equiv\s*=\s*["'']?refresh') THEN regexp_extract(tag, '(?is)url\s*=\s*["'']?([^"''>]+)', 1)
      ELSE '' END, '&amp;', '&')) AS h FROM tags),
based AS (SELECT h, CASE WHEN strpos(own, '://') > 0 THEN own ELSE url END AS url, url AS a FROM hrefs WHERE h <> ''),
joined AS (
  SELECT a, regexp_extract(url, '(?s)^(.*?)://', 1) AS scheme, regexp_extract(url, '(?s)^(.*?://[^/?#]*)', 1) AS site, regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path,
    regexp_extract(url, '(?s)^[^#]*', 0) AS whole, h, regexp_matches(h, '^[A-Za-z][A-Za-z0-9+.-]*:') AS complete FROM based),
placed AS (
  SELECT a, CASE WHEN complete THEN regexp_extract(h, '(?s)^(.*?://[^/?#]*)', 1) WHEN h LIKE '//%' THEN scheme || ':' || regexp_extract(h, '(?s)^//[^/?#]*') ELSE site END AS site,
    CASE WHEN h LIKE '#%' THEN whole WHEN complete OR h LIKE '//%' THEN NULL WHEN h LIKE '?%' THEN site || path || h END AS done, complete, h,
    CASE WHEN h LIKE '//%' THEN regexp_extract(h, '(?s)^//[^/?#]*([^?#]*)', 1) WHEN h LIKE '/%' THEN regexp_extract(h, '(?s)^[^?#]*') ELSE regexp_replace('/' || ltrim(path, '/'), '[^/]*$', '') || regexp_extract(h, '(?s)^[^?#]*') END AS path,
    regexp_extract(h, '(?s)^[^?#]*(.*)$', 1) AS rest FROM joined),
edges0 AS (
  SELECT a, CASE WHEN complete THEN h WHEN done IS NOT NULL THEN done ELSE site || list_reduce(list_prepend('', string_split(path, '/')[2:]),
      lambda kept, x: CASE WHEN x = '..' THEN regexp_replace(kept, '/[^/]*$', '') WHEN x = '.' THEN kept ELSE kept || '/' || x END)
    || CASE WHEN regexp_matches(path, '/\.{1,2}$') THEN '/' ELSE '' END || rest END AS b FROM placed),
node AS (
  SELECT DISTINCT u, translate(regexp_extract(u, '(?s)^(.*?://[^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') || regexp_extract(u, '(?s)^.*?://[^/?#]*([^#]*)', 1) AS n
  FROM (SELECT url AS u FROM pages UNION SELECT b FROM edges0) WHERE strpos(u, '://') > 0),
edges AS (SELECT DISTINCT x.n AS a, y.n AS b FROM edges0 e JOIN node x ON x.u = e.a JOIN node y ON y.u = e.b WHERE x.n <> y.n),
both_ways AS (SELECT a, b FROM edges UNION SELECT b, a FROM edges),
rules(rule, rh, rp, verdict) AS (VALUES ('net/', 'net', '/', 'block'), ('example.net/en/', 'example.net', '/en/', 'allow'),
  ('example.com/de/', 'example.com', '/de/', 'block'), ('org/fr/', 'org', '/fr/', 'allow')),
parts AS (
  SELECT n AS u, regexp_extract(n, '(?s)^.*?://([^/?#]*)', 1) AS host, regexp_extract(n, '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM (SELECT DISTINCT n FROM node)),
best AS (
  SELECT u, host, path, rule, verdict FROM (
    SELECT p.*, r.rule, r.verdict, row_number() OVER (PARTITION BY p.u ORDER BY length(r.rule) DESC) AS k
    FROM parts p LEFT JOIN rules r ON (p.host = r.rh OR p.host LIKE '%.' || r.rh) AND starts_with(p.path, r.rp)) WHERE k = 1),
reach AS (SELECT u FROM best WHERE verdict = 'block' UNION SELECT b FROM reach JOIN both_ways ON a = u)
SELECT p.page_id, coalesce(b.host, '') AS host, coalesce(b.path, '') AS path, b.rule,
  coalesce(b.verdict, CASE WHEN EXISTS (SELECT 1 FROM reach r WHERE r.u = b.u) THEN 'block' ELSE 'allow' END) AS verdict
FROM pages p LEFT JOIN node n ON n.u = p.url LEFT JOIN best b ON b.u = n.n
"""

OP6_SQL = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(text, '') AS t FROM documents),
ws AS (
  SELECT doc_id, source, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS words FROM d),
ln AS (
  SELECT doc_id, count(*) - count(DISTINCT l) AS dup FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS l FROM d)
  WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY doc_id),
w AS (
  SELECT doc_id, unnest(words) AS x, unnest(range(len(words))) AS i FROM ws),
g AS (
  SELECT doc_id, i, x AS a, lead(x) OVER o AS b, lead(x, 2) OVER o AS c FROM w WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
r AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, a, b, c) AS n FROM g WHERE c IS NOT NULL) WHERE n > 1),
rep AS (
  SELECT doc_id, count(DISTINCT i + k) AS n FROM r, (VALUES (0), (1), (2)) AS s(k) GROUP BY doc_id),
m AS (
  SELECT ws.doc_id, source, len(words) AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS word_chars,
    length(t) - length(regexp_replace(t, '[#*$%&|<>]+', '', 'g')) AS n_symbols, coalesce(ln.dup, 0) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words
  FROM ws LEFT JOIN ln USING (doc_id) LEFT JOIN rep USING (doc_id)),
f AS (SELECT *, (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed FROM m),
h AS (SELECT source, count(*) AS n, count(*) FILTER (WHERE base_failed) AS k FROM f WHERE source IS NOT NULL GROUP BY source),
a AS (SELECT sum(k) / sum(n) AS mean, sum(k * k / n) / sum(n) - (sum(k) / sum(n)) ** 2 AS var, count(*) / sum(n) AS per FROM h),
p AS (SELECT mean, greatest(1.0, CASE WHEN var - mean * (1 - mean) * per > mean * (1 - mean) / 1e6 THEN mean * (1 - mean) / (var - mean * (1 - mean) * per) - 1 ELSE 1e6 END) AS s FROM a),
bad AS (SELECT source FROM h, p WHERE (k + mean * s) / (n + s) > 0.5)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
  CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed,
  NOT base_failed AND (source IS NULL OR source NOT IN (SELECT source FROM bad)) AS kept
FROM f
"""

ORACLES = {"op4_url_filters": OP4_SQL, "op6_quality_rules": OP6_SQL, "op12_merkle_manifest": OP12_SQL, "op13_source_divergence": OP13_SQL}
