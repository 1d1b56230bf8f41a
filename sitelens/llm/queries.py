"""One query for each operator, over its whole table, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe_automaton, decontaminate, filter_audit, html_extract, language_id, near_dedup, pitman_yor, prefix_join, quality_rules, sharding, spelling, token_sstable, warc
from .common import fresh_path, table


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    """Where the public tokenizer files lie; the operators take any path."""
    import public_tokenizers

    return public_tokenizers.path(name)


def fold(id_col: str, n: int) -> F.Column:
    """crc32 of the identifier as text, modulo n."""
    return F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(n))


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return html_extract.extract(table(spark, sf_dir, "pages"))


def op2_bpe_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded by the automaton and decoded again."""
    return bpe_automaton.round_trip(table(spark, sf_dir, "documents"), tokenizer_path())


def op3_pitman_yor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of every document, learned from those outside fold 2 of 7."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pitman_yor.score(docs, fold("doc_id", 7) == 2)


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of a document and a benchmark item whose template it holds."""
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learned from those outside fold 2 of 4."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang").withColumn("held_out", F.coalesce(fold("doc_id", 4) == 2, F.lit(False)))
    model = language_id.fit(docs.filter(~F.col("held_out")))
    return language_id.predict(docs, model, keep=("doc_id", "held_out"))


def op6_token_sstable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's ids, written as sorted-string-table shards and read back."""
    folder = fresh_path(spark, "sstable")
    shards = token_sstable.write(table(spark, sf_dir, "documents"), folder, tokenizer_path())
    return token_sstable.read_digests(spark, shards)


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measures and verdict of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return quality_rules.judge(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op8_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's component of near duplicates on 2-word shingles."""
    return near_dedup.cluster(table(spark, sf_dir, "documents"), width=2)


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's place in 24 shards of near-equal bytes."""
    return sharding.assign(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op10_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every revisit among the captures made from pages, resolved."""
    found = warc.resolve(warc.captures_of_pages(table(spark, sf_dir, "pages").select("page_id", "url", "html")))
    return found.select("record_id", "canonical", F.unix_timestamp("ts").alias("at_secs"), "status", "refers_to", F.unix_timestamp("refers_ts").alias("refers_at"), "digest", F.col("headers")["etag"].alias("etag"), F.col("headers")["date"].alias("date"), F.col("headers")["content-type"].alias("content_type"), F.size("headers").alias("n_headers"))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each of five filters removes in every order, by language."""
    return filter_audit.audit(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"), table(spark, sf_dir, "labels"))


def op12_prefix_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's component of links of 0.9 on 3-word shingles."""
    return prefix_join.join(table(spark, sf_dir, "documents"), width=3, percent=90)


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every frequent word with its near words, form and root."""
    return spelling.variants(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_html_extraction, op2_bpe_automaton, op3_pitman_yor, op4_decontamination, op5_language_id, op6_token_sstable, op7_quality_rules, op8_near_dedup, op9_sharding, op10_warc_revisits, op11_filter_audit, op12_prefix_join, op13_spelling_variants)}

_OP7 = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, coalesce(source, chr(1)) AS host FROM documents),
w AS (SELECT doc_id, t, host, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws FROM d),
win AS (SELECT doc_id, i, ws[i] || ' ' || ws[i+1] || ' ' || ws[i+2] AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)),
rep AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM win) WHERE c > 1),
cov AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM rep, (VALUES (0), (1), (2)) v(k) GROUP BY doc_id),
raw AS (SELECT doc_id, host, md5(t) AS h, unnest(string_split(t, chr(10))) AS x FROM d),
ln AS (SELECT doc_id, host, h, x, trim(lower(regexp_replace(x, '[\x20\x09-\x0D]+', ' ', 'g'))) AS l FROM raw WHERE regexp_matches(x, '[^\x20\x09-\x0D]')),
dup AS (SELECT doc_id, count(*) - count(DISTINCT x) AS n FROM ln GROUP BY doc_id),
hosts AS (SELECT host, count(DISTINCT t) AS n FROM d GROUP BY host),
freq AS (SELECT ln.host, l FROM ln JOIN hosts USING (host) GROUP BY ln.host, l, hosts.n HAVING count(DISTINCT h) > 20 AND count(DISTINCT h) > 0.10 * hosts.n),
gone AS (SELECT doc_id, sum(len(string_split(l, ' '))) AS n FROM ln SEMI JOIN freq ON ln.host = freq.host AND ln.l = freq.l GROUP BY doc_id),
m AS (SELECT doc_id, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
  coalesce(dup.n, 0)::BIGINT AS n_dup_lines, coalesce(cov.n, 0)::BIGINT AS n_repeat_words, coalesce(gone.n, 0)::BIGINT AS gone
  FROM w LEFT JOIN dup USING (doc_id) LEFT JOIN cov USING (doc_id) LEFT JOIN gone USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND NOT (n_words - gone < 0.30 * n_words) AS kept FROM m
"""

_OP10 = r"""
WITH p AS (SELECT page_id, url, md5(coalesce(html, '')) AS digest, 1704067200 + page_id % 1000 * 3600 AS secs,
  regexp_replace(regexp_replace(trim(url), '#.*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://', '') AS rest FROM pages),
c AS (SELECT *, regexp_replace(regexp_replace(lower(regexp_extract(rest, '^([^/?]*)', 1)), '^[^@]*@', ''), '^www\d?\.|:(80|443)$', '', 'g')
  || regexp_replace(regexp_extract(rest, '^[^/?]*(/[^?]*)?', 1), '(/index\.html?)?/*$', '') AS base,
  list_sort(list_filter(string_split(regexp_extract(rest, '\?(.*)$', 1), '&'), lambda x: x <> '' AND NOT regexp_matches(x, '^(utm_[a-z0-9_]+|ref|gclid|fbclid|msclkid|mc_cid|mc_eid|igshid|yclid|_ga)(=|$)'))) AS q FROM p),
k AS (SELECT *, base || CASE WHEN len(q) > 0 THEN '?' || array_to_string(q, '&') ELSE '' END AS canonical FROM c),
v AS (SELECT page_id * 2 + 1 AS record_id, page_id, canonical, secs + CASE WHEN page_id % 11 = 0 THEN -3600 ELSE 108000 END AS at_secs,
  CASE WHEN page_id % 5 = 0 THEN NULL WHEN page_id % 7 = 0 THEN '"stale"' ELSE '"' || digest || '"' END AS tag FROM k),
j AS (SELECT v.record_id, v.canonical, v.at_secs, v.tag, v.page_id % 5 = 0 AS untagged, r.page_id AS rid, r.secs AS rat, r.digest AS rdigest, v.page_id % 7 = 0 AS stale,
  row_number() OVER (PARTITION BY v.record_id ORDER BY r.secs DESC, r.page_id DESC) AS rn FROM v LEFT JOIN k r ON r.canonical = v.canonical AND r.secs <= v.at_secs),
s AS (SELECT *, CASE WHEN rid IS NULL THEN 'orphan' WHEN tag IS NULL THEN 'unchecked' WHEN tag <> '"' || rdigest || '"' THEN 'mismatch' ELSE 'resolved' END AS status FROM j WHERE rn = 1)
SELECT record_id, canonical, at_secs, status, CASE WHEN status IN ('resolved', 'unchecked') THEN rid * 2 END AS refers_to, CASE WHEN status IN ('resolved', 'unchecked') THEN rat END AS refers_at,
  CASE WHEN status IN ('resolved', 'unchecked') THEN rdigest END AS digest,
  CASE WHEN status = 'unchecked' THEN '"' || rdigest || '"' WHEN tag IS NULL THEN NULL WHEN stale THEN tag ELSE 'W/' || tag END AS etag,
  CAST(at_secs AS VARCHAR) AS date, CASE WHEN status IN ('resolved', 'unchecked') THEN 'text/html' END AS content_type,
  CAST(CASE WHEN status IN ('resolved', 'unchecked') THEN 4 WHEN untagged THEN 2 ELSE 3 END AS INTEGER) AS n_headers FROM s
"""

_OP11 = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, coalesce(lang, '') AS part FROM documents),
w AS (SELECT doc_id, t, part, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws FROM d),
f AS (SELECT doc_id, part, (len(ws) < 100)::INT + 2 * (100 * len(list_distinct(ws)) < 80 * len(ws))::INT
  + 4 * (100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 10 * length(t))::INT + 8 * regexp_matches(t, '[#$%&*|]')::INT
  + 16 * coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false)::INT AS mask FROM w),
l AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id),
m AS (SELECT part, mask, count(*) AS n, coalesce(sum(good), 0) AS good, coalesce(sum(toxic), 0) AS toxic FROM f LEFT JOIN l USING (doc_id) GROUP BY part, mask),
x AS (SELECT * FROM (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) v(c, bit)),
o AS (SELECT a.c || b.c || c.c || d.c || e.c AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits FROM x a, x b, x c, x d, x e WHERE a.bit | b.bit | c.bit | d.bit | e.bit = 31),
s AS (SELECT filter_order, step, bits[step] AS bit, coalesce(list_sum(bits[1:step - 1]), 0)::INT AS prior FROM o, range(1, 6) r(step)),
r AS (SELECT part, filter_order, step, bit, sum(n) FILTER (mask & (prior | bit) = 0) AS kept, sum(n) FILTER (mask & bit > 0 AND mask & prior = 0) AS removed,
  sum(n) FILTER (mask & bit > 0 AND mask & prior > 0) AS redundant, sum(n) FILTER (mask = bit) AS unique_fails,
  sum(good) FILTER (mask & bit > 0 AND mask & prior = 0) AS good_lost, sum(toxic) FILTER (mask & bit > 0 AND mask & prior = 0) AS toxic_lost
  FROM m, s GROUP BY part, filter_order, step, bit)
SELECT part, filter_order, step::INT AS step, coalesce(kept, 0)::BIGINT AS kept, coalesce(removed, 0)::BIGINT AS removed, coalesce(redundant, 0)::BIGINT AS redundant,
  coalesce(unique_fails, 0)::BIGINT AS unique_fails, coalesce(good_lost, 0)::BIGINT AS good_lost, coalesce(toxic_lost, 0)::BIGINT AS toxic_lost,
  sum(coalesce(removed, 0)) OVER (PARTITION BY part, bit)::BIGINT AS shapley FROM r
"""

ORACLES = {"op11_filter_audit": _OP11, "op7_quality_rules": _OP7, "op10_warc_revisits": _OP10}
