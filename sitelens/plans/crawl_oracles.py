"""DuckDB SQL for the crawl queries."""

from __future__ import annotations

from ..operators import crawl as K
from .oracles import _NORMAL, _ROOT, _quote

_WWW = "regexp_replace(host, '^www[0-9]?[.]', '')"
_U = f"u AS (SELECT page_id, html, normal, host, {_ROOT.replace('host', _WWW)} AS root FROM ({_NORMAL}))"
_CLEAN = "CASE p_partkey % 5 WHEN 0 THEN p_name WHEN 1 THEN p_name WHEN 2 THEN w WHEN 3 THEN w || '.com/about' ELSE upper(w) || '.UK' END"
_CAND = (
    f"WITH {_U}, r AS (SELECT root, page_id, html, host, string_split(root, '.')[1] AS name, regexp_extract(normal, '^[a-z]+://[^/]*([^?]*)', 1) AS path, row_number() OVER (PARTITION BY root ORDER BY page_id) AS position FROM u), "
    f"b AS (SELECT *, regexp_replace(path, '^/+|/+$', '', 'g') AS bare, regexp_replace(lower({_WWW}), '[^a-z0-9]', '', 'g') AS h, regexp_replace(lower(name), '[^a-z0-9]', '', 'g') AS n FROM r), "
    "d AS (SELECT *, len(list_filter(string_split(bare, '/'), lambda x: x <> '')) AS depth FROM b), "
    f"s AS (SELECT root, page_id, html, position, (CASE WHEN contains(h, n) THEN 50 WHEN length(n) >= 4 AND contains(h, substr(n, 1, 5)) THEN 15 ELSE 0 END + CASE WHEN depth = 0 THEN 30 ELSE CASE WHEN regexp_matches(bare, {_quote(K.COMPANY_PAGE)}) THEN 10 ELSE 0 END - depth * 8 END"
    f" - CASE WHEN regexp_matches(host, {_quote(K.LOCAL_HOST)}) OR regexp_matches(host, {_quote(K.SIDE_HOST)}) THEN 45 ELSE 0 END - CASE WHEN len(string_split({_WWW}, '.')) > 2 THEN 35 ELSE 0 END - CASE WHEN regexp_matches(bare, {_quote(K.ARCHIVE)}) THEN 25 ELSE 0 END + CASE WHEN position <= 3 THEN 8 - position ELSE 0 END)::INT AS score FROM d WHERE NOT regexp_matches(path, {_quote(K.PROFILE_PATH)})), "
    "c AS (SELECT root, page_id, html, score, row_number() OVER (PARTITION BY root ORDER BY score DESC, position)::INT AS rank FROM s WHERE score > 0)"
)
_TITLE = "regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)"
for _ref, _to in K.REFERENCES:
    _TITLE = f"replace({_TITLE}, {_quote(_ref)}, {_quote(_to)})"
_TAG = r"""[a-zA-Z_:][-a-zA-Z0-9_:.]*\s*=\s*("[^"]*"|''[^'']*''|[^\s"''>]+)"""

ORACLES = {
    "input_kind": f"SELECT p_partkey, {_CLEAN} AS value, CASE WHEN p_partkey % 5 = 3 THEN 'url' ELSE 'name' END AS kind FROM (SELECT *, string_split(p_name, ' ')[1] AS w FROM part)",
    "candidate_rank": _CAND + " SELECT root, page_id, score, rank FROM c WHERE rank <= 5",
    "candidate_fall_through": _CAND + " SELECT root, arg_min(page_id, rank) AS page_id, min(rank) AS rank FROM c WHERE rank <= 5 AND lower(html) LIKE '%</body>%' GROUP BY root",
    "unique_hosts": f"WITH {_U} SELECT min(page_id) AS page_id, root FROM u WHERE page_id % 10 <> 0 GROUP BY root UNION ALL SELECT page_id, NULL FROM u WHERE page_id % 10 = 0",
    "file_stem": f"WITH {_U} SELECT DISTINCT root, regexp_replace(lower(root), '[^a-z0-9.]+', '-', 'g') AS stem FROM u",
    "fetch_batches": f"WITH {_U}, n AS (SELECT root, page_id, (row_number() OVER (PARTITION BY root ORDER BY page_id) - 1) // 10 AS call FROM u) SELECT root, call, count(*) AS urls, min(page_id) AS first_page FROM n GROUP BY ALL",
    "fetch_outcomes": "SELECT page_id, page_id % 7 >= 2 AS ok, page_id % 7 >= 2 OR page_id % 3 = 0 AS kept, CASE WHEN page_id % 7 >= 2 OR page_id % 3 = 0 THEN NULL WHEN page_id % 3 = 1 THEN 'timeout' ELSE 'not returned' END AS reason FROM pages",
    "icon_probes": f"WITH {_U}, h AS (SELECT DISTINCT host FROM u), i AS (SELECT * FROM (VALUES " + ", ".join(f"({_quote(p)}, {_quote(k)}, {n})" for p, k, n in K.ICONS) + ") v(path, kind, score)) SELECT 'https://' || host || path AS url, kind, score FROM h CROSS JOIN i",
    "sheet_skips": "WITH s AS (SELECT p_brand AS brand, p_partkey % 3 < 2 AS sheet, row_number() OVER (PARTITION BY p_brand, p_partkey % 3 < 2 ORDER BY p_partkey) AS k FROM part) SELECT brand, CASE WHEN NOT sheet THEN 'no sheet' WHEN k > 50 THEN 'beyond the cap' ELSE 'read' END AS fate, count(*) AS sheets FROM s GROUP BY ALL",
    "tag_attributes": f"WITH t AS (SELECT unnest(regexp_extract_all(html, '<[a-zA-Z][^<>]*>')) AS tag FROM pages), a AS (SELECT unnest(regexp_extract_all(tag, '{_TAG}')) AS a FROM t) SELECT lower(regexp_extract(a, '^([^\\s=]+)', 1)) AS name, count(*) AS uses, count(DISTINCT regexp_replace(regexp_replace(a, '^[^=]*=\\s*', ''), '^[\"'']|[\"'']$', '', 'g')) AS different FROM a GROUP BY 1",
    "page_head": f"WITH h AS (SELECT page_id, trim(regexp_replace({_TITLE}, '[ \\t\\r\\n]+', ' ', 'g')) AS title, lower(regexp_extract(html, '(?i)<html[^>]* lang=\"([^\"]*)\"', 1)) AS lang, lower(regexp_extract(html, '(?i)<meta charset=\"([^\"]*)\"', 1)) AS charset FROM pages), "
    "n AS (SELECT *, trim(string_split(regexp_replace(title, '\\s+([|–—·:]|-)\\s+', chr(10), 'g'), chr(10))[1]) AS name FROM h) SELECT page_id, title, lang, charset, CASE WHEN name <> '' AND length(name) <= 48 AND NOT regexp_matches(name, '(?i)^(home|welcome|coming soon|page not found|404|redirecting|official)([^a-z0-9_]|$)') THEN name END AS name FROM n",
}
