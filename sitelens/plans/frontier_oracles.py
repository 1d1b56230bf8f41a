"""DuckDB SQL for page selection and the crawl plan. Links of the given pages are absolute paths, so only these are resolved here."""

from __future__ import annotations

from ..operators.frontier import DEPTHS, EXCLUDED, HREF, INDEX, INTENTS, PAGES, PER_INTENT, PLAIN, SECTION, SEGMENTS, TOP
from .oracles import _NORMAL, _ROOT, _quote


def _has(text: str, pattern: str) -> str:
    return f"regexp_matches({text}, {_quote('(?i)' + pattern)})"


_PATH = "regexp_extract(url, '^[a-z]+://[^/]*([^?]*)', 1)"
_INTENT = "CASE " + " ".join(f"WHEN {_has('path', p)} THEN {_quote(n)}" for n, _, p in INTENTS) + " ELSE 'page' END"
_POINTS = "CASE " + " ".join(f"WHEN {_has('path', p)} THEN {k}" for _, k, p in INTENTS) + f" ELSE {PLAIN} END"
_OUT = " OR ".join(_has("asked", p) for p in EXCLUDED)
_SITE_OF = _ROOT.replace("host", "regexp_extract(url, '^[a-z]+://([^/:]*)', 1)")
_LINKS = f"""n AS (SELECT page_id, html, normal, host, {_ROOT} AS site FROM ({_NORMAL})),
raw AS (SELECT page_id, base, site, unnest(x) AS r, generate_subscripts(x, 1) - 1 AS ord FROM (SELECT page_id, normal AS base, site, regexp_extract_all(html, {_quote(HREF)}, 1) AS x FROM n)),
u AS (SELECT page_id, base, site, ord, regexp_replace(CASE WHEN r LIKE '/%' THEN regexp_extract(base, '^([a-z]+://[^/]*)', 1) || r ELSE r END, '#.*$', '') AS url
  FROM (SELECT page_id, base, site, ord, replace(regexp_replace(r, '^["'']|["'']$', '', 'g'), '&amp;', '&') AS r FROM raw)),
k AS (SELECT *, {_PATH} AS path, regexp_extract(url, '^[a-z]+://[^/]*(/.*)$', 1) AS asked, regexp_replace(url, '/$', '') AS key, len(list_filter(string_split({_PATH}, '/'), lambda x: x <> '')) AS segments FROM u),
s AS (SELECT page_id, site, ord, url, key, {_INTENT} AS intent, segments = 1 AS top, {_has('path', SECTION)} AS idx, {_POINTS} AS points FROM k
  WHERE {_SITE_OF} = site AND key <> regexp_replace(base, '/$', '') AND segments BETWEEN 1 AND {SEGMENTS} AND NOT ({_OUT}) AND path <> regexp_replace(regexp_extract(base, '^[a-z]+://[^/]*([^?]*)', 1), '/$', '')),
sc AS (SELECT page_id, site, ord, url, key, intent, points + CASE WHEN top THEN {TOP} ELSE 0 END - CASE WHEN idx THEN {INDEX} ELSE 0 END AS score,
  CASE WHEN intent = 'page' THEN 'site page' ELSE intent || ' page' END || CASE WHEN top THEN ', top level' ELSE '' END || CASE WHEN idx THEN ' (section index)' ELSE '' END AS reason FROM s)"""

_SELECT = f"""WITH {_LINKS}, o AS (SELECT * FROM sc QUALIFY row_number() OVER (PARTITION BY page_id, key ORDER BY ord) = 1),
f AS (SELECT * FROM o QUALIFY row_number() OVER (PARTITION BY page_id, intent ORDER BY score DESC, ord) <= {PER_INTENT})
SELECT page_id, url, intent, score::INT AS score, reason, row_number() OVER (PARTITION BY page_id ORDER BY score DESC, ord)::INT AS rank FROM f QUALIFY rank <= {PAGES}"""


def _level(k: int) -> str:
    """The links of the pages planned last, without those planned before; the whole plan so far."""
    return f"""c{k} AS (SELECT sc.* FROM sc JOIN l{k - 1} USING (site) WHERE sc.page_id = l{k - 1}.stored AND (sc.site, sc.key) NOT IN (SELECT (site, key) FROM p{k - 1})),
o{k} AS (SELECT * FROM c{k} QUALIFY row_number() OVER (PARTITION BY site, key ORDER BY page_id, ord) = 1),
f{k} AS (SELECT * FROM o{k} QUALIFY row_number() OVER (PARTITION BY site, intent ORDER BY score DESC, page_id, ord) <= {PER_INTENT}),
l{k} AS (SELECT site, key, url, {k} AS level, intent, score::INT AS score, reason, page_id AS via, stored FROM f{k} LEFT JOIN ids USING (key) QUALIFY row_number() OVER (PARTITION BY site ORDER BY score DESC, page_id, ord) <= {DEPTHS['deep']}),
p{k} AS (SELECT * FROM p{k - 1} UNION ALL SELECT * FROM l{k})"""


_PLAN = f"""WITH {_LINKS}, ids AS (SELECT regexp_replace(normal, '/$', '') AS key, min(page_id) AS stored FROM n GROUP BY 1),
h AS (SELECT site, arg_min(normal, page_id) AS url FROM n GROUP BY site),
l0 AS (SELECT site, key, url, 0 AS level, 'home' AS intent, NULL::INT AS score, 'homepage' AS reason, NULL::BIGINT AS via, stored FROM (SELECT *, regexp_replace(url, '/$', '') AS key FROM h) LEFT JOIN ids USING (key)),
p0 AS (SELECT * FROM l0), {_level(1)}, {_level(2)} SELECT site, level::INT AS level, url, intent, score, reason, via, stored FROM p2"""

_HEADS = f"""WITH n AS ({_NORMAL}), h AS (SELECT page_id, host, regexp_extract(html, '(?is)<head[^>]*>(.*?)(?:</head>|<body|$)', 1) AS head FROM n)
SELECT page_id, (DATE '2024-01-01' + (page_id % 7)::INT)::DATE AS day, host, length(head)::INT AS head_chars, regexp_extract(head, '(?is)<title[^>]*>(.*?)</title>', 1) AS title FROM h"""

ORACLES = {"head_scan": _HEADS, "page_links": _SELECT, "site_plan": _PLAN}
