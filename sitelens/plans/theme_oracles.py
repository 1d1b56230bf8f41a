"""DuckDB SQL for terms, pillars, taglines, headlines and positions of sites, from the rules. The given pages have no metas to read."""

from __future__ import annotations

from ..operators.faces import AUDIENCES
from ..operators.messaging import CATEGORIES
from ..operators.profile import NAVIGATION, STOP
from ..operators.themes import COMMON, HEADLINES, KEPT, PILLARS, SUPPORT, TAGLINES, TOP
from .oracles import _NORMAL, _ROOT, _TEXT, _fixed, _quote

_DECODE = "x"
for _ref, _to in (("&amp;", "'&'"), ("&lt;", "'<'"), ("&gt;", "'>'"), ("&quot;", "'\"'"), ("&#39;|&apos;", "''''"), ("&#8217;|&rsquo;", "''''"), ("&nbsp;", "' '"), ("&#[0-9]+;", "''")):
    _DECODE = f"regexp_replace({_DECODE}, '{_ref}', {_to}, 'gi')"
_DECODE = f"trim(regexp_replace({_DECODE}, '\\s+', ' ', 'g'))"
_HS = "|".join(f"<h{k}[^>]*>.*?</h{k}>" for k in range(1, 7))
_UNIQUE = f"""pg AS (SELECT page_id, html, {_ROOT} AS site FROM ({_NORMAL})),
raw AS (SELECT site, page_id, unnest(m) AS h, generate_subscripts(m, 1) - 1 AS ord FROM (SELECT site, page_id, regexp_extract_all(html, '(?is){_HS}') AS m FROM pg)),
hd AS (SELECT site, page_id, ord, substr(h, 3, 1)::INT AS level, {_DECODE} AS heading FROM (SELECT *, regexp_replace(h, '<[^>]+>', ' ', 'g') AS x FROM raw)),
u AS (SELECT * FROM hd WHERE length(heading) BETWEEN 4 AND 220 AND len(string_split(heading, ' ')) <= 24 AND NOT regexp_matches(heading, '(?i)^{NAVIGATION}') AND regexp_matches(heading, '[A-Za-z0-9_]')
  QUALIFY row_number() OVER (PARTITION BY site, lower(heading) ORDER BY page_id, ord) = 1)"""
_STOP = ", ".join(map(_quote, STOP))
_TERMS = f"""{_UNIQUE}, s AS (SELECT * FROM u WHERE level <= 3),
tk AS (SELECT site, page_id, ord, unnest(w) AS raw, generate_subscripts(w, 1) AS pos FROM (SELECT site, page_id, ord, regexp_split_to_array(regexp_replace(lower(heading), '[^a-z0-9\\s''-]', ' ', 'g'), '\\s+') AS w FROM s)),
tm AS (SELECT site, page_id, ord, pos, regexp_replace(raw, '^[-'']+|[-'']+$', '', 'g') AS term FROM tk),
tf AS (SELECT site, term, count(*) AS mentions, count(DISTINCT (page_id, ord)) AS headings, min((page_id, ord, pos)) AS f FROM tm WHERE length(term) >= 3 AND NOT regexp_matches(term, '^[0-9]+$') AND term NOT IN ({_STOP}) GROUP BY site, term),
tw AS (SELECT site, term, mentions, headings, {_fixed('mentions * ln(1 + total / headings)', 3)} AS weight, f FROM tf JOIN (SELECT site, count(*) AS total FROM s GROUP BY site) USING (site)),
tr AS (SELECT *, row_number() OVER (PARTITION BY site ORDER BY weight DESC, f)::INT AS rank FROM tw)"""
_STEM = "CASE WHEN length(term) <= 3 OR regexp_matches(term, '(ss|us|is|ous|ics)$') THEN term WHEN length(term) > 4 AND term LIKE '%ies' THEN regexp_replace(term, 'ies$', 'y') WHEN regexp_matches(term, '[^s]s$') THEN regexp_replace(term, 's$', '') ELSE term END"
_NAME = "array_to_string(list_transform(regexp_extract_all(theme, '[a-z0-9_]+|[^a-z0-9_]+'), lambda p: upper(p[1]) || p[2:]), '')"
_PILLARS = f"""WITH {_TERMS}, g AS (SELECT site, {_STEM} AS theme, term, weight, rank AS r FROM tr WHERE rank <= {TOP} AND term NOT IN ({", ".join(map(_quote, COMMON))})),
p AS (SELECT site, theme, max(weight) AS weight, list(term ORDER BY r) AS own, row_number() OVER (PARTITION BY site ORDER BY max(weight) DESC, min(r))::INT AS rank FROM g WHERE length(theme) >= 3 GROUP BY site, theme QUALIFY rank <= {PILLARS}),
t AS (SELECT site, rank, unnest(own) AS q FROM p),
sp AS (SELECT DISTINCT t.site, t.rank, page_id, ord, heading FROM t JOIN s ON s.site = t.site AND contains(lower(heading), q)),
su AS (SELECT site, rank, string_agg(heading, ' | ' ORDER BY page_id, ord) AS support FROM (SELECT * FROM sp QUALIFY row_number() OVER (PARTITION BY site, rank ORDER BY page_id, ord) <= {SUPPORT}) GROUP BY site, rank),
pv AS (SELECT t.site, t.rank, count(DISTINCT page_id) AS seen FROM t JOIN pg ON pg.site = t.site AND contains(lower(html), q) GROUP BY t.site, t.rank)
SELECT site, rank, theme, {_NAME} AS name, array_to_string(own, ', ') AS terms, weight, coalesce(support, '') AS support, {_fixed('coalesce(seen, 0) / n', 2)} AS prevalence
FROM p LEFT JOIN su USING (site, rank) LEFT JOIN pv USING (site, rank) JOIN (SELECT site, count(DISTINCT page_id) AS n FROM pg GROUP BY site) USING (site)"""
_TITLE = "trim(replace(replace(replace(regexp_extract(regexp_extract(html, '(?is)<head[^>]*>(.*?)(?:</head>|<body|$)', 1), '(?is)<title[^>]*>(.*?)</title>', 1), '&amp;', '&'), '&lt;', '<'), '&gt;', '>'))"
_POINTS = _fixed("(10 - 1.2 * abs(len(regexp_split_to_array(text, '\\s+')) - 7) - CASE WHEN regexp_matches(text, '[.!?]$') THEN 2 ELSE 0 END + CASE WHEN kind = 'h1' THEN 3 ELSE 0 END + CASE WHEN regexp_matches(text, '(?i)\\b(free|today|now|fastest|best|leading|all-in-one)\\b') THEN 1 ELSE 0 END)::DOUBLE", 2)
_TAGS = f"""{_UNIQUE}, hm AS (SELECT site, arg_min({_TITLE}, page_id) AS x FROM pg GROUP BY site),
hn AS (SELECT *, row_number() OVER (PARTITION BY site, level ORDER BY page_id, ord) AS n FROM u WHERE level <= 2),
ca AS (SELECT site, 200 AS ord, 'title tag' AS kind, {_DECODE} AS text, NULL::BIGINT AS page_id FROM hm UNION ALL SELECT site, level * 50 + n, 'h' || level, heading, page_id FROM hn WHERE n <= 8 AND (level = 2 OR n <= 4)),
cu AS (SELECT * FROM ca WHERE length(text) BETWEEN 8 AND 140 QUALIFY row_number() OVER (PARTITION BY site, lower(text) ORDER BY ord) = 1),
tg AS (SELECT site, row_number() OVER (PARTITION BY site ORDER BY {_POINTS} DESC, ord)::INT AS rank, text, kind, page_id, {_POINTS} AS score FROM cu QUALIFY rank <= {TAGLINES})"""
_CASES = " ".join(f"WHEN regexp_matches(t, '(?i)\\b({p})\\b') THEN {i}" for i, (_, p) in enumerate(CATEGORIES, 1))
_NAMED = "[" + ", ".join(_quote(n) for n, _ in CATEGORIES) + "]"
_HITS = ", ".join(f"sum(len(regexp_extract_all(low, '\\b({p})\\b'))) AS h{i}" for i, (_, p) in enumerate(AUDIENCES))
_MOST = "greatest(" + ", ".join(f"h{i}" for i in range(len(AUDIENCES))) + ")"
_POSITIONS = f"""WITH {_TAGS}, h1 AS (SELECT site, page_id, arg_max(heading, ord) AS h1 FROM u WHERE level = 1 GROUP BY site, page_id),
tx AS (SELECT site, coalesce(nullif({_TITLE}, ''), h1, '') AS t FROM pg LEFT JOIN h1 USING (site, page_id)),
ct AS (SELECT site, {_NAMED}[min(CASE {_CASES} END)] AS category FROM tx GROUP BY site),
au AS (SELECT site, {_HITS} FROM (SELECT site, lower({_TEXT}) AS low FROM pg) GROUP BY site),
an AS (SELECT site, CASE WHEN {_MOST} >= 3 THEN CASE {" ".join(f"WHEN h{i} = {_MOST} THEN {_quote(n)}" for i, (n, _) in enumerate(AUDIENCES))} END END AS audience FROM au)
SELECT site, category, audience, coalesce(category || ' that ', '') || lower(text[1]) || text[2:] || coalesce(', for ' || audience, '') AS statement FROM ct JOIN an USING (site) LEFT JOIN (SELECT site, text FROM tg WHERE rank = 1) USING (site)"""

ORACLES = {
    "salience": f"WITH {_TERMS} SELECT site, term, mentions, headings, weight, rank FROM tr WHERE rank <= {KEPT}",
    "pillars": _PILLARS,
    "taglines": f"WITH {_TAGS} SELECT * FROM tg",
    "headlines": f"WITH {_UNIQUE} SELECT site, row_number() OVER (PARTITION BY site ORDER BY level, page_id, ord)::INT AS rank, level, heading, page_id FROM u WHERE level <= 3 QUALIFY rank <= {HEADLINES}",
    "site_positions": _POSITIONS,
}
