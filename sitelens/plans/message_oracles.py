"""DuckDB SQL for the messaging, logo and export queries."""

from __future__ import annotations

from ..operators.crawl import ICONS
from ..operators.exports import WEIGHTS
from .oracles import _COLOUR, _HEAD, _KEEP, _NORMAL, _RANK, _ROOT, _TEXT, _fixed, _quote, _syllables

_SHORT = f"WITH {_HEAD} SELECT page_id, level, heading FROM hh WHERE words <= 3 OR regexp_matches(heading, '^(©|[0-9]{{4}})')"

_GRADE = f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
s AS (SELECT DISTINCT doc_id, s FROM (SELECT doc_id, trim(unnest(string_split(regexp_replace(text, '([.!?…])\\s+', '\\1' || chr(10), 'g'), chr(10)))) AS s FROM d) WHERE {_KEEP}),
{_syllables('s', 's')}, y AS (SELECT doc_id, sum(n) AS syllables FROM k GROUP BY doc_id), c AS (SELECT doc_id, count(*) AS sentences FROM s GROUP BY doc_id),
w2 AS (SELECT doc_id, len(list_filter(string_split(translate(text, chr(9) || chr(10) || chr(13), '   '), ' '), lambda w: w <> ''))::INT AS words FROM d)
SELECT doc_id, words, coalesce(sentences, 0)::INT AS sentences, CASE WHEN words > 0 AND sentences > 0 THEN {_fixed('0.39::DOUBLE * words / sentences + 11.8::DOUBLE * coalesce(syllables, 0) / words - 15.59::DOUBLE', 1)} END AS grade
FROM w2 LEFT JOIN c USING (doc_id) LEFT JOIN y USING (doc_id)"""

_USUAL = " UNION ALL ".join(f"SELECT root AS site, {1_000_000_000 + i} AS ord, 'https://' || root || {_quote(p)} AS url, {_quote(k)} AS kind, {s + 8}::DOUBLE AS score, NULL AS size FROM (SELECT DISTINCT root FROM u)" for i, (p, k, s) in enumerate(ICONS))
_BONUS = "CASE WHEN url LIKE '%.svg' THEN 30 WHEN url LIKE '%.ico' THEN -8 WHEN url LIKE '%.webp' THEN 4 ELSE 0 END"
_LOGOS = f"""WITH n AS ({_NORMAL}), u AS (SELECT page_id, {_ROOT} AS root FROM n WHERE s_ok),
c AS (SELECT root AS site, page_id AS ord, 'https://' || root || '/icon-' || (page_id % 5) || '.' || ['svg', 'png', 'ico', 'webp'][page_id % 4 + 1] AS url, CASE WHEN page_id % 3 = 0 THEN 'logo' ELSE 'icon' END AS kind,
  24.0::DOUBLE + page_id % 7 * 16 / 10 AS score, (16 + page_id % 7 * 16) || 'x' || (16 + page_id % 7 * 16) AS size FROM u UNION ALL {_USUAL}),
m AS (SELECT site, url, min(ord) AS ord, max(score) AS score, first(kind ORDER BY ord) AS kind, first(size ORDER BY ord) FILTER (size IS NOT NULL) AS size FROM c GROUP BY site, url)
SELECT site, url, kind, size, CASE WHEN url LIKE '%.svg' THEN 'svg' WHEN url LIKE '%.ico' THEN 'ico' WHEN url LIKE '%.webp' THEN 'webp' ELSE 'png' END AS format, score + {_BONUS} AS score,
  string_split(size, 'x')[1]::INT AS pixels, row_number() OVER (PARTITION BY site ORDER BY score + {_BONUS} DESC, ord)::INT AS rank FROM m""".replace(" WHERE s_ok", "")

_FLAG = {"has_head": 2, "has_title": 3, "has_manifest_name": 5, "has_description": 7, "has_theme": 11, "has_chrome": 13}
_FLAGS = ", ".join(f"CASE WHEN k % {n} = 0 THEN 1.0::DOUBLE ELSE 0.0 END AS {name}" for name, n in _FLAG.items())
_WHOLE = " + ".join(f"{n} * {w}::DOUBLE" for n, w in WEIGHTS.items())
_CONFIDENCE = f"""WITH b AS (SELECT p_brand AS site, count(*) AS k FROM part GROUP BY p_brand), f AS (SELECT site, k, {_FLAGS} FROM b),
s AS (SELECT site, least(1.0::DOUBLE, has_head * 0.35::DOUBLE + has_title * 0.3::DOUBLE + has_manifest_name * 0.2::DOUBLE + has_description * 0.15::DOUBLE) AS identity, (k % 10)::DOUBLE / 10 AS logos,
  CASE WHEN k % 4 > 0 THEN 0.4::DOUBLE ELSE 0.0 END + least((k % 6)::DOUBLE / 4, 1.0) * 0.35::DOUBLE + has_theme * 0.15::DOUBLE + has_chrome * 0.1::DOUBLE AS colors,
  CASE WHEN k % 4 > 0 THEN 0.35::DOUBLE ELSE 0.0 END + least((k % 5)::DOUBLE / 3, 1.0) * 0.4::DOUBLE + CASE WHEN k % 3 > 0 THEN 0.25::DOUBLE ELSE 0.0 END AS typography,
  least((k * 3)::DOUBLE / 120, 1.0) * 0.6::DOUBLE + least((k % 8)::DOUBLE / 4, 1.0) * 0.4::DOUBLE AS voice, least((k % 4)::DOUBLE / 3, 1.0) * 0.5::DOUBLE + least((k % 15)::DOUBLE / 10, 1.0) * 0.5::DOUBLE AS messaging FROM f),
w AS (SELECT *, {_WHOLE} AS whole FROM s)
SELECT site, {", ".join(f"{_fixed(f'least(1.0::DOUBLE, {n})', 2)} AS {n}" for n in WEIGHTS)}, {_fixed('whole', 2)} AS overall, CASE WHEN whole > 0.75 THEN 'high' WHEN whole > 0.5 THEN 'moderate' ELSE 'low' END AS grade FROM w"""

_TOKENS = f"""WITH {_COLOUR}, {_RANK}, p AS (SELECT p_brand AS brand, min(p_type) AS heading, max(p_type) AS body, min(p_size) AS small, max(p_size) AS large FROM part GROUP BY p_brand),
q AS (SELECT brand, unnest([{{'o': 0, 'n': 'font-heading', 'v': heading}}, {{'o': 1, 'n': 'font-body', 'v': body}}]) AS x FROM p),
z AS (SELECT brand, unnest([{{'n': 'size-small', 'v': small}}, {{'n': 'size-large', 'v': large}}]) AS x FROM p)
SELECT brand, rank::INT AS ord, 'colour' AS kind, 'shade-' || rank AS name, hex AS value, rank <= 2 AS declared FROM rk WHERE rank <= 5
UNION ALL SELECT brand, x.o, 'font', x.n, CASE WHEN contains(x.v, ' ') THEN '"' || x.v || '"' ELSE x.v END, true FROM q
UNION ALL SELECT brand, dense_rank() OVER (PARTITION BY brand ORDER BY x.v DESC)::INT, 'size', x.n, x.v || 'px', true FROM z"""

ORACLES = {"short_headings": _SHORT, "document_grade": _GRADE, "logo_rank": _LOGOS, "profile_confidence": _CONFIDENCE, "brand_tokens": _TOKENS}
