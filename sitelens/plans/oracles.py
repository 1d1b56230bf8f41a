"""DuckDB SQL for the registered queries, written apart from the Spark expressions."""

from __future__ import annotations

from ..functions.text import BOILERPLATE, LEXICONS
from ..operators.profile import NAVIGATION


def _fixed(x: str, n: int) -> str:
    return f"floor(({x}) * 1e{n} + 0.5) / 1e{n}"


def _quote(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


_TEXT = "html"
for _tag in ("script", "style", "nav", "header", "footer", "aside"):
    _TEXT = f"regexp_replace({_TEXT}, '<{_tag}.*?</{_tag}>', ' ', 'gis')"
_TEXT = f"regexp_replace({_TEXT}, '<[^>]+>', ' ', 'g')"
for _ref, _to in (("&nbsp;", "' '"), ("&amp;", "'&'"), ("&lt;", "'<'"), ("&gt;", "'>'"), ("&#39;|&apos;", "''''"), ("&quot;", "'\"'"), ("&#8217;|&rsquo;", "''''"), ("&#8211;|&ndash;", "'-'"), ("&#8212;|&mdash;", "'—'"), ("&#[0-9]+;", "' '")):
    _TEXT = f"regexp_replace({_TEXT}, '{_ref}', {_to}, 'gi')"
_TEXT = f"trim(regexp_replace(regexp_replace({_TEXT}, '[ \\t]+', ' ', 'g'), '\\n{{3,}}', chr(10) || chr(10), 'g'))"

_HOST = "regexp_replace(regexp_replace(lower(regexp_extract({u}, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)), '^[^@]*@', ''), ':[0-9]+$', '')"
_NORMAL = r"""SELECT page_id, html, s || '://' || h || regexp_replace(CASE WHEN p = '' THEN '/' ELSE p END, '/index\.html?$', '/', 'i') || CASE WHEN q <> '' THEN '?' || q ELSE '' END AS normal, h AS host FROM (
  SELECT page_id, html, lower(regexp_extract(b, '^([A-Za-z]+)://', 1)) AS s, regexp_extract(b, '^[^:]*://[^/?]*([^?]*)', 1) AS p, """ + _HOST.format(u="b") + r""" AS h,
    array_to_string(list_filter(string_split(regexp_extract(b, '\?(.*)$', 1), '&'), lambda x: x <> '' AND NOT regexp_matches(lower(x), '^(utm_|ref_?(=|$)|gclid(=|$)|fbclid(=|$)|mc_[ce]id(=|$)|igshid(=|$)|msclkid(=|$)|yclid(=|$)|_ga(=|$)|s_kwcid(=|$)|vero_id(=|$)|mkt_tok(=|$))')), '&') AS q
  FROM (SELECT page_id, html, regexp_replace(trim(url), '#.*$', '') AS b FROM pages))"""
_ROOT = r"""CASE WHEN regexp_matches(host, '\.(co|com|org|net|gov|edu|ac|or|ne)\.[a-z]{2}$') THEN regexp_extract(host, '([^.]+\.[^.]+\.[^.]+)$', 1) WHEN host LIKE '%.%' THEN regexp_extract(host, '([^.]+\.[^.]+)$', 1) ELSE host END"""
_KEEP = "length(s) BETWEEN 28 AND 320 AND regexp_matches(s, '[A-Za-z]') AND contains(s, ' ') AND length(regexp_replace(s, '[^.!?]', '', 'g')) <= 2 AND regexp_matches(s, '^[A-Z0-9\"'']') AND NOT (" + " OR ".join(f"contains(lower(s), {_quote(m)})" for m in BOILERPLATE) + ")"
_PAGES = f"n AS ({_NORMAL}), t AS (SELECT page_id, {_ROOT} AS host, {_TEXT} AS t FROM n), s AS (SELECT DISTINCT page_id, s FROM (SELECT page_id, trim(unnest(string_split(regexp_replace(t, '([.!?…])\\s+', '\\1' || chr(10), 'g'), chr(10)))) AS s FROM t) WHERE {_KEEP})"


def _count(text: str, terms: list[str]) -> str:
    return " + ".join(f"len(regexp_extract_all(lower({text}), {_quote(t if ' ' in t else chr(92) + 'b' + t + chr(92) + 'b')}))" for t in terms)


def _syllables(table: str, text: str) -> str:
    """k: estimated syllables of each word of each document."""
    return (
        f"w AS (SELECT doc_id, replace(unnest(regexp_extract_all(lower({text}), '[a-z'']+')), '''', '') AS w FROM {table}), "
        "k AS (SELECT doc_id, CASE WHEN length(w) <= 3 THEN 1 ELSE greatest(1, len(regexp_extract_all(regexp_replace(regexp_replace(w, '([^laeiouy]es|ed|[^laeiouy]e)$', ''), '^y', ''), '[aeiouy]{1,2}'))) END AS n FROM w WHERE w <> '')"
    )


_COLOUR = "c AS (SELECT p_brand AS brand, p_partkey AS ord, (p_partkey * 37 % 256)::DOUBLE AS r, (p_partkey * 91 % 256)::DOUBLE AS g, (p_size * 5 % 256)::DOUBLE AS b FROM part), x AS (SELECT *, greatest(r, g, b) AS hi, least(r, g, b) AS lo, printf('#%02x%02x%02x', r::INT, g::INT, b::INT) AS hex FROM c)"
_SAT = "CASE WHEN hi = lo THEN 0 ELSE (hi / 255.0 - lo / 255.0) / (1 - abs(hi / 255.0 + lo / 255.0 - 1)) END"


def _linear(c: str) -> str:
    return f"CASE WHEN {c} / 255.0 <= 0.03928 THEN {c} / 255.0 / 12.92 ELSE pow(({c} / 255.0 + 0.055) / 1.055, 2.4) END"


_LUM = f"(0.2126 * ({_linear('r')}) + 0.7152 * ({_linear('g')}) + 0.0722 * ({_linear('b')}))"
_RATIO = _fixed(f"1.05 / ({_LUM} + 0.05)", 2)
_HUE = "CASE WHEN hi = lo THEN 0 WHEN hi = r THEN CASE WHEN g >= b THEN 60.0 * (g - b) / (hi - lo) ELSE 60.0 * (g - b) / (hi - lo) + 360 END WHEN hi = g THEN 60.0 * (b - r) / (hi - lo) + 120 ELSE 60.0 * (r - g) / (hi - lo) + 240 END"
_RANK = f"g AS (SELECT brand, hex, count(*) AS uses, min(ord) AS f, any_value({_SAT} <= 0.14) AS neutral FROM x GROUP BY ALL), k AS (SELECT brand, hex, uses, f, {_fixed('least(60.0, 60 * (uses / max(uses) OVER (PARTITION BY brand)) * CASE WHEN neutral THEN 0.3 ELSE 1.0 END)', 3)} AS score FROM g), rk AS (SELECT brand, hex, uses, score, row_number() OVER (PARTITION BY brand ORDER BY score DESC, f)::INT AS rank FROM k)"


def _sets(source: str, col: str) -> str:
    return f"""WITH t AS (SELECT DISTINCT p_brand AS brand, {source} AS {col} FROM part), m AS (SELECT {col} FROM t WHERE brand = (SELECT min(brand) FROM t)),
j AS (SELECT t.brand, count(*) AS n, count(m.{col}) AS common FROM t LEFT JOIN m USING ({col}) WHERE t.brand <> (SELECT min(brand) FROM t) GROUP BY t.brand)
SELECT brand, {_fixed('common / (n + (SELECT count(*) FROM m) - common)', 2)} AS jaccard, common::INT AS shared, ((SELECT count(*) FROM m) - common)::INT AS only_subject FROM j"""


_HEAD = (
    r"h AS (SELECT page_id, substr(h, 3, 1)::INT AS level, trim(regexp_replace(regexp_replace(h, '<[^>]+>', ' ', 'g'), '[ \t\r\n]+', ' ', 'g')) AS heading FROM (SELECT page_id, unnest(regexp_extract_all(html, "
    + "'(?is)" + "|".join(f"<h{k}[^>]*>.*?</h{k}>" for k in range(1, 7)) + "')) AS h FROM pages)), "
    + f"hh AS (SELECT page_id, level, heading, len(string_split(heading, ' '))::INT AS words FROM h WHERE length(heading) BETWEEN 4 AND 220 AND len(string_split(heading, ' ')) <= 24 AND NOT regexp_matches(heading, '(?i)^{NAVIGATION}') AND regexp_matches(heading, '[A-Za-z0-9_]'))"
)

ORACLES = {
    "page_voice_profile": f"WITH {_PAGES}, m AS (SELECT page_id, count(*) AS n, sum(len(list_filter(string_split(s, ' '), lambda x: x <> '')))::DOUBLE / count(*) AS l FROM s GROUP BY page_id HAVING count(*) >= 3), "
    f"v AS (SELECT host, n, len(list_filter(regexp_split_to_array(t, '[ \\t\\r\\n]+'), lambda x: x <> '')) AS words, {_fixed('least(1.0, greatest(0.0, 1 - (l - 9) / 26.0))', 3)} AS d, {_count('t', LEXICONS['hedges'])} AS hits FROM m JOIN t USING (page_id)), "
    f"a AS (SELECT *, {_fixed('least(1.0, greatest(0.0, 1 - ' + _fixed('hits * 1000.0 / greatest(words, 1)', 2) + ' / 60.0))', 3)} AS a FROM v) "
    f"SELECT host, count(*) AS pages, sum(n)::BIGINT AS sentences, sum(words)::BIGINT AS words, {_fixed('sum(d * n) / sum(n)', 3)} AS directness, {_fixed('sum(a * n) / sum(n)', 3)} AS assertiveness, {_fixed('stddev_pop(d)', 3)} AS spread FROM a GROUP BY host",
    "url_normalise": f"SELECT page_id, normal, host, {_ROOT.replace('host', 'regexp_replace(host, $$^www[0-9]?[.]$$, $$$$)')} AS root FROM ({_NORMAL})",
    "root_host_pages": f"SELECT {_ROOT} AS root, count(*) AS pages, min(page_id) AS first_page FROM ({_NORMAL}) GROUP BY 1",
    "html_text_stats": f"WITH {_PAGES} SELECT t.page_id, length(t)::INT AS chars, count(s.s)::INT AS sentences FROM t LEFT JOIN s USING (page_id) GROUP BY t.page_id, t.t",
    "lexicon_counts": "SELECT source, " + ", ".join(f"sum({_count('text', terms)})::BIGINT AS {name}" for name, terms in LEXICONS.items()) + " FROM documents GROUP BY source",
    "syllable_counts": f"WITH {_syllables('documents', 'text')} SELECT d.doc_id, coalesce(sum(n), 0)::BIGINT AS syllables FROM documents d LEFT JOIN k USING (doc_id) GROUP BY d.doc_id",
    "headings": f"WITH {_HEAD} SELECT * FROM hh",
    "tagline_score": f"WITH {_HEAD} SELECT page_id, heading, " + _fixed(r"(10 - 1.2 * abs(words - 7) - CASE WHEN regexp_matches(heading, '[.!?]$') THEN 2 ELSE 0 END + 3 + CASE WHEN regexp_matches(lower(heading), '\b(free|today|now|fastest|best|leading|all-in-one)\b') THEN 1 ELSE 0 END)::DOUBLE", 2) + " AS score FROM hh",
    "evidence": "SELECT item_id, count(*) AS docs FROM benchmark b JOIN documents d ON contains(lower(d.text), lower(substr(b.text, 1, 40))) GROUP BY item_id",
    "call_log_rollup": f"SELECT user_id AS run, count(*) AS calls, count(DISTINCT event_type) AS surfaces, {_fixed('sum(value)', 2)} AS total_ms, sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END)::BIGINT AS failed FROM events GROUP BY user_id",
    "manifest_parse": "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events",
    "colour_describe": f"WITH {_COLOUR} SELECT brand, ord, hex, {_fixed(_HUE, 1)} AS hue, {_fixed(_SAT, 3)} AS saturation, {_fixed('(hi + lo) / 510.0', 3)} AS lightness, hi - lo AS chroma, {_fixed(_LUM, 4)} AS luminance, {_RATIO} AS contrast, CASE WHEN {_RATIO} >= 7 THEN 'AAA' WHEN {_RATIO} >= 4.5 THEN 'AA' WHEN {_RATIO} >= 3 THEN 'AA Large' ELSE 'Fail' END AS grade, (299 * r + 587 * g + 114 * b) / 1000 > 150 AS light FROM x",
    "colour_parse": f"WITH {_COLOUR} SELECT ord, r AS hex_r, g AS hex_g, b AS hex_b, r AS fn_r, g AS fn_g, b AS fn_b, 1.0::DOUBLE AS alpha FROM x",
    "colour_mix": f"WITH {_COLOUR} SELECT ord, printf('#%02x%02x%02x', floor(r * 0.75 + 63.75 + 0.5)::INT, floor(g * 0.75 + 63.75 + 0.5)::INT, floor(b * 0.75 + 63.75 + 0.5)::INT) AS mixed FROM x",
    "palette_rank": f"WITH {_COLOUR}, {_RANK} SELECT * FROM rk",
    "font_jaccard": _sets("p_type", "family"),
    "term_overlap": _sets("unnest(string_split(p_name, ' '))", "term"),
    "crowded_terms": "WITH t AS (SELECT DISTINCT p_brand AS brand, unnest(string_split(p_name, ' ')) AS term FROM part) SELECT term, count(*) AS brands FROM t GROUP BY term HAVING count(*) >= ceil((SELECT count(DISTINCT brand) FROM t) / 2)",
    "owned_terms": "WITH t AS (SELECT DISTINCT p_brand AS brand, unnest(string_split(p_name, ' ')) AS term FROM part), n AS (SELECT term, count(*) AS c FROM t GROUP BY term) SELECT term, brand FROM t JOIN n USING (term) WHERE c < ceil((SELECT count(DISTINCT brand) FROM t) / 2)",
    "tone_cosine": f"WITH v AS (SELECT label, i, avg(x::DOUBLE) AS x FROM (SELECT label, unnest(embedding) AS x, unnest(range(len(embedding))) AS i FROM embeddings) GROUP BY ALL), b AS (SELECT i, x AS y FROM v WHERE label = (SELECT min(label) FROM v)) SELECT label, {_fixed('1 - sum(x * y) / sqrt(sum(x * x) * sum(y * y))', 3)} + 0.0 AS distance FROM v JOIN b USING (i) GROUP BY label",
    "export_css": f"WITH {_COLOUR}, {_RANK} SELECT brand, ':root {{' || chr(10) || string_agg('  --color-' || rank || ': ' || hex || ';', chr(10) ORDER BY rank) || chr(10) || '}}' AS css FROM rk WHERE rank <= 5 GROUP BY brand",
    "css_tokens": f"WITH {_COLOUR}, {_RANK} SELECT brand, '--color-' || rank AS name, hex AS value FROM rk WHERE rank <= 5",
    "topn_per_group": "SELECT * FROM (SELECT p_brand, p_partkey, p_retailprice, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey)::INT AS rank FROM part) WHERE rank <= 3",
}
