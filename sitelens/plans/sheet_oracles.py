"""DuckDB SQL for the style-sheet, type and copy queries."""

from __future__ import annotations

from .oracles import _COLOUR, _LUM, _fixed, _quote

_SHEETS = """p AS (SELECT p_brand AS brand, p_partkey AS ord, string_split(p_name, ' ')[1] AS a, string_split(p_name, ' ')[2] AS b, p_size, lower(p_type) AS kind,
  printf('#%02x%02x%02x', (p_partkey * 37 % 256)::INT, (p_partkey * 91 % 256)::INT, (p_size * 5 % 256)::INT) AS hex FROM part)"""
_DEFS = _SHEETS + """, d AS (SELECT brand, ord, 0 AS pos, '--color-' || a AS name, hex AS value FROM p UNION ALL SELECT brand, ord, 1, '--' || b || '-bg', 'var(--color-' || a || ', #ffffff)' FROM p
  UNION ALL SELECT brand, ord, 2, '--' || b || '-line', 'var(--no-such, #eeeeee)' FROM p), c AS (SELECT brand, name, arg_max(value, ord * 10 + pos) AS value, count(*) AS defined FROM d GROUP BY ALL)"""
_COUNTS = {"you": "(you''re|you''ll|yourself|your|you)", "we": "(we''re|we''ll|our''s|our|we|us)", "they": "(they|their|them|customers?|users?|teams?|clients?)"}
_M = f"floor(p_size / 16.0::DOUBLE * 1000 + 0.5)"
_STOPS = " ".join(f"WHEN abs(rem - {s}::DOUBLE) < 0.3 THEN {_quote(n)}" for s, n in (("2.5", "display"), ("2", "h1"), ("1.5", "h2"), ("1.25", "h3"), ("1.125", "h4"), ("1", "body"), ("0.875", "small"), ("0.75", "caption")))

ORACLES = {
    "css_custom_properties": f"WITH {_DEFS} SELECT * FROM c",
    "css_resolved": f"WITH {_DEFS} SELECT c.brand, c.name, CASE WHEN c.value LIKE 'var(%' THEN coalesce(t.value, regexp_extract(c.value, ', (.*)[)]$', 1)) ELSE c.value END AS resolved FROM c LEFT JOIN c t ON t.brand = c.brand AND t.name = regexp_extract(c.value, '^var[(](--[a-z0-9-]+)', 1)",
    "css_colour_uses": f"WITH {_SHEETS}, l AS (SELECT brand, unnest([hex, '#ffffff', '#eeeeee', 'rgb(1, 2, 3)']) AS literal FROM p) SELECT brand, literal, count(*) AS uses FROM l GROUP BY ALL",
    "css_rank": f"WITH {_SHEETS}, u AS (SELECT brand, ord, 'https://cdn.example/' || kind || '/' || a || CASE ord % 3 WHEN 0 THEN '.css' ELSE '-theme.css?v=1' END AS url FROM p WHERE ord % 3 < 2) SELECT brand, ord, url, (CASE WHEN ord % 3 = 1 THEN 40 ELSE 0 END + greatest(0, 11 - row_number() OVER (PARTITION BY brand ORDER BY ord)))::INT AS score FROM u",
    "type_scale": f"WITH s AS (SELECT p_brand AS brand, {_M} AS m FROM part WHERE p_size / 16.0 BETWEEN 0.5 AND 6), b AS (SELECT brand, floor(m / 1000 / 0.05::DOUBLE + 0.5) AS bucket, sum(m) AS s, count(*) AS uses FROM s GROUP BY ALL), r AS (SELECT brand, {_fixed('s / uses / 1000', 2)} AS rem, uses, row_number() OVER (PARTITION BY brand ORDER BY bucket DESC)::INT AS rank FROM b) SELECT brand, rank, rem, CASE {_STOPS} ELSE rem || 'rem' END AS name, floor(rem * 16 + 0.5)::BIGINT AS px, uses FROM r WHERE rank <= 10",
    "copy_counts": "SELECT doc_id, words, you, we, they, contractions, exclamations, questions, " + _fixed("exclamations * 1000.0::DOUBLE / greatest(words, 1)", 2) + " AS exclamation_rate FROM (SELECT doc_id, len(list_filter(string_split(translate(t, chr(9) || chr(10) || chr(13), '   '), ' '), lambda w: w <> ''))::INT AS words, "
    + ", ".join(f"len(regexp_extract_all(t, '\\b{p}\\b'))::INT AS {n}" for n, p in _COUNTS.items())
    + r", len(regexp_extract_all(t, '\b\w+''(s|t|re|ll|ve|d|m)\b'))::INT AS contractions, len(regexp_extract_all(t, '!'))::INT AS exclamations, len(regexp_extract_all(t, '\?'))::INT AS questions FROM (SELECT doc_id, lower(coalesce(text, '')) AS t FROM documents))",
    "colour_print": f"WITH {_COLOUR} SELECT ord, " + ", ".join(f"CASE WHEN hi < 0.255 THEN 0 ELSE floor((hi - {x}) * 100 / hi + 0.5) END::INT AS {n}" for n, x in zip("cmy", "rgb")) + f", CASE WHEN hi < 0.255 THEN 100 ELSE floor((255 - hi) * 100 / 255 + 0.5) END::INT AS k, CASE WHEN {_LUM} > 0.42 THEN '#000000' ELSE '#ffffff' END AS ink FROM x",
    "palette_split": f"WITH {_COLOUR}, d AS (SELECT DISTINCT brand, hex, hi - lo >= 18 AND (hi + lo) / 510 > 0.05 AND (hi + lo) / 510 < 0.95 AS colourful FROM x) SELECT brand, count(*) FILTER (colourful) AS colourful, count(*) FILTER (NOT colourful) AS neutral, count(*) AS distinct_colours FROM d GROUP BY brand",
}
