"""DuckDB SQL for the font, budget and export queries."""

from __future__ import annotations

from ..operators.faces import AUDIENCES
from .oracles import _COLOUR, _RANK, _fixed, _quote

_P = "p AS (SELECT p_brand AS brand, p_partkey AS ord, p_size % 10 AS t, upper(p_type[1]) || lower(p_type[2:]) || ' Grotesk' AS family FROM part)"
_TOP = "greatest(" + ", ".join(f"h{i}" for i in range(len(AUDIENCES))) + ")"

ORACLES = {
    "font_faces": f"WITH {_P} SELECT brand, ord, family, CASE WHEN ord % 4 = 0 THEN '100 900' ELSE '700' END AS weight, 'normal' AS style, 'woff2 woff' AS formats, ord % 4 = 0 AS variable FROM p WHERE ord % 2 = 0",
    "font_families": f"WITH {_P}, e AS (SELECT brand, family, 3 AS n, true AS face FROM p WHERE ord % 2 = 0 UNION ALL SELECT brand, family, 1, false FROM p UNION ALL SELECT brand, 'JetBrains Mono', 1, false FROM p), g AS (SELECT brand, family AS shown, sum(n)::BIGINT AS points, bool_or(face) AS webfont FROM e GROUP BY ALL), "
    f"s AS (SELECT *, {_fixed('points / max(points) OVER (PARTITION BY brand)', 3)} AS share FROM g) SELECT brand, shown, points, webfont, share, {_fixed('least(1.0::DOUBLE, CASE WHEN webfont THEN 0.8::DOUBLE ELSE 0.2::DOUBLE END + points / 20.0::DOUBLE)', 3)} AS confidence, CASE WHEN shown LIKE '%Mono' THEN 'mono' ELSE 'sans' END AS kind, row_number() OVER (PARTITION BY brand ORDER BY points DESC, lower(shown))::INT AS rank FROM s WHERE webfont OR share >= 0.5 QUALIFY rank <= 8",
    "type_detail": f"WITH {_P} SELECT brand, {_fixed('-sum(t * 10) / count(*) / 1000.0::DOUBLE', 3)} AS letter_spacing, {_fixed('sum(1000 + t * 10) / count(*) / 1000.0::DOUBLE', 2)} AS line_height, count(*) FILTER (ord % 3 = 0) AS uppercase FROM p GROUP BY brand",
    "page_budget": "WITH n AS (SELECT event_id, CASE WHEN event_id % 5 = 0 THEN 14 ELSE least(24, greatest(4, trunc(value))) END::INT AS pages FROM events) SELECT event_id, pages, CASE WHEN pages <= 6 THEN 3 WHEN pages <= 12 THEN 4 ELSE 5 END AS pillars FROM n",
    "export_tokens_json": f"WITH {_COLOUR}, {_RANK} SELECT brand, '{{\"color\":{{' || string_agg('\"' || rank || '\":{{\"value\":\"' || hex || '\"}}', ',' ORDER BY rank) || '}}}}' AS json FROM rk WHERE rank <= 5 GROUP BY brand",
    "swatch_grid": f"WITH {_COLOUR}, {_RANK} SELECT brand, hex, 32 + (rank - 1) % 4 * 184 AS x, 96 + (rank - 1) // 4 * 132 AS y FROM rk",
    "reply_json": "SELECT event_id, CASE WHEN event_id % 4 <> 0 THEN CAST(json_extract_string(props, '$.k') AS BIGINT) END AS k FROM events",
    "audience": "WITH h AS (SELECT source, " + ", ".join(f"sum(len(regexp_extract_all(lower(coalesce(text, '')), {_quote(chr(92) + 'b(' + p + ')' + chr(92) + 'b')})))::BIGINT AS h{i}" for i, (_, p) in enumerate(AUDIENCES)) + f" FROM documents GROUP BY source) SELECT source, CASE WHEN {_TOP} >= 3 THEN CASE " + " ".join(f"WHEN h{i} = {_TOP} THEN {_quote(n)}" for i, (n, _) in enumerate(AUDIENCES)) + f" END END AS audience, {_TOP} AS hits FROM h",
}
