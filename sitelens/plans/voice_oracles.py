"""DuckDB SQL for the tone and contrast queries."""

from __future__ import annotations

from ..functions.text import LEXICONS
from ..operators.voice import BANDS
from .oracles import _COLOUR, _LUM, _RANK, _count, _fixed, _quote
from .sheet_oracles import _COUNTS


def _axis(x: str) -> str:
    return _fixed(f"least(1.0::DOUBLE, greatest(0.0::DOUBLE, {x}))", 3)


_TONE = (
    "WITH t AS (SELECT doc_id, lower(coalesce(text, '')) AS t FROM documents), d AS (SELECT doc_id, len(list_filter(string_split(translate(t, chr(9) || chr(10) || chr(13), '   '), ' '), lambda w: w <> ''))::DOUBLE AS words, "
    + ", ".join(f"len(regexp_extract_all(t, '\\b{p}\\b'))::DOUBLE AS {n}" for n, p in _COUNTS.items())
    + ", len(regexp_extract_all(t, '!'))::DOUBLE AS marks, "
    + ", ".join(f"({_count('t', LEXICONS[n])})::DOUBLE AS {n}" for n in ("hedges", "power", "formality", "casual", "jargon"))
    + " FROM t), r AS (SELECT *, greatest(1.0::DOUBLE, words / 250) AS scale, hedges * 1000 / greatest(words, 1) AS h, power * 1000 / greatest(words, 1) AS p FROM d), a AS (SELECT doc_id, "
    + f"{_axis('formality / (scale * 2 + 1)')} AS formality, {_axis('marks * 1000 / greatest(words, 1) / 2')} AS enthusiasm, {_axis('casual / (scale + 1)')} AS playfulness, {_axis('you / greatest(1, you + we + they)')} AS warmth, {_axis('1 - h / 60')} AS assertiveness, {_axis('p / (p + h + 6)')} AS confidence, {_axis('jargon / scale / 8')} AS technicality FROM r)"
)
_BAND = ", ".join(f"CASE WHEN {a} < {low}::DOUBLE THEN {_quote(n[0])} WHEN {a} > {high}::DOUBLE THEN {_quote(n[2])} ELSE {_quote(n[1])} END AS {a}" for a, low, high, n in BANDS)

ORACLES = {
    "tone_axes": _TONE + " SELECT * FROM a",
    "tone_bands": _TONE + f", b AS (SELECT {_BAND} FROM a) SELECT *, count(*) AS documents FROM b GROUP BY ALL",
    "contrast_matrix": f"WITH {_COLOUR}, {_RANK}, l AS (SELECT DISTINCT brand, hex, {_LUM} AS lum FROM x), k4 AS (SELECT brand, hex, rank, lum FROM rk JOIN l USING (brand, hex) WHERE rank <= 4), p AS (SELECT a.brand, a.hex AS front, b.hex AS back, {_fixed('(greatest(a.lum, b.lum) + 0.05::DOUBLE) / (least(a.lum, b.lum) + 0.05::DOUBLE)', 2)} AS ratio FROM k4 a JOIN k4 b ON a.brand = b.brand AND a.rank < b.rank) SELECT *, CASE WHEN ratio >= 7 THEN 'AAA' WHEN ratio >= 4.5 THEN 'AA' WHEN ratio >= 3 THEN 'AA Large' ELSE 'Fail' END AS grade FROM p",
}
