"""DuckDB SQL for the names of sites. The given pages have no metas but a character set, so those sources are left out here."""

from __future__ import annotations

from ..operators.names import HEADING_WORDS, LONGEST, TEXT, WORDS
from .oracles import _NORMAL

_H = " ".join(f"<h{k}[^>]*>.*?</h{k}>|" for k in (1, 2, 3)).replace(" ", "")[:-1]
_CLEAN = r"regexp_replace(regexp_replace(v, '^[\"''`]|[\"''`]$', '', 'g'), '\s+(inc|llc|ltd|limited|gmbh|plc|corp|corporation)\.?$', '', 'i')"
_DECODE = "x"
for _ref, _to in (("&amp;", "'&'"), ("&lt;", "'<'"), ("&gt;", "'>'"), ("&quot;", "'\"'"), ("&#39;|&apos;", "''''"), ("&nbsp;", "' '")):
    _DECODE = f"regexp_replace({_DECODE}, '{_ref}', {_to}, 'gi')"
_DECODE = f"trim(regexp_replace({_DECODE}, '\\s+', ' ', 'g'))"


def _written(needle: str) -> str:
    return f"trim(regexp_extract(plain, '(?is)((?:^|[^\\w.-])' || regexp_escape({needle}) || ')(?:$|[^\\w-])', 1))"


_SITE_NAMES = f"""WITH n AS ({_NORMAL}), f AS (SELECT host, arg_min(html, page_id) AS html FROM n GROUP BY host),
b AS (SELECT host, html, regexp_replace(host, '^www\\d?\\.', '') AS bare, substr(regexp_replace(html, '<[^>]+>', ' ', 'g'), 1, {TEXT}) AS plain FROM f),
l AS (SELECT *, string_split(bare, '.')[1] AS label FROM b),
hs AS (SELECT host, label, unnest(list_transform(regexp_extract_all(html, '(?is){_H}'), lambda x: regexp_replace(x, '<[^>]+>', ' ', 'g'))) AS x, generate_subscripts(regexp_extract_all(html, '(?is){_H}'), 1) AS i FROM l),
ht AS (SELECT host, label, i, {_DECODE} AS t FROM hs),
hn AS (SELECT host, arg_min(t, i) AS heading FROM ht WHERE length(t) BETWEEN 2 AND {LONGEST} AND len(string_split(t, ' ')) <= {HEADING_WORDS}
  AND NOT regexp_matches(t, '(?i)^(welcome|home|sign in|log in|search|menu|404|page not found)$') AND NOT (len(string_split(t, ' ')) > 1 AND lower(string_split(t, ' ')[-1]) = lower(label)) GROUP BY host),
tt AS (SELECT host, replace(replace(replace(trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)), '&amp;', '&'), '&lt;', '<'), '&gt;', '>') AS x FROM l),
tn AS (SELECT host, trim(regexp_replace(x, '(\\s+[|–—·:]\\s+|\\s+-\\s+)(.|\\n)*$', '')) AS title FROM tt),
v AS (SELECT l.host, coalesce(nullif({_written('bare')}, ''), nullif(CASE WHEN length(label) >= 2 THEN {_written('label')} END, '')) AS written, heading,
  CASE WHEN title <> '' AND length(title) <= {LONGEST} AND NOT regexp_matches(title, '(?i)^(home|welcome|coming soon|page not found|404|redirecting|official)\\b') THEN title END AS title, regexp_replace(l.host, '^www\\.', '') AS domain
  FROM l LEFT JOIN hn USING (host) LEFT JOIN tn USING (host)),
c AS (SELECT host, list_filter([{{'v': written, 's': 'the domain, as the site writes it'}}, {{'v': heading, 's': 'a page heading'}}, {{'v': title, 's': 'title tag'}}, {{'v': domain, 's': 'domain name'}}], lambda e: e.v IS NOT NULL AND e.v <> '') AS every FROM v),
e AS (SELECT host, every, list_transform(every, lambda e: {{'c': trim(regexp_replace({_CLEAN.replace('(v,', '(e.v,')}, '\\s+', ' ', 'g')), 's': e.s}}) AS clean FROM c),
p AS (SELECT host, every, coalesce(list_filter(clean, lambda e: len(string_split(e.c, ' ')) <= {WORDS})[1], clean[1]) AS best FROM e)
SELECT host AS site, best.c AS name, best.s AS basis, array_to_string(list_transform(every, lambda e: e.s || '=' || e.v), '; ') AS candidates FROM p"""

_FAULTS = f"""WITH names AS ({_SITE_NAMES}), n AS ({_NORMAL}),
f AS (SELECT host, arg_min(normal, page_id) AS url, lower(regexp_extract(arg_min(html, page_id), '(?i)<html[^>]* lang="([^"]*)"', 1)) AS lang, count(DISTINCT page_id) AS k, min(page_id) AS low, max(page_id) AS high FROM n GROUP BY host)
SELECT host, '$.identity' AS path, '$.identity.legalName: required property is missing' AS fault FROM f
UNION ALL SELECT host, '$.identity.url', '$.identity.url: "' || url || '" does not match ^https://' FROM f WHERE NOT starts_with(url, 'https://')
UNION ALL SELECT host, '$.lang', '$.lang: "' || lang || '" is not one of ["en","de"]' FROM f WHERE lang NOT IN ('en', 'de')
UNION ALL SELECT host, '$.pages', '$.pages: needs at least 2 item(s)' FROM f WHERE low = high
UNION ALL SELECT host, '$.pages[0]', '$.pages[0]: 0 < minimum 1' FROM f WHERE low = 0"""

ORACLES = {"site_names": _SITE_NAMES, "guide_faults": _FAULTS}
