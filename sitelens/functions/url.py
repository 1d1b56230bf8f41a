"""URL algebra on columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Query keys that only track.
TRACKING = "^(utm_|ref_?(=|$)|gclid(=|$)|fbclid(=|$)|mc_[ce]id(=|$)|igshid(=|$)|msclkid(=|$)|yclid(=|$)|_ga(=|$)|s_kwcid(=|$)|vero_id(=|$)|mkt_tok(=|$))"


def host(url: Column) -> Column:
    """Lower-cased host without user and port."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)), "^[^@]*@", ""), ":[0-9]+$", "")


def normalise(url: Column) -> Column:
    """https by default, http and https only, no fragment, no tracking keys, no index page."""
    t = F.trim(url)
    full = F.when(t.rlike("(?i)^[a-z][a-z0-9+.-]*:"), t).otherwise(F.concat(F.lit("https://"), t))
    bare = F.regexp_replace(full, "#.*$", "")
    scheme, path = F.lower(F.regexp_extract(bare, "^([A-Za-z][A-Za-z0-9+.-]*)://", 1)), F.regexp_extract(bare, r"^[^:]*://[^/?]*([^?]*)", 1)
    query = F.array_join(F.filter(F.split(F.regexp_extract(bare, r"\?(.*)$", 1), "&"), lambda x: (x != "") & ~F.lower(x).rlike(TRACKING)), "&")
    clean = F.regexp_replace(F.when(path == "", F.lit("/")).otherwise(path), "(?i)/index\\.html?$", "/")
    h = host(bare)
    private = h.rlike(r"^(localhost|127\.|10\.|192\.168\.|169\.254\.|172\.(1[6-9]|2[0-9]|3[01])\.|0\.|\[)") | h.rlike(r"\.(local|internal|localhost)$") | (h == "")
    return F.when(scheme.isin("http", "https") & ~private, F.concat(scheme, F.lit("://"), h, clean, F.when(query != "", F.concat(F.lit("?"), query)).otherwise(F.lit(""))))


def root_host(h: Column) -> Column:
    """Registered domain: the last two labels, three under a second-level suffix of a country."""
    bare = F.regexp_replace(F.lower(h), r"^www[0-9]?\.", "")
    labels = F.split(bare, r"\.")
    deep = bare.rlike(r"\.(co|com|org|net|gov|edu|ac|or|ne)\.[a-z]{2}$")
    n = F.when(deep, 3).otherwise(2)
    return F.when(F.size(labels) <= n, bare).otherwise(F.array_join(F.slice(labels, F.size(labels) - n + 1, n), "."))
