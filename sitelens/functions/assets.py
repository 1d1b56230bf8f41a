"""Columns over failures, links, names, images and SVG sources."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import colour as C
from .url import host, root_host

#: What each failure code means to a reader.
MESSAGES = {
    "target_http_error": "The site returned an error status. It may be blocking automated requests.",
    "page_not_found": "That page does not exist (404).",
    "target_unreachable": "The site could not be reached — DNS, TLS, or the connection was refused.",
    "timeout": "The page took too long to load and the request timed out.",
    "bot_blocked": "The site is behind bot protection (Cloudflare, Incapsula) and served a challenge.",
    "empty_content": "The page loaded but no readable text was found. It may be a canvas-only or image-only page.",
    "login_required": "The page sits behind a login or account wall, so it cannot be read anonymously.",
    "content_too_large": "The document exceeds the 20MB size limit.",
    "invalid_url": "The URL was rejected as unsafe (private IP, invalid scheme, or disallowed host).",
    "invalid_redirect_url": "The site redirected to a URL that was rejected as unsafe.",
    "proxy_error": "The proxy tunnel failed. The site may still be reachable directly.",
    "conditional_unsupported": "That page needs full browser rendering, so conditional requests are not supported.",
    "selector_not_matched": "None of the CSS selectors matched anything on that page.",
    "selector_unsupported": "CSS selectors cannot be applied to this kind of document.",
}
#: What failures of the caller's key or connection mean, in words of our own.
CALLER_MESSAGES = {
    "MISSING_API_KEY": "No key for the fetch service was given.",
    "INVALID_API_KEY": "The fetch service rejected the key; with a bad key every site looks unreadable.",
    "NETWORK_ERROR": "The request to the fetch service could not be completed.",
    "UPSTREAM_TIMEOUT": "The request to the fetch service timed out. Try again, or read fewer pages.",
    "HTTP_401": "The fetch service rejected the key (401).",
    "HTTP_403": "The fetch service refused the key (403). It may lack access to this kind of call.",
    "HTTP_429": "The fetch service's rate limit was reached (429). Wait a moment and try again.",
}
#: Codes by which no site at all could be read.
REQUEST_LEVEL = ("MISSING_API_KEY", "INVALID_API_KEY", "HTTP_401", "HTTP_403", "HTTP_429", "NETWORK_ERROR", "UPSTREAM_TIMEOUT", "ECONNREFUSED", "ENOTFOUND")
#: Image endings, their format and what the format adds to a logo's score.
FORMATS = ((".svg", "svg", 30), (".png", "png", 0), (".ico", "ico", -8), (".jpg", "jpg", -6), (".jpeg", "jpeg", -6), (".webp", "webp", 4), (".gif", "gif", -4))
#: Elements that no drawing may bring along.
FORBIDDEN = ("script", "foreignobject", "iframe", "object", "embed", "audio", "video", "animate", "animatetransform", "animatemotion", "set", "handler", "listener")
SVG_CHARS = 120_000


def is_request_level(code: Column) -> Column:
    """Whether a failure concerns the caller's connection and no single site."""
    return F.upper(F.coalesce(code, F.lit(""))).isin(*REQUEST_LEVEL)


def explain_error(code: Column, url: Column, status: Column) -> Column:
    """A sentence for a code, with address and status in brackets where they are known."""
    base = F.coalesce(F.create_map(*[F.lit(x) for kv in (MESSAGES | CALLER_MESSAGES).items() for x in kv])[F.coalesce(code, F.lit(""))], F.lit("That URL could not be read."))
    bits = F.array_compact(F.array(F.when(url != "", url), F.when(status > 0, F.concat(F.lit("HTTP "), status.cast("string")))))
    return F.concat(base, F.when(F.size(bits) > 0, F.concat(F.lit(" ("), F.array_join(bits, " · "), F.lit(")"))).otherwise(F.lit("")))


def same_site(a: Column, b: Column) -> Column:
    """Whether two addresses have one registered domain."""
    return F.coalesce(root_host(host(a)) == root_host(host(b)), F.lit(False))


def short_host(url: Column) -> Column:
    """The host without www."""
    return F.regexp_replace(host(url), r"^www\.", "")


def origin(url: Column) -> Column:
    """Scheme and authority, null for what is no http address."""
    found = F.regexp_extract(url, r"(?i)^(https?://[^/?#]+)", 1)
    return F.when(found != "", F.lower(found))


def resolve_url(base: Column, link: Column) -> Column:
    """A link as an absolute address: with a scheme, //host, /path, ?query, or relative to the base's folder with its dots taken out."""
    bare = F.regexp_replace(base, "[?#].*$", "")
    scheme = F.regexp_extract(bare, "^([A-Za-z][A-Za-z0-9+.-]*):", 1)
    root = F.regexp_extract(bare, "^([A-Za-z][A-Za-z0-9+.-]*://[^/]*)", 1)
    folder = F.regexp_replace(F.substring(bare, F.length(root) + 1, F.length(bare)), "[^/]*$", "")
    parts = F.split(F.concat(F.when(folder == "", F.lit("/")).otherwise(folder), F.regexp_replace(link, "[?#].*$", "")), "/")
    step = lambda a, x: F.when(x == "..", F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(1)))).when(x == ".", a).otherwise(F.concat(a, F.array(x)))
    path = F.array_join(F.aggregate(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), F.array(F.lit("")), step), "/")
    tail = F.regexp_extract(link, "([?#].*)$", 1)
    return (
        F.when(link.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), link)
        .when(link.startswith("//"), F.concat(scheme, F.lit(":"), link))
        .when(link.startswith("/"), F.concat(root, link))
        .when(link.startswith("?") | link.startswith("#") | (link == ""), F.concat(bare, link))
        .otherwise(F.concat(root, path, tail))
    )


def decode_entities(text: Column) -> Column:
    """The named references of headings; unknown numeric ones are dropped, blanks collapsed."""
    t = text
    for ref, to in (("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;|&apos;", "'"), ("&#8217;|&rsquo;", "'"), ("&nbsp;", " "), ("&#[0-9]+;", "")):
        t = F.regexp_replace(t, f"(?i){ref}", to)
    return F.trim(F.regexp_replace(t, r"\s+", " "))


def xml_escape(text: Column) -> Column:
    """Text for an XML attribute or element."""
    t = text
    for raw, ref in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        t = F.replace(t, F.lit(raw), F.lit(ref))
    return t


def capitalise(text: Column) -> Column:
    """First character in upper case."""
    return F.concat(F.upper(F.substring(text, 1, 1)), F.substring(text, 2, 1 << 30))


def title_case(text: Column) -> Column:
    """Each run of word characters begins in upper case, after a hyphen too."""
    runs = F.regexp_extract_all(text, F.lit("([A-Za-z0-9_]+|[^A-Za-z0-9_]+)"), 1)
    return F.array_join(F.transform(runs, capitalise), "")


def quote_font(family: Column) -> Column:
    """A family name, in quotes if it holds a blank."""
    return F.when(family.rlike(r"\s"), F.concat(F.lit('"'), family, F.lit('"'))).otherwise(family)


def clean_name(name: Column) -> Column:
    """A company's name without quotes and legal form; ``Unknown`` if nothing is left."""
    bare = F.regexp_replace(F.coalesce(name, F.lit("")), "^[\"'`]|[\"'`]$", "")
    bare = F.trim(F.regexp_replace(F.regexp_replace(bare, r"(?i)\s+(inc|llc|ltd|limited|gmbh|plc|corp|corporation)\.?$", ""), r"\s+", " "))
    return F.when(bare == "", F.lit("Unknown")).otherwise(bare)


def image_format(url: Column) -> Column:
    """(format, bonus) by the address's ending; png where none is known."""
    low = F.lower(F.regexp_replace(url, r"[?#].*$", ""))
    out = F.struct(F.lit("png").alias("format"), F.lit(0).alias("bonus"))
    for ending, name, bonus in reversed(FORMATS):
        out = F.when(low.endswith(ending), F.struct(F.lit(name).alias("format"), F.lit(bonus).alias("bonus"))).otherwise(out)
    return out


def largest_side(sizes: Column) -> Column:
    """The largest side in a declared size such as ``16x16 32x32``; null without one."""
    sides = F.regexp_extract_all(F.regexp_replace(sizes, "([0-9]{2,4})x([0-9]{2,4})", "<$1><$2>"), F.lit("<([0-9]{2,4})>"), 1)
    most = F.array_max(F.transform(sides, lambda x: x.cast("int")))
    return F.when(most > 0, most)


def logo_type(declared: Column, image: Column, kind: Column) -> Column:
    """What a logo file holds, by the ratio of its declared sides, else by format and kind."""
    w, h = F.regexp_extract(declared, "^([0-9]+)x", 1).try_cast("int"), F.regexp_extract(declared, "^[0-9]+x([0-9]+)", 1).try_cast("int")
    by_ratio = F.when(w / h >= 2.2, "horizontal lockup").when(w / h <= 0.85, "stacked or mark-only").otherwise("square mark")
    rest = F.when(image == "ico", "favicon mark").when(kind == "social", "social card").otherwise("unknown, check the source file")
    return F.when((w > 0) & (h > 0), by_ratio).otherwise(rest)


def paint_luminance(value: Column) -> Column:
    """Luminance of a six or three digit hex or rgb() colour; null for anything else."""
    v = F.trim(value)
    known = v.rlike(r"(?i)^#([0-9a-f]{3}|[0-9a-f]{6})$")
    short = F.when(F.length(v) == 4, F.regexp_replace(v, "(?i)([0-9a-f])", "$1$1")).otherwise(v)
    hexed = [F.conv(F.substring(short, k, 2), 16, 10).cast("double") for k in (2, 4, 6)]
    number = r"(?i)^rgba?\(\s*([\d.]+)[\s,]+([\d.]+)[\s,]+([\d.]+)"
    plain = [F.regexp_extract(v, number, k).try_cast("double") for k in (1, 2, 3)]
    bounded = [F.least(F.lit(255.0), F.greatest(F.lit(0.0), x)) for x in plain]
    return F.when(known, C.luminance(*hexed)).when(v.rlike(number), C.luminance(*bounded))


def svg_tone(markup: Column) -> Column:
    """(tone, swatches): light above a mean luminance of 0.55, dark below, else inherit or unknown."""
    text = F.coalesce(markup, F.lit(""))
    values = F.concat(
        F.regexp_extract_all(text, F.lit(r'(?i)(?:fill|stop-color|solidcolor|flood-color)\s*=\s*"([^"]+)"'), 1),
        F.regexp_extract_all(text, F.lit("(?i)(?:fill|stop-color)\\s*:\\s*([^;\"']+)"), 1),
    )
    own = F.filter(values, lambda v: ~F.trim(v).rlike(r"(?i)^(none|url\(|inherit|transparent)"))
    lumas = F.filter(F.transform(own, paint_luminance), lambda x: x.isNotNull())
    mean = F.aggregate(lumas, F.lit(0.0), lambda a, x: a + x) / F.size(lumas)
    inherits = text.rlike("(?i)currentColor|context-fill|context-stroke")
    tone = F.when((F.size(lumas) == 0) & inherits, "inherit").when(F.size(lumas) == 0, "unknown").when(mean > 0.55, "light").otherwise("dark")
    return F.struct(tone.alias("tone"), F.size(lumas).alias("swatches"))


def sanitise_svg(source: Column) -> Column:
    """SVG markup without anything that runs or reaches outside; empty if its root is no svg or it has no viewBox."""
    t = F.substring(F.coalesce(source, F.lit("")), 1, SVG_CHARS)
    for pattern in (r"(?s)<!--.*?-->", r"(?s)<\?.*?\?>", r"(?is)<!DOCTYPE[^>\[]*(\[.*?\])?[^>]*>"):
        t = F.regexp_replace(t, pattern, "")
    root = F.lower(F.regexp_extract(t, r"(?i)<\s*([a-z][a-z0-9:-]*)", 1))
    safe = t
    for name in FORBIDDEN:
        safe = F.regexp_replace(safe, rf"(?is)<{name}\b.*?</{name}\s*>", "")
        safe = F.regexp_replace(safe, rf"(?i)<{name}\b[^>]*>", "")
    safe = F.regexp_replace(safe, r"""(?i)\son[a-z]+\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", "")
    safe = F.regexp_replace(safe, r"""(?i)\s(?:xlink:)?href\s*=\s*("(?!\s*#|\s*data:image/)[^"]*"|'(?!\s*#|\s*data:image/)[^']*')""", ' href=""')
    safe = F.regexp_replace(safe, r"""(?i)\s(fill|stroke|filter|mask|clip-path|marker-start|marker-mid|marker-end)\s*=\s*["']url\((?!\s*#)[^)]*\)["']""", ' $1="none"')
    safe = F.regexp_replace(safe, r"(?i)javascript\s*:", "")
    usable = (root == "svg") & safe.rlike(r"(?i)<svg[\s>]") & safe.rlike(r"""(?i)\sviewBox\s*=\s*["'][^"']+["']""")
    return F.when(usable, safe).otherwise(F.lit(""))
