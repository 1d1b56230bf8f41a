"""What a page's head says: title, metas, links. Attribute values and metas are decoded as browsers do for the references named here."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .bind import let

HEAD = "(?is)<head[^>]*>(.*?)(?:</head>|<body|$)"
#: Named references, in the order in which they are decoded.
NAMED = (("&quot;", '"'), ("&apos;", "'"), ("&nbsp;", " "), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"))
_ATTRIBUTE = r"""([a-zA-Z_:][-a-zA-Z0-9_:.]*\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))"""


def character(code: Column) -> Column:
    """The character of a code point; empty for none."""
    known = code.between(0, 0x10FFFF) & ~code.between(0xD800, 0xDFFF)
    return F.when(known, F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")).otherwise(F.lit(""))


def decoded(text: Column) -> Column:
    """Numeric references, then the named ones."""

    def one(piece: Column) -> Column:
        hexed, plain = F.regexp_extract(piece, "(?i)^&#x0*([0-9a-f]{1,7});$", 1), F.regexp_extract(piece, "^&#0*([0-9]{1,8});$", 1)
        code = F.when(hexed != "", F.conv(hexed, 16, 10).cast("bigint")).when(plain != "", plain.cast("bigint")).otherwise(F.when(piece.rlike("(?i)^&#(x0+|0+);$"), F.lit(0)).otherwise(F.lit(-1)).cast("bigint"))
        return F.when(piece.rlike("(?i)^&#(x[0-9a-f]+|[0-9]+);$"), character(code)).otherwise(piece)

    pieces = F.regexp_extract_all(text, F.lit("(?is)(&#x[0-9a-f]+;|&#[0-9]+;|[^&]+|&)"), 1)
    out = F.when(F.contains(text, F.lit("&#")), F.array_join(F.transform(pieces, one), "")).otherwise(text)
    for ref, to in NAMED:
        out = F.replace(out, F.lit(ref), F.lit(to))
    return out


def attributes(tag: Column) -> Column:
    """(name, value) of each attribute of a tag, names in lower case, values decoded and without quotes."""
    value = lambda x: decoded(F.regexp_replace(F.regexp_replace(x, r"^[^=]*=\s*", ""), "^[\"']|[\"']$", ""))
    return F.transform(F.regexp_extract_all(tag, F.lit(_ATTRIBUTE), 1), lambda x: F.struct(F.lower(F.regexp_extract(x, r"^([^\s=]+)", 1)).alias("name"), value(x).alias("value")))


def attribute(of: Column, name: str) -> Column:
    """The last attribute of that name, else null."""
    return let(F.filter(of, lambda a: a["name"] == name), lambda own: F.get(own, F.size(own) - 1)["value"])


def head_of(html: Column) -> Column:
    """The markup of the head; its end tag may be left out."""
    return F.regexp_extract(html, HEAD, 1)


def metas(head: Column) -> Column:
    """(key, content) of each meta by property, name or itemprop, keys in lower case."""
    filled = lambda a, n: let(attribute(a, n), lambda v: F.when(v != "", v))
    rows = F.transform(F.regexp_extract_all(head, F.lit(r"(?is)<meta\s+([^>]*?)/?>"), 1), attributes)
    keyed = F.transform(rows, lambda a: F.struct(F.lower(F.coalesce(filled(a, "property"), filled(a, "name"), filled(a, "itemprop"))).alias("key"), F.coalesce(attribute(a, "content"), F.lit("")).alias("content")))
    return F.filter(keyed, lambda m: m["key"].isNotNull())


def meta(of: Column, key: str) -> Column:
    """The content of the last meta of a key, decoded; null if it is empty or missing."""
    return let(F.filter(of, lambda m: m["key"] == key), lambda own: let(F.get(own, F.size(own) - 1)["content"], lambda c: F.when(c != "", decoded(c))))


def title(head: Column) -> Column:
    """The decoded title, null without one."""
    return F.when(head.rlike("(?is)<title[^>]*>.*?</title>"), F.trim(F.regexp_replace(decoded(F.regexp_extract(head, "(?is)<title[^>]*>(.*?)</title>", 1)), r"^\s+|\s+$", "")))


def links(head: Column) -> Column:
    """rel, href, type and sizes of each link, in order."""
    rows = F.transform(F.regexp_extract_all(head, F.lit(r"(?is)<link\s+([^>]*?)/?>"), 1), attributes)
    return F.transform(rows, lambda a: F.struct(*[attribute(a, n).alias(n) for n in ("rel", "href", "type", "sizes")]))
