"""What a site is called: seven sources, each with a weight, and the choice among them.

One row is one site with its homepage. The name as the site writes its own domain is found by place: the domain is replaced
by a mark in the lower-cased text, one constant pattern finds the first mark that stands alone, and the marks before it
give back the place in the text, so no pattern is made for a row.

Defined results: null or empty markup leaves the domain as the last name; a host is as long as a site's rows, so ties of two
sources can't arise, as weights differ; the repeated rows of a site each give their own result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import assets as A
from ..functions import head as H
from ..functions import url as U
from ..functions.bind import let
from ..sources.tables import read

# Sources with their weights; longest name in characters and words; headings and titles that name nothing; text searched.
SOURCES = (("manifest", "web app manifest", 34), ("og_site", "og:site_name", 30), ("written", "the domain, as the site writes it", 28), ("og_title", "og:title", 26), ("heading", "a page heading", 22), ("title", "title tag", 16), ("domain", "domain name", 4))
LONGEST, WORDS, HEADING_WORDS, TEXT = 48, 5, 6, 60_000
NO_HEADING = "(?i)^(welcome|home|sign in|log in|search|menu|404|page not found)$"
NO_TITLE = "(?i)^(home|welcome|coming soon|page not found|404|redirecting|official)(?![A-Za-z0-9_])"
_MARK = "\x01"


def site_name(value: Column) -> Column:
    """og:site_name if it has 2 to 48 characters."""
    return let(F.trim(value), lambda v: F.when(F.length(v).between(2, LONGEST), v))


def title_name(value: Column) -> Column:
    """A title up to its first separator, unless that is long or names a kind of page."""
    first = F.trim(F.get(F.split(F.regexp_replace(value, r"\s+[|–—·:]\s+|\s+-\s+", _MARK), _MARK), F.lit(0)))
    return let(F.trim(F.regexp_replace(first, r"\s*\|\s*$", "")), lambda v: F.when((v != "") & (F.length(v) <= LONGEST) & ~v.rlike(NO_TITLE), v))


def heading_name(html: Column, label: Column) -> Column:
    """The first heading of levels 1 to 3 that is a name: short, no kind of page, and not a phrase that ends with the site's label."""

    def names(text: Column) -> Column:
        words = F.split(text, " ")
        phrase = (F.size(words) > 1) & (F.lower(F.element_at(words, -1)) == F.lower(label))
        return F.length(text).between(2, LONGEST) & ~text.rlike(NO_HEADING) & (F.size(words) <= HEADING_WORDS) & ~F.coalesce(phrase, F.lit(False))

    found = F.regexp_extract_all(html, F.lit(r"(?is)<h([1-3])[^>]*>(.*?)</h\1>"), 2)
    texts = F.transform(found, lambda x: F.trim(F.regexp_replace(A.decode_entities(F.regexp_replace(x, "<[^>]+>", " ")), r"\s+", " ")))
    return F.get(F.filter(texts, names), F.lit(0))


def written_name(text: Column, needle: Column) -> Column:
    """The needle as the text writes it, where it first stands alone, with the character before it; null where it doesn't."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

    def at(before: Column, size: Column) -> Column:
        marks = F.length(before) - F.length(F.replace(before, F.lit(_MARK), F.lit("")))
        place = F.length(before) + marks * (size - 1)  # characters before the needle
        lead = F.when((place > 0) & ~before.rlike("^$"), F.substring(text, place, F.lit(1))).otherwise(F.lit(""))
        return F.trim(F.regexp_replace(F.concat(lead, F.substring(text, place + 1, size)), r"^\s+", ""))

    def search(marked: Column) -> Column:
        alone = "(?s)^(?:|.*?[^A-Za-z0-9_.\x01-])\x01(?![A-Za-z0-9_\x01-])"
        before = let(F.regexp_extract(marked, f"({alone})", 1), lambda m: F.when(m != "", F.substring(m, F.lit(1), F.length(m) - 1)))
        return let(before, lambda b: F.when(b.isNotNull(), at(b, F.length(needle))))

    marked = F.replace(F.translate(text, upper + _MARK, lower), F.lower(needle), F.lit(_MARK))
    return F.when(F.length(needle) >= 2, search(marked))


def names_of(homes: DataFrame) -> DataFrame:
    """site, name, basis (its source), candidates (source=value by weight) of each row (site, host, html, manifest_name)."""
    bare = F.regexp_replace("host", r"^www\d?\.", "")
    rows = homes.select("site", "host", "manifest_name", "html", bare.alias("bare"), H.head_of(F.coalesce("html", F.lit(""))).alias("head"))
    rows = rows.withColumns({"label": F.get(F.split("bare", r"\."), F.lit(0)), "metas": H.metas(F.col("head")), "plain": F.substring(F.translate(F.regexp_replace(F.coalesce("html", F.lit("")), "<[^>]+>", " "), _MARK, ""), 1, TEXT)})
    filled = lambda c: let(c, lambda v: F.when(v != "", v))
    values = {
        "manifest": filled(F.col("manifest_name")), "og_site": site_name(H.meta(F.col("metas"), "og:site_name")),
        "written": F.coalesce(written_name(F.col("plain"), F.col("bare")), written_name(F.col("plain"), F.col("label"))),
        "og_title": title_name(H.meta(F.col("metas"), "og:title")), "heading": heading_name(F.coalesce("html", F.lit("")), F.col("label")),
        "title": title_name(H.title(F.col("head"))), "domain": filled(F.regexp_replace("host", r"^www\.", "")),
    }

    def named(value: Column, source: str) -> Column:
        return let(value, lambda v: F.when(v.isNotNull(), F.struct(v.alias("value"), F.lit(source).alias("source"))))

    listed = F.array_compact(F.array(*[named(values[k], said) for k, said, _ in SOURCES]))  # by weight
    rows = rows.select("site", listed.alias("all"))
    short = F.filter("all", lambda c: F.size(F.split(A.clean_name(c["value"]), " ")) <= WORDS)
    rows = rows.withColumn("best", F.coalesce(F.get(short, F.lit(0)), F.get("all", F.lit(0))))
    return rows.select("site", A.clean_name(F.col("best.value")).alias("name"), F.col("best.source").alias("basis"), F.array_join(F.transform("all", lambda c: F.concat(c["source"], F.lit("="), c["value"])), "; ").alias("candidates"))


def site_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The name of each host by its first page."""
    host = U.host(U.normalise(F.col("url")))
    first = read(spark, sf_dir, "pages").select(host.alias("host"), "page_id", "html").filter("host <> ''").groupBy("host").agg(F.min_by("html", "page_id").alias("html"))
    return names_of(first.select(F.col("host").alias("site"), "host", "html", F.lit(None).cast("string").alias("manifest_name")))


QUERIES = {"site_names": site_names}
