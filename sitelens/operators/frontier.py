"""Which pages of a site to read: links scored by the intent of their path, and a breadth-first plan over the link graph.

A page's links are resolved against its address and kept if they stay on its registered domain, are no door, form or file
and lie at most two segments deep. The plan goes level by level: the pages planned last are joined with the stored pages,
their links are freed of what is planned already by an anti-join, and each site takes two links of an intent by two grouped
minimums, so no window holds a whole site and a hub that all pages link to is aggregated before it is exchanged.

Defined results: a null page or address has no links; of links that differ in a trailing slash the first counts; an address
stored more than once gives the links of its first page; a site without readable seed has its seed alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import assets as A
from ..functions import url as U
from ..functions.bind import let
from ..sources.settled import settled
from ..sources.tables import read

# Path patterns that tell what a page is for, with points; the first that matches counts. Paths begin with a slash,
# so the product rule never does; results are to be as these patterns give them.
INTENTS = (
    ("about", 30, r"\babout|who-?we-?are|company|mission|our-story|manifesto|why-we-exist|values\b"),
    ("careers", 26, r"\bcareers?|jobs?|join-us|work-with-us|life-at|people\b"),
    ("customers", 24, r"\bcustomers?|case-?stud|stories|testimonials|success|results|case-?studies\b"),
    ("pricing", 20, r"\bpricing|plans?|plans-and-pricing|packages|buy|purchase\b"),
    ("product", 12, r"^(what-we-do|our-(products|services|platform)|(products|services|platform)(-\w+)?)$"),
    ("press", 16, r"\bpress|news|media|room|brand|assets?|kit\b"),
    ("blog", 14, r"\bblog|news|journal|insights|articles?|posts?\b"),
)
# Path and query of addresses that are never read: doors and transactions, notices, feeds, lists, files, releases.
EXCLUDED = (
    r"/(log-?in|sign-?in|sign-?on|log-?on|register|sign-?up|auth|log-?out|password|passcode|account|checkout|cart|basket|payment|order|orders|subscription|billing|unsubscribe|apply|claim)\b",
    r"/(privacy|terms|legal|cookie|cookies|gdpr|imprint|disclaimer)\b",
    r"/(rss|feed|atom|sitemap|robots)\b",
    r"/(search\?|q=|page=\d|offset=|start=)",
    r"\.(pdf|zip|docx?|xlsx?|pptx?|mp4|webm|mp3|wav|avi|mov)(\?|$)",
    r"/(download|downloads|release|releases)\b",
)
SECTION = r"/(blog|news|insights|journal|resources)\b"
HREF = r"""(?i)<a\s[^>]*?href\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)"""
#: Points of a page without intent, of a page at the top level, and of a section index; links of one intent; deepest path.
PLAIN, TOP, INDEX, PER_INTENT, SEGMENTS = 6, 4, 2, 2, 2
#: Pages read of a homepage's links, and of each level of a plan, by its depth.
PAGES = 7
DEPTHS = {"quick": 0, "standard": 5, "deep": 10}
_EDGE = "(?:(?<![A-Za-z0-9_])(?=[A-Za-z0-9_])|(?<=[A-Za-z0-9_])(?![A-Za-z0-9_]))"


def _found(text: Column, pattern: str) -> Column:
    """Whether the pattern occurs in any case, with word edges between ASCII word characters and others."""
    return text.rlike("(?i)" + pattern.replace(r"\b", _EDGE))


def absolute(base: Column, link: Column) -> Column:
    """A link's http address as browsers write it: resolved, scheme and host in lower case, no fragment, a path at least; else null."""

    def parts(whole: Column) -> Column:
        head = F.regexp_extract(whole, "(?i)^(https?://[^/?]+)", 1)
        return let(head, lambda h: let(F.substring(whole, F.length(h) + 1, F.length(whole)), lambda rest: joined(h, rest)))

    def joined(head: Column, rest: Column) -> Column:
        path = F.when(rest.rlike(r"/\.\.?([/?]|$)"), undotted(rest)).when(rest.startswith("/"), rest).otherwise(F.concat(F.lit("/"), rest))
        return F.when(head != "", F.concat(F.lower(head), path))

    clean = F.trim(F.replace(link, F.lit("&amp;"), F.lit("&")))
    return let(clean, lambda c: let(F.regexp_replace(A.resolve_url(base, c), "#.*$", ""), parts))


def undotted(rest: Column) -> Column:
    """A path, with its query, without . and .. segments; what would climb above the root stays there."""

    def step(done: Column, part: Column) -> Column:
        return F.when(part == "..", F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(1)))).when(part == ".", done).otherwise(F.concat(done, F.array(part)))

    path = F.regexp_replace(F.regexp_replace(rest, r"\?.*$", ""), r"(/\.\.?)$", "$1/")
    parts = F.split(path, "/")
    folded = F.aggregate(F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0))), F.array(F.lit("")), step)
    return F.concat(F.array_join(folded, "/"), F.regexp_extract(rest, r"(\?.*)$", 1))


def key_of(url: Column) -> Column:
    """An address without its trailing slash, by which pages are told apart."""
    return F.regexp_replace(url, "/$", "")


def place_of(url: Column) -> Column:
    """The key of an address in normal form, by which planned and stored pages meet."""
    return key_of(absolute(F.lit(""), U.normalise(url)))


def links_of(pages: DataFrame) -> DataFrame:
    """(page_id, base, ord, url): the links of each page (page_id, url, html) in page order, absolute.

    Links become addresses before they become rows, so what filters them later is never pushed below and computed anew.
    """
    own = pages.select("page_id", "html", absolute(F.lit(""), U.normalise(F.col("url"))).alias("base"))
    hrefs = F.regexp_extract_all("html", F.lit(HREF), 1)
    urls = F.transform(hrefs, lambda x: absolute(F.col("base"), F.regexp_replace(x, "^[\"']|[\"']$", "")))
    return own.select("page_id", "base", F.posexplode(urls).alias("ord", "url")).filter("url IS NOT NULL")


def scored(links: DataFrame) -> DataFrame:
    """Links worth reading, with intent, score and reason."""
    path = F.regexp_extract("url", "^[a-z]+://[^/]*([^?]*)", 1)
    home = F.regexp_replace(F.regexp_extract("base", "^[a-z]+://[^/]*([^?]*)", 1), "/$", "")
    asked = F.regexp_extract("url", "^[a-z]+://[^/]*(/.*)$", 1)
    segments = F.size(F.filter(F.split(path, "/"), lambda x: x != ""))
    kept = links.withColumns({"path": path, "asked": asked, "segments": segments})
    kept = kept.filter(A.same_site(F.col("url"), F.col("base")) & (key_of(F.col("url")) != key_of(F.col("base"))) & F.col("segments").between(1, SEGMENTS) & (F.col("path") != home))
    for pattern in EXCLUDED:
        kept = kept.filter(~_found(F.col("asked"), pattern))
    intent, points = F.lit("page"), F.lit(PLAIN)
    for name, n, pattern in reversed(INTENTS):
        hit = _found(F.col("path"), pattern)
        intent, points = F.when(hit, name).otherwise(intent), F.when(hit, n).otherwise(points)
    kept = kept.withColumns({"intent": intent, "points": points, "top": F.col("segments") == 1, "index": _found(F.col("path"), SECTION)})
    score = F.col("points") + F.when(F.col("top"), TOP).otherwise(0) - F.when(F.col("index"), INDEX).otherwise(0)
    said = F.concat(F.when(F.col("intent") == "page", "site page").otherwise(F.concat("intent", F.lit(" page"))), F.when(F.col("top"), ", top level").otherwise(""), F.when(F.col("index"), " (section index)").otherwise(""))
    return kept.withColumns({"key": key_of(F.col("url")), "score": score, "reason": said}).drop("path", "asked", "segments", "points", "top", "index")


def select_pages(pages: DataFrame, limit: int = PAGES) -> DataFrame:
    """The links of each page that are worth reading: at most two of an intent, the best first."""
    once = scored(links_of(pages)).groupBy("page_id", "key").agg(F.min(F.struct("ord", "url", "intent", "score", "reason")).alias("x")).select("page_id", "x.*")
    by_intent = F.row_number().over(Window.partitionBy("page_id", "intent").orderBy(F.desc("score"), "ord"))
    few = once.withColumn("_n", by_intent).filter(F.col("_n") <= PER_INTENT).drop("_n")
    return few.withColumn("rank", F.row_number().over(Window.partitionBy("page_id").orderBy(F.desc("score"), "ord"))).filter(F.col("rank") <= limit).select("page_id", "url", "intent", "score", "reason", "rank")


def _best(found: DataFrame) -> DataFrame:
    """The first link of each site and intent, by score, linking page and place."""
    order = F.min(F.struct((-F.col("score")).alias("s"), "page_id", "ord", "key", "url", "score", "reason")).alias("x")
    return found.groupBy("site", "intent").agg(order).select("site", "intent", "x.page_id", "x.ord", "x.key", "x.url", "x.score", "x.reason")


def crawl_plan(pages: DataFrame, seeds: DataFrame, levels: int = 2, depth: str = "deep") -> DataFrame:
    """site, level, url, intent, score, reason, via (page that links there), stored (page_id where the address is stored).

    pages: (page_id, url, html), what was fetched; seeds: (site, url), addresses to begin with.
    Each level takes two links of an intent and DEPTHS[depth] links of a site at most, from the pages of the level before.
    """
    ids = pages.select(place_of(F.col("url")).alias("key"), "page_id").filter("key IS NOT NULL").groupBy("key").agg(F.min("page_id").alias("stored"))
    start = seeds.select("site", place_of(F.col("url")).alias("key"), absolute(F.lit(""), U.normalise(F.col("url"))).alias("url")).filter("key IS NOT NULL")
    start = start.groupBy("site", "key").agg(F.min("url").alias("url"))
    none = F.lit(None)
    last = settled(start.select("site", "key", "url", F.lit(0).alias("level"), F.lit("home").alias("intent"), none.cast("int").alias("score"), F.lit("homepage").alias("reason"), none.cast("bigint").alias("via")).join(ids, "key", "left"))
    plan = last
    for level in range(1, levels + 1):
        now = last.filter("stored IS NOT NULL").select("site", F.col("stored").alias("page_id"))
        links = scored(links_of(pages.join(now.select("page_id").distinct(), "page_id", "left_semi"))).withColumn("key", place_of(F.col("url")))
        fresh = links.join(now, "page_id").join(plan.select("site", "key"), ["site", "key"], "left_anti")
        once = fresh.groupBy("site", "key").agg(F.min(F.struct("page_id", "ord", "url", "intent", "score", "reason")).alias("x")).select("site", "key", "x.*")
        first = _best(once)
        second = _best(once.join(first.select("site", "key"), ["site", "key"], "left_anti"))
        both = first.unionByName(second)  # two of each intent and site: at most sixteen rows
        rank = F.row_number().over(Window.partitionBy("site").orderBy(F.desc("score"), "page_id", "ord"))
        taken = both.withColumn("_n", rank).filter(F.col("_n") <= DEPTHS[depth])
        last = settled(taken.select("site", "key", "url", F.lit(level).alias("level"), "intent", "score", "reason", F.col("page_id").alias("via")).join(ids, "key", "left"))
        plan = plan.unionByName(last)
    return plan.select("site", "level", "url", "intent", "score", "reason", "via", "stored")


def page_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of each page worth reading, the first seven by score."""
    return select_pages(read(spark, sf_dir, "pages"))


def site_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plan of each site over two levels, begun at its first page."""
    pages = read(spark, sf_dir, "pages").select("page_id", "url", "html")
    n = U.normalise(F.col("url"))
    first = pages.select(U.root_host(U.host(n)).alias("site"), "page_id", n.alias("url")).filter("url IS NOT NULL").groupBy("site").agg(F.min_by("url", "page_id").alias("url"))
    return crawl_plan(pages, first)


QUERIES = {f.__name__: f for f in (page_links, site_plan)}
