"""What a site says of itself: its terms, pillars, taglines, headlines, category and positioning, from headings and heads.

Pages come in order of page_id within a site, headings in their place within a page; of equal headings of a site the first
counts. Where a rank is cut, Spark keeps the first rows of each site in every task before it exchanges them, and pillars find
their support and prevalence by the containment join of quotes, so no site's text is gathered.

Defined results: a site without a heading has no row in terms, pillars and headlines; a null page has neither headings nor head;
a site's homepage is its first page; other columns of pages are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import assets as A
from ..functions import head as H
from ..functions import text as T
from ..functions import url as U
from ..functions.bind import let
from ..functions.numbers import fixed
from ..sources.settled import settled
from ..sources.tables import read
from .faces import AUDIENCES
from .messaging import CATEGORIES, category, positioning
from .profile import NAVIGATION, STOP
from .quotes import contained

# Headings that no pillar is made of, and the kinds of taglines.
COMMON = ("home", "contact", "menu", "search", "privacy", "terms", "cookies", "skip", "main", "content", "page", "pages", "service", "services")
#: Terms ranked, terms that make pillars, pillars, headings that support one, headlines, taglines.
KEPT, TOP, PILLARS, SUPPORT, HEADLINES, TAGLINES = 50, 30, 5, 3, 14, 6
SALES = r"(?i)(?<![A-Za-z0-9_])(free|today|now|fastest|best|leading|all-in-one)(?![A-Za-z0-9_])"


def site_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(site, page_id, html), the site being the registered domain."""
    return read(spark, sf_dir, "pages").select(U.root_host(U.host(U.normalise(F.col("url")))).alias("site"), "page_id", "html").filter("site <> ''")


def heading_rows(pages: DataFrame) -> DataFrame:
    """(site, page_id, ord, level, heading): useful headings in their place, each text of a site once."""
    found = F.posexplode(F.regexp_extract_all("html", F.lit(r"(?is)(<h([1-6])[^>]*>.*?</h\2>)"), 1))
    rows = pages.select("site", "page_id", found.alias("ord", "h"))
    rows = rows.select("site", "page_id", "ord", F.substring("h", 3, 1).cast("int").alias("level"), A.decode_entities(F.regexp_replace("h", "<[^>]+>", " ")).alias("heading"))
    useful = F.length("heading").between(4, 220) & (F.size(F.split("heading", " ")) <= 24) & ~F.col("heading").rlike(f"(?i)^{NAVIGATION}") & F.col("heading").rlike("[A-Za-z0-9_]")
    first = F.min(F.struct("page_id", "ord", "level", "heading")).alias("x")
    return rows.filter(useful).groupBy("site", F.lower("heading").alias("key")).agg(first).select("site", "x.*")


def terms_of(headings: DataFrame, keep: int = KEPT) -> DataFrame:
    """site, term, mentions, headings (that hold it), weight, rank: terms of headings of levels 1 to 3 by tf ln(1 + N / df), N and df counting headings."""
    h = headings.filter("level <= 3")
    n = h.groupBy("site").agg(F.count("*").alias("total"))
    words = F.split(F.regexp_replace(F.lower("heading"), r"[^a-z0-9\s'-]", " "), r"\s+")
    t = h.select("site", "page_id", "ord", F.posexplode(words).alias("at", "raw")).withColumn("term", F.regexp_replace("raw", "^[-']+|[-']+$", ""))
    t = t.filter((F.length("term") >= 3) & ~F.col("term").rlike("^[0-9]+$") & ~F.col("term").isin(STOP))
    once = t.groupBy("site", "term", "page_id", "ord").agg(F.count("*").alias("c"), F.min("at").alias("at"))
    f = once.groupBy("site", "term").agg(F.sum("c").alias("mentions"), F.count("*").alias("headings"), F.min(F.struct("page_id", "ord", "at")).alias("first"))
    w = f.join(n, "site").withColumn("weight", fixed(F.col("mentions") * F.log(1 + F.col("total") / F.col("headings")), 3))
    rank = F.row_number().over(Window.partitionBy("site").orderBy(F.desc("weight"), "first"))
    return w.withColumn("rank", rank).filter(F.col("rank") <= keep).select("site", "term", "mentions", "headings", "weight", "rank")


def pillars_of(pages: DataFrame, headings: DataFrame) -> DataFrame:
    """site, rank, theme, name, terms, weight, support, prevalence of the five heaviest groups of terms with one stem.

    support: the first three headings that hold a term; prevalence: the share of the site's pages whose markup does.
    """
    top = terms_of(headings, TOP).filter(~F.col("term").isin(*COMMON)).withColumn("theme", T.stem(F.col("term"))).filter(F.length("theme") >= 3)
    groups = top.groupBy("site", "theme").agg(F.max("weight").alias("weight"), F.array_sort(F.collect_list(F.struct("rank", "term"))).alias("own"))  # of 30 terms a site
    place = F.row_number().over(Window.partitionBy("site").orderBy(F.desc("weight"), F.col("own")[0]["rank"]))
    groups = settled(groups.withColumn("rank", place).filter(F.col("rank") <= PILLARS))
    quotes = groups.select("site", F.col("rank").cast("bigint").alias("pillar"), F.explode("own.term").alias("quote"))
    lines = settled(headings.filter("level <= 3").withColumn("line", F.xxhash64("site", "page_id", "ord")).select("site", "line", "page_id", "ord", F.col("heading").alias("text")))
    held = contained(lines, quotes, "line", "pillar", group="site").join(lines, ["site", "line"])
    at = F.row_number().over(Window.partitionBy("site", "pillar").orderBy("page_id", "ord"))
    support = held.withColumn("k", at).filter(F.col("k") <= SUPPORT).groupBy("site", "pillar").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "text"))), lambda x: x["text"]), " | ").alias("support"))
    all_pages = pages.groupBy("site").agg(F.countDistinct("page_id").alias("pages"))
    seen = contained(pages, quotes, "page_id", "pillar", text="html", group="site").groupBy("site", "pillar").agg(F.count("*").alias("seen"))
    out = groups.withColumn("pillar", F.col("rank").cast("bigint")).join(support, ["site", "pillar"], "left").join(seen, ["site", "pillar"], "left").join(all_pages, "site")
    share = fixed(F.coalesce("seen", F.lit(0)) / F.col("pages"), 2)
    return out.select("site", "rank", "theme", A.title_case(F.col("theme")).alias("name"), F.array_join("own.term", ", ").alias("terms"), "weight", F.coalesce("support", F.lit("")).alias("support"), share.alias("prevalence"))


def homes_of(pages: DataFrame) -> DataFrame:
    """(site, title, og_title, description, og_description) of each site's first page."""
    first = pages.groupBy("site").agg(F.min_by("html", "page_id").alias("html")).select("site", H.head_of(F.coalesce("html", F.lit(""))).alias("head")).withColumn("metas", H.metas(F.col("head")))
    of = lambda k: H.meta(F.col("metas"), k)
    return first.select("site", H.title(F.col("head")).alias("title"), of("og:title").alias("og_title"), F.coalesce(of("description"), of("og:description")).alias("description"), of("og:description").alias("og_description"))


def tagline_points(text: Column, kind: Column) -> Column:
    """Near seven words, no closing stop, a first headline, the brand's own description, words that sell."""
    words = F.size(F.split(text, r"\s+"))
    points = 10 - 1.2 * F.abs(words - 7) - F.when(text.rlike("[.!?]$"), 2).otherwise(0) + F.when(kind == "h1", 3).otherwise(0) + F.when(kind == "og:description", 1).otherwise(0) + F.when(text.rlike(SALES), 1).otherwise(0)
    return fixed(points.cast("double"), 2)


def taglines_of(homes: DataFrame, headings: DataFrame) -> DataFrame:
    """site, rank, text, kind, page_id (null: the head), score: the six best of the head's texts, four h1 and eight h2."""
    told = ((0, "og:description", "og_description"), (1, "meta description", "description"), (2, "og:title", "og_title"), (200, "title tag", "title"))
    heads = homes.select("site", F.explode(F.array(*[F.struct(F.lit(o).alias("ord"), F.lit(k).alias("kind"), F.col(c).alias("text")) for o, k, c in told])).alias("x")).select("site", "x.*", F.lit(None).cast("bigint").alias("page_id"))
    at = F.row_number().over(Window.partitionBy("site", "level").orderBy("page_id", "ord"))
    few = headings.filter("level <= 2").withColumn("n", at).filter("n <= 8 AND (level = 2 OR n <= 4)")
    lines = few.select("site", (F.col("level") * 50 + F.col("n")).alias("ord"), F.concat(F.lit("h"), F.col("level").cast("string")).alias("kind"), F.col("heading").alias("text"), "page_id")
    rows = heads.unionByName(lines).withColumn("text", A.decode_entities(F.col("text"))).filter(F.length("text").between(8, 140))
    once = rows.groupBy("site", F.lower("text").alias("key")).agg(F.min(F.struct("ord", "kind", "text", "page_id")).alias("x")).select("site", "x.*")  # sixteen a site at most
    scored = once.withColumn("score", tagline_points(F.col("text"), F.col("kind")))
    rank = F.row_number().over(Window.partitionBy("site").orderBy(F.desc("score"), "ord"))
    return scored.withColumn("rank", rank).filter(F.col("rank") <= TAGLINES).select("site", "rank", "text", "kind", "page_id", "score")


def positions_of(pages: DataFrame, homes: DataFrame, headings: DataFrame) -> DataFrame:
    """site, category, audience, statement. Category: by og:description, description and page titles; audience: by all text of the site."""
    said = homes.select("site", F.concat_ws(" ", "og_description", "description").alias("t"))
    first_h1 = headings.filter("level = 1").groupBy("site", "page_id").agg(F.max_by("heading", "ord").alias("h1"))
    titled = pages.select("site", "page_id", H.title(H.head_of(F.coalesce("html", F.lit("")))).alias("title")).join(first_h1, ["site", "page_id"], "left")
    texts = said.unionByName(titled.select("site", F.coalesce(F.when(F.col("title") != "", F.col("title")), "h1", F.lit("")).alias("t")))
    number = F.array_position(F.array(*[F.lit(n) for n, _ in CATEGORIES]), category(F.col("t")))
    kinds = texts.groupBy("site").agg(F.min(F.when(number > 0, number)).alias("c"))
    low = F.lower(T.html_to_text(F.coalesce("html", F.lit(""))))
    hits = [F.regexp_count("low", F.lit(f"(?<![a-z0-9_])({p})(?![a-z0-9_])")) for _, p in AUDIENCES]
    sums = pages.select("site", low.alias("low")).groupBy("site").agg(*[F.sum(h).alias(f"h{i}") for i, h in enumerate(hits)])
    most = F.greatest(*[F.col(f"h{i}") for i in range(len(AUDIENCES))])
    told = sums.select("site", F.when(most >= 3, F.coalesce(*[F.when(F.col(f"h{i}") == most, F.lit(n)) for i, (n, _) in enumerate(AUDIENCES)])).alias("audience"))
    best = taglines_of(homes, headings).filter("rank = 1").select("site", "text")
    kind = F.element_at(F.array(*[F.lit(n) for n, _ in CATEGORIES]), F.col("c").cast("int"))
    named = kinds.select("site", F.when(F.col("c").isNotNull(), kind).alias("category")).join(told, "site").join(best, "site", "left")
    return named.select("site", "category", "audience", let(F.col("text"), lambda t: positioning(F.col("category"), t, F.col("audience"))).alias("statement"))


def headlines_of(headings: DataFrame) -> DataFrame:
    """site, rank, level, heading, page_id: the first fourteen headings of levels 1 to 3 by level, within a level in page order."""
    rank = F.row_number().over(Window.partitionBy("site").orderBy("level", "page_id", "ord"))
    return headings.filter("level <= 3").withColumn("rank", rank).filter(F.col("rank") <= HEADLINES).select("site", "rank", "level", "heading", "page_id")


def salience(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fifty heaviest heading terms of each site."""
    return terms_of(heading_rows(site_pages(spark, sf_dir)))


def pillars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each site's pillars with support and prevalence."""
    pages = site_pages(spark, sf_dir)
    return pillars_of(pages, settled(heading_rows(pages)))


def taglines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each site's tagline candidates."""
    pages = site_pages(spark, sf_dir)
    return taglines_of(homes_of(pages), heading_rows(pages))


def headlines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each site's headlines."""
    return headlines_of(heading_rows(site_pages(spark, sf_dir)))


def site_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each site's category, audience and positioning sentence."""
    pages = site_pages(spark, sf_dir)
    return positions_of(pages, homes_of(pages), settled(heading_rows(pages)))


QUERIES = {f.__name__: f for f in (salience, pillars, taglines, headlines, site_positions)}
