"""Site profiling: voice, messaging and URL operators over pages and documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import url as U
from ..functions.numbers import clamp01, fixed
from ..sources.tables import read

#: Words that carry no message.
STOP = (
    "a an the and or but if then than that this these those for with without from into over under about "
    "your you our we us they their it its is are was were be been being do does did have has had will "
    "can could should would may might must not no yes all any some more most less least new every each "
    "how what why when where who which while as by at of to in on up out so such only own same too very "
    "just now here there also get got make made use used using help helps like love best great good better "
    "one two three first second next last other another via per plus vs"
).split()


def _copy(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read(spark, sf_dir, "pages")
    return pages.select("page_id", U.root_host(U.host(U.normalise(F.col("url")))).alias("host"), T.html_to_text(F.col("html")).alias("t"))


def page_voice_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentence-weighted voice measures of each root host, over its pages with three sentences or more."""
    p = _copy(spark, sf_dir).withColumn("s", T.sentences(F.col("t"))).withColumn("words", F.size(F.filter(F.split(F.col("t"), r"[ \t\r\n]+"), lambda x: x != "")))
    lens = F.transform("s", lambda x: F.size(F.filter(F.split(x, " "), lambda w: w != "")))
    p = p.withColumn("n", F.size("s")).filter("n >= 3").withColumn("avg_len", F.aggregate(lens, F.lit(0), lambda a, x: a + x) / F.col("n"))
    p = p.withColumn("direct", fixed(clamp01(1 - (F.col("avg_len") - 9) / 26.0), 3)).withColumn("hedge", fixed(T.term_count(F.col("t"), T.LEXICONS["hedges"]) * 1000.0 / F.greatest(F.col("words"), F.lit(1)), 2))
    p = p.withColumn("assertive", fixed(clamp01(1 - F.col("hedge") / 60.0), 3))
    return p.groupBy("host").agg(F.count("*").alias("pages"), F.sum("n").cast("bigint").alias("sentences"), F.sum("words").cast("bigint").alias("words"), fixed(F.sum(F.col("direct") * F.col("n")) / F.sum("n"), 3).alias("directness"), fixed(F.sum(F.col("assertive") * F.col("n")) / F.sum("n"), 3).alias("assertiveness"), fixed(F.stddev_pop("direct"), 3).alias("spread"))


def url_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Normal form, host and root host of each page's URL."""
    n = U.normalise(F.col("url"))
    return read(spark, sf_dir, "pages").select("page_id", n.alias("normal"), U.host(n).alias("host"), U.root_host(U.host(n)).alias("root"))


def root_host_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages and first page of each root host."""
    return url_normalise(spark, sf_dir).groupBy("root").agg(F.count("*").alias("pages"), F.min("page_id").alias("first_page"))


def html_text_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Characters and kept sentences of each page's text."""
    p = _copy(spark, sf_dir)
    return p.select("page_id", F.length("t").alias("chars"), F.size(T.sentences(F.col("t"))).alias("sentences"))


def lexicon_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lexicon hits of each source's documents."""
    d = read(spark, sf_dir, "documents")
    d = d.select("source", F.lower("text").alias("text"))
    d = d.select("source", "text", T.listed(F.col("text"), *T.LEXICONS.values()).alias("words"))
    counts = d.select("source", *[T.term_count(F.col("text"), terms, F.col("words")).alias(name) for name, terms in T.LEXICONS.items()])
    return counts.groupBy("source").agg(*[F.sum(name).cast("bigint").alias(name) for name in T.LEXICONS])


def syllable_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Estimated syllables of each document."""
    return read(spark, sf_dir, "documents").select("doc_id", T.syllables(F.coalesce("text", F.lit(""))).cast("bigint").alias("syllables"))


def headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headings of pages with their level: 4 to 220 characters, at most 24 words, no navigation."""
    found = F.explode(F.regexp_extract_all("html", F.lit(r"(?is)(<h([1-6])[^>]*>.*?</h\2>)"), 1))
    rows = read(spark, sf_dir, "pages").select("page_id", found.alias("h"))
    inner = F.regexp_replace(F.regexp_replace("h", "<[^>]+>", " "), r"[ \t\r\n]+", " ")
    rows = rows.select("page_id", F.substring("h", 3, 1).cast("int").alias("level"), F.trim(inner).alias("heading")).withColumn("words", F.size(F.split("heading", " ")))
    return rows.filter(F.length("heading").between(4, 220) & (F.col("words") <= 24) & ~F.col("heading").rlike(f"(?i)^{NAVIGATION}") & F.col("heading").rlike("[A-Za-z0-9_]"))


#: How headings that are navigation begin.
NAVIGATION = "(home|menu|search|sign in|log ?in|sign ?up|contact|about|blog|news|privacy|terms|cookie|skip to|next|previous|close|open|toggle)"


def tagline_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score of each first-level heading as a tagline."""
    h = headings(spark, sf_dir).filter("level = 1")
    low = F.lower("heading")
    s = 10 - 1.2 * F.abs(F.col("words") - 7) - F.when(F.col("heading").rlike("[.!?]$"), 2).otherwise(0) + 3 + F.when(low.rlike("(?<![a-z0-9_])(free|today|now|fastest|best|leading|all-in-one)(?![a-z0-9_])"), 1).otherwise(0)
    return h.select("page_id", "heading", fixed(s.cast("double"), 2).alias("score"))


def call_log_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls, distinct surfaces and summed duration of each run."""
    e = read(spark, sf_dir, "events")
    return e.groupBy(F.col("user_id").alias("run")).agg(F.count("*").alias("calls"), F.countDistinct("event_type").alias("surfaces"), fixed(F.sum("value"), 2).alias("total_ms"), F.sum(F.when(F.col("event_type") == "error", 1).otherwise(0)).cast("bigint").alias("failed"))


def manifest_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON properties as typed columns; malformed text gives null."""
    return read(spark, sf_dir, "events").select("event_id", F.from_json("props", "struct<k bigint>")["k"].alias("k"))


QUERIES = {f.__name__: f for f in (page_voice_profile, url_normalise, root_host_pages, html_text_stats, lexicon_counts, syllable_counts, headings, tagline_score, call_log_rollup, manifest_parse)}
