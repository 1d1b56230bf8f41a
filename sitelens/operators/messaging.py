"""What pages claim: paragraphs, claims, headlines, navigation, category, positioning, contact, reading grade."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import assets as A
from ..functions import text as T
from ..functions.numbers import fixed
from ..sources.tables import read
from .profile import NAVIGATION, headings

#: Category and the words that show it, the first that matches counts.
CATEGORIES = (
    ("Developer platform", "api|sdk|developer|platform|framework|tooling"),
    ("Analytics", "analytics|dashboard|insights|reporting|metrics"),
    ("Design tool", "design|prototype|figma|canvas|creative"),
    ("SaaS product", "platform|software|app|workspace"),
    ("Commerce", "shop|store|checkout|commerce|selling"),
    ("Media", "content|publish|newsletter|publication"),
)
#: Words of a claim; pages that name the company; forms of a company.
CLAIM = "faster|free|secure|fast|easy|simple|unlimited|included|guaranteed"
LEGAL_PAGE = "(?i)(about|legal|terms|privacy|contact|imprint)"
LEGAL_NAME = r"(?:^|[^A-Za-z0-9_])([A-Z][A-Za-z0-9&.\- ]{1,40}?(?:Inc|LLC|Ltd|Limited|GmbH|PLC|Corp|Corporation|B\.V\.|Pte\.? Ltd)\.?)(?:\s|,|$)"


def words_of(pattern: str) -> str:
    """A pattern on ASCII word boundaries, in any case."""
    return f"(?i)(?<![A-Za-z0-9_])({pattern})(?![A-Za-z0-9_])"


def plain(markup: Column) -> Column:
    """Text of a piece of markup."""
    return A.decode_entities(F.regexp_replace(markup, "<[^>]+>", " "))


def first_of(df: DataFrame, key: Column, order: list) -> DataFrame:
    """The first row of each key."""
    n = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    return df.withColumn("_n", n).filter("_n = 1").drop("_n")


def paragraph_rows(pages: DataFrame) -> DataFrame:
    """(page_id, ord, text): the first kept sentence of each list item and paragraph, else its text of 41 to 299 characters."""
    found = F.posexplode(F.regexp_extract_all("html", F.lit(r"(?is)<(li|p)\b[^>]*>(.*?)</\1>"), 2))
    rows = pages.select("page_id", found.alias("ord", "h")).select("page_id", "ord", plain(F.col("h")).alias("whole"))
    kept = F.get(T.sentences(F.col("whole")), F.lit(0))
    text = F.coalesce(kept, F.when(F.length("whole").between(41, 299), F.col("whole")))
    return rows.select("page_id", "ord", text.alias("text")).filter("text IS NOT NULL")


def claim_rows(paragraphs: DataFrame, by: str = "page_id", keep: int = 10) -> DataFrame:
    """The first claims of each page: 25 to 220 characters with a digit or a claim's word. Of texts with equal openings the first counts, claim or not."""
    sized = paragraphs.filter(F.length("text").between(25, 220)).withColumn("_k", F.lower(F.substring("text", 1, 40)))
    once = first_of(sized, F.struct(by, "_k"), ["ord"]).drop("_k")
    hits = once.filter(F.col("text").rlike("[0-9]") | F.col("text").rlike(words_of(CLAIM)))
    return hits.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy("ord"))).filter(F.col("rank") <= keep)


def category(text: Column) -> Column:
    """The first category with a word in the text, else null."""
    out = F.lit(None).cast("string")
    for name, pattern in reversed(CATEGORIES):
        out = F.when(text.rlike(words_of(pattern)), F.lit(name)).otherwise(out)
    return out


def positioning(category_: Column, tagline: Column, audience: Column) -> Column:
    """One sentence of category, leading tagline and audience; null without a tagline."""
    low = F.concat(F.lower(F.substring(tagline, 1, 1)), F.substring(tagline, 2, 1 << 30))
    return F.concat(F.coalesce(F.concat(category_, F.lit(" that ")), F.lit("")), low, F.coalesce(F.concat(F.lit(", for "), audience), F.lit("")))


def reading_grade(words: Column, sentences: Column, syllables: Column) -> Column:
    """Flesch-Kincaid grade; null without words."""
    grade = 0.39 * words / F.greatest(sentences, F.lit(1)) + 11.8 * syllables / words - 15.59
    return F.when(words > 0, fixed(grade, 1))


def paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paragraphs and list items of every page."""
    return paragraph_rows(read(spark, sf_dir, "pages"))


def claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claims of every page."""
    return claim_rows(paragraphs(spark, sf_dir))


def short_headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headings of three words at most, or that begin like navigation or with a year: no messaging."""
    h = headings(spark, sf_dir)
    return h.filter((F.col("words") <= 3) | F.col("heading").rlike(f"(?i)^{NAVIGATION}") | F.col("heading").rlike("^(©|[0-9]{4})")).select("page_id", "level", "heading")


def contacts(pages: DataFrame, site: str) -> DataFrame:
    """Of each site: up to three addresses of mailto links and two LinkedIn company pages, in order of page and place, and the legal name."""
    mails = F.transform(F.regexp_extract_all("html", F.lit("(?i)mailto:([^\"'?>\\s]+)"), 1), lambda x: F.trim(F.coalesce(F.try_url_decode(x), x)))
    good = F.filter(mails, lambda x: x.rlike(r"(?i)^[^@\s]+@[^@\s]+\.[a-z]{2,}$"))
    links = F.filter(F.regexp_extract_all("html", F.lit("(?i)href\\s*=\\s*[\"']([^\"'?#]*linkedin\\.com/company/[^\"'?#]*)"), 1), lambda x: x != "")
    name = F.regexp_extract(F.when(F.col("url").rlike(LEGAL_PAGE), plain(F.col("html"))), LEGAL_NAME, 1)
    rows = pages.select(site, "page_id", F.slice(F.array_distinct(good), 1, 3).alias("m"), F.slice(F.array_distinct(links), 1, 2).alias("l"), F.when(name != "", F.trim(name)).alias("n"))
    rows = rows.filter((F.size("m") > 0) | (F.size("l") > 0) | F.col("n").isNotNull())
    # five of a page at most are gathered, and of a site only pages with any
    ordered = lambda c: F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("page_id", c))), lambda x: x[c]))
    return rows.groupBy(site).agg(F.slice(F.array_distinct(ordered("m")), 1, 3).alias("emails"), F.slice(F.array_distinct(ordered("l")), 1, 2).alias("linkedin"), F.min_by("n", F.when(F.col("n").isNotNull(), F.col("page_id"))).alias("legal_name"))


def document_grade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reading grade of each document: words of the whole text, sentences and syllables of the kept sentences alone; null without any."""
    d = read(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    words = F.size(F.filter(F.split(F.translate("text", "\t\n\r", "   "), " "), lambda w: w != ""))
    d = d.select("doc_id", words.alias("words"), T.sentences(F.col("text")).alias("kept"))
    d = d.select("doc_id", "words", F.size("kept").alias("sentences"), T.syllables(F.array_join("kept", " ")).alias("syllables"))
    return d.select("doc_id", "words", "sentences", F.when(F.col("sentences") > 0, reading_grade(F.col("words"), F.col("sentences"), F.col("syllables"))).alias("grade"))


QUERIES = {f.__name__: f for f in (paragraphs, claims, short_headings, document_grade)}
