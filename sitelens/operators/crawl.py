"""Planning and reading a crawl: inputs, search candidates, batches, outcomes, page heads.

All windows are per site and nothing is numbered over a whole table: work spreads over sites, while the addresses of one site meet in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.tables import read
from .profile import url_normalise
from .sheets import style_sheets

#: Addresses a fetch call takes at once.
BATCH = 10
#: Sheets read of one site.
SHEETS = 50
# Endings and openings of an input that name no company.
SUFFIXES = ("official site", "official website", "homepage", "home page", "website", "site")
FILLER = r"(?i)^(the\s+)?(official\s+)?(website|site|webpage|homepage|home\s+page|url|link)\s*(for|of|at)?\s+"
# Hosts and paths that count for or against a search result.
COMPANY_PAGE = r"(?i)(^|[^a-z0-9_])(about|company|who[- ]we[- ]are|contact|home|welcome|official|products?|platform|solutions?|enterprise|pricing)([^a-z0-9_]|$)"
LOCAL_HOST = r"(?i)(^|\.)(www\.)?(m|mobile|en|mx|de|fr|jp|uk|us|ca|au|in|br|it|es|nl|se|no|fi|dk|pl|cz|at|ch|be|ie|za|sg|hk|tw|kr|nz)\."
SIDE_HOST = r"(?i)(^|\.)(blog|docs?|help|support|status|careers?|jobs?|press|pr|news|community|forum|wiki|learn|studio|app|cdn|static|assets?|media|img|images|files|downloads?|account|login|shop|store|checkout|cart)\."
ARCHIVE = r"(?i)(^|[^a-z0-9_])(tag|tags|category|author|search|post|20[0-9][0-9]|19[0-9][0-9])([^a-z0-9_]|$)"
PROFILE_PATH = "(?i)/(company|companies|org|organisation|profile|profiles|pages?|posts?|pub|user|users|showcase)/"
# Paths where sites keep their icons.
ICONS = (("/favicon.ico", "icon", 30), ("/apple-touch-icon.png", "touch-icon", 34), ("/apple-touch-icon-precomposed.png", "touch-icon", 28))


def clean_input(raw: Column) -> Column:
    """An input without blanks at its ends, a leading @ and filler; three rounds reach the fixpoint of ordinary inputs."""
    v = F.regexp_replace(F.trim(F.regexp_replace(raw, r"\s+", " ")), "^@(?=[^/]*$)", "")
    for _ in range(3):
        v = F.regexp_replace(v, FILLER + r"(?=\S.)", "")
        for s in SUFFIXES:  # each replacement leaves two characters at least
            v = F.regexp_replace(v, rf"(?i)^(.*\S.|.\S)\s+(for\s+)?{s}$", "$1")
    return v


def looks_like_url(v: Column) -> Column:
    """A scheme, www., or a dotted host with a lower-case letter."""
    dotted = v.rlike(r"(?i)^[^\s/]+\.[a-z]{2,}(/\S*)?$") | v.rlike(r"^[\w-]{2,}(\.[\w-]+)+/\S+$")
    return v.rlike(r"(?i)^[a-z][a-z0-9+.-]*://") | v.rlike(r"(?i)^www\.\S+$") | (dotted & F.split(v, "[/?#]")[0].rlike("[a-z]"))


def input_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inputs as people write them, one for each part: cleaned, and whether they are an address or a name."""
    k, n = F.col("p_partkey"), F.col("p_name")
    word = F.split(n, " ")[0]
    raw = F.when(k % 5 == 0, F.concat(n, F.lit("  official site"))).when(k % 5 == 1, F.concat(F.lit("The website for "), n)).when(k % 5 == 2, F.concat(F.lit("@"), word)).when(k % 5 == 3, F.concat(word, F.lit(".com/about"))).otherwise(F.concat(F.upper(word), F.lit(".UK")))
    cleaned = read(spark, sf_dir, "part").select("p_partkey", clean_input(raw).alias("value"))
    return cleaned.withColumn("kind", F.when(looks_like_url(F.col("value")), "url").otherwise("name"))


def _results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Search rows: the pages of each root host as results for the host's first label."""
    u = url_normalise(spark, sf_dir).filter("normal IS NOT NULL")
    at = F.row_number().over(Window.partitionBy("root").orderBy("page_id"))
    return u.select("root", "page_id", "host", F.split("root", r"\.")[0].alias("name"), F.regexp_extract("normal", "^[a-z]+://[^/]*([^?]*)", 1).alias("path"), at.alias("position"))


def candidate_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Search results scored as a brand's own site; profiles are rejected; the first five of each brand."""
    bare = F.regexp_replace("path", "^/+|/+$", "")
    key = lambda c: F.regexp_replace(F.lower(c), "[^a-z0-9]", "")
    site = F.regexp_replace("host", r"^www[0-9]?\.", "")
    depth = F.size(F.filter(F.split(bare, "/"), lambda x: x != ""))
    own = F.contains(key(site), key(F.col("name")))
    loose = (F.length(key(F.col("name"))) >= 4) & F.contains(key(site), F.substring(key(F.col("name")), 1, 5))
    points = F.when(own, 50).when(loose, 15).otherwise(0) + F.when(depth == 0, 30).otherwise(F.when(bare.rlike(COMPANY_PAGE), 10).otherwise(0) - depth * 8)
    points = points - F.when(F.col("host").rlike(LOCAL_HOST) | F.col("host").rlike(SIDE_HOST), 45).otherwise(0) - F.when(F.size(F.split(site, r"\.")) > 2, 35).otherwise(0)
    points = points - F.when(bare.rlike(ARCHIVE), 25).otherwise(0) + F.when(F.col("position") <= 3, 8 - F.col("position")).otherwise(0)
    scored = _results(spark, sf_dir).withColumn("score", points).filter(~F.col("path").rlike(PROFILE_PATH) & (F.col("score") > 0))
    rank = F.row_number().over(Window.partitionBy("root").orderBy(F.desc("score"), "position"))
    return scored.select("root", "page_id", "score", rank.alias("rank")).filter("rank <= 5")


def candidate_fall_through(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best candidate of each brand whose page has a closed body."""
    ok = read(spark, sf_dir, "pages").filter(F.contains(F.lower("html"), F.lit("</body>"))).select("page_id")
    return candidate_rank(spark, sf_dir).join(ok, "page_id").groupBy("root").agg(F.min_by("page_id", "rank").alias("page_id"), F.min("rank").alias("rank"))


def unique_hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first page of each root host; every tenth page counts as unresolved, and all those stay."""
    u = url_normalise(spark, sf_dir).select("page_id", F.when(F.col("page_id") % 10 != 0, F.col("root")).alias("root"))
    first = u.filter("root IS NOT NULL").groupBy("root").agg(F.min("page_id").alias("page_id"))
    return first.select("page_id", "root").unionByName(u.filter("root IS NULL"))


def file_stem(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file name of each root host."""
    return url_normalise(spark, sf_dir).select("root").distinct().select("root", F.regexp_replace(F.lower("root"), "[^a-z0-9.]+", "-").alias("stem"))


def fetch_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls of ten addresses of one root host, in page order."""
    u = url_normalise(spark, sf_dir).select("page_id", "root")
    at = F.row_number().over(Window.partitionBy("root").orderBy("page_id")) - 1
    return u.withColumn("call", F.floor(at / BATCH)).groupBy("root", "call").agg(F.count("*").alias("urls"), F.min("page_id").alias("first_page"))


def outcomes(wanted: DataFrame, results: DataFrame, errors: DataFrame, key: str) -> DataFrame:
    """Every wanted row with what came back: a result, or an error as a row; an empty asset counts as there."""
    r, e = results.select(key).distinct().withColumn("ok", F.lit(True)), errors.groupBy(key).agg(F.min("code").alias("code"))
    j = wanted.join(r, key, "left").join(e, key, "left")
    kept = F.coalesce(F.col("ok") | (F.col("code") == "empty_content"), F.lit(False))
    return j.select(key, F.coalesce("ok", F.lit(False)).alias("ok"), kept.alias("kept"), F.when(~kept, F.coalesce("code", F.lit("not returned"))).alias("reason"))


def fetch_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outcome of each page's fetch: two of seven fail, by turns empty, late or without a word."""
    p = read(spark, sf_dir, "pages").select("page_id")
    k = F.col("page_id")
    errors = p.filter((k % 7 < 2) & (k % 3 < 2)).select("page_id", F.when(k % 3 == 0, "empty_content").otherwise("timeout").alias("code"))
    return outcomes(p, p.filter(k % 7 >= 2), errors, "page_id")


def icon_probes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses where each host may keep its icon."""
    rows = F.explode(F.array(*[F.struct(F.lit(p).alias("path"), F.lit(kind).alias("kind"), F.lit(n).alias("score")) for p, kind, n in ICONS]))
    return url_normalise(spark, sf_dir).filter("normal IS NOT NULL").select("host").distinct().select("host", rows.alias("i")).select(F.concat(F.lit("https://"), "host", "i.path").alias("url"), "i.kind", "i.score")


def sheet_skips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses of each site's sheets by what becomes of them: read, no sheet, beyond the cap."""
    sheet = F.col("url").rlike(r"(?i)\.css(\?|$)")
    at = F.row_number().over(Window.partitionBy("brand", sheet).orderBy("ord"))
    fate = F.when(~sheet, "no sheet").when(at > SHEETS, "beyond the cap").otherwise("read")
    return style_sheets(spark, sf_dir).select("brand", fate.alias("fate")).groupBy("brand", "fate").agg(F.count("*").alias("sheets"))


def attributes(tag: Column) -> Column:
    """(name, value) of each attribute of a tag, names lower-cased, values without quotes."""
    found = F.regexp_extract_all(tag, F.lit(r"""([a-zA-Z_:][-a-zA-Z0-9_:.]*\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))"""), 1)
    return F.transform(found, lambda x: F.struct(F.lower(F.regexp_extract(x, r"^([^\s=]+)", 1)).alias("name"), F.regexp_replace(F.regexp_replace(x, r"^[^=]*=\s*", ""), "^[\"']|[\"']$", "").alias("value")))


def tag_attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attribute names over all tags of all pages: uses and distinct values."""
    tags = read(spark, sf_dir, "pages").select(F.explode(F.regexp_extract_all("html", F.lit("(<[a-zA-Z][^<>]*>)"), 1)).alias("tag"))
    return tags.select(F.explode(attributes(F.col("tag"))).alias("a")).groupBy("a.name").agg(F.count("*").alias("uses"), F.countDistinct("a.value").alias("different"))


#: References decoded in heads, in order.
REFERENCES = (("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&nbsp;", " "), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"))


def page_head(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Title, the name in it, language and character set of each page."""
    title = F.regexp_extract("html", "(?is)<title[^>]*>(.*?)</title>", 1)
    for ref, to in REFERENCES:
        title = F.replace(title, F.lit(ref), F.lit(to))
    name = F.trim(F.split(F.regexp_replace(F.col("title"), r"\s+([|–—·:]|-)\s+", "\n"), "\n")[0])
    plain = (name != "") & (F.length(name) <= 48) & ~name.rlike("(?i)^(home|welcome|coming soon|page not found|404|redirecting|official)([^a-z0-9_]|$)")
    head = read(spark, sf_dir, "pages").select("page_id", F.trim(F.regexp_replace(title, r"[ \t\r\n]+", " ")).alias("title"), F.lower(F.regexp_extract("html", '(?i)<html[^>]* lang="([^"]*)"', 1)).alias("lang"), F.lower(F.regexp_extract("html", '(?i)<meta charset="([^"]*)"', 1)).alias("charset"))
    return head.withColumn("name", F.when(plain, name))


QUERIES = {f.__name__: f for f in (input_kind, candidate_rank, candidate_fall_through, unique_hosts, file_stem, fetch_batches, fetch_outcomes, icon_probes, sheet_skips, tag_attributes, page_head)}
