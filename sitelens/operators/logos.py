"""Logo candidates of sites: scored, joined by address, verified and chosen; drawings made safe."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import assets as A
from ..functions.numbers import fixed
from .crawl import ICONS
from .profile import url_normalise

#: File names of horizontal logos.
LOCKUP = "(?i)logo|wordmark|logotype|brandmark|brand[-_]?logo|header[-_]?logo"
SHORTLIST, ALTERNATES = 10, 5


def rank(candidates: DataFrame) -> DataFrame:
    """One row for each address of a site, best score first; candidates: site, ord, url, kind, score, reason, size.

    An address counts without its fragment; reasons are joined in order, the first size and kind are taken, and the
    file format's bonus is added. Addresses that are not http are left out. Ties go by first appearance.
    """
    clean = candidates.filter(F.col("url").rlike("(?i)^https?:")).withColumn("url", F.split("url", "#")[0])
    image = A.image_format(F.col("url"))
    first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.col("ord")))
    reasons = F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("ord", "reason"))), lambda x: x["reason"]))
    merged = clean.groupBy("site", "url").agg(F.min("ord").alias("ord"), F.max("score").alias("score"), reasons.alias("reasons"), first("kind").alias("kind"), first("size").alias("size"))
    scored = merged.select("site", "url", "ord", "kind", "size", F.array_join("reasons", "; ").alias("reason"), image["format"].alias("format"), (F.col("score") + image["bonus"]).alias("score"), A.largest_side(F.col("size")).alias("pixels"))
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy("site").orderBy(F.desc("score"), "ord")))


def choose(ranked: DataFrame, reachable: DataFrame) -> DataFrame:
    """For each site: primary (an svg, else a logo, else the best), lockup if it is another file, alternates, rejected, confidence.

    Only the first SHORTLIST candidates are looked at; reachable: the addresses that answered (url).
    """
    few = ranked.filter(F.col("rank") <= SHORTLIST).join(reachable.select("url").distinct().withColumn("ok", F.lit(True)), "url", "left")
    few = few.withColumn("ok", F.coalesce("ok", F.lit(False))).withColumn("origin", A.origin(F.col("url")))
    row = F.struct("rank", "url", "format", "kind", "origin", "score")
    order = lambda *keys: F.when(F.col("ok"), F.struct(*keys, F.col("rank")))
    primary = F.min_by(row, order((F.col("format") != "svg").alias("a"), (F.col("kind") != "logo").alias("b")))
    wide = A.logo_type(F.col("size"), F.col("format"), F.col("kind")) == "horizontal lockup"
    signal = F.when(wide, 0).when(F.col("url").rlike(LOCKUP), 1).when(F.col("kind") == "social", 2)
    lockup = F.min_by(row, F.when(signal.isNotNull(), order(signal.alias("a"))))
    good = F.array_sort(F.collect_list(F.when(F.col("ok"), row)))  # at most SHORTLIST
    lost = F.array_sort(F.collect_list(F.when(~F.col("ok"), F.struct("rank", "url"))))
    g = few.groupBy("site").agg(primary.alias("p"), lockup.alias("l"), good.alias("good"), lost.alias("lost"))
    others = F.filter("good", lambda x: (x["url"] != F.col("p.url")) & ((x["format"] != F.col("p.format")) | ~x["origin"].eqNullSafe(F.col("p.origin"))))
    confidence = F.when(F.size("good") == 0, F.lit(0.0)).otherwise(fixed(F.least(F.lit(0.95), 0.5 + F.coalesce(F.col("p.score"), F.lit(0)) / 200 + F.size("good") * 0.03), 2))
    return g.select(
        "site", F.col("p.url").alias("primary"), F.when(F.col("l.url") != F.col("p.url"), F.col("l.url")).alias("lockup"),
        F.transform(F.slice(others, 1, ALTERNATES), lambda x: x["url"]).alias("alternates"), F.transform(F.slice("lost", 1, 4), lambda x: x["url"]).alias("rejected"), confidence.alias("confidence"),
    )


def site_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates of each root host: the conventional icon paths, and a head icon for each page by its number."""
    sites = url_normalise(spark, sf_dir).filter("normal IS NOT NULL")
    paths = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(p).alias("path"), F.lit(k).alias("kind"), F.lit(float(s + 8)).alias("score")) for i, (p, k, s) in enumerate(ICONS)]))
    usual = sites.select(F.col("root").alias("site")).distinct().select("site", paths.alias("x"))
    usual = usual.select("site", (F.lit(1_000_000_000) + F.col("x.i")).cast("bigint").alias("ord"), F.concat(F.lit("https://"), F.col("site"), F.col("x.path")).alias("url"), F.col("x.kind").alias("kind"), F.col("x.score").alias("score"), F.lit("conventional path").alias("reason"), F.lit(None).cast("string").alias("size"))
    n = F.col("page_id")
    ending = F.element_at(F.array(*[F.lit(x) for x in ("svg", "png", "ico", "webp")]), (n % 4 + 1).cast("int"))
    side = (F.lit(16) + n % 7 * 16).cast("string")
    declared = sites.select(
        F.col("root").alias("site"), n.alias("ord"), F.concat(F.lit("https://"), F.col("root"), F.lit("/icon-"), (n % 5).cast("string"), F.lit("."), ending, F.lit("#"), n.cast("string")).alias("url"),
        F.when(n % 3 == 0, "logo").otherwise("icon").alias("kind"), (F.lit(24.0) + n % 7 * 16 / 10).alias("score"), F.concat(F.lit("icon "), (n % 2).cast("string")).alias("reason"), F.concat(side, F.lit("x"), side).alias("size"),
    )
    return declared.unionByName(usual)


def logo_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranked candidates of each root host."""
    return rank(site_candidates(spark, sf_dir)).select("site", "url", "kind", "size", "format", "score", "pixels", "rank")


def logo_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chosen logos of each root host; every address but those on /icon-1 answers."""
    ranked = rank(site_candidates(spark, sf_dir))
    got = choose(ranked, ranked.filter(~F.col("url").contains("/icon-1.")).select("url"))
    return got.select("site", "primary", "lockup", F.array_join("alternates", " ").alias("alternates"), F.array_join("rejected", " ").alias("rejected"), "confidence")


QUERIES = {f.__name__: f for f in (logo_rank, logo_choice)}
