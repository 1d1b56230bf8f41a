"""Tone of documents on eight axes, and contrast among a brand's leading colours."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import colour as C
from ..functions import text as T
from ..functions.numbers import clamp01, fixed
from ..sources.tables import read
from .palette import palette_rank

# Axis, lower and upper edge, and what each band is called.
BANDS = (
    ("formality", 0.2, 0.6, ("casual", "conversational", "formal")),
    ("playfulness", 0.2, 0.6, ("restrained", "light", "loose")),
    ("assertiveness", 0.6, 0.9, ("hedged", "measured", "decisive")),
    ("technicality", 0.15, 0.5, ("plain", "domain-aware", "jargon-heavy")),
)
# The words that count as you, we and they in copy; "you're" and "our's" hold them, as an apostrophe ends a word.
ADDRESSED = {
    "you": ["yourself", "your", "you"],
    "we": ["our", "we", "us"],
    "they": ["they", "their", "them", "customer", "customers", "user", "users", "team", "teams", "client", "clients"],
}


def tone_axes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seven tone axes from 0 to 1 of each document, from lexicon rates; a document without words has the axes of no hits."""
    t = F.lower(F.coalesce("text", F.lit("")))
    low, tones = F.col("t"), {n: T.LEXICONS[n] for n in ("hedges", "power", "formality", "casual", "jargon")}
    d = read(spark, sf_dir, "documents").select("doc_id", t.alias("t"))
    d = d.select("doc_id", "t", T.listed(low, *tones.values(), *ADDRESSED.values()).alias("tokens"))
    counts = [T.term_count(low, terms, F.col("tokens")).alias(n) for n, terms in (ADDRESSED | tones).items()]
    d = d.select("doc_id", T.word_count(low).alias("words"), T.times(low, "!").alias("exclamations"), *counts)
    rate = lambda n: F.col(n) * 1000.0 / F.greatest("words", F.lit(1))
    scale = F.greatest(F.lit(1.0), F.col("words") / 250.0)
    axis = lambda x: fixed(clamp01(x), 3)
    hedge: Column = rate("hedges")
    return d.select(
        "doc_id",
        axis(F.col("formality") / (scale * 2 + 1)).alias("formality"),
        axis(rate("exclamations") / 2).alias("enthusiasm"),
        axis(F.col("casual") / (scale + 1)).alias("playfulness"),
        axis(F.col("you") / F.greatest(F.lit(1), F.col("you") + F.col("we") + F.col("they"))).alias("warmth"),
        axis(1 - hedge / 60.0).alias("assertiveness"),
        axis(rate("power") / (rate("power") + hedge + 6)).alias("confidence"),
        axis(F.col("jargon") / scale / 8).alias("technicality"),
    )


def tone_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of each band of the four axes that are put into words."""
    named = [F.when(F.col(a) < low, names[0]).when(F.col(a) > high, names[2]).otherwise(names[1]).alias(a) for a, low, high, names in BANDS]
    return tone_axes(spark, sf_dir).select(*named).groupBy(*[b[0] for b in BANDS]).agg(F.count("*").alias("documents"))


def contrast_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contrast and grade of each two of a brand's first four ranked colours, the higher ranked in front: six rows at most."""
    r = palette_rank(spark, sf_dir).filter("rank <= 4")
    c = C.parse(F.col("hex"))
    lum = r.select("brand", "rank", "hex", C.luminance(c["r"], c["g"], c["b"]).alias("lum"))
    front, back = (lum.select("brand", *[F.col(x).alias(f"{x}_{side}") for x in ("rank", "hex", "lum")]) for side in "ab")
    pairs = front.join(back, "brand").filter("rank_a < rank_b")
    ratio = C.contrast(F.col("lum_a"), F.col("lum_b"))
    return pairs.select("brand", F.col("hex_a").alias("front"), F.col("hex_b").alias("back"), ratio.alias("ratio"), C.grade(ratio).alias("grade"))


QUERIES = {f.__name__: f for f in (tone_axes, tone_bands, contrast_matrix)}
