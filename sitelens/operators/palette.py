"""Colour, comparison and export operators over brands."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import colour as C
from ..functions.numbers import fixed
from ..sources.tables import brand_colours, brand_fonts, brand_terms, read


def _rgb() -> tuple:
    return F.col("r"), F.col("g"), F.col("b")


def colour_describe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hex, HSL, luminance, contrast with white and grade of each colour."""
    c = brand_colours(spark, sf_dir)
    lum = C.luminance(*_rgb())
    ratio = C.contrast(lum, F.lit(1.0))
    return c.select("brand", "ord", C.to_hex(*_rgb()).alias("hex"), fixed(C.hue(*_rgb()), 1).alias("hue"), fixed(C.saturation(*_rgb()), 3).alias("saturation"), fixed(C.lightness(*_rgb()), 3).alias("lightness"), (F.greatest(*_rgb()) - F.least(*_rgb())).alias("chroma"), fixed(lum, 4).alias("luminance"), ratio.alias("contrast"), C.grade(ratio).alias("grade"), C.is_light(*_rgb()).alias("light"))


def colour_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each colour written as hex and as rgb(), parsed again."""
    c = brand_colours(spark, sf_dir).withColumn("p", C.parse(C.to_hex(*_rgb()))).withColumn("q", C.parse(F.concat(F.lit("rgb("), *[x for n in "rgb" for x in (F.col(n).cast("int").cast("string"), F.lit(", " if n != "b" else ")"))])))
    return c.select("ord", *[F.col(f"p.{n}").alias(f"hex_{n}") for n in "rgb"], *[F.col(f"q.{n}").alias(f"fn_{n}") for n in "rgb"], F.col("q.a").alias("alpha"))


def colour_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each colour with a quarter of white in it."""
    m = C.mix(C.rgb(*_rgb()), C.rgb(F.lit(255), F.lit(255), F.lit(255)), 0.25)
    return brand_colours(spark, sf_dir).withColumn("m", m).select("ord", C.to_hex(F.col("m.r"), F.col("m.g"), F.col("m.b")).alias("mixed"))


def delta_e_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CIEDE2000 between each colour and the one before it in its brand."""
    c = brand_colours(spark, sf_dir).withColumn("lab", C.lab(*_rgb()))
    c = c.withColumn("before", F.lag("lab").over(Window.partitionBy("brand").orderBy("ord"))).filter("before IS NOT NULL")
    return c.select("ord", fixed(C.delta_e(F.col("lab"), F.col("before")), 2).alias("delta_e"))


def nearest_named_colour(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The named colour nearest to each colour; the first of equals. A colour that many parts have is compared once, within its row."""
    n = len(C.NAMED)
    names = F.array(*[F.struct(F.lit(i).alias("i"), *[F.lit(float(int(v[j : j + 2], 16))).alias(x) for x, j in zip("rgb", (1, 3, 5), strict=True)]) for i, v in enumerate(C.NAMED.values())])
    c = brand_colours(spark, sf_dir)
    # few distinct colours, dear to compare: dealt out by number, so that they are not put together again
    few = c.select(*_rgb()).distinct().repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), *_rgb()).withColumn("own", C.lab(*_rgb()))
    # distance in four places and the name's place in one number; no distance comes first
    place = F.array_min(F.transform(names, lambda x: F.coalesce(F.floor(C.delta_e(F.col("own"), C.lab(x["r"], x["g"], x["b"])) * 10000 + 0.5), F.lit(-1)) * n + x["i"]))
    near = few.select(*[F.col(x).alias(f"{x}_") for x in "rgb"], place.alias("place"))
    same = [F.col(x).eqNullSafe(F.col(f"{x}_")) for x in "rgb"]
    best = c.join(near, same[0] & same[1] & same[2]).groupBy("brand", "ord").agg(F.min("place").alias("place"))
    return best.select("brand", "ord", F.element_at(F.array(*[F.lit(k) for k in C.NAMED]), (F.pmod("place", F.lit(n)) + 1).cast("int")).alias("name"))


def palette_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Colours of a brand by uses: share of the most used, score and rank; ties by first appearance."""
    c = brand_colours(spark, sf_dir).withColumn("hex", C.to_hex(*_rgb()))
    g = c.groupBy("brand", "hex").agg(F.count("*").alias("uses"), F.min("ord").alias("first"), F.first(C.saturation(*_rgb()) <= 0.14).alias("neutral"))
    share = F.col("uses") / F.max("uses").over(Window.partitionBy("brand"))
    g = g.withColumn("score", fixed(F.least(F.lit(60.0), 60 * share * F.when(F.col("neutral"), 0.3).otherwise(1.0)), 3))
    return g.select("brand", "hex", "uses", "score", F.row_number().over(Window.partitionBy("brand").orderBy(F.desc("score"), "first")).alias("rank"))


def _top(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = brand_colours(spark, sf_dir)
    return c.withColumn("k", F.row_number().over(Window.partitionBy("brand").orderBy("ord"))).filter("k <= 8").select("brand", "ord", C.lab(*_rgb()).alias("lab"))


def palette_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First brand against each other: mean of the nearest distances of its eight colours, and matches under 2.3."""
    top = _top(spark, sf_dir)
    subject = top.agg(F.min("brand").alias("subject"))
    mine = top.join(F.broadcast(subject), F.col("brand") == F.col("subject")).select(F.col("ord").alias("mine"), F.col("lab").alias("a"))
    others = top.join(F.broadcast(subject), F.col("brand") != F.col("subject")).select("brand", F.col("lab").alias("b"))
    near = others.join(F.broadcast(mine)).groupBy("brand", "mine").agg(F.min(C.delta_e(F.col("a"), F.col("b"))).alias("d"))  # eight rows
    return near.groupBy("brand").agg(fixed(F.avg("d"), 1).alias("average"), F.sum(F.when(F.col("d") < 2.3, 1).otherwise(0)).cast("bigint").alias("shared"))


def _sets(df: DataFrame, col: str, out: str) -> DataFrame:
    per = df.groupBy("brand").agg(F.collect_set(col).alias("items"))
    subject = per.agg(F.min_by("items", "brand").alias("mine"), F.min("brand").alias("subject"))
    j = per.join(F.broadcast(subject)).filter("brand <> subject")
    return j.select("brand", fixed(F.size(F.array_intersect("mine", "items")) / F.size(F.array_union("mine", "items")), 2).alias(out), F.size(F.array_intersect("mine", "items")).alias("shared"), F.size(F.array_except("mine", "items")).alias("only_subject"))


def font_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jaccard similarity of font families with the first brand."""
    return _sets(brand_fonts(spark, sf_dir), "family", "jaccard")


def term_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jaccard similarity of vocabularies with the first brand."""
    return _sets(brand_terms(spark, sf_dir), "term", "jaccard")


def distinctiveness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weighted mean of palette, type and vocabulary distance from the first brand, by band."""
    p = palette_distance(spark, sf_dir).select("brand", F.least(F.lit(100.0), F.col("average") * 2.2).alias("p"))
    f = font_jaccard(spark, sf_dir).select("brand", ((1 - F.col("jaccard")) * 100).alias("f"))
    t = term_overlap(spark, sf_dir).select("brand", ((1 - F.col("jaccard")) * 100).alias("t"))
    s = F.floor((F.col("p") * 0.4 + F.col("f") * 0.25 + F.col("t") * 0.1) / 0.75 + 0.5)
    return p.join(f, "brand").join(t, "brand").select("brand", s.cast("bigint").alias("score"), F.when(s > 70, "distinct").when(s > 45, "related").otherwise("close").alias("band"))


def crowded_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Terms that at least half of the brands use."""
    t = brand_terms(spark, sf_dir)
    n = t.agg(F.countDistinct("brand").alias("n"))
    return t.groupBy("term").agg(F.count("*").alias("brands")).join(F.broadcast(n)).filter(F.col("brands") >= F.ceil(F.col("n") / 2)).select("term", "brands")


def owned_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Terms of a brand that are not crowded."""
    return brand_terms(spark, sf_dir).join(crowded_terms(spark, sf_dir), "term", "left_anti")


def tone_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cosine distance of each label's mean vector from the first label's."""
    v = read(spark, sf_dir, "embeddings").select("label", F.posexplode("embedding").alias("i", "x")).groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("x"))
    first = v.agg(F.min("label").alias("f"))
    base = v.join(F.broadcast(first), F.col("label") == F.col("f")).select("i", F.col("x").alias("y"))
    j = v.join(base, "i").groupBy("label").agg((1 - F.sum(F.col("x") * F.col("y")) / F.sqrt(F.sum(F.col("x") * F.col("x")) * F.sum(F.col("y") * F.col("y")))).alias("d"))
    return j.select("label", (fixed(F.col("d"), 3) + 0.0).alias("distance"))


def export_css(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A :root block of each brand's first five ranked colours."""
    r = palette_rank(spark, sf_dir).filter("rank <= 5")
    line = F.concat(F.lit("  --color-"), F.col("rank").cast("string"), F.lit(": "), F.col("hex"), F.lit(";"))
    return r.groupBy("brand").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", line.alias("l")))), lambda x: x["l"]), "\n").alias("body")).select("brand", F.concat(F.lit(":root {\n"), F.col("body"), F.lit("\n}")).alias("css"))


def css_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Custom properties read back from exported style sheets: the last value of a name wins."""
    found = export_css(spark, sf_dir).select("brand", F.explode(F.regexp_extract_all("css", F.lit(r"(--[a-z0-9-]+\s*:\s*[^;]+);"), 1)).alias("d"))
    return found.select("brand", F.regexp_extract("d", "^(--[a-z0-9-]+)", 1).alias("name"), F.trim(F.regexp_extract("d", ":(.*)$", 1)).alias("value"))


def topn_per_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three dearest parts of each brand."""
    k = F.row_number().over(Window.partitionBy("p_brand").orderBy(F.desc("p_retailprice"), "p_partkey"))
    return read(spark, sf_dir, "part").select("p_brand", "p_partkey", "p_retailprice", k.alias("rank")).filter("rank <= 3")


QUERIES = {f.__name__: f for f in (colour_describe, colour_parse, colour_mix, delta_e_pairs, nearest_named_colour, palette_rank, palette_distance, font_jaccard, term_overlap, distinctiveness, crowded_terms, owned_terms, tone_cosine, export_css, css_tokens, topn_per_group)}
