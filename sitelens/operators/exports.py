"""Design tokens of brands and their export formats; confidence of a profile's sections."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import assets as A
from ..functions import colour as C
from ..functions.numbers import clamp01, fixed
from ..sources.tables import read
from .palette import palette_rank

#: Weights of a profile's sections.
WEIGHTS = {"identity": 0.15, "logos": 0.2, "colors": 0.25, "typography": 0.15, "voice": 0.15, "messaging": 0.1}


def token_table(colours: DataFrame, fonts: DataFrame, sizes: DataFrame) -> DataFrame:
    """(brand, ord, kind, name, value, declared) of colours (brand, ord, name, hex, declared), fonts (brand, role, family), sizes (brand, step, px)."""
    place = F.when(F.col("role") == "heading", 0).when(F.col("role") == "body", 1).otherwise(2)
    return (
        colours.select("brand", F.col("ord").cast("int").alias("ord"), F.lit("colour").alias("kind"), "name", F.col("hex").alias("value"), "declared")
        .unionByName(fonts.select("brand", place.alias("ord"), F.lit("font").alias("kind"), F.concat(F.lit("font-"), F.col("role")).alias("name"), A.quote_font(F.col("family")).alias("value"), F.lit(True).alias("declared")))
        .unionByName(sizes.select("brand", F.dense_rank().over(_by_size()).alias("ord"), F.lit("size").alias("kind"), F.concat(F.lit("size-"), F.col("step")).alias("name"), F.concat(F.col("px").cast("string"), F.lit("px")).alias("value"), F.lit(True).alias("declared")))
    )


def _by_size():
    from pyspark.sql import Window

    return Window.partitionBy("brand").orderBy(F.desc("px"))


def _gathered(tokens: DataFrame, wanted: Column, item: Column) -> Column:
    """Items of the wanted tokens of one brand in order: a few dozen at most."""
    return F.transform(F.array_sort(F.collect_list(F.when(wanted, F.struct("ord", "name", item.alias("x"))))), lambda t: t["x"])


def _entries(items: Column) -> Column:
    return F.map_from_entries(items)


def to_tailwind(tokens: DataFrame) -> DataFrame:
    """(brand, text): a theme block; neutral steps in a map of their own, absent parts left out."""
    neutral = F.col("name").startswith("neutral-")
    colour, size, font = F.col("kind") == "colour", F.col("kind") == "size", F.col("kind") == "font"
    pair = lambda cut: F.struct(F.substring("name", cut, 1 << 30).alias("key"), F.col("value").alias("value"))
    g = tokens.groupBy("brand").agg(
        _entries(_gathered(tokens, colour & ~neutral, pair(1))).alias("colors"), _entries(_gathered(tokens, colour & neutral, pair(9))).alias("neutral"),
        _entries(_gathered(tokens, font, pair(6))).alias("fontFamily"), _entries(_gathered(tokens, size, pair(6))).alias("fontSize"),
    )
    present = lambda c: F.when(F.size(c) > 0, F.col(c))
    shades = F.to_json("colors")
    inner = F.when(F.size("neutral") == 0, shades).otherwise(F.concat(F.regexp_replace(shades, r"\}$", ""), F.when(F.size("colors") > 0, F.lit(",")).otherwise(F.lit("")), F.lit('"neutral":'), F.to_json("neutral"), F.lit("}")))
    rest = F.regexp_replace(F.to_json(F.struct(present("fontFamily").alias("fontFamily"), present("fontSize").alias("fontSize"))), r"^\{", "")
    text = F.concat(F.lit('{"theme":{"extend":{"colors":'), inner, F.when(rest == "}", F.lit("")).otherwise(F.lit(",")), rest, F.lit("}}"))
    return g.select("brand", text.alias("text"))


def to_figma(tokens: DataFrame) -> DataFrame:
    """(brand, text): a variables collection, channels from 0 to 1 in four places."""
    rgb = C.parse(F.col("value"))
    channel = lambda c: fixed(rgb[c] / 255.0, 4).alias(c)
    note = F.when(F.col("declared"), "declared by the site").otherwise("inferred from the palette")
    colour = F.to_json(F.struct(F.concat(F.lit("color/"), F.col("name")).alias("name"), F.lit("COLOR").alias("resolvedType"), note.alias("description"), F.struct(F.struct(*map(channel, "rgb"), F.lit(1).alias("a")).alias("Default")).alias("valuesByMode"), F.col("value").alias("hexValue")))
    words = F.to_json(F.struct(F.regexp_replace("name", "^([^-]*)-", "$1/").alias("name"), F.lit("STRING").alias("resolvedType"), F.struct(F.col("value").alias("Default")).alias("valuesByMode")))
    item = F.when(F.col("kind") == "colour", colour).otherwise(words)
    readable = (F.col("kind") != "colour") | rgb.isNotNull()
    g = tokens.filter(readable).groupBy("brand").agg(F.transform(F.array_sort(F.collect_list(F.struct("kind", "ord", "name", item.alias("x")))), lambda t: t["x"]).alias("v"))
    return g.select("brand", F.concat(F.lit('{"modes":["Default"],"variableCount":'), F.size("v").cast("string"), F.lit(',"variables":['), F.array_join("v", ","), F.lit("]}")).alias("text"))


def to_markdown(tokens: DataFrame) -> DataFrame:
    """(brand, text): a heading and a table line for each token."""
    line = F.concat(F.lit("| "), F.col("name"), F.lit(" | `"), F.col("value"), F.lit("` | "), F.when(F.col("declared"), "declared").otherwise("inferred"), F.lit(" |"))
    g = tokens.groupBy("brand").agg(F.transform(F.array_sort(F.collect_list(F.struct("kind", "ord", "name", line.alias("x")))), lambda t: t["x"]).alias("v"))
    return g.select("brand", F.concat(F.lit("# "), F.col("brand"), F.lit("\n\n| token | value | basis |\n| --- | --- | --- |\n"), F.array_join("v", "\n"), F.lit("\n")).alias("text"))


def to_css(tokens: DataFrame) -> DataFrame:
    """(brand, text): custom properties of :root, inferred colours marked."""
    prefix = F.when(F.col("kind") == "colour", F.lit("  --color-")).otherwise(F.lit("  --"))
    line = F.concat(prefix, F.col("name"), F.lit(": "), F.col("value"), F.lit(";"), F.when(F.col("declared"), F.lit("")).otherwise(F.lit("  /* inferred */")))
    g = tokens.groupBy("brand").agg(F.transform(F.array_sort(F.collect_list(F.struct("kind", "ord", "name", line.alias("x")))), lambda t: t["x"]).alias("v"))
    return g.select("brand", F.concat(F.lit(":root {\n"), F.array_join("v", "\n"), F.lit("\n}\n")).alias("text"))


def to_json(tokens: DataFrame) -> DataFrame:
    """(brand, text): all tokens of a brand as JSON."""
    item = F.struct("kind", "ord", "name", "value", "declared")
    return tokens.groupBy("brand").agg(F.to_json(F.array_sort(F.collect_list(item))).alias("text"))


FORMATS: dict[str, tuple[Callable[[DataFrame], DataFrame], str, str]] = {
    "json": (to_json, "application/json", "json"),
    "markdown": (to_markdown, "text/markdown", "md"),
    "css": (to_css, "text/css", "css"),
    "tailwind": (to_tailwind, "application/json", "json"),
    "figma": (to_figma, "application/json", "json"),
}


def render(tokens: DataFrame, format_: str) -> DataFrame:
    """(brand, filename, content_type, text) in one of FORMATS; another name is an error."""
    if format_ not in FORMATS:
        raise ValueError(f"no such format: {format_}; there are {', '.join(FORMATS)}")
    make, kind, ending = FORMATS[format_]
    stem = F.regexp_replace(F.lower("brand"), "[^a-z0-9]+", "-")
    return make(tokens).select("brand", F.concat(stem, F.lit(f"-{format_}.{ending}")).alias("filename"), F.lit(kind).alias("content_type"), "text")


def confidence(facts: DataFrame) -> DataFrame:
    """Scores of six sections from 0 to 1, the weighted whole in two places, and its grade.

    facts: site, has_head, has_title, has_manifest_name, has_description, logo_confidence, sheets, declared_colours,
    has_theme_colour, has_manifest_colour, font_faces, families, sentences, voice_pages, readable_pages, headlines.
    """
    one = lambda c, w: F.when(F.col(c), F.lit(w)).otherwise(F.lit(0.0))
    some = lambda c, w: F.when(F.col(c) > 0, F.lit(w)).otherwise(F.lit(0.0))
    part = lambda c, full, w: F.least(F.col(c) / full, F.lit(1.0)) * w
    sections = {
        "identity": one("has_head", 0.35) + one("has_title", 0.3) + one("has_manifest_name", 0.2) + one("has_description", 0.15),
        "logos": F.coalesce("logo_confidence", F.lit(0.0)),
        "colors": some("sheets", 0.4) + part("declared_colours", 4, 0.35) + one("has_theme_colour", 0.15) + one("has_manifest_colour", 0.1),
        "typography": some("sheets", 0.35) + part("font_faces", 3, 0.4) + some("families", 0.25),
        "voice": F.when(F.col("sentences") > 0, part("sentences", 120, 0.6) + part("voice_pages", 4, 0.4)).otherwise(F.lit(0.0)),
        "messaging": part("readable_pages", 3, 0.5) + part("headlines", 10, 0.5),
    }
    scored = facts.select("site", *[clamp01(x).alias(n) for n, x in sections.items()])
    overall = sum((F.col(n) * w for n, w in WEIGHTS.items()), F.lit(0.0))
    scored = scored.withColumn("whole", overall)
    grade = F.when(F.col("whole") > 0.75, "high").when(F.col("whole") > 0.5, "moderate").otherwise("low")
    return scored.select("site", *[fixed(F.col(n), 2).alias(n) for n in sections], fixed(F.col("whole"), 2).alias("overall"), grade.alias("grade"))


def most_and_least(rows: DataFrame, by: str = "score", name: str = "brand") -> DataFrame:
    """One row: the most and, of several, the least distinct brand with their scores; ties by name."""
    return rows.agg(
        F.max_by(name, F.struct(by, name)).alias("most_distinct"), F.max(by).alias("most_score"),
        F.when(F.count("*") > 1, F.min_by(name, F.struct(by, name))).alias("least_distinct"), F.when(F.count("*") > 1, F.min(by)).alias("least_score"),
    )


def brand_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of each brand: five ranked colours, the first two part types as fonts, three sizes by the parts' sizes."""
    colours = palette_rank(spark, sf_dir).filter("rank <= 5").select("brand", F.col("rank").alias("ord"), F.concat(F.lit("shade-"), F.col("rank").cast("string")).alias("name"), "hex", (F.col("rank") <= 2).alias("declared"))
    part = read(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("brand")).agg(F.min("p_type").alias("heading"), F.max("p_type").alias("body"), F.min("p_size").alias("small"), F.max("p_size").alias("large"))
    fonts = part.select("brand", F.explode(F.create_map(F.lit("heading"), F.col("heading"), F.lit("body"), F.col("body"))).alias("role", "family"))
    sizes = part.select("brand", F.explode(F.create_map(F.lit("small"), F.col("small"), F.lit("large"), F.col("large"))).alias("step", "px"))
    return token_table(colours, fonts, sizes)


def export_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every brand's tokens as Markdown."""
    return render(brand_tokens(spark, sf_dir), "markdown")


def export_figma(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every brand's tokens as a variables collection."""
    return render(brand_tokens(spark, sf_dir), "figma")


def export_tailwind(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every brand's tokens as a theme block."""
    return render(brand_tokens(spark, sf_dir), "tailwind")


def profile_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Confidence of each brand's profile; its facts are counted from the brand's parts."""
    k = F.count("*")
    flag = lambda n: (k % n == 0)
    facts = read(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("site")).agg(
        flag(2).alias("has_head"), flag(3).alias("has_title"), flag(5).alias("has_manifest_name"), flag(7).alias("has_description"), (k % 10 / 10.0).alias("logo_confidence"), (k % 4).alias("sheets"),
        (k % 6).alias("declared_colours"), flag(11).alias("has_theme_colour"), flag(13).alias("has_manifest_colour"), (k % 5).alias("font_faces"), (k % 3).alias("families"), (k * 3).alias("sentences"),
        (k % 8).alias("voice_pages"), (k % 4).alias("readable_pages"), (k % 15).alias("headlines"),
    )
    return confidence(facts)


QUERIES = {f.__name__: f for f in (brand_tokens, export_markdown, export_figma, export_tailwind, profile_confidence)}
