"""Font faces, families and type detail of style sheets, and small exports of a palette."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.numbers import clamp01, fixed
from ..sources.tables import read
from .palette import palette_rank

#: Families of a site at most.
FAMILIES = 8
# What stands in a font stack and names no typeface.
NO_FAMILY = "inherit initial unset revert revert-layer none currentcolor sans-serif serif monospace cursive fantasy ui-serif ui-sans-serif ui-monospace ui-rounded math emoji fangsong cover contain fill scale-down auto normal".split()
ICON_FONT = "(?i)(icon|awesome|glyph|emoji|material-symbols|devicon|feather)"
# Weights by name.
WEIGHTS = {"thin": "100", "extralight": "200", "light": "300", "regular": "400", "normal": "400", "medium": "500", "semibold": "600", "bold": "700", "extrabold": "800", "black": "900", "heavy": "900"}
# Words in family names, by kind, in order of preference.
KINDS = (
    ("serif", "serif|garamond|georgia|times|baskerville|didot|playfair|merriweather|lora|spectral|fraunces|cormorant|libre caslon|cinzel"),
    ("sans", "sans|grotesk|gothic|helvetica|inter|roboto|lato|montserrat|poppins|nunito|raleway|work ?sans|manrope|figtree|archivo|barlow|outfit|sora"),
    ("mono", "mono|code|courier|menlo|consolas|fira ?code|jetbrains|source ?code|inconsolata|roboto ?mono"),
    ("display", "display|black|heavy|bold|grotesque|tight|compressed|ultra"),
)


def type_sheets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(brand, ord, css): a sheet for each part with a font face for every second one."""
    k, kind = F.col("p_partkey"), F.initcap("p_type")
    face = F.concat(F.lit('@font-face{font-family:"'), kind, F.lit(' Grotesk";font-weight:'), F.when(k % 4 == 0, "100 900").otherwise("Bold"), F.lit(";font-style:normal;src:url(x.woff2) format(\"woff2\"),url(x.woff) format('woff')}"))
    tens = F.lpad((F.col("p_size") % 10).cast("string"), 2, "0")
    body = F.concat(F.lit('body{font-family:"'), kind, F.lit(' Grotesk",Arial,sans-serif;letter-spacing:-0.'), tens, F.lit("em;line-height:1."), tens, F.lit(";"), F.when(k % 3 == 0, "text-transform:uppercase").otherwise("color:red"), F.lit("}"))
    icons = F.lit("i{font-family:Feather-Icons}code{font-family:JetBrains Mono, monospace}")
    return read(spark, sf_dir, "part").select(F.col("p_brand").alias("brand"), k.alias("ord"), F.concat(F.when(k % 2 == 0, face).otherwise(F.lit("")), body, icons).alias("css"))


def unquoted(x: Column) -> Column:
    """A value without blanks and quotes at its ends."""
    return F.trim(F.regexp_replace(F.trim(x), "^[\"']|[\"']$", ""))


def weight(x: Column) -> Column:
    """A weight as a number; ranges stay."""
    low = F.lower(F.trim(x))
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(v) for kv in WEIGHTS.items() for v in kv]), low), low)


def kind(family: Column) -> Column:
    """serif, sans, mono or display by the words of a name, camel case split; else sans."""
    spaced = F.regexp_replace(family, "([a-z0-9])([A-Z])", "$1 $2")
    out = F.lit("sans")
    for text in (spaced, family):
        for name, words in reversed(KINDS):
            out = F.when(text.rlike(f"(?i)(^|[^a-z0-9_])({words})([^a-z0-9_]|$)"), name).otherwise(out)
    return out


def font_faces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Font faces of each sheet: family, weight, style, formats, and whether the weight varies."""
    b = type_sheets(spark, sf_dir).select("brand", "ord", F.explode(F.regexp_extract_all("css", F.lit(r"(?i)@font-face\s*\{([^}]*)\}"), 1)).alias("b"))
    pick = lambda p: F.regexp_extract("b", rf"(?i)(?:^|[;\s]){p}\s*:\s*([^;}}]+)", 1)
    formats = F.array_join(F.transform(F.regexp_extract_all("b", F.lit(r"""(?i)format\(\s*["']?([\w-]+)["']?\s*\)"""), 1), lambda x: F.lower(x)), " ")
    return b.select("brand", "ord", unquoted(pick("font-family")).alias("family"), weight(F.when(pick("font-weight") == "", F.lit("400")).otherwise(pick("font-weight"))).alias("weight"), F.when(pick("font-style") == "", F.lit("normal")).otherwise(pick("font-style")).alias("style"), formats.alias("formats"), F.col("b").rlike(r"(?i)font-weight\s*:\s*\d{2,3}\s+\d{2,3}").alias("variable")).filter("family <> ''")


def font_families(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Families of each site: three points a face, one a use as the first of a stack; those used, webfonts or common, the first eight."""
    faces = font_faces(spark, sf_dir).select("brand", "family", F.lit(3).alias("points"), F.lit(True).alias("face"))
    body = type_sheets(spark, sf_dir).withColumn("css", F.regexp_replace("css", r"(?i)@font-face\s*\{[^}]*\}", ""))
    stacks = body.select("brand", F.explode(F.regexp_extract_all("css", F.lit(r"(?i)font-family\s*:\s*([^;{}]+)"), 1)).alias("stack"))
    first = stacks.select("brand", unquoted(F.split("stack", ",")[0]).alias("family"), F.lit(1).alias("points"), F.lit(False).alias("face"))
    names = faces.unionByName(first).filter((F.col("family") != "") & ~F.col("family").rlike(r"[\\:;]|^[0-9]") & ~F.lower("family").isin(NO_FAMILY) & ~F.col("family").rlike(ICON_FONT))
    g = names.groupBy("brand", F.lower("family").alias("family")).agg(F.sum("points").cast("bigint").alias("points"), F.max("face").alias("webfont"), F.max(~F.col("face")).alias("used"), F.min("family").alias("shown"))
    g = g.withColumn("share", fixed(F.col("points") / F.max("points").over(Window.partitionBy("brand")), 3)).filter("used AND (webfont OR share >= 0.5)")
    sure = fixed(clamp01(F.when(F.col("webfont"), 0.8).otherwise(0.2) + F.col("points") / 20.0), 3)
    rank = F.row_number().over(Window.partitionBy("brand").orderBy(F.desc("points"), "family"))
    return g.select("brand", "shown", "points", "webfont", "share", sure.alias("confidence"), kind(F.col("shown")).alias("kind"), rank.alias("rank")).filter(F.col("rank") <= FAMILIES)


def type_detail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean letter spacing in em, mean line height within 0.8 and 3, and upper-case rules of each site."""
    s = type_sheets(spark, sf_dir)
    em = F.transform(F.regexp_extract_all("css", F.lit(r"(?i)letter-spacing\s*:\s*(-?[\d.]+)r?em"), 1), lambda x: F.floor(x.try_cast("double") * 1000 + 0.5))
    high = F.filter(F.transform(F.regexp_extract_all("css", F.lit(r"(?i)line-height\s*:\s*([\d.]+)"), 1), lambda x: x.try_cast("double")), lambda x: (x > 0.8) & (x < 3))
    milli = F.transform(high, lambda x: F.floor(x * 1000 + 0.5))
    add = lambda a: F.aggregate(a, F.lit(0).cast("bigint"), lambda t, x: t + x)
    r = s.select("brand", add(em).alias("es"), F.size(em).alias("en"), add(milli).alias("hs"), F.size(milli).alias("hn"), F.size(F.regexp_extract_all("css", F.lit(r"(?i)(text-transform\s*:\s*uppercase)"), 1)).alias("up"))
    g = r.groupBy("brand").agg(*[F.sum(c).alias(c) for c in ("es", "en", "hs", "hn", "up")])
    return g.select("brand", fixed(F.col("es") / F.col("en") / 1000.0, 3).alias("letter_spacing"), fixed(F.col("hs") / F.col("hn") / 1000.0, 2).alias("line_height"), F.col("up").cast("bigint").alias("uppercase"))


def page_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of a guide from 4 to 24, 14 where nothing usable is asked, and its pillars."""
    asked = F.when(F.col("event_id") % 5 == 0, F.lit("abc")).otherwise(F.col("value").cast("string"))
    n = F.floor(F.regexp_extract(asked, r"^\s*([+-]?\d+)", 1).try_cast("double"))
    pages = F.when(n.isNull(), 14).otherwise(F.least(F.greatest(n, F.lit(4)), F.lit(24))).cast("int")
    return read(spark, sf_dir, "events").select("event_id", pages.alias("pages")).withColumn("pillars", F.when(F.col("pages") <= 6, 3).when(F.col("pages") <= 12, 4).otherwise(5))


def export_tokens_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A style dictionary of each brand's first five ranked colours, as JSON."""
    r = palette_rank(spark, sf_dir).filter("rank <= 5")
    entry = F.struct(F.col("rank").cast("string").alias("k"), F.struct(F.col("hex").alias("value")).alias("v"))
    m = F.map_from_entries(F.transform(F.array_sort(F.collect_list(F.struct("rank", entry.alias("e")))), lambda x: x["e"]))
    return r.groupBy("brand").agg(m.alias("m")).select("brand", F.to_json(F.struct(F.struct("m").alias("color"))).alias("j")).select("brand", F.regexp_replace("j", r'^\{"color":\{"m":(.*)\}\}$', '{"color":$1}').alias("json"))


def swatch_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Place of each ranked colour on a sheet 960 wide: four cards of 168 a row, 16 apart."""
    at = F.col("rank") - 1
    per = (960 - 64 + 16) // (168 + 16)
    return palette_rank(spark, sf_dir).select("brand", "hex", (32 + at % per * 184).alias("x"), (96 + F.floor(at / per) * 132).cast("int").alias("y"))


def reply_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The JSON object in a fenced reply, one for each event; a reply without one gives null."""
    reply = F.when(F.col("event_id") % 4 == 0, F.lit("no object")).otherwise(F.concat(F.lit("Here it is:\n```json\n"), F.col("props"), F.lit("\n```\ndone")))
    body = F.regexp_extract(reply, r"(?s)(\{.*\})", 1)
    return read(spark, sf_dir, "events").select("event_id", F.get_json_object(body, "$.k").cast("bigint").alias("k"))


# Words that tell who a text is for.
AUDIENCES = (("developers", "developers?|engineers?"), ("teams", "teams?"), ("marketing teams", "marketing"), ("designers", "designers?"), ("businesses", "business(es)?|companies"), ("startups", "start-?ups?"), ("enterprise buyers", "enterprise"), ("creators", "creators?|influencers?"), ("consumers", "consumers?|customers?"))


def audience(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whom each source's documents address: the group named most, three times at least; the first of equals."""
    low = F.lower(F.coalesce("text", F.lit("")))
    hits = [F.sum(F.regexp_count(low, F.lit(f"(?<![a-z0-9_])({p})(?![a-z0-9_])"))).cast("bigint") for _, p in AUDIENCES]
    g = read(spark, sf_dir, "documents").groupBy("source").agg(*[h.alias(f"h{i}") for i, h in enumerate(hits)])
    top = F.greatest(*[F.col(f"h{i}") for i in range(len(AUDIENCES))])
    return g.select("source", F.when(top >= 3, F.coalesce(*[F.when(F.col(f"h{i}") == top, n) for i, (n, _) in enumerate(AUDIENCES)])).alias("audience"), top.alias("hits"))


QUERIES = {f.__name__: f for f in (font_faces, font_families, type_detail, page_budget, export_tokens_json, swatch_grid, reply_json, audience)}
