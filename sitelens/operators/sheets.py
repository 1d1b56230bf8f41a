"""Style-sheet, token, type and copy operators.

The sheets are derived, one for each part: its brand is the site, its name gives the tokens and its size the type.
Sites are grouped with partial aggregation; what is gathered for a site is its distinct names, never its sheets.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import tokens as T
from ..functions.numbers import fixed
from ..sources.tables import brand_colours, read
from ..functions import colour as C


def style_sheets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(brand, ord, url, css): a sheet for each part."""
    p, k = read(spark, sf_dir, "part"), F.col("p_partkey")
    w = F.split("p_name", " ")
    hex_ = C.to_hex((k * 37 % 256).cast("double"), (k * 91 % 256).cast("double"), (F.col("p_size") * 5 % 256).cast("double"))
    css = F.concat(F.lit("/* #000000 */:root{--color-"), w[0], F.lit(":"), hex_, F.lit(";--"), w[1], F.lit("-bg: var(--color-"), w[0], F.lit(", #ffffff);--"), w[1], F.lit("-line: var(--no-such, #eeeeee)}h1{font-size:"), F.col("p_size").cast("string"), F.lit("px;color:rgb(1, 2, 3)}"))
    url = F.concat(F.lit("https://cdn.example/"), F.lower("p_type"), F.lit("/"), w[0], F.when(k % 3 == 0, ".css").when(k % 3 == 1, "-theme.css?v=1").otherwise(".js"))
    return p.select(F.col("p_brand").alias("brand"), k.alias("ord"), url.alias("url"), css.alias("css"))


def properties(sheets: DataFrame) -> DataFrame:
    """(brand, name, value, defined, first) of sheets (brand, ord, css): the last definition holds."""
    rows = sheets.select("brand", "ord", F.posexplode(T.custom_properties(T.without_comments(F.col("css")))).alias("pos", "p"))
    return rows.groupBy("brand", F.col("p.name").alias("name")).agg(F.max_by("p.value", F.struct("ord", "pos")).alias("value"), F.count("*").alias("defined"), F.min(F.struct("ord", "pos")).alias("first"))


def resolved(props: DataFrame) -> DataFrame:
    """props with resolved: var() followed to its end. Only values that refer to others meet the site's properties."""
    refers = F.coalesce(F.col("value").rlike(r"(?i)^\s*var\("), F.lit(False))
    maps = props.groupBy("brand").agg(F.map_from_entries(F.collect_list(F.struct("name", "value"))).alias("props"))
    followed = props.filter(refers).join(maps, "brand").withColumn("resolved", T.resolve(F.col("props"), F.col("value"))).drop("props")
    return props.filter(~refers).withColumn("resolved", F.trim("value")).unionByName(followed)


def _properties(spark: SparkSession, sf_dir: str) -> DataFrame:
    return properties(style_sheets(spark, sf_dir)).drop("first")


def token_uses(sheets: DataFrame, props: DataFrame) -> DataFrame:
    """(brand, name, used): references by var() that begin with the name. Each distinct reference meets its own prefixes."""
    css = T.without_comments(F.col("css"))
    refs = sheets.select("brand", F.explode(F.regexp_extract_all(css, F.lit(r"var\(\s*(--[\w-]+)"), 1)).alias("ref")).groupBy("brand", "ref").agg(F.count("*").alias("n"))
    cut = F.transform(F.sequence(F.lit(2), F.length("ref")), lambda i: F.substring(F.col("ref"), F.lit(1), i))
    return refs.select("brand", F.explode(cut).alias("name"), "n").join(props.select("brand", "name"), ["brand", "name"]).groupBy("brand", "name").agg(F.sum("n").alias("used"))


def css_custom_properties(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Custom properties of each site; the last definition holds."""
    return _properties(spark, sf_dir)


def css_resolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each property of a site with var() followed to its end."""
    return resolved(_properties(spark, sf_dir)).select("brand", "name", "resolved")


def css_colour_uses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Colour literals of each site and how often they stand in its sheets."""
    return style_sheets(spark, sf_dir).select("brand", F.explode(T.colour_literals(T.without_comments(F.col("css")))).alias("literal")).groupBy("brand", "literal").agg(F.count("*").alias("uses"))


def css_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Style-sheet addresses of each site by how likely they carry its tokens."""
    s = style_sheets(spark, sf_dir).filter(F.col("url").rlike(r"(?i)\.css(\?|$)") | ~F.col("url").rlike(r"(?i)\.[a-z0-9]{2,5}(\?|$)"))
    path = F.split("url", r"\?")[0]
    at = F.row_number().over(Window.partitionBy("brand").orderBy("ord")) - 1
    known = path.rlike("(?i)(global|globals|theme|tokens|vars|variables|custom-props|palette|main|index|app|styles|tailwind|base|root|primitives|design-system)")
    vendor = path.rlike(r"(?i)(^|/)(vendor|node_modules|bootstrap|foundation|bulma|preflight|normalize|modernizr|polyfill|animate|swiper|slick|owl)[-./]")
    utility = path.rlike("(?i)(tailwind|bootstrap|bulma|foundation|animate|swiper|slick|owlcarousel|lodash)")
    build = path.rlike(r"(?i)/[a-z0-9_-]{6,10}\.[a-f0-9]{6}\.css$")
    points = sum(F.when(c, n).otherwise(0) for c, n in ((known, 40), (vendor, -30), (utility, -18), (build, -4)))
    return s.withColumn("at", at).select("brand", "ord", "url", (points + F.greatest(F.lit(0), 10 - F.col("at"))).alias("score"))


def token_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tier, role and score of each site's tokens; uses are references by var() that begin with the name."""
    p = _properties(spark, sf_dir)
    refs = token_uses(style_sheets(spark, sf_dir), p)
    k = p.join(refs, ["brand", "name"], "left").select("brand", "name", F.coalesce("used", F.lit(0)).alias("used"), T.classify(F.col("name")).alias("k"))
    return k.select("brand", "name", "used", "k.*", fixed(T.token_score(F.col("name"), F.col("k"), F.col("used")), 3).alias("score"))


def type_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten largest type sizes of each site in buckets of 0.05 rem, named by the nearest stop before them."""
    raw = style_sheets(spark, sf_dir).select("brand", F.explode(F.regexp_extract_all("css", F.lit(r"(?i)font-size\s*:\s*(\d*\.?\d+\s*(?:rem|px|em))"), 1)).alias("v"))
    n = F.regexp_extract("v", r"^([\d.]+)", 1).cast("double")
    v = raw.select("brand", F.when(F.lower("v").endswith("px"), n / 16).otherwise(n).alias("v")).filter("v BETWEEN 0.5 AND 6").withColumn("m", F.floor(F.col("v") * 1000.0 + 0.5))
    b = v.groupBy("brand", F.floor(F.col("m") / 1000.0 / 0.05 + 0.5).alias("bucket")).agg(F.sum("m").alias("s"), F.count("*").alias("uses"))
    b = b.withColumn("rem", fixed(F.col("s") / F.col("uses") / 1000.0, 2)).withColumn("rank", F.row_number().over(Window.partitionBy("brand").orderBy(F.desc("bucket")))).filter("rank <= 10")
    stops = ((2.5, "display"), (2.0, "h1"), (1.5, "h2"), (1.25, "h3"), (1.125, "h4"), (1.0, "body"), (0.875, "small"), (0.75, "caption"))
    name = F.coalesce(*[F.when(F.abs(F.col("rem") - s) < 0.3, F.lit(x)) for s, x in stops], F.concat(F.col("rem").cast("string"), F.lit("rem")))
    return b.select("brand", "rank", "rem", name.alias("name"), F.floor(F.col("rem") * 16 + 0.5).alias("px"), "uses")


#: Word boundaries of ASCII letters, digits and underscores; the engine's own also know other letters.
_OPEN, _CLOSE = "(?<![A-Za-z0-9_])", "(?![A-Za-z0-9_])"
# What is counted in copy.
COPY = {
    "you": f"{_OPEN}(you're|you'll|yourself|your|you){_CLOSE}",
    "we": f"{_OPEN}(we're|we'll|our's|our|we|us){_CLOSE}",
    "they": f"{_OPEN}(they|their|them|customers?|users?|teams?|clients?){_CLOSE}",
    "contractions": f"{_OPEN}[A-Za-z0-9_]+'(s|t|re|ll|ve|d|m){_CLOSE}",
    "exclamations": "!",
    "questions": r"\?",
}


def copy_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pronouns, contractions and marks of each document, and exclamations per 1000 words."""
    t = F.lower(F.coalesce("text", F.lit("")))
    words = F.size(F.filter(F.split(F.translate(t, "\t\n\r", "   "), " "), lambda w: w != ""))
    d = read(spark, sf_dir, "documents").select("doc_id", words.alias("words"), *[F.regexp_count(t, F.lit(p)).alias(n) for n, p in COPY.items()])
    return d.withColumn("exclamation_rate", fixed(F.col("exclamations") * 1000.0 / F.greatest("words", F.lit(1)), 2))


def colour_print(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Process colours of each colour and the ink to set on it."""
    c = brand_colours(spark, sf_dir).withColumn("hi", F.greatest("r", "g", "b"))
    black = F.col("hi") < 0.255
    part = {n: F.when(black, 0).otherwise(F.floor((F.col("hi") - F.col(x)) * 100.0 / F.col("hi") + 0.5)) for n, x in zip("cmy", "rgb", strict=True)}
    k = F.when(black, 100).otherwise(F.floor((255.0 - F.col("hi")) * 100.0 / 255.0 + 0.5))
    return c.select("ord", *[v.cast("int").alias(n) for n, v in part.items()], k.cast("int").alias("k"), F.when(C.luminance(F.col("r"), F.col("g"), F.col("b")) > 0.42, "#000000").otherwise("#ffffff").alias("ink"))


def palette_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Colourful and neutral colours of each brand."""
    hi, lo = F.greatest("r", "g", "b"), F.least("r", "g", "b")
    bright = (hi + lo) / 510.0
    colourful = (hi - lo >= 18) & (bright > 0.05) & (bright < 0.95)
    c = brand_colours(spark, sf_dir).select("brand", "r", "g", "b", colourful.alias("colourful")).distinct()
    return c.groupBy("brand").agg(F.count_if("colourful").alias("colourful"), F.count_if(~F.col("colourful")).alias("neutral"), F.count("*").alias("distinct_colours"))


QUERIES = {f.__name__: f for f in (css_custom_properties, css_resolved, css_colour_uses, css_rank, token_class, type_scale, copy_counts, colour_print, palette_split)}
