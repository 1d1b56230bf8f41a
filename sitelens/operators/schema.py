"""Validation of JSON guides against a schema: each guide as a VARIANT, walked level by level, every fault with its path.

The schema, a dictionary in the subset of JSON Schema named below, is flattened to a table of its nodes and one of its
edges (node, key, child). A guide starts as one row at the root. Each level checks its rows against their node's rules and
explodes those of the right type into their members; members that the schema doesn't name meet its additionalProperties or
are dropped, so only what has a rule is walked, and a level is a join with the edges, whose size is the schema's. There are
as many levels as the schema is deep, whatever the guides hold.

Subset: type (one or several; integer is not told from other numbers and passes), enum, const, pattern, minimum, maximum,
required, properties, additionalProperties, minItems, items. A value of the wrong type is one fault, and nothing under it is
checked. Defined results: text that is no JSON, or null, is one fault at the root; guides repeated with their identifier give
their faults as often; a guide without faults gives no row; an empty table gives no row; other columns are not read.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import url as U
from ..functions.assets import resolve_url
from ..functions.bind import let
from ..sources.tables import read
from .names import names_of

_KINDS = ("object", "array", "string", "number", "boolean", "null")
_NODE = "node int, types array<string>, said string, allowed array<string>, allowed_said string, only string, pattern string, least double, least_said string, most double, most_said string, required array<string>, min_items int, whole boolean"
_EDGE = "node int, key string, child int"
#: What a guide of this engine must look like.
GUIDE = {
    "type": "object",
    "required": ["schemaVersion", "identity", "pages"],
    "properties": {
        "schemaVersion": {"type": "string", "pattern": r"^\d+\.\d+\.\d+$"},
        "lang": {"enum": ["en", "de"]},
        "identity": {"type": "object", "required": ["name", "url", "legalName"], "properties": {"name": {"type": "string"}, "url": {"type": "string", "pattern": "^https://"}}},
        "pages": {"type": "array", "minItems": 2, "items": {"type": "number", "minimum": 1}},
    },
}


def flattened(schema: dict) -> tuple[list[tuple], list[tuple], int]:
    """Nodes and edges of a schema, and how many levels it has. An edge's key is a name, ``[]`` for items, null for other members."""
    nodes: list[tuple] = []
    edges: list[tuple] = []

    def js(value: object) -> str:
        return json.dumps(value, ensure_ascii=False, separators=(",", ":"))

    def walk(s: dict) -> tuple[int, int]:
        at, kind = len(nodes), s.get("type")
        types = [kind] if isinstance(kind, str) else kind
        nodes.append(())
        deep = 0
        under = [(k, v) for k, v in (s.get("properties") or {}).items()]
        under += [(None, s["additionalProperties"])] if isinstance(s.get("additionalProperties"), dict) else []
        under += [("[]", s["items"])] if kind == "array" and "items" in s else []
        for key, sub in under:
            child, levels = walk(sub)
            edges.append((at, key, child))
            deep = max(deep, levels)
        enum, least, most = s.get("enum"), s.get("minimum"), s.get("maximum")
        nodes[at] = (
            at, types and [t for t in types if t in _KINDS] + ["any"] * any(t not in _KINDS for t in types), types and ",".join(types), enum and [js(x) for x in enum], enum and js(enum),
            js(s["const"]) if "const" in s else None, s.get("pattern"), None if least is None else float(least), js(least), None if most is None else float(most), js(most),
            s.get("required") or [], s.get("minItems") if kind == "array" else None, kind == "object" or "properties" in s,
        )
        return at, deep + 1

    _, levels = walk(schema)
    return nodes, edges, levels


def kind_of(v: Column) -> Column:
    """object, array, string, number, boolean or null."""
    said = F.schema_of_variant(v)
    named = F.when(said.startswith("OBJECT"), "object").when(said.startswith("ARRAY"), "array").when(said == "STRING", "string").when(said == "BOOLEAN", "boolean").when(said == "VOID", "null")
    return named.otherwise("number")


def _faults(kind: Column) -> Column:
    """The faults of a row, whose node's rules stand beside it."""
    path, text, number = F.col("path"), F.try_variant_get("v", "$", "string"), F.try_variant_get("v", "$", "double")
    say = lambda *parts: F.concat(path, *[p if isinstance(p, Column) else F.lit(p) for p in parts])
    wrong = ~F.coalesce(F.col("types").isNull() | F.array_contains("types", kind) | F.array_contains("types", "any"), F.lit(True))
    own = F.to_json("v")
    missing = F.array_except("required", F.coalesce(F.json_object_keys(own), F.array().cast("array<string>")))
    rest = F.array_compact(
        F.array(
            F.when(F.col("allowed").isNotNull() & ~F.array_contains("allowed", own), say(": ", own, " is not one of ", F.col("allowed_said"))),
            F.when(own != F.col("only"), say(": expected ", F.col("only"), ", got ", own)),
            F.when((kind == "string") & ~F.call_function("regexp_like", text, F.col("pattern")), say(': "', text, '" does not match ', F.col("pattern"))),
            F.when((kind == "number") & (number < F.col("least")), say(": ", own, " < minimum ", F.col("least_said"))),
            F.when((kind == "number") & (number > F.col("most")), say(": ", own, " > maximum ", F.col("most_said"))),
            F.when((kind == "array") & (F.json_array_length(own) < F.col("min_items")), say(": needs at least ", F.col("min_items").cast("string"), " item(s)")),
        )
    )
    lacks = F.when((kind == "object") & F.col("whole"), F.transform(missing, lambda k: F.concat(path, F.lit("."), k, F.lit(": required property is missing")))).otherwise(F.array().cast("array<string>"))
    return F.when(wrong, F.array(say(": expected ", F.col("said"), ", got ", kind))).otherwise(F.concat(rest, lacks))


def faults_of(guides: DataFrame, schema: dict, id_col: str = "id", json_col: str = "guide") -> DataFrame:
    """(id_col, path, fault) of every fault of every guide; path is that of the value checked."""
    spark = guides.sparkSession
    nodes_, edges_, levels = flattened(schema)
    nodes = F.broadcast(spark.createDataFrame(nodes_, _NODE))  # as many rows as the schema has nodes
    edges = spark.createDataFrame(edges_, _EDGE)
    parsed = guides.select(F.col(id_col).alias("id"), F.try_parse_json(F.col(json_col)).alias("v"))
    out = parsed.filter("v IS NULL").select("id", F.lit("$").alias("path"), F.lit("$: not JSON").alias("fault"))
    rows = parsed.filter("v IS NOT NULL").select("id", F.lit("$").alias("path"), F.lit(0).alias("node"), "v")
    for level in range(levels):
        checked = rows.withColumn("kind", kind_of(F.col("v"))).join(nodes, "node").withColumn("faults", _faults(F.col("kind")))
        out = out.unionByName(checked.select("id", "path", F.explode("faults").alias("fault")))
        if level == levels - 1:
            break
        right = F.col("types").isNull() | F.array_contains("types", F.col("kind")) | F.array_contains("types", "any")
        inner = checked.filter(right & F.col("kind").isin("object", "array")).select("id", "path", "node", "kind", "v")
        members = inner.lateralJoin(spark.tvf.variant_explode(F.col("v").outer())).select("id", "path", "node", "kind", "pos", "key", "value")
        named = F.broadcast(edges.filter("key IS NOT NULL").toDF("en", "ek", "child"))
        other = F.broadcast(edges.filter("key IS NULL").select(F.col("node").alias("on"), F.col("child").alias("other")))
        met = members.withColumn("k", F.when(F.col("kind") == "array", "[]").otherwise(F.col("key")))
        met = met.join(named, (F.col("node") == F.col("en")) & (F.col("k") == F.col("ek")), "left").join(other, (F.col("node") == F.col("on")) & (F.col("kind") == "object"), "left")
        step = F.when(F.col("kind") == "array", F.concat(F.lit("["), F.col("pos").cast("string"), F.lit("]"))).otherwise(F.concat(F.lit("."), F.col("key")))
        rows = met.select("id", F.concat("path", step).alias("path"), F.coalesce("child", "other").alias("node"), F.col("value").alias("v")).filter("node IS NOT NULL")
    return out.select(F.col("id").alias(id_col), "path", "fault")


def manifests_of(texts: DataFrame, url_col: str = "url", text_col: str = "text") -> DataFrame:
    """url, name, short_name, description, theme_color, background_color, display, icons (resolved), maskable of web app manifests; text that is no JSON object gives no row."""
    fields = "name string, short_name string, description string, theme_color string, background_color string, display string, icons array<struct<src string, sizes string, type string, purpose string>>"
    m = texts.select(F.col(url_col).alias("url"), F.try_parse_json(F.col(text_col)).alias("v"), F.from_json(F.col(text_col), fields).alias("m")).filter(F.col("v").isNotNull()).filter(kind_of(F.col("v")) == "object")
    filled = lambda c: F.when(c != "", c)
    named = F.filter(F.coalesce("m.icons", F.array().cast("array<struct<src string, sizes string, type string, purpose string>>")), lambda i: F.coalesce(i["src"], F.lit("")) != "")
    icons = F.transform(named, lambda i: F.struct(resolve_url(F.col("url"), i["src"]).alias("url"), filled(i["sizes"]).alias("sizes"), filled(i["type"]).alias("type"), filled(i["purpose"]).alias("purpose")))
    rows = m.select("url", F.coalesce(filled(F.col("m.name")), filled(F.col("m.short_name"))).alias("name"), *[filled(F.col(f"m.{c}")).alias(c) for c in ("short_name", "description", "theme_color", "background_color", "display")], icons.alias("icons"))
    return rows.withColumn("maskable", let(F.filter("icons", lambda i: F.contains(F.coalesce(i["purpose"], F.lit("")), F.lit("maskable"))), lambda a: F.get(a, F.lit(0))))


def guide_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults of a guide of each host: its name, the address and language of its first page, and the numbers of its pages."""
    n = U.normalise(F.col("url"))
    pages = read(spark, sf_dir, "pages").select("page_id", "html", n.alias("url")).withColumn("host", U.host(F.col("url"))).filter("host <> ''")
    lang = F.lower(F.regexp_extract("html", '(?i)<html[^>]* lang="([^"]*)"', 1))
    first = pages.groupBy("host").agg(F.min_by(F.struct("html", "url", lang.alias("lang")), "page_id").alias("x"), F.min("page_id").alias("low"), F.max("page_id").alias("high"))
    first = first.select("host", "x.html", "x.url", "x.lang", F.array_distinct(F.array("low", "high")).alias("pages"))
    named = names_of(first.select(F.col("host").alias("site"), "host", "html", F.lit(None).cast("string").alias("manifest_name"))).select(F.col("site").alias("host"), "name")
    guide = F.to_json(F.struct(F.lit("1.0.0").alias("schemaVersion"), "lang", F.struct("name", "url").alias("identity"), "pages"))
    return faults_of(first.join(named, "host").select("host", guide.alias("guide")), GUIDE, "host")


QUERIES = {"guide_faults": guide_faults}
