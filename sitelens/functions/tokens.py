"""Style-sheet text and design-token names as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Vocabulary of token names.
NAMESPACES = "color colors colour colours theme brand ui tokens token semantic app ds design palette base global".split()
ROLES = {
    "primary": "primary brand main key",
    "secondary": "secondary",
    "accent": "accent highlight",
    "tertiary": "tertiary",
    "background": "bg background canvas page body backdrop",
    "surface": "surface panel card elevated",
    "text": "fg foreground text ink content copy label",
    "muted": "muted subtle faint quaternary",
    "link": "link anchor hyperlink",
    "border": "border outline divider stroke line rule",
    "success": "success positive",
    "warning": "warning caution",
    "error": "error danger destructive critical",
    "info": "info",
}
TEXT_WORDS = "text fg foreground content".split()
CONTAINERS = "surface panel card container wrapper shell region block tile canvas header footer hero sidebar modal".split()
COLOUR_WORDS = "white black red green blue yellow orange purple violet indigo pink cyan teal magenta lime olive navy amber coral salmon khaki plum crimson brown grey gray slate zinc stone neutral rose sky emerald turquoise lavender beige ivory tan aqua fuchsia".split()
VARIANTS = "hover hovered active focus focused visited pressed selected disabled open opened closed tint shade soft hard ghost washed faded alpha outline ring shadow 0 1 2 3 4 5 6 7 8 9 10 one two three stronger weaker lighter darker inverse invert reversed small medium large".split()
QUALIFIERS = {"primary": 4, "base": 3, "main": 3, "default": 2, "secondary": 2, "tertiary": 1}
TIERS = {"declaredRole": 300.0, "bareRole": 250.0, "paletteEntry": 95.0, "component": 25.0}
PAGE_SCOPE = "(^|-)(body|page|global|document|root|app|site|main|default)(-|$)"
COMPONENT_SCOPE = "(^|-)(template|layout|shell|chrome|view|card|panel|header|footer|nav|navigation|hero|banner|modal|tooltip|dropdown|button|btn|input|form|table|row|column|grid|cell|list|menu|tab|print|tag|pill|badge|chip|switch|toolbar|sidebar|wrapper|container|inner|outer|browser|popover|drawer|toast|accordion|pagination|avatar|kbd|label|legend|divider|separator|scrollbar|caret|chevron|handle|swatch|glyph|mark|wordmark|logo|icon|sticker|thumbnail|preview|skeleton|spinner|loader|snippet|code|editor|dock|titlebar|statusbar|breadcrumb|overlay|dialog)(-|$)"


def _map(pairs: dict) -> Column:
    return F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv])


def without_comments(css: Column) -> Column:
    """The style sheet without comments."""
    return F.regexp_replace(css, r"(?s)/\*.*?\*/", "")


def custom_properties(css: Column) -> Column:
    """(name, value) of each custom property in order; names are lower-cased."""
    found = F.regexp_extract_all(css, F.lit(r"(?i)(--[\w-]+\s*:\s*[^;{}]+)(?=[;}]|$)"), 1)
    return F.transform(found, lambda d: F.struct(F.lower(F.regexp_extract(d, r"^(--[\w-]+)", 1)).alias("name"), F.trim(F.regexp_replace(F.regexp_extract(d, r"(?s)^[^:]*:(.*)$", 1), r"(?i)\s*!?important\s*$", "")).alias("value")))


def resolve(props: Column, value: Column, hops: int = 8) -> Column:
    """Follows var() through a map of properties: at most so many hops, never a name twice, else the fallback."""
    ref = r"(?i)^\s*var\(\s*(--[\w-]+)\s*(?:,([^)]*))?\)"

    def step(s: Column, _: Column) -> Column:
        name = F.lower(F.regexp_extract(s["v"], ref, 1))
        fallback = F.trim(F.regexp_extract(s["v"], ref, 2))
        stop = s["done"] | s["v"].isNull() | (name == "") | F.array_contains(s["seen"], name)
        target = F.try_element_at(props, name)
        return F.when(stop, F.struct(s["v"].alias("v"), s["seen"].alias("seen"), F.lit(True).alias("done"))).otherwise(F.struct(F.coalesce(target, F.when(fallback != "", fallback)).alias("v"), F.array_append(s["seen"], name).alias("seen"), target.isNull().alias("done")))

    start = F.struct(value.alias("v"), F.array().cast("array<string>").alias("seen"), F.lit(False).alias("done"))
    return F.trim(F.aggregate(F.sequence(F.lit(1), F.lit(hops)), start, step, lambda s: s["v"]))


def colour_literals(css: Column) -> Column:
    """Every colour literal, lower-cased: hex first, then rgb, then hsl."""
    forms = (r"(#[0-9a-fA-F]{3,8}\b)", r"(?i)(\brgba?\(\s*[\d.%,\s/]+\s*\))", r"(?i)(\bhsla?\(\s*[\d.%,\s/deg-]+\s*\))")
    return F.transform(F.concat(*[F.regexp_extract_all(css, F.lit(p), 1) for p in forms]), lambda x: F.lower(F.trim(x)))


def classify(name: Column) -> Column:
    """tier, role, on_primary, variant and qualifier that a token's name states."""
    seg = F.filter(F.split(F.lower(F.regexp_replace(name, "^--", "")), "-"), lambda s: s != "")
    n, last = F.size(seg), F.coalesce(F.try_element_at(seg, F.lit(-1)), F.lit(""))
    head = F.coalesce(F.get(seg, 0), F.lit(""))
    roles = _map({w: role for role, words in ROLES.items() for w in words.split()})
    space = (n > 1) & head.isin(NAMESPACES)
    start = F.when(space, 1).otherwise(0)
    hits = F.filter(F.transform(seg, lambda s, i: F.struct(i.alias("i"), s.alias("s"), F.try_element_at(roles, s).alias("role"))), lambda h: h["role"].isNotNull() & (h["i"] >= start))
    purpose = F.filter(hits, lambda h: ~h["s"].isin(CONTAINERS))
    hit = F.coalesce(F.get(purpose, 0), F.get(hits, 0))
    # a place gives way to a purpose; a purpose that stands first stays
    hit = F.when(F.get(hits, 0)["s"].isin(CONTAINERS), hit).otherwise(F.get(hits, 0))
    role = hit["role"]
    after = F.filter(seg, lambda s, i: i > hit["i"])
    meaning = F.filter(seg, lambda s, i: (i >= start) & ~s.isin(VARIANTS))
    word = (F.size(meaning) == 1) & F.coalesce(F.get(meaning, 0), F.lit("")).isin(COLOUR_WORDS)
    scale = last.rlike(r"^\d+$")
    declared = space | (last.isin("colour", "color") & (n >= 3))
    tier = F.when(scale | word, "paletteEntry").when(role.isNull(), "component").when(declared, "declaredRole").when(F.try_element_at(roles, head).isNotNull(), "bareRole").otherwise("component")
    named = ~scale & ~word & role.isNotNull()
    return F.struct(
        tier.alias("tier"),
        F.when(named, role).alias("role"),
        (named & (role == "primary") & F.exists(after, lambda s: s.isin(TEXT_WORDS))).alias("on_primary"),
        F.coalesce(scale | (named & F.exists(after, lambda s: s.isin(VARIANTS))), F.lit(False)).alias("variant"),
        F.when(named, F.get(F.filter(after, lambda s: s.isin(list(QUALIFIERS))), 0)).alias("qualifier"),
    )


def token_score(name: Column, kind: Column, used: Column) -> Column:
    """Score of a token: tier, qualifier, scope and uses, in which no count can outweigh a tier."""
    score = F.try_element_at(_map(TIERS), kind["tier"]) * F.when(kind["variant"], 0.55).otherwise(1.0)
    score = score + F.coalesce((F.try_element_at(_map(QUALIFIERS), kind["qualifier"]) - 1) * 40.0, F.lit(0.0))
    score = score + F.when(name.rlike(PAGE_SCOPE), 70.0).otherwise(0.0) - F.when(F.lower(name).rlike(COMPONENT_SCOPE), 55.0).otherwise(0.0)
    return score + F.least(F.lit(60.0), F.log2(used + 1.0) * 22) - F.when(used == 0, 45.0).otherwise(0.0)
