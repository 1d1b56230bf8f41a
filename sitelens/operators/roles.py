"""Colour tokens, core palette, designer roles, neutral ramp and contrast pairs of a site.

Evidence, ranking and the choice of candidates are joins and aggregations over all of a site's sheets. Only the steps in
which one colour's claim bars the next run on plain values, one row a site: at most one candidate for each role, the
ramp, and the colours that its tokens declare as primary, accent or secondary.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import colour as C
from ..functions import plain_colour as P
from ..functions import tokens as T
from ..functions.numbers import fixed
from ..sources.tables import read
from .sheets import properties, resolved, style_sheets, token_uses

# Thresholds, orders, stops and pairs.
OPAQUE, SAME, NEUTRAL_SATURATION, RARE = 0.6, 4.5, 0.14, 0.04
PRIORITY = "primary background text accent secondary border surface muted link onPrimary success warning error info tertiary".split()
ROLE_KEYS = "primary secondary accent background surface text muted border link success warning error onPrimary".split()
#: Roles in the order in which they claim a colour; from surface on a claimed colour may serve again.
CLAIMS = "primary background text accent secondary surface border muted link success warning error onPrimary".split()
EXCLUSIVE = CLAIMS[:5]
VIVID, STATUS = ("primary", "accent", "secondary", "link"), ("success", "warning", "error")
STATUS_WORDS = {"success": "green", "warning": "yellow|orange|amber", "error": "red|crimson"}
STOPS = {"0": 1.0, "50": 0.97, "100": 0.94, "200": 0.88, "300": 0.79, "400": 0.66, "500": 0.53, "600": 0.42, "700": 0.33, "800": 0.24, "900": 0.16}
DEFAULT_RAMP = {"0": "#ffffff", "50": "#f8fafc", "100": "#f1f5f9", "200": "#e2e8f0", "300": "#cbd5e1", "400": "#94a3b8", "500": "#64748b", "600": "#475569", "700": "#334155", "800": "#1e293b", "900": "#0f172a"}
PAIRS = (
    ("text", "background", "body copy on the page"),
    ("link", "background", "link text on the page"),
    ("text", "surface", "body copy on a card"),
    ("primary", "surface", "accent on a card"),
    ("onPrimary", "primary", "button label on a primary button"),
    ("muted", "background", "secondary text on the page"),
    ("text", "border", "text against a hairline panel"),
)


def site_heads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(brand, head_theme, manifest_theme): theme colours derived from each site's first part; some sites have none."""
    p, k = read(spark, sf_dir, "part"), F.col("ord")
    first = p.groupBy(F.col("p_brand").alias("brand")).agg(F.min("p_partkey").alias("ord"))
    hex_ = C.to_hex((k * 53 % 256).cast("double"), (k * 29 % 256).cast("double"), (k * 7 % 256).cast("double"))
    return first.select("brand", F.when(k % 3 == 0, hex_).alias("head_theme"), F.when(k % 2 == 0, hex_).alias("manifest_theme"))


def _literal_map(pairs: dict) -> Column:
    return F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv])


def colour_evidence(sheets: DataFrame, heads: DataFrame) -> DataFrame:
    """One row for each sign of a colour: where it stands in the order of signs, its source, score and what it claims.

    All signs are gathered as texts first, so that the plan parses colours in one place.
    """
    props = properties(sheets)
    names = resolved(props).join(token_uses(sheets, props), ["brand", "name"], "left").withColumn("k", F.explode(F.array(T.classify(F.col("name"))))).filter("k.tier <> 'component'")
    used = F.coalesce("used", F.lit(0))
    place = lambda branch, x, y: F.struct(F.lit(branch).alias("branch"), x.cast("long").alias("x"), y.cast("long").alias("y"))
    tier = F.try_element_at(_literal_map(T.TIERS), F.col("k.tier"))
    strength = F.coalesce(F.try_element_at(_literal_map(T.QUALIFIERS), F.col("k.qualifier")), F.lit(0)) + tier / 100
    none = F.lit(None)
    component = (none.cast("string").alias("role"), none.cast("double").alias("strength"), none.cast("string").alias("token"), F.lit(T.TIERS["component"]).alias("tier"), none.cast("boolean").alias("variant"), F.lit(False).alias("on_primary"))
    token = names.select("brand", F.col("resolved").alias("written"), place(0, F.col("first.ord"), F.col("first.pos")).alias("at"), F.lit("stylesheet").alias("source"), T.token_score(F.col("name"), F.col("k"), used).alias("score"), F.col("k.role").alias("role"), strength.alias("strength"), F.col("name").alias("token"), tier.alias("tier"), F.col("k.variant").alias("variant"), F.coalesce("k.on_primary", F.lit(False)).alias("on_primary"))
    literals = sheets.select("brand", "ord", F.posexplode(T.colour_literals(T.without_comments(F.col("css")))).alias("pos", "literal"))
    form = F.when(F.col("literal").startswith("#"), 0).when(F.col("literal").startswith("rgb"), 1).otherwise(2)
    # forms stand in the order of their patterns, whichever sheet holds them; a long holds form and sheet
    literals = literals.groupBy("brand", "literal").agg(F.count("*").alias("uses"), F.min(place(1, form * F.lit(1 << 48) + F.col("ord"), F.col("pos"))).alias("at"))
    most = literals.groupBy("brand").agg(F.max("uses").alias("most"))
    # the share in place of a score until the colour is known
    frequency = literals.join(most, "brand").select("brand", F.col("literal").alias("written"), "at", F.lit("frequency").alias("source"), (F.col("uses") / F.col("most")).alias("score"), *component)
    chrome = heads.select("brand", F.posexplode(F.array("head_theme", "manifest_theme")).alias("i", "written"))
    chrome = chrome.select("brand", "written", place(2, F.col("i"), F.lit(0)).alias("at"), F.when(F.col("i") == 0, "head").otherwise("manifest").alias("source"), F.lit(25.0).alias("score"), *component)
    signs = token.unionByName(frequency).unionByName(chrome).withColumn("c", F.explode(F.array(C.parse(F.col("written"))))).filter("c.a > 0")
    neutral, rare = C.saturation(F.col("c.r"), F.col("c.g"), F.col("c.b")) <= NEUTRAL_SATURATION, F.col("score") < RARE
    signs = signs.filter((F.col("source") != "frequency") | neutral | ~rare)
    score = F.when(F.col("source") == "frequency", F.least(F.lit(60.0), 60 * F.col("score") * F.when(neutral, 0.3).otherwise(1.0))).otherwise(F.col("score"))
    # a token for text on the brand colour claims that role as well
    claim = F.struct(score.alias("score"), F.col("role"), F.when(F.col("role").isNotNull(), F.col("strength")).alias("strength"), F.col("variant"), F.lit(0).alias("turn"))
    second = F.struct((F.col("tier") + 25).alias("score"), F.lit("onPrimary").alias("role"), F.col("strength"), none.cast("boolean").alias("variant"), F.lit(1).alias("turn"))
    claims = F.when(F.col("on_primary") & (F.col("c.a") == 1), F.array(claim, second)).otherwise(F.array(claim))
    out = signs.select("brand", "at", "c", F.when(F.col("source") == "frequency", "stylesheet").otherwise(F.col("source")).alias("source"), "token", "tier", F.explode(claims).alias("x"))
    return out.select("brand", "at", "c", "source", "token", "tier", "x.*")


def tokens_of(evidence: DataFrame) -> DataFrame:
    """The colours of a site by hex with score, rank, tier, roles and confidence; translucent ones are left out."""
    rows = evidence.filter(F.col("c.a") >= OPAQUE).withColumn("hex", C.to_hex(F.col("c.r"), F.col("c.g"), F.col("c.b")))
    order = F.array_position(F.array(*map(F.lit, PRIORITY)), F.col("role"))
    claim = F.when(F.col("role").isNotNull(), F.struct((-F.col("strength")).alias("s"), order.alias("o"), "role"))
    g = rows.groupBy("brand", "hex").agg(
        F.sum("score").alias("sum"), F.min("at").alias("first"), F.min_by("c", "at").alias("c"), F.max("tier").alias("tier"), F.collect_set("source").alias("sources"),
        (~F.coalesce(F.bool_or(~F.col("variant")), F.lit(False))).alias("only_variants"), F.collect_set(claim).alias("claims"),
        F.collect_set(F.when(F.col("token").isNotNull(), F.struct("at", "token"))).alias("named"),
    )
    # scores are summed in any order; the sixth place makes their rounding independent of it
    total = fixed(F.col("sum"), 6)
    sure = F.when(F.size("named") > 0, 0.55).otherwise(0.2) + F.least(F.lit(1.0), F.size("sources") / 2) * 0.25 + F.least(total / 300, F.lit(1.0)) * 0.2
    r, gr, b = F.col("c.r"), F.col("c.g"), F.col("c.b")
    tiers = _literal_map({v: k for k, v in T.TIERS.items()})
    out = g.select(
        "brand", "hex", F.floor(total + 0.5).alias("score"), "first", F.try_element_at(tiers, F.col("tier")).alias("tier"), "only_variants",
        F.array_distinct(F.array_sort("claims")["role"]).alias("roles"), F.slice(F.array_sort("named")["token"], 1, 6).alias("tokens"), F.array_sort("sources").alias("sources"),
        fixed(F.least(F.lit(1.0), sure), 2).alias("confidence"), (F.greatest(r, gr, b) - F.least(r, gr, b)).alias("chroma"), fixed(C.lightness(r, gr, b), 3).alias("lightness"), F.col("c.a").alias("alpha"),
    )
    colourful = (F.col("chroma") >= 18) & (F.col("lightness") > 0.05) & (F.col("lightness") < 0.95)
    return out.withColumn("colourful", colourful).withColumn("rank", F.row_number().over(Window.partitionBy("brand").orderBy(F.desc("score"), "first"))).drop("first")


def facts_of(tokens: DataFrame) -> DataFrame:
    """What a site's colours offer, one row a site: the best claim of each role, candidates of the core palette, greys by stop."""
    w = Window.partitionBy("brand")
    grey = ~F.col("colourful") & (F.col("alpha") >= 1)
    own, declared = F.col("colourful") & ~F.col("only_variants"), F.col("tier") != "component"
    upto = lambda cond: F.when(cond, F.sum(F.when(cond, 1).otherwise(0)).over(w.orderBy("rank")))
    t = tokens.select("*", upto(own & declared).alias("n5"), upto(own).alias("n3"), upto(F.col("colourful")).alias("n6"))
    t = t.withColumn("greys", F.count_if(grey).over(w)).withColumn("i", F.row_number().over(w.orderBy(~grey, "lightness", "rank")) - 1)
    parts = [F.when(F.array_contains("roles", role) & ~F.col("only_variants"), F.lit(i)) for i, role in enumerate(("primary", "accent", "secondary"))]
    parts = F.array_compact(F.array(*parts, F.when(F.col("n5") <= 5, F.lit(3)), F.when(F.col("n3") <= 3, F.lit(4)), F.when(F.col("n6") <= 6, F.lit(9))))
    main = F.exists("tokens", lambda x: x.rlike("(^|-)primary(-|$)"))
    names = F.array_join("tokens", " ")
    strong = F.col("chroma") >= 40

    def claim(role: str) -> Column:
        fit = strong if role in VIVID else F.col("lightness") < 0.6 if role == "text" else F.col("chroma") >= 25 if role in STATUS else F.lit(True)
        return F.min_by("hex", F.when(F.array_contains("roles", role) & fit, F.struct(~main, F.col("rank")))).alias(f"hit_{role}")

    near = [F.min_by("hex", F.when(grey & (F.abs(F.col("lightness") - v) < 0.045), F.struct("lightness", "rank"))).alias(f"near_{k}") for k, v in STOPS.items()]
    like = [F.min_by("hex", F.when(strong & names.rlike(p), F.col("rank"))).alias(f"like_{role}") for role, p in STATUS_WORDS.items()]
    middle = F.max(F.when(grey & (F.col("greys") >= 3) & (F.col("i") == F.floor(F.col("greys") / 2)), F.col("hex"))).alias("middle")
    core = F.collect_list(F.when(F.size(parts) > 0, F.struct("rank", "hex", parts.alias("parts")))).alias("offers")
    return t.groupBy("brand").agg(*map(claim, CLAIMS), *near, *like, middle, core, F.min_by("hex", F.when(strong, F.col("rank"))).alias("vivid"))


def ramp_of(tokens: DataFrame, sites: DataFrame) -> DataFrame:
    """(brand, stop, hex): the site's own greys near each stop, else tints of its middle grey; under three greys a fixed ramp."""
    facts = sites.select("brand").join(facts_of(tokens), "brand", "left").withColumn("base", F.explode(F.array(C.parse(F.col("middle")))))
    tint = lambda v: C.to_hex(*[255.0 + (F.col(f"base.{x}") - 255.0) * (1 - v) for x in "rgb"])
    own = lambda k, v: F.when(F.col("middle").isNull(), F.lit(DEFAULT_RAMP[k])).otherwise(F.coalesce(f"near_{k}", tint(v)))
    return facts.select("brand", F.explode(F.array(*[F.struct(F.lit(k).alias("stop"), own(k, v).alias("hex")) for k, v in STOPS.items()])).alias("s")).select("brand", "s.*")


def ramp_stop(row: dict, stop: str) -> str:
    """One stop of ramp_of on a row of facts."""
    if not row["middle"]:
        return DEFAULT_RAMP[stop]
    return row[f"near_{stop}"] or P.mixed("#ffffff", row["middle"], 1 - STOPS[stop])


def distinct_colours(hexes: list[str]) -> list[str]:
    """Those that differ visibly from every one kept before them."""
    kept: list[str] = []
    for h in hexes:
        if all(P.delta_e(h, k) >= SAME for k in kept):
            kept.append(h)
    return kept


def offered(offers: list) -> tuple[list[str], list[str]]:
    """Candidates of the core palette in order, and the colours that stand in when there are none."""
    rows = sorted((p, o["rank"], o["hex"]) for o in offers for p in o["parts"])
    return [h for p, _, h in rows if p < 9], [h for p, _, h in rows if p == 9]


def core_of(tokens: DataFrame) -> DataFrame:
    """(brand, core): up to eight colours a site is known by, in order; without any, its first six colourful ones."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            lists = [offered(x) for x in b["offers"]]
            yield pd.DataFrame({"brand": b["brand"], "core": [distinct_colours(named)[:8] or spare for named, spare in lists]})

    return facts_of(tokens).select("brand", "offers").mapInPandas(run, "brand string, core array<string>")


def assign(hits: dict[str, str], core: list[str], vivid: str | None, status: dict[str, str], ramp: dict[str, str], theme: str | None, theme_hex: str | None) -> dict:
    """Roles of one site: declared colours claim theirs in order, the rest is derived from them and listed as inferred."""
    roles: dict[str, str] = {}
    inferred, shared, claimed = [], [], []
    chroma = lambda h: max(P.channels(h)) - min(P.channels(h))
    for role in CLAIMS:
        if role not in hits:
            continue
        clash = next((c for c in claimed if P.delta_e(c, hits[role]) < SAME), None)
        if clash is None:
            claimed.append(hits[role])
        elif role in EXCLUSIVE:
            continue
        else:
            shared.append(f"{role} is the same colour as {clash}")
        roles[role] = hits[role]

    def infer(role: str, value: str) -> None:
        roles[role] = value
        inferred.append(role)

    if "background" not in roles:
        infer("background", theme or ramp["0"])
    page = theme_hex if roles["background"] == theme and theme_hex is not None else roles["background"]
    page = page if page.startswith("#") and len(page) == 7 else None
    dark = page is not None and P.lightness(page) < 0.5
    if "text" not in roles:
        infer("text", ramp["100"] if dark else ramp["900"])
    text = roles["text"]
    if "primary" not in roles:
        infer("primary", next((h for h in core if chroma(h) >= 40), vivid) or text)
    if "accent" not in roles:
        other = next((h for h in core if chroma(h) >= 40 and P.delta_e(h, roles["primary"]) > 40), None)
        if other:
            infer("accent", other)
    if "onPrimary" not in roles:
        infer("onPrimary", "#ffffff" if P.contrast("#ffffff", roles["primary"]) >= P.contrast("#000000", roles["primary"]) else "#000000")  # what is written on primary is read against primary
    if page and "surface" not in roles:
        infer("surface", P.mixed(page, text, 0.04))
    if page and ("border" not in roles or P.delta_e(roles["border"], page) < SAME):
        infer("border", P.mixed(page, text, 0.14))
    if page and "muted" not in roles:
        infer("muted", P.mixed(text, page, 0.45 if dark else 0.38))
    if "link" not in roles:
        roles["link"] = roles["primary"]
        shared.append("link is the same colour as primary")
    for role in STATUS:
        if role not in roles and role in status:
            infer(role, status[role])
    roles["background"] = page or roles["background"]
    return roles | {"theme": theme, "inferred": inferred, "shared": shared, "dark_surface": dark}


def roles_of(tokens: DataFrame, heads: DataFrame) -> DataFrame:
    """One row a site: a colour for each role, which were inferred or shared, and whether the page is dark."""
    theme = F.coalesce("head_theme", "manifest_theme")
    own = heads.select("brand", theme.alias("theme"), F.explode(F.array(C.parse(theme))).alias("c"))
    own = own.select("brand", "theme", C.to_hex(F.col("c.r"), F.col("c.g"), F.col("c.b")).alias("theme_hex"))
    facts = own.join(facts_of(tokens), "brand", "left")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for r in b.to_dict("records"):
                offers = r.pop("offers")
                r = {k: v if isinstance(v, str) else None for k, v in r.items()}
                hits = {role: r[f"hit_{role}"] for role in CLAIMS if r[f"hit_{role}"]}
                status = {role: r[f"like_{role}"] for role in STATUS if r[f"like_{role}"]}
                core = distinct_colours(offered(offers)[0])[:8] if offers is not None else []
                got = assign(hits, core, r["vivid"], status, {k: ramp_stop(r, k) for k in STOPS}, r["theme"], r["theme_hex"])
                rows.append([r["brand"], *[got.get(k) for k in ROLE_KEYS], got["theme"], got["inferred"], got["shared"], got["dark_surface"]])
            yield pd.DataFrame(rows, columns=["brand", *ROLE_KEYS, "theme", "inferred", "shared", "dark_surface"])

    schema = ", ".join(["brand string", *(f"{k} string" for k in ROLE_KEYS), "theme string, inferred array<string>, shared array<string>, dark_surface boolean"])
    return facts.mapInPandas(run, schema)


def pairs_of(roles: DataFrame) -> DataFrame:
    """Contrast and grade of the pairs of roles that meet on a page."""
    own = F.create_map(*[x for k in ROLE_KEYS for x in (F.lit(k), F.col(k))])
    pairs = F.array(*[F.struct(F.lit(i).alias("ord"), F.lit(f).alias("fg"), F.lit(b).alias("bg"), F.lit(u).alias("use")) for i, (f, b, u) in enumerate(PAIRS)])
    rows = roles.select("brand", own.alias("own"), F.explode(pairs).alias("p")).select("brand", "p.*", F.col("own")[F.col("p.fg")].alias("foreground"), F.col("own")[F.col("p.bg")].alias("background"))
    shape = "^#[0-9a-f]{6}$"
    rows = rows.filter(F.col("foreground").rlike(shape) & F.col("background").rlike(shape))
    byte = lambda x, i: F.conv(F.substring(x, i, 2), 16, 10).cast("double")
    for x, column in (("f", "foreground"), ("b", "background")):
        rows = rows.withColumn(x, F.struct(*[byte(column, i).alias(n) for n, i in zip("rgb", (2, 4, 6), strict=True)]))
    light = lambda x: C.luminance(F.col(f"{x}.r"), F.col(f"{x}.g"), F.col(f"{x}.b"))
    rows = rows.withColumn("ratio", C.contrast(light("f"), light("b")))
    return rows.select("brand", "ord", "fg", "bg", "use", "foreground", "background", "ratio", C.grade(F.col("ratio")).alias("grade"))


def _parts(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    heads = site_heads(spark, sf_dir)
    return tokens_of(colour_evidence(style_sheets(spark, sf_dir), heads)), heads


def colour_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Colours of each site with evidence, tier, roles, rank and confidence."""
    return _parts(spark, sf_dir)[0]


def core_palette(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The core colours of each site in order."""
    return core_of(_parts(spark, sf_dir)[0]).select("brand", F.posexplode("core").alias("ord", "hex"))


def colour_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Designer roles of each site."""
    return roles_of(*_parts(spark, sf_dir))


def neutral_ramp(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eleven neutral steps of each site."""
    return ramp_of(*_parts(spark, sf_dir))


def contrast_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contrast of the pairs of roles of each site."""
    return pairs_of(colour_roles(spark, sf_dir))


def colour_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of each site's design tokens, distinct and declared colours, and translucent overlays left out."""
    heads = site_heads(spark, sf_dir)
    e = colour_evidence(style_sheets(spark, sf_dir), heads)
    signs = e.groupBy("brand").agg(F.count_if((F.col("at.branch") == 0) & (F.col("turn") == 0)).alias("design_tokens"), F.count_if(F.col("c.a") < OPAQUE).alias("overlays"))
    own = tokens_of(e).groupBy("brand").agg(F.count("*").alias("distinct_colours"), F.count_if(F.col("tier") != "component").alias("declared_colours"))
    out = heads.select("brand").join(signs, "brand", "left").join(own, "brand", "left")
    return out.select("brand", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("design_tokens", "distinct_colours", "declared_colours", "overlays")])


QUERIES = {f.__name__: f for f in (colour_tokens, core_palette, colour_roles, neutral_ramp, contrast_pairs, colour_sections)}
