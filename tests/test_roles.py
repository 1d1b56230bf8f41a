"""Colour roles on hand-made sheets whose roles are known."""

import pytest
from pyspark.sql import functions as F

from sitelens.functions import colour as C
from sitelens.functions import plain_colour as P
from sitelens.operators import roles as R
from sitelens.operators import sheets as S

SITE = """/* #00ff00 */:root{--theme-bg-primary:#fcfcfc;--theme-bg-secondary:#f4f4f4;--theme-text-primary:#2b2d31;
--theme-border-primary:#e4e4e6;--theme-brand-bg:#0f766e;--theme-brand-text:#fcfcfc;--theme-accent:#10776f;
--theme-accent-hover:#3f9a92;--theme-accent-tint:#eef8f6;--theme-link-primary:#0f766e;--tag-border:#0000001a}
.p{color:#fcfcfc}.q{color:#fcfcfc;border:1px solid #0000001a}"""
BARE = ":root{--background: 60 20% 98%;--foreground: 210 30% 14%;--primary: 150 40% 24%;--primary-foreground: 60 50% 95%}"
CARD = ":root{--shop-body-background-color:#fdfdfd;--shop-text-color:#1b1b1a;--shop-surface-background-color:#ededec;--shop-surface-text-color:#1b1b1a;--shop-brand-color:#8a1c4a}"
HAIR = ":root{--theme-bg-primary:#fafafa;--theme-border-primary:#fafafa;--theme-brand-bg:#b4551d}"
GREY = ":root{--ui-link-color:#d5dade;--moss-brand:#5f8f3f}"
YELLOW = ":root{--theme-bg-primary:#ffffff;--theme-text-primary:#101010;--theme-brand-bg:#ffee00}"
SHEETS = {"site": SITE, "bare": BARE, "card": CARD, "hair": HAIR, "grey": GREY, "yellow": YELLOW, "dark": "", "shade": ":root{--color-green:#11aa33}a{color:#111111}b{color:#777777}i{color:#eeeeee}"}


@pytest.fixture(scope="module")
def parts(spark):
    sheets = spark.createDataFrame([(k, 1, v) for k, v in SHEETS.items()], "brand string, ord long, css string")
    heads = spark.createDataFrame([(k, "#0b0d12" if k in ("site", "dark") else None, None) for k in SHEETS], "brand string, head_theme string, manifest_theme string")
    evidence = R.colour_evidence(sheets, heads)
    return evidence, R.tokens_of(evidence).cache(), heads


@pytest.fixture(scope="module")
def roles(parts):
    df = R.roles_of(parts[1], parts[2]).cache()
    return df, {r.brand: r for r in df.collect()}


def test_declared_roles(roles):
    r = roles[1]["site"]
    assert (r.primary, r.background, r.text, r.border, r.onPrimary, r.link) == ("#0f766e", "#fcfcfc", "#2b2d31", "#e4e4e6", "#fcfcfc", "#0f766e")
    assert r.accent is None and "muted" in r.inferred and "link is the same colour as #0f766e" in r.shared and not r.dark_surface
    assert roles[1]["bare"].primary == "#25563d"


def test_cards_hairlines_and_greys(roles):
    by = roles[1]
    # a surface named by its background is a background; the card is derived from page and text
    assert by["card"].surface == P.mixed("#fdfdfd", "#1b1b1a", 0.04) and by["card"].text == "#1b1b1a"
    assert by["hair"].border != by["hair"].background and "border" in by["hair"].inferred
    assert by["grey"].link != "#d5dade" and by["grey"].primary != "#d5dade"


def test_on_primary_is_read_against_primary(roles):
    assert (roles[1]["yellow"].primary, roles[1]["yellow"].onPrimary) == ("#ffee00", "#000000") and "onPrimary" in roles[1]["yellow"].inferred


def test_sites_without_tokens(roles):
    r = roles[1]["dark"]
    assert (r.background, r.text, r.dark_surface, r.theme) == ("#0b0d12", "#f1f5f9", True, "#0b0d12")
    assert r.primary == r.text and r.accent is None
    assert roles[1]["shade"].success == "#11aa33"


def test_overlays_variants_and_core(parts):
    evidence, tokens, _ = parts
    assert evidence.filter("c.a < 0.6").count() > 0 and tokens.filter("brand = 'site' AND hex = '#000000'").count() == 0
    core = {r.brand: r.core for r in R.core_of(tokens).collect()}
    # --theme-brand-text names the page a primary too, and the page ranks first
    assert not {"#eef8f6", "#3f9a92"} & set(core["site"]) and core["site"][:2] == ["#fcfcfc", "#0f766e"]
    assert all(P.delta_e(a, b) >= 4.5 for c in core.values() for a in c for b in c if a != b)


def test_ramp_and_pairs(parts, roles):
    ramp = {}
    for r in R.ramp_of(parts[1], parts[2]).collect():
        ramp.setdefault(r.brand, {})[r.stop] = r.hex
    assert ramp["dark"] == R.DEFAULT_RAMP
    greys = ("#111111", "#777777", "#eeeeee")
    for stop, target in R.STOPS.items():
        near = [g for g in greys if abs(round(P.lightness(g), 3) - target) < 0.045]
        assert ramp["shade"][stop] == (near[0] if near else P.mixed("#ffffff", "#777777", 1 - target))
    pairs = {(r.brand, r.use): r for r in R.pairs_of(roles[0]).collect()}
    assert len(pairs) == 7 * len(SHEETS)
    assert pairs["card", "body copy on a card"].ratio > 4.5
    assert all(r.ratio == P.contrast(r.foreground, r.background) for r in pairs.values())


def test_uses_count_longer_names_too(spark):
    sheets = spark.createDataFrame([("x", 1, ":root{--a:#111111;--a-b:#222222}p{color:var(--a);top:var( --a-b);left:var(--a-b-c)}")], "brand string, ord long, css string")
    got = {r.name: r.used for r in S.token_uses(sheets, S.properties(sheets)).collect()}
    assert got == {"--a": 3, "--a-b": 2}


def test_plain_distance_is_the_columns_distance(spark):
    hexes = ["#000000", "#ffffff", "#0f766e", "#10776f", "#dc143c", "#00ff7f", "#808080", "#1b1b1a", "#ededec", "#8a1c4a"]
    df = spark.createDataFrame([(a, b, P.lab(a), P.lab(b)) for a in hexes for b in hexes], "a string, b string, p struct<l:double,a:double,b:double>, q struct<l:double,a:double,b:double>")
    for r in df.select("a", "b", C.delta_e(F.col("p"), F.col("q")).alias("d")).collect():
        assert abs(r.d - P.delta_e(r.a, r.b)) < 2e-4
    own = spark.createDataFrame([(h, *map(float, P.channels(h))) for h in hexes], "h string, r double, g double, b double")
    for r in own.select("h", C.lab(F.col("r"), F.col("g"), F.col("b")).alias("lab")).collect():
        assert all(abs(x - y) < 1e-9 for x, y in zip(r.lab, P.lab(r.h), strict=True))
