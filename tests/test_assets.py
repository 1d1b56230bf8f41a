"""Known values of the functions over failures, links, names, images and drawings, and of the operators built on them."""

import json

import pytest
from pyspark.sql import functions as F

from sitelens.functions import assets as A
from sitelens.operators import exports, logos, messaging


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize("base, link, want", [
    ("https://a.com/x/y?q", "z.css", "https://a.com/x/z.css"), ("https://a.com/x/y", "../z", "https://a.com/z"), ("https://a.com/x/", "./z?k=1#f", "https://a.com/x/z?k=1#f"),
    ("https://a.com", "z", "https://a.com/z"), ("https://a.com/x", "//b.com/z", "https://b.com/z"), ("https://a.com/x/y", "/z", "https://a.com/z"),
    ("https://a.com/x", "http://b.com/", "http://b.com/"), ("https://a.com/x/y#f", "?k", "https://a.com/x/y?k"), ("https://a.com/", "../../z", "https://a.com/z"),
])
def test_resolve_url(spark, base, link, want):
    assert one(spark, A.resolve_url(F.lit(base), F.lit(link))) == want


def test_failures_and_names(spark):
    got = one(spark, A.explain_error(F.lit("page_not_found"), F.lit("https://a.com/"), F.lit(404)))
    assert got == "That page does not exist (404). (https://a.com/ · HTTP 404)"
    assert one(spark, A.explain_error(F.lit(None).cast("string"), F.lit(""), F.lit(0))) == "That URL could not be read."
    assert one(spark, A.is_request_level(F.lit("http_429"))) and not one(spark, A.is_request_level(F.lit("timeout")))
    assert one(spark, A.same_site(F.lit("https://app.a.com/x"), F.lit("https://www.a.com"))) and not one(spark, A.same_site(F.lit("https://a.com"), F.lit("https://b.com")))
    assert one(spark, A.clean_name(F.lit('"Acme  Works Ltd."'))) == "Acme Works" and one(spark, A.clean_name(F.lit(None).cast("string"))) == "Unknown"
    assert one(spark, A.title_case(F.lit("new well-known x"))) == "New Well-Known X"
    assert one(spark, A.xml_escape(F.lit('<a & "b">'))) == "&lt;a &amp; &quot;b&quot;&gt;" and one(spark, A.quote_font(F.lit("A B"))) == '"A B"'
    assert one(spark, A.short_host(F.lit("https://www.a.com/x"))) == "a.com" and one(spark, A.decode_entities(F.lit("a&amp;b &#8212; c&nbsp;"))) == "a&b c"


def test_images(spark):
    assert tuple(one(spark, A.image_format(F.lit("https://a.com/x.SVG?v=1")))) == ("svg", 30) and tuple(one(spark, A.image_format(F.lit("https://a.com/x")))) == ("png", 0)
    assert one(spark, A.largest_side(F.lit("16x16 180x192"))) == 192 and one(spark, A.largest_side(F.lit("any"))) is None
    kinds = [one(spark, A.logo_type(F.lit(s), F.lit("ico"), F.lit("icon"))) for s in ("440x200", "100x200", "64x64", "any")]
    assert kinds == ["horizontal lockup", "stacked or mark-only", "square mark", "favicon mark"]


@pytest.mark.parametrize("markup, tone, swatches", [
    ('<svg><path fill="#ffffff"/></svg>', "light", 1), ('<svg><path fill="#0f172a"/><path style="fill:#111"/></svg>', "dark", 2), ('<svg fill="currentColor"/>', "inherit", 0),
    ('<svg><path fill="none"/></svg>', "unknown", 0), ('<svg><stop stop-color="rgb(250, 250, 250)"/></svg>', "light", 1), (None, "unknown", 0),
])
def test_svg_tone(spark, markup, tone, swatches):
    assert tuple(one(spark, A.svg_tone(F.lit(markup).cast("string")))) == (tone, swatches)


def test_sanitise_svg(spark):
    clean = lambda s: one(spark, A.sanitise_svg(F.lit(s).cast("string")))
    bad = '<?xml version="1.0"?><!-- x --><svg viewBox="0 0 1 1" onload="a()"><script>b()</script><set x="1"/><use href="https://e/x.svg#y"/><use href="#z"/><path fill="url(https://e/)" stroke="url(#g)"/></svg>'
    assert clean(bad) == '<svg viewBox="0 0 1 1"><use href=""/><use href="#z"/><path fill="none" stroke="url(#g)"/></svg>'
    assert clean("<html><svg viewBox='0 0 1 1'></svg></html>") == clean("<svg width='1'></svg>") == clean(None) == ""


def test_logos(spark):
    rows = [("s", 1, "https://a.com/x.png#1", "icon", 50.0, "one", None), ("s", 2, "https://a.com/x.png", "icon", 60.0, "two", "64x64"), ("s", 3, "https://a.com/y.svg", "icon", 20.0, "three", None), ("s", 4, "https://a.com/header-logo.png", "logo", 48.0, "four", None), ("s", 5, "ftp://a", "logo", 99.0, "five", None)]
    ranked = logos.rank(spark.createDataFrame(rows, "site string, ord long, url string, kind string, score double, reason string, size string"))
    got = [(r.url[-9:], r.score, r.reason, r.pixels) for r in ranked.orderBy("rank").collect()]
    assert got == [("com/x.png", 60.0, "one; two", 64), ("com/y.svg", 50.0, "three", None), ("-logo.png", 48.0, "four", None)]
    chosen = logos.choose(ranked, ranked.select("url")).first()
    assert chosen.primary.endswith("y.svg") and chosen.lockup.endswith("header-logo.png") and len(chosen.alternates) == 2 and chosen.rejected == [] and chosen.confidence == 0.84
    none = logos.choose(ranked, ranked.select("url").filter("false")).first()
    assert none.primary is None and none.confidence == 0.0 and len(none.rejected) == 3


def test_messaging(spark):
    page = "<p>Sold in 1999 to nobody at all, they say.</p><li>sold in 1999 to nobody at all, they say. Again.</li><p>It is fast and free for all who want to try it.</p><p>Nothing is said here that anybody could check.</p><p>x</p>"
    pages = spark.createDataFrame([(1, "https://a.com/about", page + "<a href='mailto:hi%40a.com?x'>m</a><a href='https://linkedin.com/company/a?y'>l</a> by Acme Works Ltd, all")], "page_id long, url string, html string")
    assert messaging.paragraph_rows(pages).count() == 4
    assert [r.text[:12] for r in messaging.claim_rows(messaging.paragraph_rows(pages)).orderBy("rank").collect()] == ["Sold in 1999", "It is fast a"]
    got = messaging.contacts(pages.withColumn("site", F.lit("a")), "site").first()
    assert got.emails == ["hi@a.com"] and got.linkedin == ["https://linkedin.com/company/a"] and got.legal_name.endswith("Acme Works Ltd")
    assert one(spark, messaging.positioning(F.lit("Analytics"), F.lit("See it all"), F.lit("teams"))) == "Analytics that see it all, for teams"
    assert one(spark, messaging.category(F.lit("a design API"))) == "Developer platform" and one(spark, messaging.category(F.lit("rapid"))) is None
    assert one(spark, messaging.reading_grade(F.lit(100), F.lit(10), F.lit(150))) == 6.0


def test_exports(spark):
    rows = [("B 1", 1, "colour", "primary", "#ff8000", True), ("B 1", 2, "colour", "neutral-50", "#fafafa", False), ("B 1", 0, "font", "font-body", '"A B"', True), ("B 1", 1, "size", "size-h1", "32px", True)]
    tokens = spark.createDataFrame(rows, "brand string, ord int, kind string, name string, value string, declared boolean")
    text = {f: exports.render(tokens, f).first() for f in exports.FORMATS}
    theme = json.loads(text["tailwind"].text)["theme"]["extend"]
    assert theme == {"colors": {"primary": "#ff8000", "neutral": {"50": "#fafafa"}}, "fontFamily": {"body": '"A B"'}, "fontSize": {"h1": "32px"}}
    figma = json.loads(text["figma"].text)
    assert figma["variableCount"] == 4 and figma["variables"][0]["valuesByMode"]["Default"] == {"r": 1.0, "g": 0.502, "b": 0.0, "a": 1}
    assert text["css"].text == ':root {\n  --color-primary: #ff8000;\n  --color-neutral-50: #fafafa;  /* inferred */\n  --font-body: "A B";\n  --size-h1: 32px;\n}\n'
    assert text["markdown"].filename == "b-1-markdown.md" and "| primary | `#ff8000` | declared |" in text["markdown"].text and len(json.loads(text["json"].text)) == 4
    with pytest.raises(ValueError, match="no such format"):
        exports.render(tokens, "pdf")
    both = exports.most_and_least(spark.createDataFrame([("a", 3), ("b", 9)], "brand string, score int")).first()
    assert tuple(both) == ("b", 9, "a", 3)
