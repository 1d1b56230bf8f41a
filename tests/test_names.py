"""Heads and names of sites on hand-made pages."""

import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sitelens.functions import head as H
from sitelens.operators import names


def named(spark, host, html, manifest=None):
    df = spark.createDataFrame([("s", host, html, manifest)], "site string, host string, html string, manifest_name string")
    return names.names_of(df).first()


@pytest.mark.parametrize(
    ("host", "html", "manifest", "name", "basis"),
    [
        ("www.tax.example", "<head><title>Welcome to TAX.EXAMPLE</title></head><main><h2>Forms on TAX.EXAMPLE</h2><h2>Rates and reliefs</h2></main>", None, "TAX.EXAMPLE", "the domain, as the site writes it"),
        ("lumo.example", "<meta property='og:title' content='Lumo Lamps for the Whole Wide World'><p>We at LuMo build lamps.</p>", None, "LuMo", "the domain, as the site writes it"),
        ("www2.zzz.example", "<h1>Home</h1><h2>Brass &amp; Sons</h2>", None, "Brass & Sons", "a page heading"),
        ("zzz.example", "<h1>Read all about Zzz</h1>", None, "Zzz", "the domain, as the site writes it"),
        ("zzz.example", "<h1>N</h1><h3>One two three four five six seven</h3><h4>Fir</h4><h3> Tall   <b>Oak</b></h3>", None, "Tall Oak", "a page heading"),
        ("zzz.example", '<head><meta content="Oak, Inc." property="og:site_name"><meta name=og:title content="Oak | trees"></head>', None, "Oak,", "og:site_name"),
        ("zzz.example", '<head><meta property="og:site_name" content="An Endless Name of Far Too Many Words"><meta property="og:title" content="Oak &#8211; trees"><title>x</title>', None, "Oak", "og:title"),
        ("zzz.example", "<head><title>Elm - the tree people</title></head>", None, "Elm", "title tag"),
        ("zzz.example", "<h1>Ash</h1>", "Birch Ltd", "Birch", "web app manifest"),
        ("shop.zzz.example", None, None, "shop.zzz.example", "domain name"),
        ("shop.zzz.example", "", None, "shop.zzz.example", "domain name"),
    ],
)
def test_the_best_source_names_the_site(spark, host, html, manifest, name, basis):
    got = named(spark, host, html, manifest)
    assert (got.name, got.basis) == (name, basis)
    assert got.candidates.endswith("domain name=" + host.removeprefix("www."))


def test_a_phrase_about_the_site_is_no_name(spark):
    df = spark.createDataFrame([("<h2>Read all about Zzz</h2><h2>Zzz</h2>", "zzz"), ("<h2>Read all about Zzz</h2>", "zzz"), ("<h2>About Zzz</h2>", None)], "html string, label string")
    assert [r.x for r in df.select(names.heading_name(F.col("html"), F.col("label")).alias("x")).collect()] == ["Zzz", None, "About Zzz"]


def test_a_needle_is_found_where_it_stands_alone(spark):
    @settings(max_examples=25, deadline=None)
    @given(st.text("aAb.- (\n_", max_size=25), st.sampled_from(["ab", "a.b", "aa", "b"]))
    def run(text, needle):
        df = spark.createDataFrame([(text, needle)], "t string, n string")
        got = df.select(names.written_name(F.col("t"), F.col("n")).alias("x")).first().x
        want = re.search(rf"(^|[^\w.-]){re.escape(needle)}(?![\w-])", text, re.I | re.A) if len(needle) > 1 else None
        assert got == (want.group(0).strip() if want else None)

    run()


def test_heads(spark):
    html = """<html><head lang=x><title>A &amp; B &#x1F600;&#233;</title><META NAME="Description" content='one &quot;two&quot;'>
      <meta property="og:image" name="skip" content=/i.png /><meta name="description" content="last"><meta name=empty content=""><meta charset=u>
      <link rel="Stylesheet preload" href="/a.css"><link href=/b.ico rel='shortcut icon' sizes=16x16><body><meta name="late" content="no">"""
    df = spark.createDataFrame([(html,), ("<p>x</p>",), (None,)], "html string")
    head = H.head_of(F.coalesce("html", F.lit("")))
    rows = df.select(H.title(head).alias("title"), H.metas(head).alias("m"), H.links(head).alias("links")).select("*", *[H.meta(F.col("m"), k).alias(k.replace(":", "_")) for k in ("description", "og:image", "empty", "late", "skip")]).collect()
    r = rows[0]
    assert (r.title, r.description, r.og_image, r.empty, r.late, r.skip) == ("A & B \U0001f600é", "last", "/i.png", None, None, None)
    assert [tuple(x) for x in r.links] == [("Stylesheet preload", "/a.css", None, None), ("shortcut icon", "/b.ico", None, "16x16")]
    assert all(x.title is None and x.m == [] and x.description is None for x in rows[1:])


def test_references(spark):
    for raw, want in [("&#65;&#x42;", "AB"), ("&#0;", "\x00"), ("&#99999999999;&#xD800;&#x110000;", ""), ("a&b &lt;&amp;gt; &#; &#x;", "a&b <> &#; &#x;"), ("", ""), ("&#0000000000065;", "A")]:
        df = spark.createDataFrame([(raw,)], "t string")
        assert df.select(H.decoded(F.col("t")).alias("x")).first().x == want, raw
