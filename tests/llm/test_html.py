"""Pages by hand, hostile pages, and the query over a table with odd rows."""

import time

import pytest
from pyspark.sql import functions as F

from sitelens.llm import html_extract, queries

SF = "/root/testdata/sf0.001"
LONG = "This is the text of a paragraph that has more than seventy characters and the usual words of the language in it."

PAGES = [
    ("<div class='layout has-sidebar'><article><p>One.</p></article></div>", "One."),
    ("<div id='search-results-page'><article><p>One.</p><div class=comments><p>x</p></div></article></div>", "One."),
    ("<div data-id='related'><article><p>One.</p></article></div>", "One."),
    ("<article><p>One.</p></article><div class=related><article><p>Two</p></article></div>", "One."),
    ("<article><p>One.</p><p><a href=x>Only a link</a></p><ul><li><a href=y>menu entry</a></ul></article>", "One.\nOnly a link"),
    (f"<div class=widget><p>{LONG}</p><p>{LONG}</p></div><div class=ad>Buy</div>", f"{LONG}\n{LONG}"),
    (f"<p>{LONG}</p><div hidden>{LONG}</div><p style='display: none'>{LONG}</p>", LONG),
    ("<main><h1>T</h1><p>a&nbsp;b&amp;c &#x41;&#66;</p><script>if (a<b) {}</script><style>p{}</style></main>", "T\na b&c AB"),
    ("<article><p>cut <b", "cut"),
    ("<html><head><title>t</title><body><article><p>One.</p></article>", "One."),
    ("<html><head><meta charset=u><link rel=x><title>t</title><article><p>One.</p></article>", "One."),
    (f"<head><title>t</title>\n<style>p{{}}</style>{LONG}", LONG),
    ("<head><template><div>no</div></template><script>x</script><p>One.", "One."),
    ("<body><form action=x><nav><a href=y>Menu</a></nav><article><p>One.</p><form><p>Your comment</p></form></article></form>", "One."),
    (f"<body><form id=aspnetForm><div class=menu><a href=y>Menu</a></div><p>{LONG}</p><p>{LONG}</p></form>", f"{LONG}\n{LONG}"),
    (f"<p>{LONG}</p><form><label>Your name</label></form><p>{LONG}</p>", f"{LONG}\n{LONG}"),
    ("<article><div class='entry-header'><h1>Title</h1></div><p class='teaser'>Lead.</p><h2 id='login-flow'>Flow</h2><h2 id='search'>Search</h2><p>End.</p></article>", "Title\nLead.\nFlow\nSearch\nEnd."),
    ("<article><p>One.</p><div class='comment-list'><p>Reader</p></div><div class=notice>Sign in</div><div class='share-bar'>Share</div></article>", "One."),
    ("<article><table><tr><td><a href=x>Cell</a><td>Plain</table></article>", "Cell\nPlain"),
    ("<ul><li><a href=x>\u9996\u9875</a></ul><div>" + "\u8fd9\u662f\u4e00\u6bb5\u6b63\u6587\u3002" * 6 + "</div>", "\u8fd9\u662f\u4e00\u6bb5\u6b63\u6587\u3002" * 6),
    (f"<h2 id=related>Heads</h2><p>{LONG}</p>", f"Heads\n{LONG}"),
    ("", ""),
    (None, ""),
]


@pytest.mark.parametrize("page, text", PAGES)
def test_pages(page, text):
    assert html_extract.main_text(page) == text


@pytest.mark.parametrize("unit", ["<b>", "<b></i>", "<i><div></i>", "<div class=ad>", "</p>", "<p><a>", "<!--", "<a '", "<td>x", "&amp", "<"])
def test_time_grows_with_the_page(unit):
    took = []
    for n in (10_000, 80_000):
        began = time.process_time()
        html_extract.main_text(unit * n)
        took.append(time.process_time() - began)
    assert took[1] < 30 * took[0] + 0.5


def test_table(spark):
    pages = spark.createDataFrame([(i, "u", page, "x", 1) for i, (page, _) in enumerate(PAGES)] + [(None, None, "<p>" + "x" * 1_000_000, "x", 1)], "page_id bigint, url string, html string, text string, n_chars int")
    got = html_extract.extract(pages)
    assert got.columns == ["page_id", "url", "text", "n_chars"]
    rows = {r.page_id: (r.text, r.n_chars) for r in got.collect()}
    assert rows == {i: (text, len(text)) for i, (_, text) in enumerate(PAGES)} | {None: ("x" * 1_000_000, 1_000_000)}
    assert html_extract.extract(pages.filter("false")).count() == 0


def test_query_keeps_articles(spark):
    got = queries.op1_html_extraction(spark, SF)
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    joined = got.join(pages, "page_id").filter(F.col("html").rlike("<article"))
    assert joined.filter("n_chars = 0").count() == 0 and got.count() == pages.count()
