"""Terms, pillars, taglines, headlines and positions on hand-made pages on which simpler rules fail."""

import math

from pyspark.sql import functions as F

from sitelens.operators import messaging, themes

HOME = """<head><title>Brookline</title><meta property="og:description" content="The leading ledger for teams that rent boats">
<meta name="description" content="Boat rental, with reporting and metrics"></head>
<h2>Zebra rentals start here</h2><h2>Rental rates and rental terms</h2><h1>Rent boats</h1><h3>Rental for harbours &amp; harbours</h3><h2>zebra RENTALS start here</h2><h2>Menu of things</h2><h4>Rental rental deep</h4>"""
ABOUT = "<h1>Ask every harbour</h1><h2>Apples are not boats</h2><p>Our developers and engineers and developers love teams, teams and teams, and teams.</p>"


def pages(spark, *rows):
    return spark.createDataFrame([(s, i, h) for s, i, h in rows], "site string, page_id bigint, html string")


def shop(spark):
    return pages(spark, ("b", 1, HOME), ("b", 2, ABOUT), ("b", 3, None), ("c", 4, "<p>none</p>"), ("d", 5, "<h2>Der Tag im Hafen</h2>"))


def test_terms_count_headings_not_pages(spark):
    got = {r.term: r for r in themes.terms_of(themes.heading_rows(shop(spark))).filter("site = 'b'").collect()}
    # six headings of levels 1 to 3; "rental" twice in one and once in another; "harbours" twice in one
    assert (got["rental"].mentions, got["rental"].headings) == (3, 2) and got["rental"].weight == math.floor(3 * math.log(1 + 6 / 2) * 1000 + 0.5) / 1000
    assert (got["harbours"].mentions, got["harbours"].headings) == (2, 1) and got["boats"].headings == 2
    assert got["rental"].rank == 1 and got["harbours"].rank == 2 and "deep" not in got and "every" not in got
    assert got["zebra"].rank < got["ask"].rank  # of equal weights the first to appear


def test_pillars_with_support_and_prevalence(spark):
    p = shop(spark)
    got = {r.theme: r for r in themes.pillars_of(p, themes.heading_rows(p)).filter("site = 'b'").collect()}
    rent = got["rental"]
    assert (rent.rank, rent.name, rent.terms) == (1, "Rental", "rental, rentals") and rent.prevalence == 0.33
    assert rent.support == "Zebra rentals start here | Rental rates and rental terms | Rental for harbours & harbours"
    assert got["harbour"].terms == "harbours, harbour" and got["harbour"].prevalence == 0.67 and len(got) == 5
    assert got["boat"].support == "Rent boats | Apples are not boats"


def test_headlines_keep_page_order_within_a_level(spark):
    got = [(r.rank, r.level, r.heading) for r in themes.headlines_of(themes.heading_rows(shop(spark))).filter("site = 'b'").orderBy("rank").collect()]
    assert got == [(1, 1, "Rent boats"), (2, 1, "Ask every harbour"), (3, 2, "Zebra rentals start here"), (4, 2, "Rental rates and rental terms"), (5, 2, "Apples are not boats"), (6, 3, "Rental for harbours & harbours")]
    many = pages(spark, ("m", 1, "".join(f"<h2>Heading number {i}</h2>" for i in range(30))))
    assert [r.heading for r in themes.headlines_of(themes.heading_rows(many)).orderBy("rank").collect()] == [f"Heading number {i}" for i in range(14)]


def test_taglines_of_heads_and_headings(spark):
    p = shop(spark)
    got = themes.taglines_of(themes.homes_of(p), themes.heading_rows(p)).orderBy("site", "rank").collect()
    b = [(r.text, r.kind, r.score) for r in got if r.site == "b"]
    assert b[0] == ("The leading ledger for teams that rent boats", "og:description", 10.8)
    assert ("Ask every harbour", "h1", 8.2) in b and ("Boat rental, with reporting and metrics", "meta description", 8.8) in b and len(b) == 6
    assert [x[2] for x in b] == sorted((x[2] for x in b), reverse=True)
    assert [(r.text, r.kind) for r in got if r.site == "d"] == [("Der Tag im Hafen", "h2")] and not [r for r in got if r.site == "c"]


def test_positions_from_heads_not_bodies(spark):
    p = shop(spark)
    got = {r.site: r for r in themes.positions_of(p, themes.homes_of(p), themes.heading_rows(p)).collect()}
    # "developers" in a body makes no category; "reporting" in the description does; six "teams" beat three "developers"
    assert (got["b"].category, got["b"].audience) == ("Analytics", "teams")
    assert got["b"].statement == "Analytics that the leading ledger for teams that rent boats, for teams"
    assert got["c"].category is None and got["c"].statement is None and got["d"].statement == "der Tag im Hafen"
    assert themes.positions_of(p.filter("false"), themes.homes_of(p.filter("false")), themes.heading_rows(p.filter("false"))).count() == 0


def test_grade_reads_kept_sentences_alone(spark, tmp_path):
    text = "Menu. Home. Buy now. Shop. This sentence has seven words in it. Accept all cookies before you can read anything here."
    spark.createDataFrame([(1, text), (2, "Menu. Home."), (3, None)], "doc_id bigint, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r for r in messaging.document_grade(spark, str(tmp_path)).collect()}
    assert (got[1].words, got[1].sentences) == (21, 1) and got[1].grade == round(0.39 * 21 + 11.8 * 9 / 21 - 15.59, 1)
    assert got[2].grade is None and got[3].words == 0 and got[3].grade is None


def test_stems_and_case(spark):
    df = spark.createDataFrame([("a",)], "x string")
    assert df.select(themes.tagline_points(F.lit("Seven words are the best of all."), F.lit("h1")).alias("s")).first().s == 12.0
