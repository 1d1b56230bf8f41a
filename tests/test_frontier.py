"""Page selection and the plan of a site on hand-made pages."""

import pytest

from sitelens.operators import frontier


def pages(spark, links, home="https://www.acme.example/"):
    html = "".join(f'<a class="x" href="{x}">y</a>' for x in links)
    return spark.createDataFrame([(1, home, f"<body>{html}</body>")], "page_id bigint, url string, html string")


def picked(spark, links, limit=7, home="https://www.acme.example/"):
    rows = frontier.select_pages(pages(spark, links, home), limit).orderBy("rank").collect()
    return [(r.url, r.intent, r.score, r.reason) for r in rows]


def test_doors_files_and_strangers_are_left_out(spark):
    base = "https://www.acme.example"
    bad = ["/sign-in-to-it", "/log-in-here", "/privacy", "/rss", "/page.pdf?x=1", "/downloads", "/checkout", "https://other.example/about", "mailto:a@b.example", "javascript:x()", "#top", "/", "", "/a/b/c", "tel:1", "/search?q=1"]
    assert picked(spark, [*bad, "/about"]) == [(f"{base}/about", "about", 34, "about page, top level")]


def test_intents_by_the_first_rule_and_two_of_each(spark):
    base = "https://www.acme.example"
    got = picked(spark, ["/pricing", "/roundabout", "/about", "/about/", "/company", "/mission", "/blog", "/team/x", "/our-products", "/resources/a", "//www.acme.example/careers#now"], limit=9)
    assert got == [
        (f"{base}/about", "about", 34, "about page, top level"),
        (f"{base}/company", "about", 34, "about page, top level"),
        (f"{base}/careers", "careers", 30, "careers page, top level"),
        (f"{base}/pricing", "pricing", 24, "pricing page, top level"),
        (f"{base}/blog", "blog", 16, "blog page, top level (section index)"),
        (f"{base}/roundabout", "page", 10, "site page, top level"),
        (f"{base}/our-products", "page", 10, "site page, top level"),  # a path begins with a slash, so the product rule can't match
    ]
    assert len(picked(spark, [f"/p{i}" for i in range(20)])) == 2 and len(picked(spark, ["/about", "/careers", "/pricing"], limit=2)) == 2


@pytest.mark.parametrize("link", ["about", "./about", "../about", "/x/../x/about", "HTTPS://WWW.ACME.EXAMPLE/about", "https://shop.acme.example/about?a=1&amp;b=2"])
def test_links_are_resolved(spark, link):
    got = picked(spark, [link], home="https://www.acme.example/x/y")
    assert len(got) == 1 and got[0][1] == "about" and "#" not in got[0][0] and got[0][0].startswith("https://")


def test_a_plan_follows_stored_pages_level_by_level(spark):
    a = "https://acme.example"
    page = lambda i, url, *links: (i, url, "".join(f"<a href='{x}'>l</a>" for x in links))
    stored = [
        page(1, f"{a}/", "/about", "/blog", "/careers", "https://else.example/about"),
        page(2, f"{a}/about/", "/", "/about", "/about/team", "/mission", "/company", "/values"),
        page(3, f"{a}/careers?utm_source=x", "/jobs/one", "/jobs/two", "/jobs/three", "/about"),
        page(4, f"{a}/jobs/one", "/deep"), page(5, "https://else.example/", "/about"), page(6, None), page(7, f"{a}/about", "/never"), (8, f"{a}/null", None),
    ]
    df = spark.createDataFrame(stored, "page_id bigint, url string, html string")
    seeds = spark.createDataFrame([("acme.example", a), ("else.example", "else.example"), ("gone.example", "https://gone.example/x"), ("bad", None)], "site string, url string")
    got = {(r.site, r.level, r.url.removeprefix(a), r.intent, r.via, r.stored) for r in frontier.crawl_plan(df, seeds).collect()}
    assert got == {
        ("acme.example", 0, "/", "home", None, 1), ("else.example", 0, "https://else.example/", "home", None, 5), ("gone.example", 0, "https://gone.example/x", "home", None, None),
        ("acme.example", 1, "/about", "about", 1, 2), ("acme.example", 1, "/careers", "careers", 1, 3), ("acme.example", 1, "/blog", "blog", 1, None), ("else.example", 1, "https://else.example/about", "about", 5, None),
        ("acme.example", 2, "/mission", "about", 2, None), ("acme.example", 2, "/company", "about", 2, None),  # two of an intent, though /values and /about/team are there
        ("acme.example", 2, "/jobs/one", "careers", 3, 4), ("acme.example", 2, "/jobs/two", "careers", 3, None),
    }
    deeper = frontier.crawl_plan(df, seeds, levels=3)
    assert [r.url for r in deeper.filter("level = 3").collect()] == [f"{a}/deep"]
    assert frontier.crawl_plan(df, seeds, depth="quick").filter("level > 0").count() == 0
    assert frontier.crawl_plan(df.filter("false"), seeds).count() == 3
