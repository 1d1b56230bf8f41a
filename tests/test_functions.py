import pytest
from pyspark.sql import functions as F

from sitelens.functions import colour as C
from sitelens.functions import text as T
from sitelens.functions import url as U
from sitelens.operators import crawl as K
from sitelens.operators import faces as A
from sitelens.operators import sheets, voice


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize("s, want", [("#7070ff", (112, 112, 255, 1)), ("rgba(1,2,3,0.5)", (1, 2, 3, 0.5)), ("hsl(0, 100%, 50%)", (255, 0, 0, 1)), ("white", (255, 255, 255, 1)), ("#fff", (255, 255, 255, 1)), ("transparent", (0, 0, 0, 0)), ("#12", None), ("#12345", None), ("rgb(", None), ("notacolour", None), ("", None), ("aqua", None)])
def test_parse(spark, s, want):
    got = one(spark, C.parse(F.lit(s)))
    assert (got is None) if want is None else tuple(got) == pytest.approx(want, abs=1e-6)


def test_bare_hsl(spark):
    p = C.parse(F.lit("20 48% 22%"))
    assert one(spark, C.to_hex(p["r"], p["g"], p["b"])) == "#532f1d"


@pytest.mark.parametrize("p, q, want", [((50, 2.6772, -79.7751), (50, 0, -82.7485), 2.0425), ((50, 3.1571, -77.2803), (50, 0, -82.7485), 2.8615), ((50, 2.8361, -74.02), (50, 0, -82.7485), 3.4412), ((50, -1.3802, -84.2814), (50, 0, -82.7485), 1.0), ((50, 0, 0), (50, -1, 2), 2.3669), ((50, 2.5, 0), (73, 25, -18), 27.1492), ((2.0776, 0.0795, -1.135), (0.9033, -0.0636, -0.5514), 0.9082)])
def test_delta_e(spark, p, q, want):
    lab = lambda t: F.struct(*[F.lit(float(x)).alias(n) for n, x in zip("lab", t, strict=True)])
    assert one(spark, C.delta_e(lab(p), lab(q))) == pytest.approx(want, abs=2e-4)


def test_contrast(spark):
    lum = lambda *c: C.luminance(*[F.lit(float(x)) for x in c])
    assert one(spark, C.contrast(lum(0, 0, 0), lum(255, 255, 255))) == 21
    assert one(spark, C.contrast(lum(0x28, 0x2A, 0x30), lum(255, 255, 255))) == pytest.approx(14.34, abs=0.05)


def test_urls(spark):
    assert one(spark, U.normalise(F.lit("linear.app?utm_source=x&ref=y"))) == "https://linear.app/"
    assert one(spark, U.root_host(F.lit("app.linear.app"))) == "linear.app"
    assert one(spark, U.root_host(F.lit("www.a.b.co.uk"))) == "b.co.uk"
    assert one(spark, U.normalise(F.lit("http://127.0.0.1/x"))) is None


def test_text(spark):
    assert one(spark, T.stem(F.lit("companies"))) == "company"
    assert one(spark, T.stem(F.lit("class"))) == "class"
    assert one(spark, T.term_count(F.lit("Powerful and powerful, up to now"), T.LEXICONS["power"])) == 4
    assert one(spark, T.html_to_text(F.lit("<nav>x</nav><p>a &amp;  b</p><script>c</script>"))) == "a & b"


@pytest.mark.parametrize("raw, value, url", [("  the website for   lumo ", "lumo", False), ("lumo official site", "lumo", False), ("@brook", "brook", False), ("TAX.XY", "TAX.XY", False), ("tax.xy", "tax.xy", True), ("www.x.y/z", "www.x.y/z", True), ("site", "site", False), ("@a/b", "@a/b", False)])
def test_inputs(spark, raw, value, url):
    assert one(spark, K.clean_input(F.lit(raw))) == value
    assert one(spark, K.looks_like_url(F.lit(value))) is url


def test_outcomes(spark):
    t = lambda rows, schema: spark.createDataFrame(rows, schema)
    got = K.outcomes(t([(i,) for i in range(4)], "u long"), t([(0,), (0,)], "u long"), t([(1, "empty_content"), (2, "timeout")], "u long, code string"), "u")
    assert sorted(map(tuple, got.collect())) == [(0, True, True, None), (1, False, True, None), (2, False, False, "timeout"), (3, False, False, "not returned")]


@pytest.mark.parametrize("family, kind", [("PlayfairDisplay", "serif"), ("Space Grotesk", "sans"), ("JetBrains Mono", "mono"), ("Acme Tight", "display"), ("Acme", "sans")])
def test_family_kind(spark, family, kind):
    assert one(spark, A.kind(F.lit(family))) == kind
    assert one(spark, A.weight(F.lit(" Semibold "))) == "600" and one(spark, A.weight(F.lit("100 900"))) == "100 900"


def test_attributes(spark):
    got = one(spark, K.attributes(F.lit("<a HREF=\"x\" b = 'y z' c=1>")))
    assert [tuple(a) for a in got] == [("href", "x"), ("b", "y z"), ("c", "1")]


def test_words_of_address_match_their_patterns(spark):
    """Counts by listed words are those of the copy patterns, apostrophes, underscores and other letters beside them included."""
    texts = ["you're you'll You yourselves yourself, your_s", "our's we'll we're us weé us2 -our-", "Users' teams' team client's them themé", "", "YOU'REX you''re scales api_ 10x"]
    low = F.lower("t")
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for n, terms in voice.ADDRESSED.items():
        own = T.term_count(low, terms, T.listed(low, terms))
        assert [r[0] for r in df.select(own).collect()] == [r[0] for r in df.select(F.regexp_count(low, F.lit(sheets.COPY[n]))).collect()]


def test_tone_texts_are_not_split_into_words(spark):
    plan = voice.tone_axes(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "[^a-z0-9_]+" not in plan and plan.count("regexp_count") <= 4
