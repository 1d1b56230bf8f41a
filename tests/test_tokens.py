import pytest
from pyspark.sql import functions as F

from sitelens.functions import tokens as T


@pytest.mark.parametrize(
    "name,tier,role,on_primary,variant,qualifier",
    [
        ("--color-bg-primary", "declaredRole", "background", False, False, "primary"),
        ("--header-bg", "component", "background", False, False, None),
        ("--blue-500", "paletteEntry", None, False, True, None),
        ("--harbour-brand-colour", "declaredRole", "primary", False, False, None),
        ("--harbour-surface-text-colour", "declaredRole", "text", False, False, None),
        ("--harbour-link-hover-colour", "declaredRole", "link", False, True, None),
        ("--color-brand-text", "declaredRole", "primary", True, False, None),
        ("--bg-base", "bareRole", "background", False, False, "base"),
        ("--color-red", "paletteEntry", None, False, False, None),
        ("--", "component", None, False, False, None),
    ],
)
def test_classify(spark, name, tier, role, on_primary, variant, qualifier):
    k = spark.createDataFrame([(name,)], "n string").select(T.classify(F.col("n")).alias("k")).first()["k"]
    assert (k["tier"], k["role"], bool(k["on_primary"]), k["variant"], k["qualifier"]) == (tier, role, on_primary, variant, qualifier)


def test_resolve(spark):
    props = {"--a": "var(--b)", "--b": "var(--c, red)", "--c": "#fff", "--x": "var(--y)", "--y": "var(--x)", "--m": "var(--none, blue)", "--n": "var(--none)"}
    df = spark.createDataFrame([(props,)], "p map<string,string>").select(F.explode("p").alias("k", "v"), "p").select("k", T.resolve(F.col("p"), F.col("v")))
    got = dict(map(tuple, df.collect()))
    assert (got["--a"], got["--b"], got["--c"], got["--m"], got["--n"]) == ("#fff", "#fff", "#fff", "blue", None)
    assert got["--x"].startswith("var(")
