"""Stages of the pipeline against plain versions of their rules, and odd rows through all of it."""

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from sitelens.llm import decontaminate, quality_rules, queries
from sitelens.llm.common import maybe_in, without

SF = "/root/testdata/sf0.001"


def ids(df):
    return sorted(r.doc_id for r in df.select("doc_id").collect())


def test_filter_misses_nothing(spark):
    df, gone = spark.range(20_000).withColumnRenamed("id", "k"), spark.range(0, 20_000, 7)
    assert maybe_in(df, "k", gone).filter("k % 7 = 0 AND NOT _maybe").count() == 0
    assert maybe_in(df, "k", gone).filter("_maybe").count() < 3000
    assert without(df, "k", gone).count() == 20_000 - gone.count()
    assert without(df, "k", gone.filter("false")).count() == 20_000
    odd = spark.createDataFrame([(None,), (1,), (2,)], "k bigint")
    assert sorted(str(r.k) for r in without(odd, "k", spark.range(2, 3)).collect()) == ["1", "None"]


def test_quality_stage_is_the_rule(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    want = sorted(r[0] for r in con.execute(f"SELECT doc_id FROM ({queries.ORACLES['op7_quality_rules']}) WHERE kept").fetchall())
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = corpus_pipeline.quality_stage(spark, docs, SF)
    assert got.columns == docs.columns and ids(got) == want
    assert ids(corpus_pipeline.quality_stage(spark, docs.unionByName(docs), SF)) == sorted(want * 2)


def test_dedup_stage_keeps_one_of_each_component(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    sets = {}
    for r in docs.collect():
        w = (r.text or "").encode().lower().split()
        sets[r.doc_id] = frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) or frozenset([tuple(w)] if w else [])
    keep = []
    todo = dict(sets)
    while todo:
        low = min(todo)
        group, front = {low}, [low]
        while front:
            x = todo[front.pop()] if front[-1] in todo else sets[front.pop()]
            for b, y in todo.items():
                if b not in group and x and y and 100 * len(x & y) >= 80 * len(x | y):
                    group.add(b)
                    front.append(b)
        keep.append(low)
        todo = {d: s for d, s in todo.items() if d not in group}
    assert ids(corpus_pipeline.dedup_stage(spark, docs, SF)) == sorted(keep)


def test_decontamination_stage(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    found = {r.doc_id for r in queries.op4_decontamination(spark, SF).collect()}
    want = [d for d in ids(docs) if d not in found]
    assert ids(corpus_pipeline.decontaminate_stage(spark, docs, SF)) == want
    assert ids(decontaminate.clean(docs, spark.read.parquet(f"{SF}/benchmark.parquet"), small_bytes=0)) == want


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
def test_odd_rows(spark, name, stage):
    long = "the word of a very long text and so on " * 20_000
    plain = " ".join(f"word{i} next{i} last{i}" for i in range(40))
    rows = [(None, None, None, None, None), (1, "", "en", "h", 0), (2, long, "en", "h", 1), (3, plain, "en", None, 1), (3, plain, "en", None, 1), (None, plain + " x", "en", "h", 1)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    wide = docs.withColumn("kept", F.lit("x")).withColumn("n", F.lit(1)).withColumn("id", F.lit(2)).withColumn("set", F.lit(3))
    for table in (docs, wide, docs.filter("false")):
        out = stage(spark, table, SF)
        assert out.count() <= table.count()
        if name != "bpe":
            assert out.columns == table.columns
    kept = {"language_id": [3, 3], "quality_rules": [3, 3], "near_dedup": [1, 2, 3, 3], "decontaminate": [1, 2, 3, 3], "bpe": [1, 2, 3, 3]}
    assert [r.doc_id for r in stage(spark, docs, SF).filter("doc_id IS NOT NULL").orderBy("doc_id").collect()][-len(kept[name]) :] == kept[name]
