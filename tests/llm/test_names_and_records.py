"""Columns with clashing names through the filters, and WARC answers that are no full responses."""

import datetime

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from sitelens.llm import common, quality_rules, warc

SF = "/root/testdata/sf0.001"
CLASHES = ["_lang", "_score", "_rejected", "_row", "_gone", "_maybe", "_key", "_words", "_held", "_bits", "_bits_row", "_bits_byte", "_bits_bit", "_l", "id", "n", "KEPT", "_Row_"]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def clashing(docs):
    for i, c in enumerate(CLASHES):
        docs = docs.withColumn(c, F.lit(i))
    return docs


def test_names_are_drawn_free(spark):
    df = spark.createDataFrame([(1, 2, 3)], "_row int, _ROW_ int, x int")
    assert common.free(df, "_row", "_row", "y") == ["_row__", "_row___", "y"]


def test_judge_and_filters_keep_foreign_columns(spark, docs):
    odd = clashing(docs)
    want = {r.doc_id: r.kept for r in quality_rules.judge(docs).select("doc_id", "kept").collect()}
    assert {r.doc_id: r.kept for r in quality_rules.judge(odd).select("doc_id", "kept").collect()} == want
    kept = quality_rules.keep(odd)
    assert kept.columns == odd.columns and kept.count() == sum(want.values())
    assert kept.select(*[F.col(f"`{c}`") for c in CLASHES]).distinct().count() == 1
    gone = spark.range(0, 100).select("id")
    assert common.without(odd, "doc_id", gone).columns == odd.columns
    assert common.without(odd, "doc_id", gone).count() == common.without(docs, "doc_id", gone).count()


@pytest.mark.parametrize("stage", ["language_id", "quality_rules", "near_dedup", "decontaminate"])
def test_stages_keep_foreign_columns(spark, docs, stage):
    run = dict(corpus_pipeline.STAGES)[stage]
    got = run(spark, clashing(docs), SF)
    assert got.columns == clashing(docs).columns
    assert sorted(r.doc_id for r in got.select("doc_id").collect()) == sorted(r.doc_id for r in run(spark, docs, SF).select("doc_id").collect())


def test_only_full_answers_are_referred_to(spark):
    at = lambda h: datetime.datetime(2024, 1, 1, h)
    rows = [
        ("ok", "u", at(1), "response", 200, None), ("busy", "u", at(2), "response", 503, None), ("part", "u", at(3), "response", 206, None), ("moved", "u", at(4), "response", 301, None),
        ("r1", "u", at(5), "revisit", 304, "http://netpreserve.org/warc/1.1/revisit/server-not-modified"), ("r2", "u", at(6), "revisit", 200, "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
        ("r3", "u", at(7), "revisit", None, None), ("gone", "v", at(1), "response", 404, None), ("r4", "v", at(2), "revisit", 304, None),
    ]
    df = spark.createDataFrame([(*r, None, {"date": r[0]}) for r in rows], "record_id string, url string, ts timestamp, kind string, http_status int, profile string, digest string, headers map<string,string>")
    got = {r.record_id: (r.status, r.refers_to) for r in warc.resolve(df).collect()}
    assert got == {"r1": ("unchecked", "ok"), "r3": ("unchecked", "ok"), "r4": ("orphan", None)}


def test_records_carry_status_and_profile(spark, tmp_path):
    def record(kind, status, extra=""):
        block = f"HTTP/1.1 {status} X\r\nETag: \"a\"\r\n\r\nbody".encode()
        return f"WARC/1.1\r\nWARC-Type: {kind}\r\nWARC-Target-URI: http://u.example/\r\nWARC-Date: 2024-01-0{status % 7 + 1}T00:00:00Z\r\nWARC-Record-ID: <{kind}{status}>\r\n{extra}Content-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"

    (tmp_path / "a.warc").write_bytes(record("response", 200) + record("response", 503) + record("revisit", 304, "WARC-Profile: p/server-not-modified\r\n") + record("metadata", 200))
    got = {r.record_id: r for r in warc.records(spark.read.format("binaryFile").load(str(tmp_path))).collect()}
    assert {k: (r.http_status, r.profile) for k, r in got.items()} == {"<response200>": (200, None), "<response503>": (503, None), "<revisit304>": (304, "p/server-not-modified")}
    assert got["<response200>"].headers == {"etag": '"a"'} and bytes(got["<response200>"].body) == b"body"
