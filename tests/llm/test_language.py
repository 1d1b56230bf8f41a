"""Held-out accuracy, rejection, and rows out of the ordinary of language identification and revisit resolution."""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from sitelens.llm import language_id, queries, warc

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang")
    got = queries.op5_language_id(spark, SF).join(docs, "doc_id").filter("held_out AND lang IS NOT NULL AND lang_pred <> 'und'")
    assert got.count() > 100 and got.filter("lang = lang_pred").count() >= 0.97 * got.count()


def test_statistics_of_all_labelled_texts(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang")
    odd = docs.unionByName(docs.filter("doc_id % 3 = 0").withColumn("doc_id", F.lit(None).cast("long"))).repartition(7)
    model = language_id.fit(odd)
    rows = odd.filter(r"lang IS NOT NULL AND text RLIKE '\\p{L}'").toPandas()
    held = np.concatenate([c for _, _, c in language_id.counts(pa.array(rows["text"], pa.large_string()))])
    assert len(held) > 3 * language_id.SAMPLE
    assert np.allclose(model.idf, np.log((1 + len(held)) / (1 + (held > 0).sum(axis=0))) + 1, atol=1e-5)
    best = (language_id.vectors(pa.array(rows["text"], pa.large_string()), model.idf) @ model.centroids.T).max(axis=1)
    for lang, limit in model.limits.items():
        exact = np.quantile(best[rows["lang"] == lang], language_id.REJECT_QUANTILE, method="inverted_cdf")
        assert abs(limit - language_id.REJECT_SHARE * exact) < 2 / language_id.BINS


def test_far_texts_are_rejected(spark):
    learned = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang")
    model = language_id.fit(learned)
    texts = ["", None, "12 34 !?", "你好世界 " * 30, "Привет мир " * 30]
    odd = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = {r.doc_id: r for r in language_id.predict(odd, model).collect()}
    assert all(rows[i].rejected for i in range(len(texts)))
    assert all(rows[i].lang_pred == "und" and rows[i].score == 0 for i in range(3))


def test_revisits_of_odd_captures(spark):
    schema = "record_id long, url string, ts timestamp, kind string, digest string, headers map<string,string>, canonical string"
    at = "2024-01-0{} 00:00:00"
    rows = [
        (1, "http://a.com/", at.format(1), "response", "d1", {"etag": '"1"', "vary": "x"}, "clash"),
        (2, "https://www.a.com", at.format(2), "revisit", None, {"etag": 'W/"1"', "server": "s", "date": "now"}, "clash"),
        (3, "http://a.com/", at.format(3), "revisit", None, {"etag": '"2"'}, "clash"),
        (4, "http://b.com/", at.format(1), "revisit", None, None, "clash"),
        (5, None, at.format(1), "revisit", "d", {}, "clash"),
        (6, "http://a.com/", None, "revisit", "d", {}, "clash"),
        (7, "http://a.com/", at.format(1), "response", "d7", {"etag": '"7"'}, "clash"),
        (8, "http://a.com/", at.format(1), "revisit", None, {"etag": '"7"'}, "clash"),
    ]
    table = spark.createDataFrame([(*r[:2], None, *r[3:]) for r in rows], schema).drop("ts").join(spark.createDataFrame([(r[0], r[2]) for r in rows], "record_id long, at string"), "record_id")
    table = table.withColumn("ts", F.to_timestamp("at"))
    got = {r.record_id: r for r in warc.resolve(table).collect()}
    assert {k: (r.status, r.refers_to) for k, r in got.items()} == {2: ("mismatch", None), 3: ("mismatch", None), 4: ("orphan", None), 5: ("orphan", None), 6: ("orphan", None), 8: ("resolved", 7)}
    assert got[8].headers == {"etag": '"7"'} and warc.resolve(table.filter("false")).count() == 0
    twice = warc.resolve(table.unionByName(table))
    assert twice.count() == 12 and twice.filter("record_id = 8 AND refers_to = 7").count() == 2
