"""Scores that depend on the rows alone, and a model whose probabilities add up to one."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sitelens.llm import pitman_yor

SF = "/root/testdata/sf0.001"


def test_scores_depend_on_rows_alone(spark, monkeypatch):
    monkeypatch.setattr(pitman_yor, "SHARD_BYTES", 20_000)
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    held = F.col("doc_id") % 7 == 2
    before = spark.conf.get("spark.sql.shuffle.partitions")
    results = []
    try:
        for partitions, parts, block in ((1, 1, 8 << 20), (16, 5, 30_000), (64, 3, 8 << 20)):
            spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
            monkeypatch.setattr(pitman_yor, "BLOCK_BYTES", block)
            spread = docs.repartition(parts, "doc_id") if parts > 1 else docs
            spread.write.mode("overwrite").parquet(f"/tmp/sitelens-scores-{parts}")
            own = spark.read.parquet(f"/tmp/sitelens-scores-{parts}")
            results.append({r.doc_id: (r.score, r.base_score) for r in pitman_yor.score(own, held).collect()})
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    for other in results[1:]:
        assert other.keys() == results[0].keys()
        assert all(other[d] == pytest.approx(results[0][d], rel=1e-9) for d in other)


@pytest.mark.parametrize("shard_bytes", [6 << 20, 600])
def test_texts_share_one_unit_of_probability(spark, monkeypatch, shard_bytes):
    monkeypatch.setattr(pitman_yor, "SHARD_BYTES", shard_bytes)
    rng = np.random.default_rng(0)
    words = [f"w{i}" for i in range(30)]
    rows = [(i, " ".join(rng.choice(words, rng.integers(0, 4), p=np.arange(30, 0, -1) / 465)), False) for i in range(400)]
    # all texts of at most two known words; longer and unknown ones have the rest of the unit
    probes = [(1000 + k, t, True) for k, t in enumerate(["", *words, *(f"{a} {b}" for a in words for b in words)])]
    got = pitman_yor.score(spark.createDataFrame(rows + probes, "doc_id long, text string, held boolean"), F.col("held")).filter("held_out").collect()
    total = sum(10**r.score for r in got)
    seen = sum(r[1].count(" ") < 2 for r in rows) / len(rows)
    assert len(got) == len(probes) and 0.8 * seen < total < 1
