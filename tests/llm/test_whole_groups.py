import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from sitelens.llm import sharding


@pytest.mark.parametrize("a_bucket", [20_000, 60])
def test_groups_below_a_share_stay_whole(spark, monkeypatch, a_bucket):
    monkeypatch.setattr(sharding, "GROUPS_A_BUCKET", a_bucket)
    rng = np.random.default_rng(2)
    texts = [f"{i} " + "x" * int(n) for i, n in enumerate(rng.integers(10, 200, 600))]
    # copies of 0.9, 0.5 and 0.2 of a fair share, and of two shares
    share = sum(map(len, texts)) / 4
    texts += [c * 92 for c, part in (("a", 0.9), ("b", 0.5), ("c", 0.2), ("d", 2.0)) for _ in range(int(part * share / 100))]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = sharding.assign(docs, 8).cache()
    assert got.count() == len(texts)
    places = {c: got.filter(F.col("text_crc32") == zlib.crc32((c * 92).encode())).select("shard").distinct().count() for c in "abcd"}
    assert (places["a"], places["b"], places["c"]) == (1, 1, 1) and places["d"] > 1
    sums = [r.b for r in got.groupBy("shard").agg(F.sum("size").alias("b")).collect()]
    assert len(sums) == 8 and max(sums) - min(sums) <= 0.03 * sum(sums) / 8
