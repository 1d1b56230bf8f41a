"""op6 and op9 over a whole table against the library and the contract's laws, repeated and null identifiers included."""

import struct
import zlib

import pytest
from pyspark.sql import functions as F

from sitelens.llm import queries, token_sstable
from sitelens.llm.common import fresh_path

tokenizers = pytest.importorskip("tokenizers")
SF = "/root/testdata/sf0.001"


def test_starts_and_checksums(spark):
    lib = tokenizers.Tokenizer.from_file(queries.tokenizer_path())
    want, start = [], 0
    for r in sorted(spark.read.parquet(f"{SF}/documents.parquet").collect(), key=lambda r: r.doc_id):
        ids = [*lib.encode(r.text or "", add_special_tokens=False).ids, 0]
        want.append((r.doc_id, start, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))))
        start += len(ids)
    got = queries.op6_token_sstable(spark, SF).select("doc_id", "start", "n_tokens", "ids_crc32").collect()
    assert sorted(map(tuple, got)) == want


def test_repeated_and_null_identifiers_fill_several_shards(spark):
    docs = spark.range(400).select(F.when(F.col("id") % 4 > 0, F.lit(None).cast("long")).otherwise(F.lit(7)).alias("doc_id"), F.concat(F.lit("text "), "id").alias("text"))
    shards = token_sstable.write(docs, fresh_path(spark, "sst"), queries.tokenizer_path(), shards=4)
    rows = token_sstable.read(spark, shards).orderBy("start").collect()
    assert len(rows) == 400 and len(shards) > 2 and [r.doc_id for r in rows] == [None] * 300 + [7] * 100
    assert all(a.start + a.n_tokens == b.start for a, b in zip(rows[:-1], rows[1:], strict=True))


def test_shards_by_their_law(spark):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = queries.op9_sharding(spark, SF).collect()
    assert sorted(r.doc_id for r in rows) == sorted(docs) and {r.law for r in rows} == {"bytes"} and {r.grown_shard for r in rows} == {None}
    assert all(r.size == len(docs[r.doc_id].encode()) + 8 and r.text_crc32 == zlib.crc32(docs[r.doc_id].encode()) for r in rows)
    slots: dict = {}
    for r in rows:
        slots.setdefault(r.shard, []).append(r.slot)
    assert set(slots) <= set(range(24)) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    share, places, sizes = sum(r.size for r in rows) / 24, {}, {}
    for r in rows:
        places.setdefault(docs[r.doc_id], set()).add(r.shard)
        sizes[docs[r.doc_id]] = sizes.get(docs[r.doc_id], 0) + r.size
    assert all(len(places[t]) == 1 for t in places if sizes[t] <= share)
