import random
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sitelens.llm import bpe_automaton, decontaminate, html_extract, language_id, near_dedup, pitman_yor, quality_rules, queries, sharding, token_sstable, warc
from sitelens.llm.common import fresh_path

tokenizers = pytest.importorskip("tokenizers")
SF = "/root/testdata/sf0.001"
TEXTS = [None, "", " \n ", "a", "one two", "one two", "x " * 3000, "Don't stop <|endoftext|> now  é ñ 😀", "the cat sat on the mat and then the cat sat on the rug"]


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and long texts, repeats, and extra columns with the names operators use."""
    rows = [(i, t, None if i % 3 else "en", None if i % 2 else "h", 1, "s") for i, t in enumerate(TEXTS)] + [(None, "no identifier here", "en", "h", 1, "s")]
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n bigint, shard string")


def test_bpe_equals_library():
    lib = tokenizers.Tokenizer.from_file(queries.tokenizer_path())
    mine = bpe_automaton.encoder(queries.tokenizer_path())
    rng = random.Random(3)
    texts = [t or "" for t in TEXTS] + ["".join(rng.choice("aabtheing \n1é<|") for _ in range(40)) for _ in range(500)]
    for t in texts:
        ids = lib.encode(t, add_special_tokens=False).ids
        assert mine.encode(t) == ids
        assert mine.automaton.decode(ids) == lib.decode(ids, skip_special_tokens=False)


def test_joined_parts_equal_library():
    lib = tokenizers.Tokenizer.from_file(queries.tokenizer_path())
    mine = token_sstable.LibraryEncoder(queries.tokenizer_path())
    rng = random.Random(5)
    texts = [t or "" for t in TEXTS] + ["  a  b ", "a\n\n  b  c\u3000d", " \x1c x", "".join(rng.choice("ab thé 1\n <|") for _ in range(3000))]
    texts += ["".join(rng.choice("aabtheing \n1é<|\x85") for _ in range(60)) for _ in range(300)]
    got = [bytes(raw[a:b]) for _, at, raw in mine.encode(pa.array(texts)) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
    assert got == [mine.pack(lib.encode(t, add_special_tokens=False).ids) for t in texts]


def test_html():
    page = "<html><head><title>x</title></head><body><nav><a href=/>Home</a></nav><div class='ad'>Buy the things that you want from us today and tomorrow at the shop.</div><article><h1>A  title &amp; more</h1><p><b>First.<br><p>Tom &lt; Jerry<aside>no</aside><div class='comments'>nice post</div></article><form>f</form><footer>&copy;</footer>"
    assert html_extract.main_text(page) == "A title & more\nFirst.\nTom < Jerry"
    assert html_extract.main_text(None) == html_extract.main_text("") == ""
    assert html_extract.main_text("<p>cut <b") == "cut"


def test_odd_rows(spark, odd):
    path = queries.tokenizer_path()
    assert bpe_automaton.round_trip(odd, path).count() == odd.count()
    judged = quality_rules.judge(odd)
    assert judged.filter("doc_id = 0").first().base_failed and judged.count() == odd.count()
    model = language_id.fit(odd)
    assert language_id.predict(odd, model).filter("doc_id < 3 AND lang_pred = 'und'").count() == 3
    got = {r.doc_id: r.component_id for r in near_dedup.cluster(odd, 2).collect()}
    assert got[5] == 4 and got[0] == 0 and got[1] == 1
    shards = sharding.assign(odd, 4)
    assert shards.count() == odd.count()
    assert pitman_yor.score(odd, F.lit(False)).count() == odd.count()
    assert decontaminate.contaminated(odd, odd.filter("doc_id = 8").withColumnRenamed("doc_id", "item_id")).select("doc_id").first()[0] == 8


def test_empty_tables(spark, odd):
    none = odd.filter("false")
    assert quality_rules.judge(none).count() == near_dedup.cluster(none).count() == sharding.assign(none).count() == pitman_yor.score(none, F.lit(False)).count() == 0
    assert token_sstable.write(none, fresh_path(spark, "none"), queries.tokenizer_path()) == []
    assert language_id.predict(odd, language_id.fit(none)).filter("lang_pred <> 'und'").count() == 0
    assert decontaminate.contaminated(odd, none.withColumnRenamed("doc_id", "item_id")).count() == 0


def test_sstable_lookup(spark, odd):
    path = queries.tokenizer_path()
    folder = fresh_path(spark, "sst")
    shards = token_sstable.write(odd, folder, path, shards=3)
    lib = tokenizers.Tokenizer.from_file(path)
    key = token_sstable.key_of(7)
    found = [ids for p, *_ in shards for ids in token_sstable.open_shard(p).find(key)]
    assert [i.tolist() for i in found] == [[*lib.encode(TEXTS[7], add_special_tokens=False).ids, 0]]
    assert not any(token_sstable.open_shard(p).find(token_sstable.key_of(10**9)) for p, *_ in shards)
    rows = token_sstable.read(spark, shards).orderBy("start").collect()
    assert sum(r.n_tokens for r in rows) == rows[-1].start + rows[-1].n_tokens
    fs, name = pafs.FileSystem.from_uri(folder)
    assert not [f for f in fs.get_file_info(pafs.FileSelector(name)) if f.base_name.startswith(".")]


def test_karmarkar_karp_is_even():
    rng = np.random.default_rng(1)
    sizes = rng.integers(1, 1000, 3000)
    placed, sums = sharding.place_groups(sizes, 24)
    assert np.array_equal(np.bincount(placed, weights=sizes, minlength=24).astype(int), sums) and sums.max() - sums.min() <= 5
    vectors = [rng.integers(0, 1000, 24) for _ in range(9)]
    final, places = sharding.difference(vectors)
    check = np.zeros(24, int)
    for v, p in zip(vectors, places, strict=True):
        check[p] += v
    assert np.array_equal(np.sort(check), np.sort(final))


def test_near_duplicates_by_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    sets = {}
    for r in docs.collect():
        w = (r.text or "").encode().lower().split()
        sets[r.doc_id] = frozenset(zip(w, w[1:], strict=False)) if len(w) > 1 else frozenset(map(tuple, [w] if w else []))
    root = {d: d for d in sets}
    changed = True
    while changed:
        changed = False
        for a, x in sets.items():
            for b, y in sets.items():
                if a < b and x and y and root[a] != root[b] and 100 * len(x & y) >= 80 * len(x | y):
                    low = min(root[a], root[b])
                    high = max(root[a], root[b])
                    root = {d: low if r == high else r for d, r in root.items()}
                    changed = True
    for few in (8, 0):
        near_dedup.FEW = few
        assert {r.doc_id: r.component_id for r in near_dedup.cluster(docs, 2).collect()} == root
    near_dedup.FEW = 8


def test_components_without_one_task(spark):
    links = spark.createDataFrame([(1, 2), (2, 3), (9, 8), (7, 8), (5, 6)], "a bigint, b bigint")
    assert sorted(map(tuple, near_dedup.components(links, 0).collect())) == sorted(map(tuple, near_dedup.components(links).collect()))


def test_templates(spark):
    items = spark.createDataFrame([(1, "A train leaves Paris at 10 km per hour and Paris is 300 km away from the sea"), (2, None)], "item_id bigint, text string")
    docs = spark.createDataFrame([(1, "x. A train leaves Rome at 25 km per hour and Rome is 900 km away from the sea"), (2, "A train leaves Rome at 25 km per hour and Oslo is 900 km away from the sea"), (3, "nothing alike"), (4, None)], "doc_id bigint, text string")
    for bound in (8 << 20, 0):
        got = decontaminate.contaminated(docs, items, small_bytes=bound).collect()
        assert [(r.doc_id, r.item_id, r.exact) for r in got] == [(1, 1, False)]


def test_base_scores(spark):
    rows = queries.op3_pitman_yor(spark, SF).collect()
    docs = {r.doc_id: (r.text or "").encode().lower().split() + [None] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    count: dict = {}
    for d, t in docs.items():
        if zlib.crc32(str(d).encode()) % 7 != 2:
            for w in t:
                count[w] = count.get(w, 0) + 1
    n, v = sum(count.values()), len(count)
    for r in rows:
        assert r.train_tokens == n and r.n_tokens == len(docs[r.doc_id])
        assert r.base_score == pytest.approx(sum(np.log10((count.get(w, 0) + 1) / (n + v + 1)) for w in docs[r.doc_id]), rel=1e-9)
    held = [r for r in rows if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_warc_parse():
    body = b"HTTP/1.1 200 OK\r\nETag: \"a\"\r\n\r\nhello"
    raw = b"WARC/1.0\r\nWARC-Type: response\r\nWARC-Target-URI: http://a/\r\nContent-Length: " + str(len(body)).encode() + b"\r\n\r\n" + body + b"\r\n\r\nWARC/1.0\r\nContent-Length: 99\r\n\r\ncut"
    (r,) = warc.parse(raw)
    assert r["body"] == b"hello" and r["http_headers"] == {"etag": '"a"'} and r["http_status"] == 200


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "labels", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = queries.QUERIES[name](spark, SF)
    names = sorted(df.columns)
    cursor = con.execute(queries.ORACLES[name])
    columns = [d[0] for d in cursor.description]
    assert sorted((tuple(r[c] for c in names) for r in df.collect()), key=str) == sorted((tuple(x[columns.index(c)] for c in names) for x in cursor.fetchall()), key=str)


def test_pipeline(spark):
    import corpus_pipeline

    out = corpus_pipeline.run(spark, SF)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert 0 < out.count() < docs.count()
    leaked = {r.doc_id for r in queries.op4_decontamination(spark, SF).collect()}
    assert not leaked & {r.doc_id for r in out.collect()}
    assert isinstance(out.schema["n_tokens"].dataType, T.LongType)
