"""Spelling variants against all pairs of words."""

import re
import zlib
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sitelens.llm import queries, spelling

SF = "/root/testdata/sf0.001"


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def expected(rows, least=6, seen=5):
    n = Counter()
    for i, t in rows:
        for run, k in Counter(x.encode().lower().decode() for x in re.findall("[A-Za-zÀ-ÿ]+", t or "")).items():
            h = zlib.crc32(f"{'null' if i is None else i}:{run}".encode())
            n[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 199 == 0 else run] += k
    words = {w: k for w, k in n.items() if len(w) >= least and k >= seen}
    near = {w: [v for v in words if abs(len(v) - len(w)) < 2 and one_edit(v, w)] for w in words}
    form = {w: f for w in words if near[w] and words[f := min(near[w], key=lambda v: (-words[v], v))] >= 5 * words[w]}
    out = []
    for w in words:
        r = w
        while r in form:
            r = form[r]
        out.append((w, words[w], len(near[w]), form.get(w), words.get(form.get(w)), r))
    return sorted(out, key=str)


def rows_of(df):
    return sorted(map(tuple, df.select("word", "n", "n_near", "form", "form_n", "root").collect()), key=str)


def test_query_is_the_rule(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    got = rows_of(queries.op13_spelling_variants(spark, SF))
    assert got == expected([tuple(r) for r in docs.collect()]) and any(r[3] for r in got)


def test_chain_ties_and_odd_rows(spark):
    many = lambda w, n: f"{w} " * n
    rows = [
        (1, many("colourful", 625) + many("colorful", 125) + many("colorfull", 25) + many("colorfulll", 5)),  # a chain of forms
        (2, many("abcdef", 5) + many("abcdeg", 30) + many("abcdeh", 30)),  # two forms of one count: the smaller word
        (3, many("Éclairs", 7) + many("éclairs", 50)),  # only A-Z are lower-cased
        (4, many("straße÷x", 9)), (5, None), (6, ""), (None, many("abcdef", 2)), (7, "abcdeg" * 3000), (2, many("abcdeg", 3)), (2, many("abcdeg", 3)),
    ]
    docs = spark.createDataFrame([(i, t, "w", 3) for i, t in rows], "doc_id bigint, text string, word string, n int")
    got = rows_of(spelling.variants(docs))
    assert got == expected(rows)
    assert ("colorfulll", 5, 1, "colorfull", 25, "colourful") in got and spelling.variants(docs.filter("false")).count() == 0


def test_counts_do_not_depend_on_when_a_task_passes_them_on(spark, monkeypatch):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    whole = sorted(map(tuple, spelling.word_counts(docs).collect()))
    monkeypatch.setattr(spelling, "HELD", 50)
    assert sorted(map(tuple, spelling.word_counts(docs).collect())) == whole


@pytest.mark.parametrize("least", [1, 2, 5])
def test_no_pair_is_missed(spark, least):
    found = []

    @settings(max_examples=8, deadline=None)
    @given(st.sets(st.text("abÀ\U0001f600", min_size=least, max_size=least + 4), min_size=2, max_size=60))
    def run(words):
        df = spark.createDataFrame([(w, 1) for w in words], "word string, n bigint")
        got = [tuple(sorted((r.a, r.b))) for r in spelling.near_pairs(df, least).collect()]
        assert len(got) == len(set(got))
        assert set(got) == {(a, b) for a in words for b in words if a < b and one_edit(a, b)}
        found.append(len(got))

    run()
    assert sum(found)
