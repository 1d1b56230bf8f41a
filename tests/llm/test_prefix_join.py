"""The adaptive prefix join against all pairs."""

import random

import numpy as np
import pytest

from sitelens.llm import prefix_join, queries

SF = "/root/testdata/sf0.001"


def expected(rows, width, percent):
    sets = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets[i] = frozenset(tuple(w[k : k + width]) for k in range(len(w) - width + 1)) or frozenset([tuple(w)] if w else [])
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            if a is not None and b is not None and a < b and sets[a] and sets[b]:
                both = len(sets[a] & sets[b])
                if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                    x, y = find(a), find(b)
                    root[max(x, y)] = min(x, y)
    return sorted(((i, len(sets[i]), find(i)) for i, _ in rows), key=str)


def rows_of(df):
    return sorted(map(tuple, df.select("doc_id", "n_shingles", "component_id").collect()), key=str)


def test_query_is_all_pairs(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    got = rows_of(queries.op12_prefix_join(spark, SF))
    assert got == expected([tuple(r) for r in docs.collect()], 3, 90)
    assert any(i != c for i, _, c in got)


@pytest.mark.parametrize(("few", "percent", "counters"), [(32, 90, 1 << 10), (2, 80, 1 << 8), (3, 50, 2)])
def test_chains_of_near_copies_and_a_common_passage(spark, monkeypatch, few, percent, counters):
    """Copies that drift apart word by word, so that no hub reaches all; cells of all sizes; a table of counters that tells little."""
    monkeypatch.setattr(prefix_join, "FEW", few)
    rng = random.Random(few)
    word = lambda: f"w{rng.randrange(400)}"
    common = [word() for _ in range(30)]
    rows, text = [], [word() for _ in range(60)]
    for i in range(60):
        rows.append((i, " ".join(text)))
        text = list(text)
        text[rng.randrange(len(text))] = word()
    rows += [(100 + i, " ".join([word() for _ in range(20)] + common + [word() for _ in range(rng.randrange(25))])) for i in range(50)]
    rows += [(200 + i, " ".join(common)) for i in range(3)] + [(300 + i, rows[7][1]) for i in range(4)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert rows_of(prefix_join.join(docs, width=2, percent=percent, counters=counters)) == expected(rows, 2, percent)


def test_odd_rows(spark):
    long = " ".join(f"v{i}" for i in range(5000))
    rows = [(1, None), (2, ""), (3, " \n\t"), (4, "One  two"), (5, "one two"), (6, "one two three"), (7, long), (8, long + " end"), (9, "ONE\ttwo\nthree"), (11, "Été x y z"), (12, "été x y z")]
    docs = spark.createDataFrame([(i, t, 1, 2, "r") for i, t in rows] + [(7, long, 1, 2, "r")], "doc_id bigint, text string, cell int, n int, root string")
    assert rows_of(prefix_join.join(docs, 3, 90)) == expected([*rows, (7, long)], 3, 90)
    nulls = spark.createDataFrame([(None, "a b c d"), (None, "a b c d"), (1, "a b c d")], "doc_id bigint, text string")
    assert rows_of(prefix_join.join(nulls, 3, 90)) == [(1, 2, 1), (None, 2, None), (None, 2, None)]
    assert prefix_join.join(docs.filter("false"), 3, 90).count() == 0


def test_deeper_prefixes_where_partners_are_many():
    rare, crowded = np.full(40, 0.5), np.full(40, 50.0)
    steep = np.concatenate([np.full(11, 0.5), np.full(29, 1e6)])
    assert prefix_join.depth(rare, 100, 90) > 1 and prefix_join.depth(crowded, 100, 90) > 1
    assert prefix_join.depth(steep, 100, 90) == 1  # more shingles would meet more postings than they save
    assert prefix_join.depth(crowded, 1, 90) == 1  # one shingle is all there is
    assert [prefix_join.least_common(n, 90) for n in (1, 9, 10, 11)] == [1, 9, 9, 10]
