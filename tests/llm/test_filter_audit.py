"""Filter interactions against SQL and against filters applied one after another."""

from itertools import permutations

import duckdb
import pytest

from sitelens.llm import filter_audit, queries

SF = "/root/testdata/sf0.001"
WORDS = "a b c d e f g h i j".split()


def test_query_is_the_sql(spark):
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    cursor = con.execute(queries.ORACLES["op11_filter_audit"])
    names = [c[0] for c in cursor.description]
    got = queries.op11_filter_audit(spark, SF)
    assert sorted(got.columns) == sorted(names)
    want = sorted(tuple(r[names.index(c)] for c in got.columns) for r in cursor.fetchall())
    assert sorted(map(tuple, got.collect())) == want and len(want) == 600 * len({r[0] for r in want})


def replay(rows, labels):
    """The five filters run in every order over Python rows (id, text, part)."""
    fails = {}
    for k, (i, t, _) in enumerate(rows):
        t = t or ""
        w = t.encode().split()
        same = [j for j, u, _ in rows if (u or "") == t and j is not None and i is not None and j < i]
        fails[k] = {c for c, x in zip("ABCDE", (len(w) < 100, 100 * len(set(w)) < 80 * len(w), 100 * sum("A" <= c <= "Z" for c in t) > 10 * len(t), any(c in "#$%&*|" for c in t), bool(same)), strict=True) if x}
    out = {}
    for part in {p or "" for _, _, p in rows}:
        own = [k for k, r in enumerate(rows) if (r[2] or "") == part]
        total = dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            left = list(own)
            for step, c in enumerate(order, 1):
                gone = [k for k in left if c in fails[k]]
                left = [k for k in left if c not in fails[k]]
                total[c] += len(gone)
                good, toxic = (sum(any(i is not None and i == rows[k][0] and x == 1 for i, *v in labels for x in [v[at]]) for k in gone) for at in (0, 1))
                out[part, "".join(order), step] = [len(left), len(gone), sum(c in fails[k] for k in own) - len(gone), sum(fails[k] == {c} for k in own), good, toxic]
        for order in permutations("ABCDE"):
            for step, c in enumerate(order, 1):
                out[part, "".join(order), step].append(total[c])
    return sorted((*k, *v) for k, v in out.items())


def test_odd_rows(spark):
    long = " ".join(f"w{i}" for i in range(120))
    rows = [(1, None, "en"), (2, "", "en"), (3, "", None), (4, long, "de"), (5, long, "en"), (5, long, "en"), (6, long + " $", "de"), (None, long, "de"), (7, "AB " * 200, ""), (8, "x " * 9000 + "y", "de"), (9, long, "de"), (None, "", "en"), (10, " ", "en")]
    labels = [(4, 1, 0), (9, 1, 1), (5, 0, None), (7, None, 1), (9, 0, 1), (None, 1, 1)]
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id bigint, text string, lang string, digest string, key int")
    marks = spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    got = sorted(map(tuple, filter_audit.audit(docs, marks).collect()))
    assert got == replay(rows, labels)
    assert sum(r[1] == "ABCDE" for r in got) == 15
    assert filter_audit.audit(docs.filter("false"), marks).count() == 0
    assert sorted(map(tuple, filter_audit.audit(docs, marks.filter("false")).collect())) == replay(rows, [])


@pytest.mark.parametrize("letters", ["AB", "ABC"])
def test_dividends_share_what_is_removed(spark, letters):
    """The values of all filters add up to what all remove together, in every order."""
    rows = [("p", m, (7 * m + 3) % 5 + 1, m % 2, m % 3) for m in range(1 << len(letters))]
    exact = spark.createDataFrame(rows, "part string, mask int, n bigint, good bigint, toxic bigint")
    got = filter_audit.report(filter_audit.joint_failures(exact, letters), letters).collect()
    orders = {r.filter_order for r in got}
    for o in orders:
        own = [r for r in got if r.filter_order == o]
        assert sum(r.shapley for r in own) == len(orders) * sum(r.removed for r in own) == len(orders) * sum(n for _, m, n, *_ in rows if m)
