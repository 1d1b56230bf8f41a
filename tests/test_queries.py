import glob
import os

import duckdb
import pytest

from sitelens import registry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return c


def plain(rows):
    return sorted((tuple(round(float(x), 9) if isinstance(x, (int, float)) and not isinstance(x, bool) else x for x in r) for r in rows), key=str)


@pytest.mark.parametrize("name", [n for n in registry.QUERIES if n in registry.ORACLES])
def test_parity(spark, con, name):
    df = registry.QUERIES[name](spark, SF)
    names = sorted(df.columns)
    cursor = con.execute(registry.ORACLES[name])
    columns = [d[0] for d in cursor.description]
    want = [tuple(r[columns.index(c)] for c in names) for r in cursor.fetchall()]
    assert plain(tuple(r[c] for c in names) for r in df.collect()) == plain(want)


@pytest.mark.parametrize("name", [n for n in registry.QUERIES if n not in registry.ORACLES])
def test_runs(spark, name):
    assert registry.QUERIES[name](spark, SF).count() > 0 or name == "claims"  # the pages hold none; test_assets has some


def test_stream(spark, tmp_path):
    from sitelens.streaming import progress

    src = tmp_path / "events"
    spark.read.parquet(f"{SF}/events.parquet").write.parquet(str(src))
    progress.follow(spark, str(src), "runs", str(tmp_path / "state")).awaitTermination()
    batch = progress.run_state(spark.read.parquet(str(src)))
    assert sorted(map(tuple, spark.table("runs").collect())) == sorted(map(tuple, batch.collect()))
