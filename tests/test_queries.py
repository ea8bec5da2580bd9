"""Every query with SQL against DuckDB on the smallest tables; the others must run and give rows of a stable schema."""

import os

import duckdb
import pytest

from probanda.plans import queries as q

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{SF}/{t}.parquet"):
            con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(q.ORACLE))
def test_matches_sql(spark, duck, name):
    got = q.QUERIES[name](spark, SF).toPandas()
    want = duck.sql(q.ORACLE[name]).df()
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    assert len(got) == len(want)
    plain = [c for c in columns if want[c].dtype.kind != "f"]
    floats = [c for c in columns if c not in plain]
    got, want = (df[columns].assign(**{c: df[c].astype(str) for c in plain}).sort_values([*plain, *floats]).reset_index(drop=True) for df in (got, want))
    for c in plain:
        assert got[c].tolist() == want[c].tolist(), c
    for c in floats:
        assert got[c].astype(float).tolist() == pytest.approx(want[c].astype(float).tolist(), abs=2e-3, nan_ok=True), c


@pytest.mark.parametrize("name", sorted(set(q.QUERIES) - set(q.ORACLE)))
def test_runs(spark, name):
    df = q.QUERIES[name](spark, SF)
    assert df.columns
    df.collect()
