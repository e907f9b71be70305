"""Every registered query with SQL, against DuckDB on the smallest fixture."""

import os

import pytest

from tesserae.plans.registry import ORACLES, QUERIES

duckdb = pytest.importorskip("duckdb")
SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the fixtures aren't here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def rounded(row, order):
    return tuple(round(row[i], 9) if isinstance(row[i], float) else row[i] for i in order)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    expected = duck.sql(ORACLES[name])
    assert sorted(df.columns) == sorted(expected.columns)
    order = sorted(df.columns)
    key = lambda t: [(x is None, str(x)) for x in t]
    got = sorted((rounded(tuple(r), [df.columns.index(c) for c in order]) for r in df.collect()), key=key)
    want = sorted((rounded(r, [expected.columns.index(c) for c in order]) for r in expected.fetchall()), key=key)
    assert got == want
