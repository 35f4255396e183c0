"""Every query with SQL against DuckDB, over the smallest tables."""

import glob
import math
import os

import pytest

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
duckdb = pytest.importorskip("duckdb")
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v)
    if isinstance(v, (list, tuple)):
        return [plain(x) for x in v]
    return str(v)


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    c.sql("set TimeZone = 'UTC'")
    for p in glob.glob(f"{FOLDER}/*.parquet"):
        c.sql(f"create view {os.path.basename(p)[:-8]} as from read_parquet('{p}')")
    return c


def names():
    from corpusmill.plans import catalogue

    return sorted(catalogue.QUERIES)


@pytest.mark.parametrize("name", names())
def test_query(spark, db, name):
    from corpusmill.plans import catalogue

    df = catalogue.QUERIES[name](spark, FOLDER)
    columns = sorted(df.columns)
    got = sorted(str([plain(r[c]) for c in columns]) for r in df.collect())
    if name not in catalogue.ORACLE:
        assert got
        return
    want = db.sql(catalogue.ORACLE[name])
    at = [want.columns.index(c) for c in columns]
    assert sorted(want.columns) == columns
    assert got == sorted(str([plain(r[k]) for k in at]) for r in want.fetchall())


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
