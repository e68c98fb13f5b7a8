"""Every query that has SQL, against DuckDB on the smallest tables."""

import glob
import math
import os

import duckdb
import pytest

import __spark_entry__ as entry

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for p in glob.glob(f"{DATA}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}{'/*.parquet' if os.path.isdir(p) else ''}'")
    return c


def plain(v):
    return ("NaN" if math.isnan(v) else round(v, 5) + 0.0) if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_against_sql(spark, duck, name):
    df = entry.queries()[name](spark, DATA)
    got = sorted((tuple(plain(x) for x in r) for r in df.select(*sorted(df.columns)).collect()), key=repr)
    rows = duck.execute(entry.oracle_sql()[name])
    names = [c[0] for c in rows.description]
    at = sorted(range(len(names)), key=lambda i: names[i])
    assert [names[i] for i in at] == sorted(df.columns)
    want = sorted((tuple(plain(r[i]) for i in at) for r in rows.fetchall()), key=repr)
    assert got == want


@pytest.mark.parametrize("name", sorted(set(entry.queries()) - set(entry.oracle_sql())))
def test_others_run(spark, name):
    """Run whole: there are rows, and none twice. The 60 symbols of the smallest tables have no edges among each other."""
    df = entry.queries()[name](spark, DATA).cache()
    n = df.count()
    assert n == df.distinct().count() and (n or (name == "n2_edges" and DATA.endswith("sf0.001")))
    df.unpersist()


def test_entry(spark):
    assert entry.entry(spark).columns
