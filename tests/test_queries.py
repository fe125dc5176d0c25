"""Every core query gives the rows of its SQL on the smallest tables."""

import glob
import math
import os

import pytest

from corvigraph import registry

BASE = "/root/testdata/sf0.001"
QUERIES, SQL = registry.load()
pytestmark = pytest.mark.skipif(not os.path.isdir(BASE), reason="no tables")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for f in glob.glob(f"{BASE}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def plain(v):
    if isinstance(v, float):
        return "NaN" if math.isnan(v) else f"{v:.5g}"
    return [plain(x) for x in v] if isinstance(v, (list, tuple)) else str(v)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows_as_sql(spark, duck, name):
    df = QUERIES[name](spark, BASE)
    result = duck.sql(SQL[name])
    cols = sorted(df.columns)
    assert cols == sorted(result.columns)
    order = [result.columns.index(c) for c in cols]
    expected = sorted(str([plain(r[i]) for i in order]) for r in result.fetchall())
    assert sorted(str([plain(x) for x in r]) for r in df.select(*cols).collect()) == expected


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, name):
    QUERIES[name](spark, BASE).collect()
