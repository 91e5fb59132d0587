"""Every query runs on the smallest data and agrees with its SQL."""

import glob
import math
import os

import pytest

from causeway.plans import registry

DATA = "/root/testdata/sf0.001"


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v)
    if isinstance(v, list | tuple):
        return "[" + ",".join(map(plain, v)) + "]"
    return str(v)


@pytest.fixture(scope="module")
def con():
    import duckdb

    c = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        c.execute(f"create view {os.path.basename(f)[:-8]} as select * from read_parquet('{f}')")
    return c


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_agrees_with_sql(spark, con, name):
    df = registry.QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    ours = sorted(tuple(plain(r[c]) for c in columns) for r in df.collect())
    result = con.execute(registry.ORACLES[name])
    names = [d[0] for d in result.description]
    at = [names.index(c) for c in columns]
    assert sorted(names) == columns
    assert ours == sorted(tuple(plain(row[i]) for i in at) for row in result.fetchall())


def test_entry_point(spark):
    import __spark_entry__ as entry

    queries = entry.queries()
    assert set(entry.oracle_sql()) <= set(queries)
    assert set(registry.QUERIES) <= set(queries)
    assert entry.entry(spark).count() > 0
