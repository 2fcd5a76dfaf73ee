"""Every registered query against its SQL on the smallest tables, where those exist."""

import os

import duckdb
import pytest

from lexiloom.plans import catalog

DATA = os.environ.get("LEXILOOM_TEST_DATA", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")


def norm(v):
    if v is None or v != v:
        return "NULL"
    if isinstance(v, list | tuple):
        return "[" + ",".join(map(norm, v)) + "]"
    return f"{v:.9g}" if isinstance(v, float) else str(v)


def compare(spark, query, sql):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    df = query(spark, DATA)
    r = con.execute(sql)
    cols, got = [c[0] for c in r.description], df.collect()
    assert sorted(cols) == sorted(df.columns)
    assert sorted([norm(x[c]) for c in cols] for x in got) == sorted([norm(v) for v in x] for x in r.fetchall())


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_query(spark, name):
    compare(spark, catalog.QUERIES[name], catalog.SQL[name])


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.SQL)))
def test_query_without_sql_runs(spark, name):
    assert catalog.QUERIES[name](spark, DATA).count() > 0
