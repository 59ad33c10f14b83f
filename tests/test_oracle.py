"""Every registered query that has SQL against DuckDB, on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from strataspark.plans import queries as point_queries

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


def norm(v):
    return round(v, 9) + 0.0 if isinstance(v, float) else int(v) if type(v).__name__ == "Decimal" else v


def compare(name, query, sql, spark, sf_dir, duck):
    df = query(spark, sf_dir)
    columns = sorted(df.columns)
    got = [tuple(norm(r[c]) for c in columns) for r in df.collect()]
    cursor = duck.execute(sql)
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    want = [tuple(norm(r[i]) for i in at) for r in cursor.fetchall()]
    key = lambda row: tuple(map(str, row))
    assert sorted(got, key=key) == sorted(want, key=key), name


@pytest.mark.parametrize("name", sorted(point_queries.oracle_sql()))
def test_query_equals_sql(name, spark, sf_dir, duck):
    compare(name, point_queries.queries()[name], point_queries.oracle_sql()[name], spark, sf_dir, duck)


def test_entry_has_rows(spark):
    if not os.path.isdir("/root/testdata/sf0.001"):
        pytest.skip("no tables")
    assert entry.entry(spark).count() > 0


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
