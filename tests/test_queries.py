"""Every registered query on the smallest tables, against its SQL on DuckDB."""

import math

import pytest

import __spark_entry__ as entry

duckdb = pytest.importorskip("duckdb")

QUERIES, SQL = entry.queries(), entry.oracle_sql()
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(data):
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{data}/{table}.parquet'")
    return con


def normal(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 6) + 0.0
    return value


def ordered(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(([normal(r[i]) for i in order] for r in rows), key=repr)


def test_every_sql_belongs_to_a_query():
    assert set(SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, data, duck, name):
    df = QUERIES[name](spark, data)
    got = [tuple(r) for r in df.collect()]
    if name in SQL:
        result = duck.execute(SQL[name])
        columns = [c[0] for c in result.description]
        assert sorted(columns) == sorted(df.columns)
        assert ordered(got, df.columns) == ordered(result.fetchall(), columns)


def test_entry(spark, data):
    rows = entry.entry(spark).collect()
    assert {r.k for r in rows} == {1, 5, 10}
