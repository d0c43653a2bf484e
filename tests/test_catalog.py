import math

import duckdb
import pytest

import __spark_entry__ as entry

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


@pytest.fixture(scope="module")
def duck(sf):
    connection = duckdb.connect()
    for name in TABLES:
        connection.sql(f"create view {name} as select * from '{sf}/{name}.parquet'")
    return connection


def plain(rows, columns):
    def cell(value):
        if value is None:
            return "null"
        if isinstance(value, float):
            return "nan" if math.isnan(value) else repr(round(value + 0.0, 6))
        return str(value)

    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(cell(row[i]) for i in order) for row in rows)


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query_matches_its_oracle(spark, sf, duck, name):
    frame = entry.queries()[name](spark, sf)
    rows = [tuple(row) for row in frame.collect()]
    sql = entry.oracle_sql().get(name)
    if sql is None:
        assert rows
        return
    expected = duck.sql(sql)
    assert sorted(frame.columns) == sorted(expected.columns)
    assert plain(rows, frame.columns) == plain(expected.fetchall(), expected.columns)


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_oracles_belong_to_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())
