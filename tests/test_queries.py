"""Registered queries against their SQL twins on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry_points
from oracles import ORACLES
from rankdraft.queries import QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    return con


def comparable(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(str([row[i] for i in order]) for row in rows)


def test_every_query_has_a_twin():
    assert set(QUERIES) == set(ORACLES)
    assert QUERIES.items() <= entry_points.queries().items()
    assert ORACLES.items() <= entry_points.oracle_sql().items()


@pytest.mark.parametrize("name", QUERIES)
def test_query_equals_sql(spark, duck, name):
    frame = QUERIES[name](spark, SF)
    twin = duck.sql(ORACLES[name])
    assert sorted(frame.columns) == sorted(twin.columns)
    got = comparable(frame.columns, [tuple(r) for r in frame.collect()])
    assert got and got == comparable(twin.columns, twin.fetchall())


def test_entry(spark):
    assert entry_points.entry(spark).count() > 0
