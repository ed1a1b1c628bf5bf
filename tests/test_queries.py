"""Every registered query with SQL against that SQL on the smallest tables."""

import os

import duckdb
import pytest

from blockscope.plans.queries import ORACLE, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for name in os.listdir(SF):
        con.sql(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{SF}/{name}'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_against_sql(spark, tables, name):
    got, want = QUERIES[name](spark, SF), tables.sql(ORACLE[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    rows = [tuple(r) for r in got.select(*columns).collect()]
    assert sorted(rows, key=str) == sorted(want.select(*(f'"{c}"' for c in columns)).fetchall(), key=str)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_without_sql_has_rows(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).columns[:3] == ["iteration", "species", "pos"]
