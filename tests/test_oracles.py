"""Every query with an SQL twin gives its rows on the smallest tables."""

import os

import duckdb
import pytest

from strideframe import catalog


@pytest.fixture(scope="module")
def duck(small):
    con = duckdb.connect()
    for name in os.listdir(small):
        con.sql(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{small}/{name}'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_twin(spark, duck, small, name):
    found = catalog.QUERIES[name](spark, small)
    twin = duck.sql(catalog.ORACLES[name])
    assert sorted(found.columns) == sorted(twin.columns)
    order = sorted(found.columns)
    ours = sorted(str([r[c] for c in order]) for r in found.collect())
    at = [twin.columns.index(c) for c in order]
    assert ours == sorted(str([r[i] for i in at]) for r in twin.fetchall())


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_others_give_rows(spark, small, name):
    assert catalog.QUERIES[name](spark, small).count() > 0
