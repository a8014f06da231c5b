"""Every training-data query with an SQL twin gives its rows on the smallest tables."""

import os

import duckdb
import pytest

from strideframe.llm import queries


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_twin(spark, small, name):
    duck = duckdb.connect()
    for table in os.listdir(small):
        duck.sql(f"CREATE VIEW {table.split('.')[0]} AS SELECT * FROM '{small}/{table}'")
    found = queries.QUERIES[name](spark, small)
    twin = duck.sql(queries.ORACLES[name])
    assert sorted(found.columns) == sorted(twin.columns)
    assert sorted(str(tuple(r)) for r in found.select(twin.columns).collect()) == sorted(str(r) for r in twin.fetchall())
