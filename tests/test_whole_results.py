"""Queries do their whole job: compared with SQL or brute force of this file, not with the twins."""

import duckdb
import pytest

from strideframe import catalog
from strideframe.plans.bridge import REACHED, sql


@pytest.fixture(scope="module")
def duck(small):
    con = duckdb.connect()
    for name in ("part", "orders", "lineitem", "customer"):
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{small}/{name}.parquet'")
    return con


@pytest.mark.parametrize("name", ["reach_distances_tiles", "reach_distances_rounds"])
def test_all_nodes_are_origins(spark, duck, small, name):
    whole = sql("SELECT origin, node_id, round(d, 3) AS distance_m FROM reached", "hops", "nodes", origins="SELECT node_id AS origin FROM nodes", reached=REACHED)
    rows = sorted(map(tuple, catalog.QUERIES[name](spark, small).select("origin", "node_id", "distance_m").collect()))
    assert rows == sorted(duck.sql(whole).fetchall()) and any(r[0] % 2 for r in rows)


def test_all_amenities_have_their_position(spark, duck, small):
    whole = sql("SELECT category, osm_type, osm_id, row_number() OVER (ORDER BY category, osm_type, osm_id) AS k FROM amenities", "amenities")
    found = catalog.QUERIES["amenity_rows_ordered"](spark, small).select("category", "osm_type", "osm_id", "k")
    rows = sorted(map(tuple, found.collect()))
    assert rows == sorted(duck.sql(whole).fetchall()) and len(rows) > 25 and dict(found.dtypes)["k"] == "bigint"


def test_all_zooms_are_tiled(spark, duck, small):
    x, y = catalog._tile_sql("lon", "lat")
    whole = sql(f"SELECT z, {x} AS x, {y} AS y, osm_type, osm_id FROM amenities, (SELECT unnest(range(9, 15)) AS z)", "amenities")
    wanted = sorted(duck.sql(whole).fetchall())
    assert sorted(map(tuple, catalog.QUERIES["tile_assign_amenities"](spark, small).select("z", "x", "y", "osm_type", "osm_id").collect())) == wanted
    assert {tuple(r)[:3] for r in catalog.QUERIES["tile_ids"](spark, small).select("z", "x", "y").collect()} == {r[:3] for r in wanted}
    assert {r["z"] for r in catalog.QUERIES["mvt_tiles"](spark, small).collect()} >= set(range(5, 15))
