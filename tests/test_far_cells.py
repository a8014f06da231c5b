"""Cells and points far from all nodes: exact results without pairs, tables or shuffles that grow with the distance."""

import numpy as np
import pytest

from strideframe import catalog
from strideframe.operators import reach, snap

POINTS = "i long, lat double, lon double"
NODES = "node_id long, lat double, lon double"


def nearest(points, nodes):
    """Brute force: distances to the micrometre, ties to the smaller id."""
    ids, lat, lon = (np.array(c) for c in zip(*nodes, strict=True))
    out = {}
    for i, y, x in points:
        h = np.sin(np.radians(lat - y) / 2) ** 2 + np.cos(np.radians(y)) * np.cos(np.radians(lat)) * np.sin(np.radians(lon - x) / 2) ** 2
        far = np.round(12742000.0 * np.arctan2(np.sqrt(h), np.sqrt(1 - h)), 6)
        out[i] = (int(ids[far == far.min()].min()), float(far.min()))
    return out


def same(found, wanted):
    assert found.keys() == wanted.keys()
    for i, (node, far) in wanted.items():
        assert found[i][0] == node and found[i][1] == pytest.approx(far, abs=2e-6), (i, found[i], wanted[i])


def strip(count=4000, spread=300):
    """Nodes in 40 rows, 22 degrees long as those of large tables."""
    return [(i, 53.3 + i % 40 * 0.0005, -6.4 + i // 40 * 0.00075 * spread) for i in range(count)]


def test_points_far_from_a_strip_of_nodes_write_nothing(spark, monkeypatch):
    def refuse(df, name):
        raise AssertionError(f"writes {name}")

    monkeypatch.setattr(snap, "written", refuse)
    nodes = strip()
    points = [(i, 53.3 + i % 50 * 0.05, -6.4 + i // 50 * 0.5) for i in range(2500)]
    rows = snap.nearest_nodes(spark.createDataFrame(points, POINTS), spark.createDataFrame(nodes, NODES)).collect()
    same({r["i"]: (r["node_id"], r["distance_m"]) for r in rows}, nearest(points, nodes))


def test_nearest_of_odd_positions(spark):
    rng = np.random.default_rng(3)
    nodes = [(i, float(y), float(x)) for i, (y, x) in enumerate(zip(rng.uniform(-89, 89, 300), rng.uniform(-180, 180, 300), strict=True))]
    nodes += [(1000 - i, 10.0, 20.0) for i in range(90)] + [(2000, 0.0, -179.9), (2001, 0.0, 170.0), (2002, 90.0, 0.0)]  # many at one place, and both sides of the antimeridian
    points = [(i, float(y), float(x)) for i, (y, x) in enumerate(zip(rng.uniform(-90, 90, 400), rng.uniform(-180, 180, 400), strict=True))]
    points += [(900, 10.0, 20.0), (901, 0.0, 179.9), (902, 89.999, 135.0)]
    odd = [(950, None, 1.0), (951, 1.0, None), (952, float("nan"), 1.0)]
    placed = spark.createDataFrame([*nodes, (5000, None, None)], NODES)
    found = {r["i"]: (r["node_id"], r["distance_m"]) for r in snap.nearest_nodes(spark.createDataFrame([*points, *odd], POINTS), placed).collect()}
    assert all(found.pop(i) == (None, None) for i, *_ in odd)
    wanted = nearest(points, nodes)
    same(found, wanted)
    assert wanted[900][0] == 911 and wanted[901][0] == 2000


def test_ties_go_to_the_smaller_id(spark):
    nodes = [(9 - i, 53.3 + i % 3 * 0.0005, -6.4 + i // 3 * 0.00075) for i in range(9)]
    points = [(i, 53.30025 + i % 2 * 0.0005, -6.4 + i // 2 * 0.00075) for i in range(6)]
    rows = snap.nearest_nodes(spark.createDataFrame(points, POINTS), spark.createDataFrame(nodes, NODES)).collect()
    same({r["i"]: (r["node_id"], r["distance_m"]) for r in rows}, nearest(points, nodes))


def refusing(monkeypatch, module, name):
    def refuse(*_):
        raise AssertionError(f"calls {name}")

    monkeypatch.setattr(module, name, refuse)


@pytest.mark.parametrize("name", ["origin_dedup_union", "flagship_scored_grid", "cell_popups", "publish_rows_grid", "mvt_tiles", "grid_rows_by_resolutions", "grid_rows_ordered", "score_summary"])
def test_cells_are_placed_without_tables_of_pairs(spark, small, monkeypatch, name):
    refusing(monkeypatch, snap, "written")
    assert catalog.QUERIES[name](spark, small).count() > 0


def test_edges_reach_the_driver_as_arrays(spark, monkeypatch):
    edges = spark.createDataFrame([(0, 1, 5.0), (0, 2, 100.0), (1, 2, 5.0)], "src long, dst long, length_m float")
    refusing(monkeypatch, type(edges), "toPandas")
    rows = reach.reach_local(spark.createDataFrame([(0,)], "node_id long"), edges, 10.0).collect()
    assert sorted((r["node_id"], r["distance_m"]) for r in rows) == [(0, 0.0), (1, 5.0), (2, 10.0)]
