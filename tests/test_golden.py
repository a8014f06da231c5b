"""Golden cases of graph, reachability, snapping, scores, grids, boxes and tiles."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from strideframe import config
from strideframe.functions import geo, scoring
from strideframe.operators import graph, grid, reach, snap, tiles
from strideframe.operators.polygon import clip_ring, inside, interior_point, is_flat, ring_area


def edges_of(spark, rows):
    return spark.createDataFrame(rows, "src long, dst long, length_m float")


def counts_of(spark, reached, weights):
    rows = reach.reach_counts(reached, spark.createDataFrame(weights, "node_id long, category string, n long")).collect()
    return {(r["origin"], r["category"]): r["n"] for r in rows}


@pytest.mark.parametrize("form", ["local", "rounds", "tiles"])
@pytest.mark.parametrize(("cutoff", "expected"), [(10.0, {(0, "a"): 2, (0, "b"): 3}), (9.0, {(0, "a"): 2})])
def test_two_hops_beat_a_long_edge_and_the_cutoff_is_inclusive(spark, form, cutoff, expected):
    edges = edges_of(spark, [(0, 1, 5.0), (0, 2, 100.0), (1, 2, 5.0)])
    origins = spark.createDataFrame([(0,)], "node_id long")
    nodes = spark.createDataFrame([(0, 53.0, -6.0), (1, 53.00002, -6.0), (2, 53.00004, -6.0)], "node_id long, lat float, lon float")
    reached = {"local": lambda: reach.reach_local(origins, edges, cutoff), "rounds": lambda: reach.reach_rounds(origins, edges, cutoff), "tiles": lambda: reach.reach_tiles(origins, edges, nodes, cutoff)}[form]()
    assert counts_of(spark, reached, [(0, "a", 2), (2, "b", 3)]) == expected


def test_edges_are_directed(spark):
    reached = reach.reach_local(spark.createDataFrame([(0,), (1,)], "node_id long"), edges_of(spark, [(0, 1, 5.0)]), 10.0)
    assert counts_of(spark, reached, [(0, "a", 1), (1, "b", 2)]) == {(0, "a"): 1, (0, "b"): 2, (1, "b"): 2}


def test_unknown_ids_raise(spark):
    nodes = spark.createDataFrame([(0,)], "node_id long")
    with pytest.raises(ValueError, match="origins"):
        reach.check_known(spark.createDataFrame([(0,), (7,)], "node_id long"), nodes, "origins")
    reach.check_known(nodes, nodes, "origins")


def test_edge_statistics(spark):
    nodes = spark.createDataFrame([(10, 53.0, -6.0), (20, 53.1, -6.1)], "node_id long, lat float, lon float")
    pairs = spark.createDataFrame([(10, 20), (10, 30), (10, 10)], "src long, dst long")
    assert graph.edge_stats(pairs, nodes).first().asDict() == {"edges_emitted": 1, "skipped_missing_nodes": 1, "skipped_zero_length": 1}
    both = spark.createDataFrame([(10, 20), (20, 10)], "src long, dst long")
    edges = graph.graph_edges(both, nodes)
    assert sorted((r["node_id"], r["degree"], r["offset"]) for r in graph.degree_offsets(nodes, edges).collect()) == [(10, 1, 0), (20, 1, 1)]


def test_distance(spark):
    far = spark.range(1).select(geo.haversine_m(F.lit(53.3498), F.lit(-6.2603), F.lit(54.5973), F.lit(-5.9301))).first()[0]
    assert abs(far - 140_400) <= 1_000


def test_walkable(spark):
    cases = [({"highway": "residential"}, True), ({"highway": "motorway"}, False), ({"highway": "footway", "access": "Private"}, False), ({"highway": "residential", "foot": "no"}, False), ({"highway": ""}, True), ({}, False), *(({"highway": h}, False) for h in config.EXCLUDED_HIGHWAYS)]
    frame = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(cases)], "i int, tags map<string,string>")
    assert [r[0] for r in frame.orderBy("i").select(scoring.is_walkable(F.col("tags"))).collect()] == [w for _, w in cases]


def test_category(spark):
    cases = [({"shop": "no", "amenity": "pharmacy"}, "shops"), ({"highway": "bus_stop"}, "transport"), ({"railway": "halt"}, "transport"), ({"railway": "signal", "leisure": "garden"}, "parks"), ({"amenity": "dentist"}, "healthcare"), ({}, None)]
    frame = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(cases)], "i int, tags map<string,string>")
    assert [r[0] for r in frame.orderBy("i").select(scoring.feature_category(F.col("tags"))).collect()] == [c for _, c in cases]


@pytest.mark.parametrize("text", ["1,2,3", "1,2,3,4,5", "a,2,3,4", "5,2,3,4", "1,5,3,4"])
def test_bad_boxes(text):
    with pytest.raises(ValueError):
        config.parse_bbox(text)


def test_boxes():
    box = config.parse_bbox(" 51, -10 ,55,-5 ")
    assert box == (51, -10, 55, -5) and config.expand_bbox(box, 0) == box
    wide = config.expand_bbox(box, 1000)
    assert wide[0] < 51 and wide[1] < -10 and wide[2] > 55 and wide[3] > -5
    assert config.same_box(box, (51.0000000001, -10, 55, -5)) and not config.same_box(box, None)


def test_snap(spark):
    nodes = spark.createDataFrame([(0, 53.0, -6.0), (1, 53.001, -6.0), (2, 53.002, -6.0)], "node_id long, lat float, lon float")
    points = spark.createDataFrame([("shops", 53.0, -6.0), ("shops", 53.0, -6.0), ("parks", 53.002, -6.0), ("far", 10.0, 20.0)], "category string, lat double, lon double")
    found = sorted((r["category"], r["node_id"]) for r in snap.nearest_nodes(points, nodes).collect())
    assert found[1:] == [("parks", 2), ("shops", 0), ("shops", 0)] and found[0][0] == "far"
    with pytest.raises(ValueError):
        snap.nearest_nodes(points, nodes.limit(0))
    assert snap.nearest_nodes(points.limit(0), nodes).count() == 0


def test_snap_is_the_brute_force(spark):
    rng = np.random.default_rng(1)
    nodes = [(i, float(a), float(b)) for i, (a, b) in enumerate(zip(rng.uniform(53, 53.05, 300), rng.uniform(-6.3, -6.1, 300), strict=True))]
    points = [(i, float(a), float(b)) for i, (a, b) in enumerate(zip(rng.uniform(52.9, 53.1, 100), rng.uniform(-6.5, -6.0, 100), strict=True))]
    found = {r["i"]: r["node_id"] for r in snap.nearest_nodes(spark.createDataFrame(points, "i long, lat double, lon double"), spark.createDataFrame(nodes, "node_id long, lat double, lon double")).collect()}

    def far(p, n):
        a, b, c, d = map(np.radians, (p[1], p[2], n[1], n[2]))
        return np.sin((c - a) / 2) ** 2 + np.cos(a) * np.cos(c) * np.sin((d - b) / 2) ** 2

    assert found == {p[0]: min(nodes, key=lambda n: far(p, n))[0] for p in points}


def test_counts_and_scores(spark):
    weights = reach.amenity_weights(spark.createDataFrame([(0, "shops"), (0, "shops"), (2, "parks")], "node_id long, category string"))
    reached = spark.createDataFrame([(0, 0, 0.0), (1, 0, 1.0), (1, 2, 1.0), (2, 2, 0.0)], "origin long, node_id long, distance_m double")
    counts = reach.reach_counts(reached, weights)
    assert {(r["origin"], r["category"]): r["n"] for r in counts.collect()} == {(0, "shops"): 2, (1, "shops"): 2, (1, "parks"): 1, (2, "parks"): 1}
    cells = spark.createDataFrame([("a", 1), ("b", 99)], "cell_id string, node_id long")
    rows = {r["cell_id"]: r.asDict() for r in grid.score_cells(cells, counts).collect()}
    assert rows["a"]["total_score"] == 2 / 5 * 25 + 1 / 2 * 25 and rows["b"]["total_score"] == 0.0 and rows["b"]["count_parks"] == 0
    missing = reach.missing_origins(spark.createDataFrame([(0,), (1,), (1,), (None,)], "node_id long"), counts.where("origin = 0"))
    assert [r[0] for r in missing.collect()] == [1]
    merged = reach.merge_counts(spark.createDataFrame([(0, "shops", 1), (5, "parks", 2)], "origin long, category string, n long"), spark.createDataFrame([(0, "parks", 7)], "origin long, category string, n long"))
    assert sorted(tuple(r) for r in merged.collect()) == [(0, "parks", 7), (5, "parks", 2)]


def test_grids(spark):
    assert grid.grid_cells(spark, 1.0, grid.rectangle(0, 0, 2, 1)).count() == 2
    inner = grid.rectangle(0.25, 0.25, 0.75, 0.75)
    cell = grid.grid_cells(spark, 1.0, [[[(0.25, 0.25), (0.75, 0.25), (0.75, 0.75), (0.25, 0.75)]]]).first()
    assert cell["clip_required"] and cell["share"] == pytest.approx(0.25)
    assert grid.grid_cells(spark, 1.0, inner, keep="within").count() == 0
    with pytest.raises(ValueError):
        grid.grid_cells(spark, 1.0, inner, keep="touching")
    ids = spark.createDataFrame([(2.5,), (0.0005,), (0.0015,)], "x double").select(geo.cell_id(F.lit(5000), F.col("x"), F.lit(-1.0))).collect()
    assert [r[0] for r in ids] == ["5000:2500:-1000", "5000:0:-1000", "5000:2:-1000"]


def test_polygons():
    notch = [(0, 0), (10, 0), (10, 10), (5, 2), (0, 10), (0, 0)]
    assert inside([[notch]], 1, 1) and not inside([[notch]], 5, 8) and not inside([[notch, [(1, 0.2), (2, 0.2), (2, 1.5), (1, 1.5)]]], 1.5, 1)
    assert ring_area(clip_ring(notch, (0, 0, 10, 1))) == pytest.approx(10)
    x, y = interior_point(notch)
    assert inside([[notch]], x, y)
    assert is_flat([(0, 0)]) and not is_flat([(0, 0, 1)])


def test_projection_origin(spark):
    x, y = geo.IRISH_GRID.forward(F.lit(-8.0), F.lit(53.5))
    assert [round(v, 6) for v in spark.range(1).select(x, y).first()] == [600000.0, 750000.0]


def test_tile_ranges(spark):
    rows = {r["z"]: tuple(r)[1:] for r in tiles.tile_ranges(spark).collect()}
    assert rows[5] == (15, 15, 10, 10, 1) and rows[14] == (7691, 7950, 5142, 5463, 83720) and sum(r[-1] for r in rows.values()) == 112010


def test_hilbert_ids(spark):
    def brute(z, x, y):
        d, n = 0, 1 << z
        base = sum(4**i for i in range(z))
        s = n >> 1
        while s:
            rx, ry = int(x & s > 0), int(y & s > 0)
            d += s * s * ((3 * rx) ^ ry)
            if ry == 0:
                if rx == 1:
                    x, y = n - 1 - x, n - 1 - y
                x, y = y, x
            s >>= 1
        return base + d

    cases = [(z, x, y) for z in range(4) for x in range(1 << z) for y in range(1 << z)] + [(14, 7800, 5300), (16, 1, 65535)]
    found = spark.createDataFrame(cases, "z int, x int, y int").select("z", "x", "y", geo.hilbert_id(F.col("z"), F.col("x"), F.col("y")).alias("t")).collect()
    assert all(r["t"] == brute(r["z"], r["x"], r["y"]) for r in found)
    assert sorted(r["t"] for r in found if r["z"] < 4) == list(range(85))


def test_vector_tiles(spark, tmp_path):
    points = spark.createDataFrame([(53.3, -6.3, "shops", "osm", "N/1"), (53.3, -6.3, "parks", "osm", None)], "lat double, lon double, category string, source string, source_ref string")
    made = tiles.joined_tiles(tiles.amenity_tiles(points, (9, 10)))
    layers = tiles.decode_tile(bytes(made.first()["mvt"]))
    assert sorted(a["category"] for _, a in layers["amenities"]) == ["parks", "shops"] and all(t == 1 for t, _ in layers["amenities"])
    assert tiles.write_archive(made, str(tmp_path / "a.pmtiles")) == 2
    data = (tmp_path / "a.pmtiles").read_bytes()
    assert data[:8] == b"PMTiles\x03"
    at, size = np.frombuffer(data[24:40], "<u8")
    import gzip

    assert json.loads(gzip.decompress(data[at : at + size]))["vector_layers"][1]["minzoom"] == 9


def test_colors(spark):
    rows = spark.createDataFrame([(0.0,), (25.0,), (100.0,), (None,)], "s double").select(scoring.score_color(F.col("s"))).collect()
    assert [r[0] for r in rows] == ["#440154", "#3b528b", "#fde725", "#440154"]


def test_hash_cascade():
    base = config.tier_hashes(config.ScoringConfig(), "f")
    moved = lambda **c: {k for k, v in config.tier_hashes(config.ScoringConfig(**c), "f").items() if v != base[k]}
    assert moved(tile_version=3) == {"render", "config", "build"}
    assert moved(grid_version=3) == {"score", "render", "config", "build"}
    assert moved(study_area="m1_corridor") == {"geo", "reach", "score", "render", "config", "build"}
    assert config.content_hash("/nowhere") == "missing" and len(base["geo"]) == 12
