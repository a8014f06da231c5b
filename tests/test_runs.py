"""Whole runs: what is kept, what is made anew, areas as geometries, imports, tables and the command line."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from strideframe import config, pipeline, storage
from strideframe.operators import grid, polygon, reach, tiles
from strideframe.plans import imports, maintenance, publishing
from strideframe.plans.tiers import Tier
from strideframe.sources import boundary, features, graph_files, osm_pbf

from .test_lifecycle import extract


def geojson(path, *rings, **more):
    path.write_text(json.dumps({"type": "FeatureCollection", "features": [{"type": "Feature", "properties": {}, "geometry": {"type": "Polygon", "coordinates": [r]}} for r in rings]} | more))
    return str(path)


def square(west, south, east, north):
    return [[west, south], [east, south], [east, north], [west, north], [west, south]]


@pytest.fixture(scope="module")
def island(tmp_path_factory):
    """A lattice; a park that straddles the boundary, one with a hole, one outside, and a line of trees."""
    folder = tmp_path_factory.mktemp("runs")
    nodes = [(100 * i + j + 1, 53.30 + i * 0.001, -6.30 + j * 0.0015, {}) for i in range(8) for j in range(8)]
    nodes += [(9001, 53.3021, -6.2981, {"shop": "bakery"}), (9002, 53.309, -6.29, {"shop": "far"})]
    corners = {1: (53.303, -6.2995), 2: (53.303, -6.26), 3: (53.304, -6.26), 4: (53.304, -6.2995), 5: (53.30, -6.299), 6: (53.30, -6.295), 7: (53.304, -6.295), 8: (53.304, -6.299), 9: (53.3005, -6.2985), 10: (53.3005, -6.2955), 11: (53.3035, -6.2955), 12: (53.3035, -6.2985), 13: (53.4, -6.0), 14: (53.4, -5.9), 15: (53.5, -5.9)}
    nodes += [(20_000 + k, *xy, {}) for k, xy in corners.items()]
    at = lambda *ks: [20_000 + k for k in ks]
    ways = [(i + 1, {"highway": "residential"}, [100 * i + j + 1 for j in range(8)]) for i in range(8)] + [(50 + j, {"highway": "footway"}, [100 * i + j + 1 for i in range(8)]) for j in range(8)]
    ways += [(80, {"leisure": "park"}, at(1, 2, 3, 4, 1)), (81, {}, at(5, 6, 7)), (82, {}, at(5, 8, 7)), (83, {}, at(9, 10, 11, 12, 9)), (84, {"leisure": "park"}, at(13, 14, 15, 13)), (85, {"leisure": "garden"}, at(5, 6)), (86, {}, at(1, 2))]
    relations = [(7, {"leisure": "park"}, [("W", 81, "outer"), ("W", 83, "inner"), ("W", 82, "outer")]), (8, {"leisure": "park"}, [("W", 81, "outer")]), (9, {"leisure": "park"}, [("W", 999, "outer"), ("W", 81, "outer"), ("W", 82, "outer")])]
    extract(folder / "i.osm.pbf", nodes, ways, relations)
    geojson(folder / "west.geojson", square(-6.301, 53.2995, -6.2955, 53.308))
    geojson(folder / "east.geojson", square(-6.2955, 53.2995, -6.289, 53.308))
    return folder


def test_areas_are_geometries(spark, island):
    osm_pbf.register(spark)
    rows = features.features(spark.read.format("osm_pbf").load(str(island / "i.osm.pbf")))
    found = {(r["osm_type"], r["osm_id"]): r for r in rows.collect()}
    assert {k: r["kind"] for k, r in found.items()} == {("N", 9001): "point", ("N", 9002): "point", ("W", 80): "polygon", ("W", 84): "polygon", ("W", 85): "line", ("R", 7): "polygon"}
    ring, hole = found["R", 7]["geometry"][0]
    assert len(ring) == 5 and len(hole) == 5
    lon, lat = found["R", 7]["lon"], found["R", 7]["lat"]
    assert polygon.inside([[ring, hole]], lon, lat) and not polygon.inside([[hole]], lon, lat)
    area = boundary.load_island(spark, [str(island / "west.geojson")])
    kept = {(r["osm_type"], r["osm_id"]) for r in features.meeting(rows, area).select("osm_type", "osm_id").collect()}
    assert kept == {("N", 9001), ("W", 80), ("W", 85), ("R", 7)}  # the park whose point lies outside straddles the boundary


def test_geometries_meet_as_plainly():
    rng = np.random.default_rng(4)
    area = [[[(0, 0), (10, 0), (10, 10), (6, 10), (6, 4), (4, 4), (4, 10), (0, 10)], [(1, 1), (2, 1), (2, 2), (1, 2)]]]
    edges = polygon.side_array(area)
    for _ in range(200):
        x, y, w = *rng.uniform(-3, 12, 2), rng.uniform(0.1, 1.5)
        box = [[[[x, y], [x + w, y], [x + w, y + w], [x, y + w]]]]
        want = bool(polygon.clip_rings(area, (x, y, x + w, y + w)))
        assert features.geometry_meets(box, "polygon", area, edges, edges[:, :2]) == want, (x, y, w)


def test_long_outlines_by_a_join(spark):
    turn = np.linspace(0, 2 * np.pi, 3000, endpoint=False)
    area = [[[((2 + np.sin(9 * t)) * np.cos(t), (2 + np.sin(9 * t)) * np.sin(t)) for t in turn], [(-0.2, -0.2), (0.2, -0.2), (0.2, 0.2), (-0.2, 0.2)]], [[(5.0, 5.0), (6.0, 5.0), (6.0, 6.0), (5.0, 6.0)]]]
    rng = np.random.default_rng(5)
    xy = [(i, float(x), float(y)) for i, (x, y) in enumerate(rng.uniform(-3.2, 6.2, (800, 2)))]
    points = spark.createDataFrame([*xy, (9999, None, 1.0)], "i int, x double, y double")
    want = {i for i, x, y in xy if polygon.inside(area, x, y)}
    for inline in (0, 10_000):
        assert {r["i"] for r in polygon.within_area(points, area, F.col("x"), F.col("y"), inline=inline).collect()} == want


def test_grids_leave_holes_out_and_cover_polygons(spark):
    area = [[[(0, 0), (100, 0), (100, 70), (0, 70)], [(10, 10), (30, 10), (30, 30), (10, 30)]], [[(200, 0), (240, 0), (240, 40), (200, 40)]]]
    cells = grid.grid_cells(spark, 20, area).collect()
    assert sum(c["share"] * 400 for c in cells) == pytest.approx(100 * 70 - 400 + 1600)
    by = {c["cell_id"]: c for c in cells}
    assert by["20:0:0"]["share"] == pytest.approx(0.75) and by["20:0:0"]["clip_required"] and polygon.inside(area, by["20:0:0"]["x"], by["20:0:0"]["y"])
    assert not by["20:40000:0"]["clip_required"] and {c["cell_id"] for c in grid.grid_cells(spark, 20, area, keep="within").collect()} <= set(by)
    drawn = {r["cell_id"]: r["geometry"] for r in grid.with_geometry(grid.grid_cells(spark, 20, area), area).collect()}
    for k, c in by.items():
        assert sum(map(polygon.polygon_area, drawn[k])) == pytest.approx(c["share"] * 400)
    lost = spark.createDataFrame([("20:500000:0", 500.0, 0.0, 520.0, 20.0, None)], "cell_id string, minx double, miny double, maxx double, maxy double, clip_required boolean")
    with pytest.raises(Exception, match="20:500000:0"):
        grid.with_geometry(lost, area).collect()


def test_corridor(spark, island):
    area = polygon.corridor([[[(0, 0), (100, 0), (100, 100), (0, 100)], [(45, 45), (55, 45), (55, 55), (45, 55)]]], [(-20, 50), (50, 50), (50, 200)], 10)
    near = lambda x, y: min(np.hypot(x - np.clip(x, -20, 50), y - 50), np.hypot(x - 50, y - np.clip(y, 50, 200)))
    rng = np.random.default_rng(6)
    for x, y in rng.uniform(-5, 105, (600, 2)):
        inner = 0 < x < 100 and 0 < y < 100 and not (45 < x < 55 and 45 < y < 55)
        if abs(near(x, y) - 10) > 0.05:
            assert polygon.inside(area, x, y) == (inner and near(x, y) < 10)
    with pytest.raises(ValueError):
        boundary.study_polygons(spark, "m1_corridor", boundary.load_island(spark, [geojson(island / "far.geojson", square(-9, 51.5, -8.9, 51.6))]))


def test_boundaries(spark, island):
    both = boundary.load_island(spark, [str(island / "west.geojson"), str(island / "east.geojson")])
    assert len(both) == 2 and polygon.inside(both, -6.29, 53.305) and polygon.inside(both, -6.30, 53.305)
    metric = boundary.to_metric(spark, both[:1])[0][0]
    path = geojson(island / "metric.geojson", [[*p] for p in metric], crs={"properties": {"name": "urn:ogc:def:crs:EPSG::2157"}}, name="area")
    assert np.allclose(boundary.load_boundary(spark, path)[0][0], both[0][0], atol=1e-7)
    with pytest.raises(ValueError, match="layer"):
        boundary.load_boundary(spark, path, layer="other")
    with pytest.raises(ValueError, match="reference"):
        boundary.load_boundary(spark, path, source_crs="EPSG:27700")
    with pytest.raises(ValueError):
        boundary.clean_union([[[[(0, 0), (1, 1), (0, 0)]]]])


def test_runs_go_on_and_rebake(spark, island, tmp_path, monkeypatch):
    settings = config.ScoringConfig(grid_sizes_m=(500, 250))
    source, west, east, out = str(island / "i.osm.pbf"), str(island / "west.geojson"), str(island / "east.geojson"), str(tmp_path)
    first = pipeline.run(spark, source, [west, east], out, settings)
    assert first["amenity_counts"] == {"shops": 1, "transport": 0, "healthcare": 0, "parks": 3}
    assert first["tiles"]["tiles_written"] > 0 and first["tiles"]["tiles_empty"] >= 0
    assert {t for t in storage.listed(spark, f"{out}/cache")} == {"geo", "reach", "score"}
    build = pipeline.Build(spark, source, [west, east], out, settings)
    assert all(t.valid() for t in (build.geo, build.reach, build.score))
    # the order of sizes is no other build, another boundary is
    assert pipeline.Build(spark, source, [west, east], out, config.ScoringConfig(grid_sizes_m=(250, 500))).hashes == build.hashes
    assert pipeline.Build(spark, source, [west], out, settings).hashes["geo"] != build.hashes["geo"]
    # complete: nothing runs; without its archive: only tiles
    monkeypatch.setattr(pipeline, "make_graph", None)
    assert pipeline.run(spark, source, [west, east], out, settings)["build_key"] == first["build_key"]
    archive = build.archive(None)
    bytes_ = archive.read_bytes()
    archive.unlink()
    assert pipeline.run(spark, source, [west, east], out, settings)["tiles"] == first["tiles"] and archive.read_bytes() == bytes_
    monkeypatch.undo()
    # cut short behind reachability: tables and counts stay
    publishing.delete_build(spark, build.published, build.hashes["build"])
    storage.delete(spark, f"{build.score.uri}/scored")
    searched = []
    monkeypatch.setattr("strideframe.streaming.refresh.reach", lambda o, *a, real=reach.reach: searched.append(o.count()) or real(o, *a))
    again = pipeline.run(spark, source, [west, east], out, settings)
    assert searched == [0] and again["walk_cell_counts"] == first["walk_cell_counts"]
    # a finer grid searches only its new nodes; forced, all
    finer = pipeline.run(spark, source, [west, east], out, config.ScoringConfig(grid_sizes_m=(500, 125)))
    assert finer["grid_sizes_m"] == [500, 125] and searched[1] > 0
    pipeline.run(spark, source, [west, east], out, settings, force=True)
    assert searched[2] > searched[0]


def test_imports(spark, island, tmp_path):
    folder, source = str(tmp_path), str(island / "i.osm.pbf")
    with pytest.raises(RuntimeError):
        imports.ensure(spark, folder, source, "f1", scope_hash="s", version="v", allowed=False)
    assert imports.ensure(spark, folder, source, "f1", scope_hash="s", version="v").count() > 0
    row = imports.manifest(spark, folder, "f1")
    assert imports.is_complete(row, "s") and not imports.is_complete(row, "t") and not imports.is_complete(None)
    assert imports.ensure(spark, folder, source, "f1", scope_hash="s", version="v", allowed=False).count() > 0
    imports.begin(spark, folder, import_fingerprint="f1", extract_path=source)
    assert imports.manifest(spark, folder, "f1")["status"] == "building"
    with pytest.raises(Exception):
        imports.ensure(spark, folder, str(island / "west.geojson"), "f1", scope_hash="s", version="v", force=True)
    assert imports.manifest(spark, folder, "f1") is None and imports.elements(spark, folder, "f1") is None
    assert {r["extract_path"]: (r["builds"], r["ready"]) for r in imports.readiness(spark.createDataFrame([("x", "building"), ("x", "complete"), ("y", "building")], "extract_path string, status string")).collect()} == {"x": (2, True), "y": (1, False)}


@pytest.mark.parametrize("argv", [["o", "--force-precompute"], ["o", "--auto-refresh-import"], ["o", "--precompute"], ["o", "--refresh-import", "--extract", "x.osm.pbf"]])
def test_command_line_rules(argv):
    with pytest.raises(SystemExit) as e:
        pipeline.main(argv)
    assert e.value.code == 2


def test_command_line(spark, island, tmp_path, capsys):
    base = [str(tmp_path), "--extract", str(island / "i.osm.pbf"), "--boundary", str(island / "west.geojson"), "--grid-sizes", "500"]
    assert pipeline.main([*base, "--precompute"]) == 1  # no import yet, and not allowed
    assert pipeline.main([*base, "--refresh-import"]) == 0
    assert pipeline.main([*base, "--precompute"]) == 0 and "build_key" in capsys.readouterr().out
    assert pipeline.main([str(tmp_path / "none")]) == 1
    (tmp_path / "index.html").write_text("x")
    server = pipeline.serve_build(spark, str(tmp_path), str(tmp_path), "127.0.0.1", 0)
    server.server_close()


def test_tier_of_other_versions_is_made_anew(spark, tmp_path):
    tier = Tier(tmp_path, "geo", "h")
    tier.prepare("x")
    tier.save("t", spark.range(3))
    Tier(tmp_path, "geo", "h").prepare("x")
    assert tier.has("t")
    found = json.loads((tier.path / "manifest.json").read_text())
    (tier.path / "manifest.json").write_text(json.dumps(found | {"environment": found["environment"] | {"pyspark": "1.0"}}))
    Tier(tmp_path, "geo", "h").prepare("x")
    assert not tier.has("t")


def test_tables(spark):
    maintenance.drop_tables(spark, ["sf_rows"])
    assert not maintenance.table_exists(spark, "sf_rows")
    assert maintenance.ensure_table(spark, "sf_rows", "a bigint, b string") == [] and maintenance.table_exists(spark, "sf_rows")
    assert maintenance.ensure_table(spark, "sf_rows", "a bigint, b string, c double") == ["c double"] and spark.table("sf_rows").columns == ["a", "b", "c"]
    maintenance.drop_tables(spark, ["sf_rows", "sf_none"])
    assert not maintenance.table_exists(spark, "sf_rows")


def test_weights_from_records(spark, tmp_path):
    np.array([[0, 2, 0], [1, 0, 3]], "<u4").tofile(tmp_path / "w")
    nodes = spark.createDataFrame([(0,), (1,)], "node_id long")
    records = graph_files.read_weights(spark, tmp_path / "w", ("shops", "parks"))
    assert sorted(map(tuple, reach.checked_weights(records, nodes).collect())) == [(0, "shops", 2), (1, "parks", 3)]
    with pytest.raises(ValueError, match="node 1"):
        reach.checked_weights(records, nodes.where("node_id = 0"))
    with pytest.raises(ValueError):
        graph_files.read_weights(spark, tmp_path / "w", ("shops", "parks", "x"))


def test_addresses_names_and_flat_geometry(spark):
    assert config.jdbc_options({"DATABASE_URL": "postgresql+driver://u:p%40@h.org/db?sslmode=require&x=1"})["url"] == "jdbc:postgresql://h.org:5432/db?sslmode=require"
    assert config.jdbc_options({"POSTGRES_HOST": "h", "POSTGRES_DB": "d", "POSTGRES_USER": "u", "POSTGRES_PASSWORD": "p"})["password"] == "p"
    for odd in ({"DATABASE_URL": "postgres://u@h.org/db"}, {"DATABASE_URL": "mysql://h/d"}, {"DATABASE_URL": "postgres://localhost"}):
        with pytest.raises(ValueError):
            config.jdbc_options(odd)
    with pytest.raises(RuntimeError, match="POSTGRES_USER"):
        config.jdbc_options({"POSTGRES_HOST": "h", "POSTGRES_DB": "d", "POSTGRES_PASSWORD": "p"})
    assert len(config.environment()) == 11 and config.environment(("none",))["none"] == "unknown"
    config.check_extract_name("A.OSM.PBF")
    frame = spark.createDataFrame([("c1", [[[[0.0, 1.0]]]]), ("c2", [[[[0.0, 1.0, 2.0]]]])], "cell_id string, geometry array<array<array<array<double>>>>")
    flat = frame.withColumn("geometry", publishing.plane_geometry("geometry", F.col("cell_id")))
    assert flat.where("cell_id = 'c1'").first()["geometry"] == [[[[0.0, 1.0]]]]
    with pytest.raises(Exception, match="c2"):
        flat.collect()


def test_snapping_keeps_points_without_a_position(spark):
    from strideframe.operators.snap import nearest_nodes

    nodes = spark.createDataFrame([(1, 53.0, -6.0)], "node_id long, lat double, lon double")
    points = spark.createDataFrame([("a", 53.0, -6.0), ("b", None, -6.0), ("c", 53.0, None)], "k string, lat double, lon double")
    assert {r["k"]: r["node_id"] for r in nearest_nodes(points, nodes).collect()} == {"a": 1, "b": None, "c": None}
    assert {r["k"]: r["node_id"] for r in nearest_nodes(points.where("k = 'b'"), nodes).collect()} == {"b": None}


def test_dense_tiles_are_several_tasks_work(spark):
    nodes = spark.createDataFrame([(k, 53.0 + k * 1e-5, -6.0) for k in range(60)], "node_id long, lat float, lon float")
    edges = spark.createDataFrame([(k, k + 1, 1.2) for k in range(59)], "src long, dst long, length_m float")
    one, many = (sorted(map(tuple, reach.reach_tiles(nodes.select("node_id"), edges, nodes, 5.0, tile_m=500.0, most=m).collect())) for m in (2048, 7))
    assert one == many == sorted(map(tuple, reach.reach_local(nodes.select("node_id"), edges, 5.0).collect()))


def test_orders(spark):
    rows = spark.createDataFrame([(200, "b"), (800, "a"), (200, "a")], "resolution_m int, cell_id string")
    assert [tuple(r) for r in publishing.ordered(rows, "grid_by_resolutions").collect()] == [(800, "a"), (200, "a"), (200, "b")]
    assert publishing.of_resolutions(rows, []).count() == 0 and publishing.of_resolutions(rows, [200, 200]).count() == 2
    assert grid.category_order(["zoo", "parks", "art"]) == ["shops", "transport", "healthcare", "parks", "art", "zoo"]
    counts = spark.createDataFrame([(1, "shops", 2), (1, "zoo", 4)], "origin long, category string, n long")
    assert grid.pivot_counts(counts, "origin", others=["zoo"]).first().asDict() == {"origin": 1, "count_shops": 2, "count_transport": 0, "count_healthcare": 0, "count_parks": 0, "count_zoo": 4}
    made = tiles.tile_counters(tiles.tile_ranges(spark, (5, 5)), spark.createDataFrame([], "z int")).first()
    assert tuple(made) == (0, 1)
