"""Sources, publishing, tiers, progress, streaming, serving and the whole batch run."""

import json
import struct
import threading
import urllib.error
import urllib.request
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from strideframe import config, pipeline, serve
from strideframe.plans import publishing
from strideframe.plans.progress import Progress, load_history
from strideframe.plans.tiers import Tier, status_lines, valid_tiers
from strideframe.sources import boundary, features, graph_files, osm_pbf
from strideframe.streaming import refresh

# a small writer of the extract format


def varint(n):
    out = b""
    while n > 127:
        out += bytes([n & 127 | 128])
        n >>= 7
    return out + bytes([n])


def field(k, v):
    return varint(k << 3) + varint(v) if isinstance(v, int) else varint(k << 3 | 2) + varint(len(v)) + v


def zig(n):
    return n << 1 if n >= 0 else (-n << 1) - 1


def packed(values):
    return b"".join(map(varint, values))


def deltas(values):
    return [zig(b - a) for a, b in zip([0, *values], values, strict=False)]


def extract(path, nodes, ways, relations=()):
    words = [""]

    def word(w):
        if w not in words:
            words.append(w)
        return words.index(w)

    tags = lambda t: (field(2, packed([word(k) for k in t])) + field(3, packed([word(v) for v in t.values()]))) if t else b""
    dense = field(1, packed(deltas([n[0] for n in nodes]))) + field(8, packed(deltas([round(n[1] * 1e7) for n in nodes]))) + field(9, packed(deltas([round(n[2] * 1e7) for n in nodes])))
    dense += field(10, packed([i for n in nodes for i in [*(x for k, v in n[3].items() for x in (word(k), word(v))), 0]]))
    group = field(2, dense) + b"".join(field(3, field(1, i) + tags(t) + field(8, packed(deltas(refs)))) for i, t, refs in ways)
    group += b"".join(field(4, field(1, i) + tags(t) + field(8, packed([word(r) for *_, r in m])) + field(9, packed(deltas([r for _, r, _ in m]))) + field(10, packed(["NWR".index(k) for k, *_ in m]))) for i, t, m in relations)
    block = field(1, b"".join(field(1, w.encode()) for w in words)) + field(2, group)
    with open(path, "wb") as f:
        for kind, body in (("OSMHeader", b""), ("OSMData", block)):
            blob = field(2, len(body)) + field(3, zlib.compress(body))
            head = field(1, kind.encode()) + field(3, len(blob))
            f.write(struct.pack(">I", len(head)) + head + blob)


@pytest.fixture(scope="module")
def island(tmp_path_factory):
    """An extract of a 12 x 12 lattice with amenities, and its boundary."""
    folder = tmp_path_factory.mktemp("island")
    nodes = [(100 * i + j + 1, 53.30 + i * 0.001, -6.30 + j * 0.0015, {}) for i in range(12) for j in range(12)]
    nodes += [(9001, 53.3021, -6.2981, {"shop": "bakery", "name": "B"}), (9002, 53.305, -6.295, {"highway": "bus_stop"}), (9003, 60.0, 10.0, {"shop": "x"}), (9004, 53.306, -6.294, {"amenity": "bench"})]
    ways = [(i + 1, {"highway": "residential"}, [100 * i + j + 1 for j in range(12)]) for i in range(12)] + [(50 + j, {"highway": "footway"}, [100 * i + j + 1 for i in range(12)]) for j in range(12)]
    ways += [(80, {"highway": "motorway"}, [1, 1112]), (81, {"leisure": "park"}, [1, 2, 102, 101, 1]), (82, {"highway": "path"}, [1])]
    extract(folder / "i.osm.pbf", nodes, ways, [(7, {"amenity": "hospital"}, [("W", 81, "outer")])])
    ring = [[-6.301, 53.299], [-6.282, 53.299], [-6.282, 53.312], [-6.29, 53.309], [-6.301, 53.312], [-6.301, 53.299]]
    (folder / "b.geojson").write_text(json.dumps({"type": "FeatureCollection", "features": [{"type": "Feature", "properties": {"k": "in"}, "geometry": {"type": "Polygon", "coordinates": [[[*p, 5.0] for p in ring]]}}, {"type": "Feature", "properties": {"k": "out"}, "geometry": None}]}))
    return folder


def test_extract_source(spark, island):
    osm_pbf.register(spark)
    rows = spark.read.format("osm_pbf").load(str(island / "i.osm.pbf"))
    assert {r[0]: r[1] for r in rows.groupBy("osm_type").count().collect()} == {"N": 148, "W": 27, "R": 1}
    bakery = rows.where("osm_id = 9001").first()
    assert bakery["tags"] == {"shop": "bakery", "name": "B"} and bakery["lat"] == pytest.approx(53.3021)
    assert rows.where("osm_type = 'W' AND osm_id = 81").first()["refs"] == [1, 2, 102, 101, 1]
    found = {(r["osm_type"], r["osm_id"]): r["category"] for r in features.features(rows).collect()}
    assert found == {("N", 9001): "shops", ("N", 9002): "transport", ("N", 9003): "shops", ("W", 81): "parks", ("R", 7): "healthcare"}
    only = spark.read.format("osm_pbf").option("kinds", "W").load(str(island / "i.osm.pbf"))
    assert only.select("osm_type").distinct().collect()[0][0] == "W"


def test_extract_names(tmp_path):
    with pytest.raises(ValueError, match="pdf"):
        config.check_extract("a.osm.pdf")
    with pytest.raises(ValueError):
        config.check_extract("a.osm")
    with pytest.raises(FileNotFoundError):
        config.check_extract(str(tmp_path / "a.osm.pbf"))


def test_boundary(spark, island):
    area = boundary.load_boundary(spark, str(island / "b.geojson"))
    assert len(area) == 1 and all(len(p) == 2 for p in area[0][0])
    with pytest.raises(ValueError):
        boundary.load_boundary(spark, str(island / "b.geojson"), lambda p: p["k"] == "other")
    with pytest.raises(ValueError):
        boundary.study_area("elsewhere", area)
    assert boundary.study_area("m1_corridor", area)["width_m"] == 10_000


def test_whole_run(spark, island, tmp_path):
    settings = config.ScoringConfig(grid_sizes_m=(500, 250))
    summary = pipeline.run(spark, str(island / "i.osm.pbf"), str(island / "b.geojson"), str(tmp_path), settings)
    assert summary["amenity_counts"] == {"shops": 1, "transport": 1, "healthcare": 1, "parks": 1}
    tables = [spark.read.parquet(f"{tmp_path}/published/{n}") for n in ("manifests", "grid", "amenities")]
    state = publishing.runtime_state(*tables)
    assert state["grid_sizes_m"] == [500, 250] and state["default_zoom"] == 6
    flat = publishing.flat_grid(tables[1])
    assert flat.where("total_score > 0").count() > 0 and flat.where("total_score < 0 OR total_score > 100").count() == 0
    assert len(list((tmp_path / "tiles").glob("*.pmtiles"))) == 1
    assert pipeline.run(spark, str(island / "i.osm.pbf"), str(island / "b.geojson"), str(tmp_path), settings)["build_key"] == summary["build_key"]
    publishing.delete_build(spark, f"{tmp_path}/published", summary["build_key"])
    assert not list((tmp_path / "published" / "grid").glob("build_key=*"))


def test_graph_files(spark, tmp_path):
    nodes = spark.createDataFrame([(0, 53.0, -6.0), (1, 53.1, -6.0)], graph_files.NODES)
    edges = spark.createDataFrame([(0, 1, 5.0)], graph_files.EDGES)
    graph_files.save_graph(nodes, edges, str(tmp_path / "g"), extract_fingerprint="f", bbox=[1, 2, 3, 4], bbox_padding_m=500.0)
    _, _, meta = graph_files.load_graph(spark, str(tmp_path / "g"))
    assert graph_files.matches(meta, extract_fingerprint="f", bbox=(1, 2, 3, 4), padding_m=500.0)
    assert not graph_files.matches(meta, extract_fingerprint="g", bbox=(1, 2, 3, 4), padding_m=500.0)
    edges.unionByName(edges).write.mode("append").parquet(str(tmp_path / "g" / "edges"))
    with pytest.raises(ValueError):
        graph_files.load_graph(spark, str(tmp_path / "g"))
    np.array([0, 1, 1], "<u8").tofile(tmp_path / "offsets.u64")
    np.array([1], "<u4").tofile(tmp_path / "targets.u32")
    np.array([5], "<f4").tofile(tmp_path / "lengths.f32")
    assert [tuple(r) for r in graph_files.csr_edges(spark, *graph_files.read_csr(tmp_path, 2)).collect()] == [(0, 1, 5.0)]
    with pytest.raises(ValueError):
        graph_files.read_csr(tmp_path, 3)
    (tmp_path / "odd").write_bytes(b"123")
    with pytest.raises(ValueError):
        graph_files.read_array(tmp_path / "odd", "<u4")


def test_tiers(spark, tmp_path):
    tiers = {n: Tier(tmp_path, n, f"h{n}") for n in ("geo", "reach", "score")}
    assert not tiers["geo"].mark_complete("x")
    for tier in tiers.values():
        tier.mark_building("start")
        assert not tier.valid()
        tier.save("t", spark.range(3))
        assert tier.valid(("t",)) and tier.mark_complete("end")
    assert valid_tiers(tiers) == {"geo": True, "reach": True, "score": True}
    (tiers["reach"].path / "manifest.json").write_text("{")
    assert valid_tiers(tiers) == {"geo": True, "reach": False, "score": False}
    assert not any(valid_tiers(tiers, force=True).values())
    assert tiers["score"].load(spark, "t").count() == 3 and tiers["score"].load(spark, "none") is None
    for f in (tiers["score"].path / "t").glob("part*"):
        f.write_bytes(b"broken")
    assert tiers["score"].load(spark, "t") is None and (tiers["score"].path / "t.bad").exists()
    assert "geo other: missing" in status_lines(tmp_path, {"geo": "other", "reach": "hreach", "score": "hscore"})


def test_progress(tmp_path):
    now = [0.0]
    p = Progress({"amenities": 20.0, "publish": 5.0}, lambda: now[0], ("import", "amenities", "publish"))
    p.start("import")
    assert p.left() is None
    now[0] = 12.0
    p.update(1, 4)
    assert p.left() == 36.0 + 25.0
    p.start("amenities")
    assert p.left() == 25.0 and p.seconds == {"import": 12.0}
    now[0] = 15.0
    assert p.left() == 22.0  # without units the time that has passed is taken off
    p.update(1, 100)
    assert p.left() == 20.0 * 0.99 + 5.0
    assert Progress({"import": 3.0}, lambda: now[0], ("import", "grids")).left() is None  # a later phase without history
    p.save(tmp_path / "t.json")
    assert load_history(tmp_path / "t.json")["import"] == 12.0
    (tmp_path / "t.json").write_text('{"seconds": {"import": -1, "other": 3, "grids": 2}}')
    assert load_history(tmp_path / "t.json") == {"grids": 2.0} and load_history(tmp_path / "none") == {}
    assert config.hms(-3) == "00:00:00" and config.hms(3725) == "01:02:05"


def test_readiness():
    assert publishing.refresh_needed(True, True, False, False) is False
    assert publishing.refresh_needed(False, True, False, True) and publishing.refresh_needed(True, True, True, True)
    with pytest.raises(RuntimeError):
        publishing.refresh_needed(False, False, False, False)


def test_refresh_stream(spark, tmp_path):
    nodes = spark.createDataFrame([(0, 53.0, -6.0), (1, 53.00001, -6.0)], "node_id long, lat float, lon float")
    edges = spark.createDataFrame([(0, 1, 5.0)], "src long, dst long, length_m float")
    weights = spark.createDataFrame([(1, "shops", 2)], "node_id long, category string, n long")
    arrivals, folder, checkpoint = (str(tmp_path / n) for n in ("arrivals", "counts", "checkpoint"))
    for batch in ([0], [0, 1], [5]):
        spark.createDataFrame([(i,) for i in batch], "node_id long").write.mode("append").parquet(arrivals)
        refresh.refresh_stream(spark, arrivals, edges, nodes, weights, folder, 10.0, checkpoint).awaitTermination()
    assert sorted((r["origin"], r["category"] or "", r["n"]) for r in refresh.cached_counts(spark, folder).collect()) == [(0, "shops", 2), (1, "shops", 2), (5, "", 0)]
    assert refresh.merged(spark, folder, spark.createDataFrame([(0, "parks", 1)], refresh.COUNTS)).where("origin = 0").first()["category"] == "parks"


def test_latest_manifest(spark):
    rows = [("a", "complete", "2024-01-02", "2024-01-01"), ("b", "building", None, "2024-01-05"), ("c", "complete", "2024-01-02", "2024-01-01")]
    frame = spark.createDataFrame(rows, "build_key string, status string, completed_at string, created_at string").withColumns({c: F.col(c).cast("timestamp") for c in ("completed_at", "created_at")})
    assert publishing.latest_complete(frame).first()["build_key"] == "a"
    with pytest.raises(RuntimeError):
        publishing.runtime_state(frame.where("status = 'building'"), None, None)


def test_server(tmp_path):
    (tmp_path / "index.html").write_text("hello")
    (tmp_path / "a.pmtiles").write_bytes(bytes(range(100)))
    with pytest.raises(FileNotFoundError):
        serve.make_server(dict, tmp_path / "none", tmp_path)

    def state():
        return {"build_key": "b"}

    server = serve.make_server(state, tmp_path / "a.pmtiles", tmp_path, port=0)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    base = f"http://127.0.0.1:{server.server_address[1]}"

    def get(path, **headers):
        try:
            with urllib.request.urlopen(urllib.request.Request(base + path, headers=headers)) as r:
                return r.status, r.read()
        except urllib.error.HTTPError as e:
            return e.code, e.read()

    assert get("/tiles/archive.pmtiles", Range="bytes=10-12") == (206, bytes([10, 11, 12]))
    assert get("/tiles/archive.pmtiles", Range="bytes=98-") == (206, bytes([98, 99]))
    assert get("/tiles/archive.pmtiles", Range="bytes=-5")[0] == 416 and get("/tiles/archive.pmtiles", Range="bytes=100-")[0] == 416
    assert get("/") == (200, b"hello") and get("/static/../x")[0] == 404 and get("/other")[0] == 404
    assert json.loads(get("/api/runtime")[1])["build_key"] == "b"
    server.shutdown()
