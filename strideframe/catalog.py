"""All queries of the access-scoring engine by name, with their SQL twins.

Sizes and zooms follow the extent of the derived lattice (about 2 km high): grid
cells of 800, 400 and 200 m, tiles of zooms 14 to 16.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strideframe.config import AMENITY_ZOOM, CAPS, CATEGORIES, SCORE_COLORS, TILE_ZOOMS, expand_bbox, parse_bbox
from strideframe.functions import geo, scoring
from strideframe.operators import graph, grid, reach, snap, tiles
from strideframe.operators.polygon import in_corridor, inside_expr, within_area
from strideframe.plans import publishing, scored_grid
from strideframe.plans.bridge import COUNTS, REACHED, Inputs, haversine_sql, nearest_sql, sql
from strideframe.sources.features import meeting

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

SIZES = (800, 400, 200)
CUTOFF = 500.0
LINEAGE = {"build_key": "b1", "config_hash": "c1", "import_fingerprint": "f1", "created_at": "2024-01-01 00:00:00"}
LINEAGE_SQL = "'b1' AS build_key, 'c1' AS config_hash, 'f1' AS import_fingerprint, '2024-01-01 00:00:00' AS created_at"
#: A notched study area (lon, lat) and a line through it, inside the lattice.
STUDY = [[[(-6.4, 53.3), (-6.385, 53.302), (-6.37, 53.3), (-6.36, 53.31), (-6.372, 53.32), (-6.378, 53.309), (-6.395, 53.321), (-6.41, 53.311)]]]
LINE = [(-6.4, 53.305), (-6.38, 53.312), (-6.36, 53.308)]


def query(oracle: str | None = None):
    def add(f: Callable[[Inputs], DataFrame]) -> Callable[[Inputs], DataFrame]:
        QUERIES[f.__name__] = lambda spark, folder: f(Inputs(spark, folder))
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return add


def _category(t: Inputs) -> DataFrame:
    return t.features.withColumn("category", scoring.feature_category(F.col("tags")))


def _segments(t: Inputs) -> DataFrame:
    return graph.way_segments(graph.walkable_ways(t.ways))


def _edges(t: Inputs) -> DataFrame:
    return graph.graph_edges(_segments(t), t.nodes)


def _snapped(t: Inputs) -> DataFrame:
    return snap.nearest_nodes(scored_grid.amenities(t.features), t.nodes)


@query(sql("SELECT osm_type, osm_id, category FROM classified", "classified"))
def classify_features(t):
    return _category(t).select("osm_type", "osm_id", "category")


@query(sql("SELECT way_id FROM walkable", "walkable"))
def walkable_ways(t):
    return graph.walkable_ways(t.ways).select("way_id")


@query(sql("SELECT * FROM segments", "segments"))
def way_segments(t):
    return _segments(t)


BOX = expand_bbox(parse_bbox("53.303, -6.399, 53.312, -6.38"), 50.0)
BOX_SQL = f"lat::DOUBLE BETWEEN {BOX[0]!r}::DOUBLE AND {BOX[2]!r}::DOUBLE AND lon::DOUBLE BETWEEN {BOX[1]!r}::DOUBLE AND {BOX[3]!r}::DOUBLE"


@query(sql(f"SELECT node_id FROM nodes WHERE {BOX_SQL} AND node_id IN (SELECT node_id FROM way_refs WHERE way_id IN (SELECT way_id FROM walkable))", "nodes", "walkable"))
def graph_nodes_retained(t):
    return graph.retained_nodes(t.nodes, graph.walkable_ways(t.ways), BOX).select("node_id")


@query(sql("SELECT src, dst, round(length_m::DOUBLE, 3) AS length_m FROM edges", "edges"))
def graph_edges(t):
    return _edges(t).select("src", "dst", F.round(F.col("length_m").cast("double"), 3).alias("length_m"))


@query(sql("SELECT count(*) FILTER (length_m > 0) AS edges_emitted, count(*) FILTER (length_m IS NULL) AS skipped_missing_nodes, count(*) FILTER (NOT length_m > 0) AS skipped_zero_length FROM measured", "measured"))
def graph_edge_stats(t):
    return graph.edge_stats(_segments(t), t.nodes)


@query(sql("SELECT (SELECT count(*) FROM nodes) AS node_count, (SELECT count(*) FROM edges) AS edge_count", "nodes", "edges"))
def graph_size(t):
    return graph.graph_size(t.nodes, _edges(t))


@query(sql(f"SELECT node_id, lat::DOUBLE AS lat, lon::DOUBLE AS lon FROM (SELECT node_id, round(lat::DOUBLE, 6) AS lat, round(lon::DOUBLE, 6) AS lon FROM nodes WHERE {BOX_SQL})", "nodes"))
def bbox_filter(t):
    lat, lon = F.col("lat").cast("double"), F.col("lon").cast("double")
    return t.nodes.where(geo.in_box(lat, lon, BOX)).select("node_id", F.round(lat, 6).alias("lat"), F.round(lon, 6).alias("lon"))


@query(sql("SELECT node_id, degree, coalesce(sum(degree) OVER (ORDER BY node_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS offset FROM (SELECT node_id, count(src) AS degree FROM nodes LEFT JOIN edges ON src = node_id GROUP BY node_id)", "nodes", "edges"))
def node_degrees_csr(t):
    return graph.degree_offsets(t.nodes, _edges(t))


@query(sql("SELECT node_id, category, n FROM weights", "weights"))
def amenity_weights(t):
    return reach.amenity_weights(_snapped(t))


@query(sql("SELECT node_id, " + ", ".join(f"coalesce(sum(n) FILTER (category = '{c}'), 0)::BIGINT AS count_{c}" for c in CATEGORIES) + " FROM weights GROUP BY node_id", "weights"))
def amenity_weights_pivot(t):
    return grid.pivot_counts(reach.amenity_weights(_snapped(t)), "node_id")


@query(sql("SELECT osm_type, osm_id, node_id, round(distance_m, 3) AS distance_m FROM snapped", "snapped"))
def nearest_node_snap(t):
    return _snapped(t).select("osm_type", "osm_id", "node_id", F.round("distance_m", 3).alias("distance_m"))


@query(sql("SELECT count(DISTINCT node_id) AS source_nodes, count(*) AS amenities FROM snapped", "snapped"))
def source_nodes(t):
    return _snapped(t).agg(F.countDistinct("node_id").alias("source_nodes"), F.count("*").alias("amenities"))


# Origins of the distance queries; wanted and cached origins of the query of missing ones.
ALL_NODES = "SELECT node_id AS origin FROM nodes"
EVEN = "SELECT node_id AS origin FROM nodes WHERE node_id % 2 = 0"
BY_THREE = "SELECT node_id AS origin FROM nodes WHERE node_id % 3 = 0"


def _counts(t: Inputs, origins: DataFrame, cutoff: float = CUTOFF) -> DataFrame:
    return reach.reach_counts(reach.reach(origins, _edges(t), t.nodes, cutoff), reach.amenity_weights(_snapped(t)))


@query(sql("SELECT * FROM counts", "hops", "weights", "nodes", origins="SELECT node_id AS origin FROM nodes", reached=REACHED, counts=COUNTS))
def reach_counts_500m(t):
    return _counts(t, t.nodes.select("node_id"))


@query(sql("SELECT origin, node_id, round(d, 3) AS distance_m FROM reached", "hops", "nodes", origins=ALL_NODES, reached=REACHED))
def reach_distances_tiles(t):
    found = reach.reach_tiles(t.nodes.select("node_id"), _edges(t), t.nodes, CUTOFF)
    return found.select("origin", "node_id", F.round("distance_m", 3).alias("distance_m"))


@query(sql("SELECT origin, node_id, round(d, 3) AS distance_m FROM reached", "hops", "nodes", origins=ALL_NODES, reached=REACHED))
def reach_distances_rounds(t):
    found = reach.reach_rounds(t.nodes.select("node_id"), _edges(t), CUTOFF)
    return found.select("origin", "node_id", F.round("distance_m", 3).alias("distance_m"))


@query(sql("SELECT origin AS node_id FROM origins WHERE origin % 3 <> 0", "nodes", origins=EVEN))
def reach_missing_origins(t):
    even, three = t.nodes.where("node_id % 2 = 0"), t.nodes.where("node_id % 3 = 0")
    return reach.missing_origins(even.select("node_id").unionByName(even.select(F.lit(None).cast("long").alias("node_id"))), three.select(F.col("node_id").alias("origin")))


@query(sql("SELECT node_id AS origin, category, CASE WHEN node_id % 3 = 0 THEN n + 1 ELSE n END AS n FROM weights", "weights"))
def counts_merge_right_wins(t):
    cached = reach.amenity_weights(_snapped(t)).withColumnRenamed("node_id", "origin")
    return reach.merge_counts(cached, cached.where("origin % 3 = 0").withColumn("n", F.col("n") + 1))


def _score_sql(source: str, keys: str) -> str:
    parts = [f"least(count_{c} / {float(n)}::DOUBLE, 1.0::DOUBLE) * 25.0::DOUBLE" for c, n in CAPS.items()]
    return f"SELECT {keys}, " + ", ".join(f"count_{c}" for c in CAPS) + ", " + ", ".join(f"{p} AS score_{c}" for p, c in zip(parts, CAPS, strict=True)) + f", {' + '.join(parts)} AS total_score FROM {source}"


def _wide_sql(source: str, key: str) -> str:
    return f"SELECT {key}, " + ", ".join(f"coalesce(sum(n) FILTER (category = '{c}'), 0)::BIGINT AS count_{c}" for c in CATEGORIES) + f" FROM {source} GROUP BY {key}"


@query(sql(_score_sql("wide", "node_id"), "weights", wide=_wide_sql("weights", "node_id")))
def score_nodes(t):
    return grid.score_rows(grid.pivot_counts(reach.amenity_weights(_snapped(t)), "node_id"))


# The metric grid in SQL: forward and inverse projection, cells over the nodes' bounds.
G = geo.IRISH_GRID


def _n(v: float) -> str:
    return f"({v!r}::DOUBLE)"


def _forward_sql(lon: str, lat: str, source: str, keys: str) -> str:
    xs = "".join(f" + {_n(c)} * cos({2 * j} * xi) * sinh({2 * j} * eta)" for j, c in enumerate(G.alpha, 1))
    ys = "".join(f" + {_n(c)} * sin({2 * j} * xi) * cosh({2 * j} * eta)" for j, c in enumerate(G.alpha, 1))
    return f"""SELECT {keys}, {_n(G.east)} + {_n(G.scale)} * (eta{xs}) AS x, {_n(G.north)} + {_n(G.scale)} * (xi{ys}) AS y FROM (
      SELECT {keys}, atan2(t, cos(away)) AS xi, asinh(sin(away) / sqrt(t * t + cos(away) * cos(away))) AS eta FROM (
        SELECT {keys}, sinh(atanh(sin(radians({lat}))) - {_n(G.e)} * atanh({_n(G.e)} * sin(radians({lat})))) AS t, radians({lon}) - {_n(G.lon0)} AS away FROM {source}))"""


def _inverse_sql(source: str, keys: str) -> str:
    xi = "".join(f" - {_n(c)} * sin({2 * j} * xi0) * cosh({2 * j} * eta0)" for j, c in enumerate(G.beta, 1))
    eta = "".join(f" - {_n(c)} * cos({2 * j} * xi0) * sinh({2 * j} * eta0)" for j, c in enumerate(G.beta, 1))
    step = lambda s: f"tanh(iso + {_n(G.e)} * atanh({_n(G.e)} * {s}))"
    return f"""SELECT {keys}, degrees({_n(G.lon0)} + atan2(sinh(eta), cos(xi))) AS lon, degrees(asin({step(step(step(step('tanh(iso)'))))})) AS lat FROM (
      SELECT *, asinh(sin(xi) / sqrt(sinh(eta) * sinh(eta) + cos(xi) * cos(xi))) AS iso FROM (
        SELECT {keys}, xi0{xi} AS xi, eta0{eta} AS eta FROM (SELECT {keys}, (y - {_n(G.north)}) / {_n(G.scale)} AS xi0, (x - {_n(G.east)}) / {_n(G.scale)} AS eta0 FROM {source})))"""


METRIC = _forward_sql("lon::DOUBLE", "lat::DOUBLE", "nodes", "node_id")
BOUNDS = "SELECT round(min(x), 3) AS x0, round(min(y), 3) AS y0, round(max(x), 3) AS x1, round(max(y), 3) AS y1 FROM metric"
CELLS = f"""SELECT size || ':' || CAST(round_even(minx * 1000, 0) AS BIGINT) || ':' || CAST(round_even(miny * 1000, 0) AS BIGINT) AS cell_id, size AS resolution_m, minx, miny, minx + size AS maxx, miny + size AS maxy,
  (minx + size > x1 OR miny + size > y1) AS clip_required, (minx + least(minx + size, x1)) / 2 AS x, (miny + least(miny + size, y1)) / 2 AS y FROM (
  SELECT size, x1, y1, x0 + i * size::DOUBLE AS minx, y0 + j * size::DOUBLE AS miny FROM bounds, (SELECT unnest({list(SIZES)}) AS size),
    LATERAL (SELECT unnest(range(greatest(1, ceil((x1 - x0) / size)::BIGINT))) AS i), LATERAL (SELECT unnest(range(greatest(1, ceil((y1 - y0) / size)::BIGINT))) AS j))"""


@query(sql("SELECT node_id, round(x, 3) AS x, round(y, 3) AS y FROM metric", "nodes", metric=METRIC))
def crs_forward_itm(t):
    x, y = G.forward(F.col("lon").cast("double"), F.col("lat").cast("double"))
    return t.nodes.select("node_id", F.round(x, 3).alias("x"), F.round(y, 3).alias("y"))


@query(sql("SELECT node_id, round(lon, 6) AS lon, round(lat, 6) AS lat FROM back", "nodes", metric=METRIC, back=_inverse_sql("metric", "node_id")))
def crs_inverse_itm(t):
    x, y = G.forward(F.col("lon").cast("double"), F.col("lat").cast("double"))
    lon, lat = G.inverse(F.col("x"), F.col("y"))
    return t.nodes.select("node_id", x.alias("x"), y.alias("y")).select("node_id", F.round(lon, 6).alias("lon"), F.round(lat, 6).alias("lat"))


def _cells(t: Inputs) -> DataFrame:
    box, out = scored_grid.metric_box(t.nodes), None
    for size in SIZES:
        made = grid.grid_cells_rect(t.spark, size, box)
        out = made if out is None else out.unionByName(made)
    return out


@query(sql("SELECT cell_id, resolution_m, round(minx, 3) AS minx, round(miny, 3) AS miny, clip_required, round(x, 3) AS x, round(y, 3) AS y FROM cells", "nodes", metric=METRIC, bounds=BOUNDS, cells=CELLS))
def grid_cells_rect(t):
    return _cells(t).select("cell_id", "resolution_m", *(F.round(c, 3).alias(c) for c in ("minx", "miny")), "clip_required", *(F.round(c, 3).alias(c) for c in ("x", "y")))


@query(sql("SELECT cell_id, round(minx, 3) AS minx, round(miny, 3) AS miny, round(maxx, 3) AS maxx, round(maxy, 3) AS maxy FROM cells", "nodes", metric=METRIC, bounds=BOUNDS, cells=CELLS))
def cell_id_roundtrip(t):
    names = ("minx", "miny", "maxx", "maxy")
    return _cells(t).select("cell_id", *(F.round(v, 3).alias(n) for v, n in zip(geo.cell_bounds(F.col("cell_id")), names, strict=True)))


@query(sql(f"SELECT a.node_id, round({haversine_sql('a.lat::DOUBLE', 'a.lon::DOUBLE', 'b.lat::DOUBLE', 'b.lon::DOUBLE')}, 3) AS distance_m FROM nodes a JOIN nodes b ON b.node_id = a.node_id + 1", "nodes"))
def haversine_pairs(t):
    a, b = t.nodes, t.nodes.select((F.col("node_id") - 1).alias("node_id"), F.col("lat").alias("lat2"), F.col("lon").alias("lon2"))
    far = geo.haversine_m(*(F.col(c).cast("double") for c in ("lat", "lon", "lat2", "lon2")))
    return a.join(b, "node_id").select("node_id", F.round(far, 3).alias("distance_m"))


def _inside_sql(x: str, y: str) -> str:
    points = STUDY[0][0]
    parts = [f"CASE WHEN ({y1!r} > {y}) <> ({y2!r} > {y}) AND {x} < ({x2!r}::DOUBLE - {x1!r}::DOUBLE) * ({y} - {y1!r}::DOUBLE) / ({y2!r}::DOUBLE - {y1!r}::DOUBLE) + {x1!r}::DOUBLE THEN 1 ELSE 0 END" for (x1, y1), (x2, y2) in zip(points, points[1:] + points[:1], strict=True) if y1 != y2]
    return f"({' + '.join(parts)}) % 2 = 1"


@query(sql(f"SELECT osm_type, osm_id, category FROM amenities WHERE {_inside_sql('lon', 'lat')}", "amenities"))
def study_area_point_filter(t):
    return scored_grid.amenities(t.features, inside_expr(STUDY, F.col("lon"), F.col("lat"))).select("osm_type", "osm_id", "category")


#: Half the side of the squares that stand for features' areas.
HALF = 0.0015


def _crossing_sql() -> str:
    """Whether a side of the study area crosses one of a square (west, south, east, north)."""
    points, tests = STUDY[0][0], []
    for (x1, y1), (x2, y2) in zip(points, points[1:] + points[:1], strict=True):
        for c in ("west", "east"):
            tests.append(f"(({_n(x1)} - {c}) * ({_n(x2)} - {c}) < 0 AND {_n(y1)} + ({_n(y2)} - {_n(y1)}) * ({c} - {_n(x1)}) / ({_n(x2)} - {_n(x1)}) BETWEEN south AND north)")
        for c in ("south", "north"):
            if y1 != y2:
                tests.append(f"(({_n(y1)} - {c}) * ({_n(y2)} - {c}) < 0 AND {_n(x1)} + ({_n(x2)} - {_n(x1)}) * ({c} - {_n(y1)}) / ({_n(y2)} - {_n(y1)}) BETWEEN west AND east)")
    return " OR ".join(tests)


SQUARES = f"SELECT osm_type, osm_id, category, lon - {HALF} AS west, lat - {HALF} AS south, lon + {HALF} AS east, lat + {HALF} AS north FROM amenities"


@query(sql(f"SELECT osm_type, osm_id, category FROM squares WHERE {' OR '.join(_inside_sql(x, y) for x in ('west', 'east') for y in ('south', 'north'))} OR {' OR '.join(f'({_n(x)} BETWEEN west AND east AND {_n(y)} BETWEEN south AND north)' for x, y in STUDY[0][0])} OR {_crossing_sql()}", "amenities", squares=SQUARES))
def study_area_intersects(t):
    """Features that are squares, of which those stay that share a point with the study area, also where their middle lies outside."""
    found = scored_grid.amenities(t.features)
    west, east, south, north = (F.col(c) + d for c, d in (("lon", -HALF), ("lon", HALF), ("lat", -HALF), ("lat", HALF)))
    ring = F.array(*(F.array(x, y) for x, y in ((west, south), (east, south), (east, north), (west, north))))
    squares = found.withColumns({"kind": F.lit("polygon"), "geometry": F.array(F.array(ring))})
    return meeting(squares, STUDY).select("osm_type", "osm_id", "category")


@query(sql(f"SELECT osm_type, osm_id, category FROM amenities WHERE {_inside_sql('lon', 'lat')}", "amenities"))
def study_area_point_join(t):
    """The points in the study area by the join with its sides that long outlines take."""
    return within_area(scored_grid.amenities(t.features), STUDY, F.col("lon"), F.col("lat"), inline=0).select("osm_type", "osm_id", "category")


def _line_sql(x: str, y: str) -> str:
    parts = []
    for (ax, ay), (bx, by) in zip(LINE, LINE[1:]):  # noqa: B905
        dx, dy = bx - ax, by - ay
        s = f"greatest(0.0::DOUBLE, least(1.0::DOUBLE, (({x} - {_n(ax)}) * {_n(dx)} + ({y} - {_n(ay)}) * {_n(dy)}) / {_n(dx * dx + dy * dy)}))"
        parts.append(f"sqrt(pow({x} - {_n(ax)} - {s} * {_n(dx)}, 2) + pow({y} - {_n(ay)} - {s} * {_n(dy)}, 2))")
    return f"least({', '.join(parts)})"


@query(sql(f"SELECT osm_type, osm_id FROM features WHERE {_inside_sql('lon', 'lat')} AND {_line_sql('lon', 'lat')} <= 0.003", "features"))
def corridor_point_filter(t):
    return t.features.where(in_corridor(STUDY, LINE, 0.003, F.col("lon"), F.col("lat"))).select("osm_type", "osm_id")


# The flagship: the scored grid.
PLACED = nearest_sql("positions", "cell_id, resolution_m")
GRID_VIEWS = {"metric": METRIC, "bounds": BOUNDS, "cells": CELLS, "positions": _inverse_sql("cells", "cell_id, resolution_m"), "placed": PLACED, "origins": "SELECT DISTINCT node_id AS origin FROM placed", "reached": REACHED, "counts": COUNTS, "wide": _wide_sql("counts", "origin")}
ZERO = "SELECT p.cell_id, p.resolution_m, p.node_id, " + ", ".join(f"coalesce(w.count_{c}, 0) AS count_{c}" for c in CATEGORIES) + " FROM placed p LEFT JOIN wide w ON w.origin = p.node_id"
GRID_VIEWS |= {"dense": ZERO, "scored": _score_sql("dense", "cell_id, resolution_m, node_id")}


def _grid_sql(body: str) -> str:
    return sql(body, "nodes", "hops", "weights", **GRID_VIEWS)


def _scored(t: Inputs) -> DataFrame:
    return scored_grid.scored_grid(t.nodes, t.ways, t.features, SIZES, cutoff=CUTOFF)


@query(_grid_sql("SELECT * FROM scored"))
def flagship_scored_grid(t):
    return _scored(t).select("cell_id", "resolution_m", "node_id", *(f"count_{c}" for c in CAPS), *(f"score_{c}" for c in CAPS), "total_score")


@query(_grid_sql("SELECT origin AS node_id FROM origins"))
def origin_dedup_union(t):
    return scored_grid.snapped_cells(_cells(t), t.nodes).select("node_id").distinct()


@query(_grid_sql("SELECT resolution_m, count(*) AS cells, min(total_score) AS min_score, round(avg(total_score), 6) AS avg_score, max(total_score) AS max_score FROM scored GROUP BY resolution_m"))
def score_summary(t):
    return grid.score_summary(_scored(t)).withColumn("avg_score", F.round("avg_score", 6))


@query(_grid_sql(f"SELECT {LINEAGE_SQL}, resolution_m, cell_id, " + ", ".join(f"count_{c}" for c in CATEGORIES) + ", " + ", ".join(f"score_{c}" for c in CATEGORIES) + ", total_score FROM scored"))
def publish_rows_grid(t):
    rows = publishing.grid_rows(_scored(t), **LINEAGE)
    return rows.select("build_key", "config_hash", "import_fingerprint", "created_at", "resolution_m", "cell_id", *(F.coalesce(F.col("counts")[c], F.lit(0)).cast("long").alias(f"count_{c}") for c in CATEGORIES), *(F.col("scores")[c].alias(f"score_{c}") for c in CATEGORIES), "total_score")


@query(sql(f"SELECT {LINEAGE_SQL}, category, round(lat, 6) AS lat, round(lon, 6) AS lon, 'osm_local_pbf' AS source, osm_type || '/' || osm_id AS source_ref FROM amenities", "amenities"))
def publish_rows_amenities(t):
    rows = publishing.amenity_rows(scored_grid.amenities(t.features), **LINEAGE)
    return rows.withColumns({c: F.round(c, 6) for c in ("lat", "lon")})


@query(sql("SELECT c.category, count(a.category) AS n FROM (SELECT unnest(['shops', 'transport', 'healthcare', 'parks']) AS category) c LEFT JOIN amenities a USING (category) GROUP BY c.category", "amenities"))
def amenity_counts_by_category(t):
    return publishing.amenity_counts(scored_grid.amenities(t.features))


@query(_grid_sql("SELECT DISTINCT resolution_m FROM scored"))
def available_resolutions(t):
    return publishing.available_resolutions(_cells(t))


@query(sql("SELECT build_key, completed_at, created_at FROM manifests WHERE status = 'complete' AND extract_path = 'x3' AND config_hash = 'c2' ORDER BY completed_at DESC NULLS FIRST, created_at DESC NULLS FIRST, build_key LIMIT 1", "manifests"))
def latest_complete_manifest(t):
    return publishing.latest_complete(t.manifests, extract_path="x3", config_hash="c2").select("build_key", "completed_at", "created_at")


@query(sql("SELECT extract_path, config_hash, build_key FROM (SELECT *, row_number() OVER (PARTITION BY extract_path, config_hash ORDER BY completed_at DESC NULLS FIRST, created_at DESC NULLS FIRST, build_key) AS k FROM manifests WHERE status = 'complete') WHERE k = 1", "manifests"))
def latest_manifest_by_config(t):
    return publishing.latest_by(t.manifests, "extract_path", "config_hash")


@query(sql("SELECT extract_path, count(*) AS builds, count(*) FILTER (status = 'complete') > 0 AS ready FROM manifests GROUP BY extract_path", "manifests"))
def import_readiness(t):
    return t.manifests.groupBy("extract_path").agg(F.count("*").alias("builds"), (F.count_if(F.col("status") == "complete") > 0).alias("ready"))


@query(sql("SELECT category, osm_type, osm_id, row_number() OVER (ORDER BY category, osm_type, osm_id) AS k FROM amenities", "amenities"))
def amenity_rows_ordered(t):
    return publishing.numbered(scored_grid.amenities(t.features).select("category", "osm_type", "osm_id"), "category", "osm_type", "osm_id")


@query(_grid_sql("SELECT resolution_m, cell_id, row_number() OVER (ORDER BY resolution_m, cell_id) AS k FROM scored"))
def grid_rows_ordered(t):
    return publishing.numbered(_scored(t).select("resolution_m", "cell_id"), "resolution_m", "cell_id")


@query(_grid_sql("SELECT resolution_m, cell_id, total_score, row_number() OVER (ORDER BY resolution_m DESC, cell_id) AS k FROM scored WHERE resolution_m IN (200, 800)"))
def grid_rows_by_resolutions(t):
    rows = publishing.of_resolutions(_scored(t).select("resolution_m", "cell_id", "total_score"), [200, 800, 200])
    return publishing.numbered(rows, F.desc("resolution_m"), "cell_id")


@query(sql("SELECT category, osm_type || '/' || osm_id AS source_ref, row_number() OVER (ORDER BY category, osm_type || '/' || osm_id) AS k FROM amenities", "amenities"))
def amenity_rows_by_source(t):
    return publishing.numbered(scored_grid.amenities(t.features).select("category", "source_ref"), "category", "source_ref")


@query(sql("SELECT category, count(*) AS n, row_number() OVER (ORDER BY CASE category WHEN 'shops' THEN 0 WHEN 'transport' THEN 1 WHEN 'healthcare' THEN 2 WHEN 'parks' THEN 3 ELSE 4 END, category) AS place FROM (SELECT coalesce(category, 'other ' || osm_type) AS category FROM classified) GROUP BY category", "classified"))
def categories_in_order(t):
    """Configured categories first, then others by name; one row a category."""
    rows = _category(t).select(F.coalesce("category", F.concat(F.lit("other "), F.col("osm_type"))).alias("category")).groupBy("category").agg(F.count("*").alias("n"))
    names = grid.category_order([r["category"] for r in rows.select("category").collect()])  # a row a category
    return rows.withColumn("place", F.array_position(F.array(*map(F.lit, names)), F.col("category")))


@query(_grid_sql("SELECT cell_id, 'Walk score ' || printf('%.1f', total_score) || ' / 100' AS title, 'Resolution: ' || resolution_m || 'm' AS resolution, " + ", ".join(f"'{c.capitalize()}: ' || printf('%.1f', score_{c}) || ' points, ' || count_{c} || ' found' AS line_{c}" for c in CATEGORIES) + " FROM scored"))
def cell_popups(t):
    return scoring.cell_popup(_scored(t))


@query(sql("SELECT osm_type, osm_id, CASE category WHEN 'shops' THEN '#2166ac' WHEN 'transport' THEN '#762a83' WHEN 'healthcare' THEN '#d6604d' WHEN 'parks' THEN '#1a9850' ELSE '#888888' END AS color FROM classified", "classified"))
def category_colors(t):
    return _category(t).select("osm_type", "osm_id", scoring.category_color(F.col("category")).alias("color"))


@query("SELECT event_id, CAST(coalesce(json_extract(props, '$.k'), '0') AS INTEGER) AS k, CAST(coalesce(json_extract(props, '$.missing'), '0') AS INTEGER) AS missing FROM events")
def json_defaults(t):
    take = lambda name: F.coalesce(F.get_json_object("props", f"$.{name}").cast("int"), F.lit(0)).alias(name)
    return t.events.select("event_id", take("k"), take("missing"))


@query("SELECT event_type, user_id % 7 AS phase, round(sum(value), 4) AS total, count(*) AS n FROM events GROUP BY ALL")
def timing_totals(t):
    return t.events.groupBy("event_type", (F.col("user_id") % 7).alias("phase")).agg(F.round(F.sum("value"), 4).alias("total"), F.count("*").alias("n"))


def _tile_sql(lon: str, lat: str) -> tuple[str, str]:
    x = f"greatest(0, least(pow(2, z) - 1, floor({_tile_at(lon, lat)[0]})))::INTEGER"
    y = f"greatest(0, least(pow(2, z) - 1, floor({_tile_at(lon, lat)[1]})))::INTEGER"
    return x, y


def _tile_at(lon: str, lat: str) -> tuple[str, str]:
    """Unrounded positions in tiles."""
    return f"(({lon} + 180) / 360 * pow(2, z))", f"((1 - ln(tan(radians({lat})) + 1 / cos(radians({lat}))) / pi()) / 2 * pow(2, z))"


def _first_sql(at: str) -> str:
    """The first tile that a position meets: on an edge the one before it."""
    return f"greatest(0, least(pow(2, z) - 1, ceil({at}) - 1))::INTEGER"


AMENITY_TILES = """SELECT z, x, y, osm_type, osm_id FROM (SELECT z, osm_type, osm_id, {} AS xa, {} AS xb, {} AS ya, {} AS yb FROM amenities, (SELECT unnest(range(9, 15))::INTEGER AS z)),
  LATERAL (SELECT unnest(range(xa, xb + 1))::INTEGER AS x), LATERAL (SELECT unnest(range(ya, yb + 1))::INTEGER AS y)""".format(_first_sql(_tile_at("lon", "lat")[0]), _tile_sql("lon", "lat")[0], _first_sql(_tile_at("lon", "lat")[1]), _tile_sql("lon", "lat")[1])


@query(sql(AMENITY_TILES, "amenities"))
def tile_assign_amenities(t):
    return tiles.assign_points(scored_grid.amenities(t.features), (AMENITY_ZOOM, TILE_ZOOMS[1])).select("z", "x", "y", "osm_type", "osm_id")


# Points on tiles' edges and corners, of exact binary positions: longitudes of the tiles of zoom 12, latitude 0.
EDGES_SQL = "SELECT c_custkey AS k, c_custkey * 360 / 4096::DOUBLE - 180 + CASE WHEN c_custkey % 3 = 0 THEN 0.001 ELSE 0 END AS lon, CASE WHEN c_custkey % 2 = 0 THEN 0.0 ELSE 0.01 END::DOUBLE AS lat FROM customer WHERE c_custkey < 4096"


@query(f"""WITH p AS ({EDGES_SQL}) SELECT z, x, y, k FROM (SELECT z, k, {_first_sql(_tile_at('lon', 'lat')[0])} AS xa, {_tile_sql('lon', 'lat')[0]} AS xb, {_first_sql(_tile_at('lon', 'lat')[1])} AS ya, {_tile_sql('lon', 'lat')[1]} AS yb FROM p, (SELECT unnest([3, 12, 14])::INTEGER AS z)),
  LATERAL (SELECT unnest(range(xa, xb + 1))::INTEGER AS x), LATERAL (SELECT unnest(range(ya, yb + 1))::INTEGER AS y)""")
def tile_edge_points(t):
    """Points on edges are in the tiles of both sides, at three zooms."""
    k = F.col("c_custkey")
    points = t.table("customer").where(k < 4096).select(k.alias("k"), (k * 360 / F.lit(4096.0) - 180 + F.when(k % 3 == 0, 0.001).otherwise(0.0)).alias("lon"), F.when(k % 2 == 0, 0.0).otherwise(0.01).alias("lat"))
    out = None
    for z in (3, 12, 14):
        made = tiles.assign_points(points, (z, z))
        out = made if out is None else out.unionByName(made)
    return out.select("z", "x", "y", "k")


def _corner_sql(x: str, y: str) -> str:
    return _inverse_sql(f"(SELECT cell_id, {x} AS x, {y} AS y FROM cells)", "cell_id")


def _boxes(cells: DataFrame) -> DataFrame:
    """The wgs84 envelope of metric bounds, from their four corners."""
    corners = [G.inverse(F.col(x), F.col(y)) for x in ("minx", "maxx") for y in ("miny", "maxy")]
    lons, lats = zip(*corners, strict=True)
    return cells.withColumns({"west": F.least(*lons), "east": F.greatest(*lons), "south": F.least(*lats), "north": F.greatest(*lats)})


ENVELOPES = "SELECT cell_id, min(lon) AS west, max(lon) AS east, min(lat) AS south, max(lat) AS north FROM (" + " UNION ALL ".join(_corner_sql(x, y) for x in ("minx", "maxx") for y in ("miny", "maxy")) + ") GROUP BY cell_id"


@query(sql("SELECT cell_id, round(west, 6) AS west, round(south, 6) AS south, round(east, 6) AS east, round(north, 6) AS north FROM envelopes", "nodes", metric=METRIC, bounds=BOUNDS, cells=CELLS, envelopes=ENVELOPES))
def cell_envelopes(t):
    return _boxes(_cells(t)).select("cell_id", *(F.round(c, 6).alias(c) for c in ("west", "south", "east", "north")))


CELL_TILES = """SELECT z, x, y, cell_id, resolution_m FROM (SELECT cell_id, resolution_m, z, {} AS xa, {} AS xb, {} AS ya, {} AS yb FROM envelopes JOIN (SELECT cell_id, resolution_m FROM cells) USING (cell_id), (SELECT unnest({{}})::INTEGER AS z)),
  LATERAL (SELECT unnest(range(xa, xb + 1))::INTEGER AS x), LATERAL (SELECT unnest(range(ya, yb + 1))::INTEGER AS y)""".format(_first_sql(_tile_at("west", "0")[0]), _tile_sql("east", "0")[0], _first_sql(_tile_at("0", "north")[1]), _tile_sql("0", "south")[1])


@query(sql(f"SELECT z, x, y, cell_id FROM ({CELL_TILES.format([14, 15, 16])})", "nodes", metric=METRIC, bounds=BOUNDS, cells=CELLS, envelopes=ENVELOPES))
def tile_grid_features(t):
    return tiles.assign_boxes(_boxes(_cells(t)), (14, 16), resolutions=False).select("z", "x", "y", "cell_id")


#: The level of detail on the derived grid: sizes by zoom as the map's, a size class finer each.
DETAIL = {20000: 800, 10000: 400, 5000: 200}


@query(sql(f"SELECT z, x, y, cell_id FROM ({CELL_TILES.format(list(range(5, 15)))}) WHERE resolution_m = CASE WHEN z >= 11 THEN 200 WHEN z >= 8 THEN 400 ELSE 800 END", "nodes", metric=METRIC, bounds=BOUNDS, cells=CELLS, envelopes=ENVELOPES))
def tile_grid_by_zoom(t):
    """Cells with their tiles at the zooms that draw their size."""
    drawn = _boxes(_cells(t)).replace({v: k for k, v in DETAIL.items()}, subset=["resolution_m"])
    return tiles.assign_boxes(drawn, TILE_ZOOMS).select("z", "x", "y", "cell_id")


CORNERS = [("minx", "miny"), ("maxx", "miny"), ("maxx", "maxy"), ("minx", "maxy")]


def _apart_sql(sides: list, points: list) -> str:
    tests = []
    for (x1, y1), (x2, y2) in zip(sides, sides[1:] + sides[:1]):  # noqa: B905
        away = ", ".join(f"({x2} - {x1}) * ({py} - {y1}) - ({y2} - {y1}) * ({px} - {x1})" for px, py in points)
        tests.append(f"greatest({away}) < 0")
    return " OR ".join(tests)


_TILE = [(f"({x} / pow(2, z) * 360 - 180)", f"degrees(atan(sinh(pi() * (1 - 2 * {y} / pow(2, z)))))") for x, y in (("x", "(y + 1)"), ("(x + 1)", "(y + 1)"), ("(x + 1)", "y"), ("x", "y"))]
_CELL = [(f"lon{i}", f"lat{i}") for i in range(4)]
EXACT = "SELECT a.cell_id, " + ", ".join(f"q{i}.lon AS lon{i}, q{i}.lat AS lat{i}" for i in range(4)) + " FROM (SELECT cell_id FROM cells) a " + " ".join(f"JOIN ({_corner_sql(x, y)}) q{i} USING (cell_id)" for i, (x, y) in enumerate(CORNERS))


@query(sql(f"SELECT z, x, y, cell_id FROM ({CELL_TILES.format([17])}) JOIN exact USING (cell_id) WHERE NOT ({_apart_sql(_CELL, _TILE)} OR {_apart_sql(_TILE, _CELL)})", "nodes", metric=METRIC, bounds=BOUNDS, cells=CELLS, envelopes=ENVELOPES, exact=EXACT))
def tile_grid_exact(t):
    """Cells with the tiles that they themselves meet, not only their boxes."""
    placed = _boxes(_cells(t))
    for i, (x, y) in enumerate(CORNERS):
        lon, lat = G.inverse(F.col(x), F.col(y))
        placed = placed.withColumns({f"lon{i}": lon, f"lat{i}": lat})
    made = tiles.assign_boxes(placed, (17, 17), resolutions=False)
    return made.where(tiles.corners_meet(_CELL, F.col("z"), F.col("x"), F.col("y"))).select("z", "x", "y", "cell_id")


@query("SELECT z::INTEGER AS z, CASE WHEN z >= 11 THEN 5000 WHEN z >= 8 THEN 10000 ELSE 20000 END AS resolution_m FROM (SELECT unnest(range(5, 15)) AS z)")
def zoom_resolution(t):
    return t.spark.range(5, 15).select(F.col("id").cast("int").alias("z")).withColumn("resolution_m", geo.zoom_resolution(F.col("z")))


@query("SELECT z::INTEGER AS z, {w} AS x_min, {e} AS x_max, {n} AS y_min, {s} AS y_max, (({e} - {w} + 1) * ({s} - {n} + 1))::BIGINT AS tiles FROM (SELECT unnest(range(5, 15)) AS z)".format(w=_tile_sql("-11.0::DOUBLE", "0")[0], e=_tile_sql("-5.3::DOUBLE", "0")[0], n=_tile_sql("0", "55.5::DOUBLE")[1], s=_tile_sql("0", "51.3::DOUBLE")[1]))
def tile_range_per_zoom(t):
    return tiles.tile_ranges(t.spark)


def _color_sql(score: str) -> str:
    cases = ""
    for (low, a), (high, b) in zip(SCORE_COLORS, SCORE_COLORS[1:]):  # noqa: B905
        parts = " || ".join(f"lpad(lower(hex(CAST(round({int(a[i:i + 2], 16)} + ({score} - {low}) / {float(high - low)}::DOUBLE * {int(b[i:i + 2], 16) - int(a[i:i + 2], 16)}) AS BIGINT))), 2, '0')" for i in (1, 3, 5))
        cases += f" WHEN {score} < {high} THEN '#' || {parts}"
    return f"CASE{cases} ELSE '{SCORE_COLORS[-1][1]}' END"


@query(sql(f"SELECT node_id, {_color_sql('total_score')} AS color FROM scored", "weights", wide=_wide_sql("weights", "node_id"), scored=_score_sql("wide", "node_id")))
def score_color_ramp(t):
    return score_nodes(t).select("node_id", scoring.score_color(F.col("total_score")).alias("color"))


@query()
def mvt_tiles(t):
    """Both layers' tiles of all zooms with their ids and sizes; the grid by its level of detail."""
    points = scored_grid.amenities(t.features).withColumn("source", F.lit("osm_local_pbf"))
    cells = _boxes(_scored(t)).replace({v: k for k, v in DETAIL.items()}, subset=["resolution_m"]).withColumn("size", F.col("resolution_m"))
    made = tiles.joined_tiles(tiles.grid_tiles(cells, TILE_ZOOMS), tiles.amenity_tiles(points, (AMENITY_ZOOM, TILE_ZOOMS[1])))
    return made.select("z", "x", "y", "tile_id", F.length("mvt").alias("bytes"))


HILBERT = """SELECT z, x, y, x AS hx, y AS hy, ((pow(4, z) - 1) / 3)::BIGINT AS d, z - 1 AS k FROM tiles
  UNION ALL SELECT z, x, y, CASE WHEN ry = 0 THEN fy ELSE fx END, CASE WHEN ry = 0 THEN fx ELSE fy END, d + half * half * CASE WHEN rx = 1 THEN 3 - ry ELSE ry END, k - 1 FROM (
    SELECT *, CASE WHEN ry = 0 AND rx = 1 THEN half - 1 - hx % half ELSE hx % half END AS fx, CASE WHEN ry = 0 AND rx = 1 THEN half - 1 - hy % half ELSE hy % half END AS fy FROM (
      SELECT *, (hx // half) % 2 AS rx, (hy // half) % 2 AS ry FROM (SELECT *, pow(2, k)::BIGINT AS half FROM hilbert WHERE k >= 0)))"""


@query(sql("SELECT z, x, y, d AS tile_id FROM hilbert WHERE k = -1", "amenities", assigned=AMENITY_TILES, tiles="SELECT DISTINCT z, x::BIGINT AS x, y::BIGINT AS y FROM assigned", hilbert=HILBERT))
def tile_ids(t):
    """Hilbert ids of the amenities' tiles."""
    return tile_assign_amenities(t).select("z", "x", "y").distinct().withColumn("tile_id", geo.hilbert_id(F.col("z"), F.col("x"), F.col("y")))


#: A notched area as shares of the nodes' metric bounds.
NOTCHED = ((0.05, 0.1), (0.5, 0.0), (0.95, 0.1), (1.0, 0.9), (0.6, 0.95), (0.5, 0.4), (0.3, 1.0), (0.0, 0.8))


@query()
def clip_boundary_cells(t):
    """Cells of a notched metric area, clipped to it."""
    x0, y0, x1, y1 = scored_grid.metric_box(t.nodes)
    area = [[[(x0 + (x1 - x0) * a, y0 + (y1 - y0) * b) for a, b in NOTCHED]]]
    return grid.grid_cells(t.spark, 200, area).select("cell_id", "clip_required", *(F.round(c, 3).alias(c) for c in ("x", "y")), F.round("share", 6).alias("share"))
