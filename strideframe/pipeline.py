"""The batch run over an extract, and its command line.

    python -m strideframe.pipeline OUT --refresh-import --extract EXTRACT --boundary FILE
    python -m strideframe.pipeline OUT --precompute --extract EXTRACT --boundary FILE [--boundary FILE]
    python -m strideframe.pipeline OUT --serve --static FOLDER

All folders but the archive's are reached through Spark's stores; the archive is
one file, written by the driver to a folder of its own (``archive``).
"""

from __future__ import annotations

import argparse
import json
import sys
from dataclasses import replace
from functools import reduce
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strideframe import config, storage
from strideframe.functions.geo import IRISH_GRID
from strideframe.operators.graph import graph_edges, retained_nodes, walkable_ways, way_segments
from strideframe.operators.grid import grid_cells, score_cells
from strideframe.operators.reach import amenity_weights, check_known
from strideframe.operators.snap import nearest_nodes
from strideframe.operators.tiles import amenity_tiles, grid_tiles, joined_tiles, tile_counters, tile_ranges, write_archive
from strideframe.plans import imports, publishing, scored_grid
from strideframe.plans.progress import Progress, history_of
from strideframe.plans.tiers import Tier
from strideframe.sources import boundary, features, graph_files
from strideframe.streaming.refresh import add_missing, cached_counts

IMPORTER = "strideframe-1"


class Build:
    """What a run is about: settings with the boundaries' state, hashes, folders and tiers."""

    def __init__(self, spark: SparkSession, extract: str, boundaries: list[str], out: str, settings: config.ScoringConfig | None = None):
        config.check_extract_name(extract)
        self.spark, self.extract, self.boundaries, self.out = spark, extract, boundaries, out
        self.settings = replace(settings or config.ScoringConfig(), boundary=boundary.boundary_state(spark, boundaries))
        self.source = config.import_fingerprint(imports.fingerprint(spark, extract), IMPORTER)
        self.hashes = config.tier_hashes(self.settings, self.source)
        self.geo, self.reach, self.score = (Tier(f"{out}/cache", n, self.hashes[n], self.settings) for n in ("geo", "reach", "score"))
        self.published = f"{out}/published"

    def imported(self, *, force: bool = False, allowed: bool = True) -> DataFrame:
        return imports.ensure(self.spark, f"{self.out}/imports", self.extract, self.source, scope_hash=self.hashes["geo"], version=IMPORTER, force=force, allowed=allowed)

    def done(self) -> dict | None:
        """The summary of a complete build of these hashes."""
        if not storage.exists(self.spark, f"{self.published}/manifests/build_key={self.hashes['build']}"):
            return None
        row = publishing.latest_complete(self.spark.read.parquet(f"{self.published}/manifests"), build_key=self.hashes["build"]).first()
        return json.loads(row["summary"]) if row is not None else None

    def archive(self, folder: str | None) -> Path:
        return Path(folder or f"{self.out}/tiles") / f"{self.hashes['build']}.pmtiles"


def make_graph(build: Build, elements: DataFrame, island: list) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of the walking graph; those of an earlier run with the same extract, box and padding stay."""
    west, south, east, north = (f(p[k] for polygon in island for ring in polygon for p in ring) for f, k in ((min, 0), (min, 1), (max, 0), (max, 1)))
    box, radius, folder = (south, west, north, east), build.settings.walk_radius_m, f"{build.geo.uri}/graph"
    if storage.exists(build.spark, f"{folder}/meta/_SUCCESS"):
        nodes, edges, meta = graph_files.load_graph(build.spark, folder)
        if graph_files.matches(meta, extract_fingerprint=build.source, bbox=box, padding_m=radius):
            return nodes, edges
    walkable = walkable_ways(features.ways(elements))
    nodes = storage.written(retained_nodes(features.nodes(elements), walkable, config.expand_bbox(box, radius)), "nodes")
    graph_files.save_graph(nodes, graph_edges(way_segments(walkable), nodes), folder, extract_fingerprint=build.source, bbox=box, bbox_padding_m=radius)
    return graph_files.load_graph(build.spark, folder)[:2]


def placed_cells(build: Build, metric: list, nodes: DataFrame) -> DataFrame:
    """Cells of all sizes at their nodes; each size is a table of its own, so that another size reuses them."""
    sizes = sorted(set(build.settings.grid_sizes_m))
    return reduce(DataFrame.unionByName, (build.score.kept(build.spark, f"cells_{s}", lambda s=s: scored_grid.snapped_cells(grid_cells(build.spark, s, metric), nodes)) for s in sizes))


def origins(build: Build, placed: DataFrame) -> DataFrame:
    """The distinct nodes of all cells, by the sizes they are of."""
    name = "origins_" + "_".join(str(s) for s in sorted(set(build.settings.grid_sizes_m)))
    return build.score.kept(build.spark, name, lambda: placed.select("node_id").where("node_id IS NOT NULL").distinct())


def bake(build: Build, archive: Path, island: list) -> dict:
    """The tile archive from the published rows; returns how many tiles are written and empty."""
    spark, own = build.spark, F.col("build_key") == build.hashes["build"]
    grid = spark.read.parquet(f"{build.published}/grid").where(own)
    found = spark.read.parquet(f"{build.published}/amenities").where(own)
    flat = publishing.flat_grid(grid).join(grid.select("cell_id", "minx", "miny", "maxx", "maxy"), "cell_id")
    corners = [IRISH_GRID.inverse(F.col(x), F.col(y)) for x in ("minx", "maxx") for y in ("miny", "maxy")]
    lons, lats = zip(*corners, strict=True)
    boxed = flat.withColumns({"west": F.least(*lons), "east": F.greatest(*lons), "south": F.least(*lats), "north": F.greatest(*lats)})
    zooms = config.TILE_ZOOMS
    made = storage.written(joined_tiles(grid_tiles(boxed, zooms), amenity_tiles(found, (config.AMENITY_ZOOM, zooms[1]))), "tiles")
    west, south, east, north = (f(p[k] for polygon in island for ring in polygon for p in ring) for f, k in ((min, 0), (min, 1), (max, 0), (max, 1)))
    archive.parent.mkdir(parents=True, exist_ok=True)
    write_archive(made, str(archive), zooms=zooms, box=(west, south, east, north))
    return tile_counters(tile_ranges(spark, zooms, (west, south, east, north)), made).first().asDict()


def run(spark: SparkSession, extract: str, boundary_paths: str | list[str], out: str, settings: config.ScoringConfig | None = None, *, force: bool = False, refresh_import: bool = True, archive_folder: str | None = None) -> dict:
    """Import, graph, scores, publish and tiles; returns the build's summary.

    A complete build of the same hashes is kept as it is, and if only its archive
    is missing, that is baked again from the published rows.  A run that was cut
    short goes on from the tables that its tiers hold; origins that have counts
    aren't searched again.  ``force`` makes all anew; ``refresh_import``: whether
    an import that isn't ready may run.
    """
    build = Build(spark, extract, [boundary_paths] if isinstance(boundary_paths, str) else list(boundary_paths), out, settings)
    archive, timings = build.archive(archive_folder), f"{out}/timings.json"
    progress = Progress(history_of(storage.read_text(spark, timings)))
    done = None if force else build.done()
    if done is not None and archive.exists():
        return done
    progress.start("geometry")
    island = boundary.load_island(spark, build.boundaries)
    if done is not None:
        return done | {"tiles": bake(build, archive, island)}
    metric, degrees = boundary.study_polygons(spark, build.settings.study_area, island)
    progress.start("import")
    elements = build.imported(allowed=refresh_import)
    progress.start("amenities")
    for tier in (build.geo, build.reach, build.score):
        tier.prepare("amenities", force=force)
    found = build.reach.kept(spark, "amenities", lambda: scored_grid.amenities(features.meeting(features.features(elements), degrees)))
    progress.start("networks")
    nodes, edges = make_graph(build, elements, degrees)
    build.geo.mark_complete("networks")
    progress.start("reachability")
    placed = placed_cells(build, metric, nodes)
    weights = build.reach.kept(spark, "weights", lambda: amenity_weights(nearest_nodes(found, nodes).where("node_id IS NOT NULL")))
    check_known(weights.select("node_id"), nodes, "amenities")
    counts = f"{build.reach.uri}/counts"
    add_missing(origins(build, placed), edges, nodes, weights, counts, build.settings.walk_radius_m)
    build.reach.mark_complete("reachability")
    progress.start("grids")
    scored = build.score.kept(spark, "scored", lambda: score_cells(placed, cached_counts(spark, counts).where("category IS NOT NULL"), build.settings.caps))
    build.score.mark_complete("grids")
    progress.start("publish")
    lon, lat = boundary.centroid(degrees)
    sizes = {str(r[0]): r[1] for r in scored.groupBy("resolution_m").count().collect()}
    totals = {r["category"]: r["n"] for r in publishing.amenity_counts(found).collect()}
    summary = {"build_key": build.hashes["build"], "config_hash": build.hashes["config"], "import_fingerprint": build.source, "extract_path": extract, "grid_sizes_m": sorted(build.settings.grid_sizes_m, reverse=True), "map_center": {"lat": lat, "lon": lon}, "walk_cell_counts": sizes, "amenity_counts": totals, "zoom_breaks": list(build.settings.zoom_breaks)}
    lineage = {"build_key": build.hashes["build"], "config_hash": build.hashes["config"], "import_fingerprint": build.source, "created_at": "now"}
    now = F.current_timestamp()
    publishing.publish(spark, build.published, {"build_key": build.hashes["build"], "extract_path": extract, "config_hash": build.hashes["config"], "import_fingerprint": build.source, "summary": json.dumps(summary)}, publishing.grid_rows(scored, **lineage).withColumn("created_at", now), publishing.amenity_rows(found, **lineage).withColumn("created_at", now))
    counted = bake(build, archive, degrees)
    storage.write_text(spark, timings, progress.timings())
    return summary | {"tiles": counted}


def parser() -> argparse.ArgumentParser:
    made = argparse.ArgumentParser(prog="strideframe.pipeline", description="Neighbourhood-access scores from an extract.")
    made.add_argument("out", help="folder of imports, caches, published tables and tiles")
    made.add_argument("--extract", help=".osm.pbf file")
    made.add_argument("--boundary", action="append", default=[], help="GeoJSON file; several are united")
    made.add_argument("--refresh-import", action="store_true", help="import the extract anew, without scores")
    made.add_argument("--precompute", action="store_true", help="compute and publish scores and tiles")
    made.add_argument("--force-precompute", action="store_true", help="also where a complete build exists")
    made.add_argument("--auto-refresh-import", action="store_true", help="let --precompute import what isn't ready")
    made.add_argument("--serve", "--render", action="store_true", help="serve the newest complete build; the default")
    made.add_argument("--static", default="static", help="folder of the page's files")
    made.add_argument("--host", default="127.0.0.1")
    made.add_argument("--port", type=int, default=8000)
    made.add_argument("--study-area", default="ireland", choices=["ireland", "m1_corridor"])
    made.add_argument("--grid-sizes", default=",".join(map(str, config.GRID_SIZES_M)))
    return made


def serve_build(spark: SparkSession, out: str, static: str, host: str, port: int):
    """A server of the newest complete build."""
    from strideframe.serve import make_server

    state = lambda: publishing.runtime_state(*(spark.read.parquet(f"{out}/published/{n}") for n in ("manifests", "grid", "amenities")))
    if not storage.exists(spark, f"{out}/published/manifests"):
        raise RuntimeError(f"{out} has no build")
    return make_server(state, Path(out) / "tiles" / f"{state()['build_key']}.pmtiles", Path(static), host=host, port=port)


def main(argv: list[str] | None = None) -> int:
    """The command line's run: 0, or 1 with a message where something needed is missing."""
    options = parser()
    given = options.parse_args(argv)
    for name in ("force_precompute", "auto_refresh_import"):
        if getattr(given, name) and not given.precompute:
            options.error(f"--{name.replace('_', '-')} requires --precompute")
    if (given.precompute or given.refresh_import) and not (given.extract and given.boundary):
        options.error("--precompute and --refresh-import require --extract and --boundary")
    spark = SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate()
    settings = config.ScoringConfig(study_area=given.study_area, grid_sizes_m=tuple(int(s) for s in given.grid_sizes.split(",")))
    try:
        if given.refresh_import:
            Build(spark, given.extract, given.boundary, given.out, settings).imported(force=True)
        if given.precompute:
            print(json.dumps(run(spark, given.extract, given.boundary, given.out, settings, force=given.force_precompute, refresh_import=given.auto_refresh_import), indent=1))
        if given.serve or not (given.precompute or given.refresh_import):
            serve_build(spark, given.out, given.static, given.host, given.port).serve_forever()
    except (RuntimeError, FileNotFoundError) as e:
        print(e, file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
