"""The engine's pipeline: from features and ways to scored cells, as one composed plan."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strideframe.config import CAPS
from strideframe.functions.geo import IRISH_GRID
from strideframe.functions.scoring import feature_category
from strideframe.operators.graph import graph_edges, walkable_ways, way_segments
from strideframe.operators.grid import rect_cells, rect_places, score_cells
from strideframe.operators.reach import amenity_weights, reach, reach_counts
from strideframe.operators.snap import nearest_nodes
from strideframe.storage import written


def amenities(features: DataFrame, study_filter=None) -> DataFrame:
    """Categorised features in the study area (a column expression), with ``source_ref``."""
    found = features.withColumn("category", feature_category(F.col("tags"))).where("category IS NOT NULL")
    if study_filter is not None:
        found = found.where(study_filter)
    return found.select("osm_type", "osm_id", "category", "lat", "lon", F.concat_ws("/", "osm_type", F.col("osm_id").cast("string")).alias("source_ref"))


def metric_box(nodes: DataFrame) -> tuple[float, float, float, float]:
    """The nodes' bounds in the metric grid, to the millimetre."""
    x, y = IRISH_GRID.forward(F.col("lon").cast("double"), F.col("lat").cast("double"))
    return tuple(nodes.select(x.alias("x"), y.alias("y")).agg(*(F.round(f(c), 3) for f, c in ((F.min, "x"), (F.min, "y"), (F.max, "x"), (F.max, "y")))).first())


def with_positions(cells: DataFrame) -> DataFrame:
    """Cells with the latitude and longitude of their anchors."""
    lon, lat = IRISH_GRID.inverse(F.col("x"), F.col("y"))
    return cells.withColumns({"lat": lat, "lon": lon})


def snapped_cells(cells: DataFrame, nodes: DataFrame) -> DataFrame:
    return nearest_nodes(with_positions(cells), nodes)


def scored_grid(nodes: DataFrame, ways: DataFrame, features: DataFrame, sizes: tuple[int, ...], *, cutoff: float = 500.0, caps: dict[str, int] = CAPS) -> DataFrame:
    """Scored cells of all grid sizes over the nodes' bounds.  Origins are the distinct nodes of all sizes, so each is searched once.

    Between the search of the nearest node and the scores a cell is its size, column, row and node; its other columns are made last.
    """
    nodes = written(nodes.select("node_id", "lat", "lon"), "nodes")
    box = metric_box(nodes)
    places = reduce(DataFrame.unionByName, (rect_places(nodes.sparkSession, size, box) for size in sizes))
    points = with_positions(rect_cells(places, box)).select("resolution_m", "i", "j", "lat", "lon")
    placed = written(nearest_nodes(points, nodes).select("resolution_m", "i", "j", "node_id"), "cells")
    edges = graph_edges(way_segments(walkable_ways(ways)), nodes)
    weights = amenity_weights(nearest_nodes(amenities(features), nodes))
    counts = reach_counts(reach(placed.select("node_id"), edges, nodes, cutoff), weights)
    return with_positions(rect_cells(score_cells(placed, counts, caps), box)).drop("i", "j")
