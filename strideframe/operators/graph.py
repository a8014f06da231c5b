"""The walking graph: segments of ways, retained nodes, edges and their statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strideframe.functions.geo import haversine_m, in_box
from strideframe.functions.scoring import is_walkable
from strideframe.storage import written


def walkable_ways(ways: DataFrame) -> DataFrame:
    """Ways (way_id, tags, refs) that can be walked and have two nodes at least."""
    return ways.where(is_walkable(F.col("tags")) & (F.size("refs") >= 2))


def way_segments(ways: DataFrame) -> DataFrame:
    """way_id, src, dst: neighbours in each way's node list, in both directions; repeats stay.  No shuffle."""
    n = F.size("refs") - 1
    pairs = F.arrays_zip(F.slice("refs", 1, n).alias("a"), F.slice("refs", 2, n).alias("b"))
    both = F.explode(F.flatten(F.transform(pairs, lambda p: F.array(F.struct(p["a"].alias("src"), p["b"].alias("dst")), F.struct(p["b"].alias("src"), p["a"].alias("dst"))))))
    return ways.select("way_id", both.alias("s")).select("way_id", "s.src", "s.dst")


def retained_nodes(nodes: DataFrame, ways: DataFrame, box: tuple[float, float, float, float] | None = None) -> DataFrame:
    """Nodes that a way refers to, inside the box."""
    if box:
        nodes = nodes.where(in_box(F.col("lat").cast("double"), F.col("lon").cast("double"), box))
    return nodes.join(ways.select(F.explode("refs").alias("node_id")).distinct(), "node_id", "left_semi")


def measured_segments(segments: DataFrame, nodes: DataFrame, *, local_nodes: int = 2_000_000) -> DataFrame:
    """src, dst, length_m (single precision; null where an end is missing): positions are single precision before the length is computed.

    Up to ``local_nodes`` nodes (150 MB as a table of hashes) are broadcast, and segments aren't shuffled.
    """
    place = nodes.select("node_id", *(F.col(c).cast("float").cast("double").alias(c) for c in ("lat", "lon")))
    if nodes.limit(local_nodes + 1).count() <= local_nodes:
        place = F.broadcast(place)
    end = lambda name: place.select(F.col("node_id").alias(name), *(F.col(c).alias(f"{name}_{c}") for c in ("lat", "lon")))
    both = segments.select("src", "dst").join(end("src"), "src", "left").join(end("dst"), "dst", "left")
    return both.select("src", "dst", haversine_m(*(F.col(f"{e}_{c}") for e in ("src", "dst") for c in ("lat", "lon"))).cast("float").alias("length_m"))


def graph_edges(segments: DataFrame, nodes: DataFrame) -> DataFrame:
    """Directed edges: both ends known, and a finite length above 0."""
    length = F.col("length_m")
    return measured_segments(segments, nodes).where(length.isNotNull() & ~F.isnan(length) & (length > 0) & (length < float("inf")))


def edge_stats(segments: DataFrame, nodes: DataFrame) -> DataFrame:
    """One row: edges_emitted, skipped_missing_nodes, skipped_zero_length."""
    length = F.col("length_m")
    good = length.isNotNull() & ~F.isnan(length) & (length > 0) & (length < float("inf"))
    count = lambda c, name: F.count_if(c).alias(name)
    return measured_segments(segments, nodes).agg(count(good, "edges_emitted"), count(length.isNull(), "skipped_missing_nodes"), count(length.isNotNull() & ~good, "skipped_zero_length"))


def degree_offsets(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """node_id, degree and offset, the degrees' sum over all smaller ids.  Ranges of ids are summed apart; only a row a range goes through a window over all."""
    degrees = nodes.select("node_id").join(edges.groupBy(F.col("src").alias("node_id")).count(), "node_id", "left").select("node_id", F.coalesce("count", F.lit(0)).alias("degree"))
    parts = written(degrees.repartitionByRange("node_id").withColumn("part", F.spark_partition_id()), "degrees")
    before = lambda w: F.coalesce(F.sum("degree").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = parts.groupBy("part").agg(F.sum("degree").alias("degree")).select("part", before(Window.orderBy("part")).alias("start"))
    own = before(Window.partitionBy("part").orderBy("node_id"))
    return parts.withColumn("own", own).join(F.broadcast(starts), "part").select("node_id", "degree", (F.col("start") + F.col("own")).alias("offset"))


def graph_size(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: node_count, edge_count."""
    both = nodes.select(F.lit(1).alias("n"), F.lit(0).alias("e")).unionByName(edges.select(F.lit(0).alias("n"), F.lit(1).alias("e")))
    return both.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("node_count"), F.coalesce(F.sum("e"), F.lit(0)).alias("edge_count"))
