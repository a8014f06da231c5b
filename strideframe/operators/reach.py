"""Bounded reachability: nodes within a walking distance of origins, and what they hold.

Three forms with equal results.  ``reach_tiles`` is the one for large graphs: the
plane is cut into tiles, edges are copied to every tile within the walking
distance of their start, and each tile searches its own origins; a task holds a
tile.  ``reach_local`` ships the adjacency to every task and is taken only where
the graph is small (a checked bound).  ``reach_rounds`` is declarative: rounds
of join and minimum until nothing improves.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strideframe.storage import written

REACH = "origin long, node_id long, distance_m double"


class Adjacency:
    """Compressed rows of a directed graph, in arrays: nodes by number, and each row's targets and lengths."""

    def __init__(self, src: np.ndarray, dst: np.ndarray, length: np.ndarray):
        self.ids = np.unique(np.concatenate((src, dst)).astype(np.int64))
        start = np.searchsorted(self.ids, src)
        order = np.argsort(start, kind="stable")
        self.offsets = np.concatenate(([0], np.cumsum(np.bincount(start, minlength=len(self.ids)))))
        self.dst, self.length = np.searchsorted(self.ids, dst)[order].astype(np.int32), length[order].astype(np.float64)

    def within(self, origin: int, cutoff: float) -> dict[int, float]:
        """Distances of all nodes up to ``cutoff`` (inclusive), the origin at 0."""
        first = int(np.searchsorted(self.ids, origin))
        if first == len(self.ids) or self.ids[first] != origin:
            return {origin: 0.0}
        best, settled, heap = {first: 0.0}, {}, [(0.0, first)]
        while heap:
            d, node = heapq.heappop(heap)
            if node in settled:
                continue
            settled[node] = d
            row = slice(self.offsets[node], self.offsets[node + 1])
            for there, hop in zip(self.dst[row].tolist(), self.length[row].tolist(), strict=True):
                far = d + hop
                if far <= cutoff and far < best.get(there, np.inf):
                    best[there] = far
                    heapq.heappush(heap, (far, there))
        return dict(zip(self.ids[list(settled)].tolist(), settled.values(), strict=True))


def _found(adjacency: Adjacency, origins: list[int], cutoff: float) -> pd.DataFrame:
    parts = [(o, found) for o in origins for found in [adjacency.within(o, cutoff)]]
    frame = {"origin": np.repeat(np.array([o for o, _ in parts], np.int64), [len(f) for _, f in parts]), "node_id": np.fromiter((n for _, f in parts for n in f), np.int64), "distance_m": np.fromiter((d for _, f in parts for d in f.values()), np.float64)}
    return pd.DataFrame(frame)


def reach_local(origins: DataFrame, edges: DataFrame, cutoff: float) -> DataFrame:
    """Collects the edges up to ``cutoff`` long and broadcasts them: for graphs of a checked size."""
    table = edges.where(F.col("length_m") <= cutoff).select("src", "dst", "length_m").toArrow()  # no row is a Python object in the driver
    sent = origins.sparkSession.sparkContext.broadcast(Adjacency(*(table[c].to_numpy() for c in ("src", "dst", "length_m"))))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for i in range(0, len(frame), 256):
                yield _found(sent.value, frame["origin"].iloc[i : i + 256].tolist(), cutoff)

    return origins.select(F.col("node_id").alias("origin")).repartition("origin").mapInPandas(run, REACH)


def reach_tiles(origins: DataFrame, edges: DataFrame, nodes: DataFrame, cutoff: float, *, tile_m: float | None = None, most: int = 2048) -> DataFrame:
    """Each tile of ``tile_m`` searches its origins over the edges that start within ``cutoff`` of it; a path can't leave that margin, as an edge is never shorter than the way as the crow flies.  A tile of more than ``most`` origins is several tasks' work, so a dense one is neither a long task nor a large result."""
    tile_m = tile_m or 4 * cutoff
    high = nodes.agg(F.max(F.abs("lat"))).first()[0] or 0.0
    dy = tile_m / 111_000.0
    dx = dy / max(0.01, float(np.cos(np.radians(float(high)))))
    margin = (cutoff + 1.0) / tile_m * 1.01
    place = nodes.select("node_id", (F.col("lat").cast("double") / dy).alias("y"), (F.col("lon").cast("double") / dx).alias("x"))
    own = origins.select("node_id").join(place, "node_id").select(F.col("node_id").alias("origin"), F.floor("y").alias("ty"), F.floor("x").alias("tx"))
    span = lambda c: F.explode(F.sequence(F.floor(F.col(c) - margin), F.floor(F.col(c) + margin)))
    near = edges.where(F.col("length_m") <= cutoff).join(place, edges["src"] == place["node_id"]).select("src", "dst", "length_m", "x", span("y").alias("ty")).select("src", "dst", "length_m", "ty", span("x").alias("tx"))

    def search(here: pd.DataFrame, graph: pd.DataFrame) -> pd.DataFrame:
        return _found(Adjacency(*(graph[c].to_numpy() for c in ("src", "dst", "length_m"))), here["origin"].tolist(), cutoff)

    own = written(own, "origins")
    shares = own.groupBy("ty", "tx").agg(F.ceil(F.count("*") / F.lit(most)).cast("int").alias("shares"))
    dealt = own.join(shares, ["ty", "tx"]).select("ty", "tx", F.pmod(F.xxhash64("origin"), F.col("shares")).cast("int").alias("share"), "origin")
    copied = near.join(shares, ["ty", "tx"]).select("ty", "tx", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)).alias("share"), "src", "dst", "length_m")
    found = dealt.groupBy("ty", "tx", "share").cogroup(copied.groupBy("ty", "tx", "share")).applyInPandas(search, REACH)
    lost = origins.select("node_id").join(place, "node_id", "left_anti")  # origins without a position reach themselves
    return found.unionByName(lost.select(F.col("node_id").alias("origin"), "node_id", F.lit(0.0).alias("distance_m")))


def reach_rounds(origins: DataFrame, edges: DataFrame, cutoff: float) -> DataFrame:
    """Rounds of join and minimum; parallel edges collapse first, and each round is written to the shared folder."""
    hops = written(edges.where(F.col("length_m") <= cutoff).groupBy("src", "dst").agg(F.min(F.col("length_m").cast("double")).alias("hop")), "hops")
    best = written(origins.select(F.col("node_id").alias("origin"), F.col("node_id").alias("node_id"), F.lit(0.0).alias("distance_m")), "reach")
    front = best
    while not front.isEmpty():
        at = front.toDF("o", "here", "so_far")
        step = at.join(hops, at["here"] == hops["src"]).select("o", F.col("dst").alias("there"), (F.col("so_far") + F.col("hop")).alias("far")).where(F.col("far") <= cutoff)
        step = step.groupBy("o", "there").agg(F.min("far").alias("far"))
        known = best.toDF("ko", "kn", "kd")
        front = written(step.join(known, (step["o"] == known["ko"]) & (step["there"] == known["kn"]), "left").where(F.col("kd").isNull() | (F.col("far") < F.col("kd"))).select(F.col("o").alias("origin"), F.col("there").alias("node_id"), F.col("far").alias("distance_m")), "front")
        best = written(best.unionByName(front).groupBy("origin", "node_id").agg(F.min("distance_m").alias("distance_m")), "reach")
    return best


def reach(origins: DataFrame, edges: DataFrame, nodes: DataFrame, cutoff: float, *, local_edges: int = 2_000_000) -> DataFrame:
    """``reach_local`` up to ``local_edges`` edges (40 MB as arrays), else ``reach_tiles``.  Origins: distinct ids that aren't null."""
    origins = origins.where("node_id is not null").select("node_id").distinct()
    edges = written(edges.where(F.col("length_m") <= cutoff).select("src", "dst", "length_m"), "edges")
    if edges.limit(local_edges + 1).count() <= local_edges:
        return reach_local(origins, edges, cutoff)
    return reach_tiles(origins, edges, nodes, cutoff)


def check_known(ids: DataFrame, nodes: DataFrame, what: str) -> None:
    """Raises where an id isn't a node's."""
    if (lost := ids.join(nodes, "node_id", "left_anti").first()) is not None:
        raise ValueError(f"{what}: node {lost['node_id']} is not in the graph")


def checked_weights(records: DataFrame, nodes: DataFrame) -> DataFrame:
    """Weights (node_id, category, n) from elsewhere; raises where a node isn't the graph's or a count isn't positive."""
    check_known(records.select("node_id"), nodes, "weights")
    if (odd := records.where("n IS NULL OR n <= 0 OR category IS NULL").first()) is not None:
        raise ValueError(f"weights: node {odd['node_id']} has {odd['n']} of {odd['category']}")
    return records.groupBy("node_id", "category").agg(F.sum("n").cast("long").alias("n"))


def amenity_weights(snapped: DataFrame) -> DataFrame:
    """node_id, category, n: amenities at each node; each counts, also at one place."""
    return snapped.groupBy("node_id", "category").agg(F.count("*").alias("n"))


def reach_counts(reached: DataFrame, weights: DataFrame) -> DataFrame:
    """origin, category, n over the reached nodes; categories without any are left out."""
    return reached.join(weights, "node_id").groupBy("origin", "category").agg(F.sum("n").alias("n"))


def missing_origins(wanted: DataFrame, cached: DataFrame) -> DataFrame:
    """Wanted origins (distinct, not null) whose counts aren't cached yet."""
    return wanted.where("node_id is not null").select("node_id").distinct().join(cached.select(F.col("origin").alias("node_id")).distinct(), "node_id", "left_anti")


def merge_counts(cached: DataFrame, new: DataFrame) -> DataFrame:
    """All counts; where an origin is in both, the new ones count."""
    return new.unionByName(cached.join(new.select("origin").distinct(), "origin", "left_anti"))
