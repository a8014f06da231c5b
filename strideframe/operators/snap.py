"""Nearest-node join: a tree of the nodes in every task, or expanding bins."""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strideframe.config import EARTH_RADIUS_M
from strideframe.functions.geo import haversine_m
from strideframe.storage import written

_DEGREE_M = 111_194.0
_CANDIDATES = "array<struct<node_id: long, lat: double, lon: double>>"


class NodeTree:
    """Nodes in arrays, halved by the longer side down to groups of at most 16, with the box of each group at every third halving.

    A search is exact: it descends to one node first, whose distance bounds the
    others', then takes all boxes that aren't farther.  Distances are compared as
    haversines; a box's is its least, with gaps in latitude and longitude apart.
    """

    FAN = 8

    def __init__(self, ids: np.ndarray, lat: np.ndarray, lon: np.ndarray):
        order = np.lexsort((ids, lon, lat))
        first = np.ones(len(ids), bool)  # of nodes at one place the one of the smallest id counts
        first[1:] = (np.diff(lat[order]) != 0) | (np.diff(lon[order]) != 0)
        self.ids, self.lat, self.lon = (a[order[first]] for a in (ids, lat, lon))
        depth = 0
        while -(-len(self.ids) // self.FAN**depth) > 16:
            depth += 1
        leaf = -(-len(self.ids) // self.FAN**depth)
        at = np.arange(leaf * self.FAN**depth) * len(self.ids) // (leaf * self.FAN**depth)  # some twice, so that groups are equal
        for half in range(3 * depth):
            at = at.reshape(1 << half, -1)
            y, x = self.lat[at], self.lon[at]
            wide = np.ptp(x, axis=1) * np.cos(np.radians(y.mean(axis=1))) > np.ptp(y, axis=1)
            at = np.take_along_axis(at, np.argpartition(np.where(wide[:, None], x, y), at.shape[1] // 2, axis=1), axis=1)
        at = at.ravel()
        self.ids, self.lat, self.lon = self.ids[at], self.lat[at], self.lon[at]
        y, x = np.radians(self.lat), np.radians(_turned(self.lon))
        self.levels = []
        for level in range(1, depth + 1):
            ys, xs = y.reshape(self.FAN**level, -1), x.reshape(self.FAN**level, -1)
            south, north = ys.min(axis=1), ys.max(axis=1)
            self.levels.append((self.FAN, south, north, xs.min(axis=1), xs.max(axis=1), np.minimum(np.cos(south), np.cos(north))))
        self.levels.append((leaf, y, y, x, x, np.cos(y)))

    @staticmethod
    def _least(level: tuple, at: np.ndarray, y: np.ndarray, x: np.ndarray, shrink: np.ndarray) -> np.ndarray:
        """The least haversine between points and boxes, also around the back of the globe."""
        _, south, north, west, east, least = level
        w, e = west[at], east[at]
        up = np.maximum(np.maximum(south[at] - y, y - north[at]), 0.0)
        aside = np.maximum(np.minimum(np.maximum(w - x, x - e), 2 * np.pi - np.maximum(x - w, e - x)), 0.0)
        return np.sin(up / 2) ** 2 + shrink * least[at] * np.sin(aside / 2) ** 2

    @staticmethod
    def _farther(h: np.ndarray) -> np.ndarray:
        """The haversine of a distance five micrometres longer."""
        return np.sin(np.minimum(np.arcsin(np.sqrt(np.minimum(h, 1.0))) + 2.5e-6 / EARTH_RADIUS_M, np.pi / 2)) ** 2

    def nearest(self, lat: np.ndarray, lon: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row numbers, ascending, and nodes' positions: for each point all nodes up to five micrometres farther than the nearest."""
        y, x = np.radians(lat), np.radians(_turned(lon))
        shrink, rows = np.cos(y), np.arange(len(y))
        at = np.zeros(len(y), int)
        for level in self.levels:
            kids = at[:, None] * level[0] + np.arange(level[0])
            low = self._least(level, kids, y[:, None], x[:, None], shrink[:, None])
            pick = low.argmin(axis=1)
            at, low = kids[rows, pick], low[rows, pick]
        limit, row, at = self._farther(low), rows, np.zeros(len(y), int)
        for level in self.levels:
            row, at = np.repeat(row, level[0]), (at[:, None] * level[0] + np.arange(level[0])).ravel()
            low = self._least(level, at, y[row], x[row], shrink[row])
            kept = low <= limit[row]
            row, at, low = row[kept], at[kept], low[kept]
        best = np.minimum.reduceat(low, np.searchsorted(row, rows)) if len(rows) else low
        kept = low <= self._farther(best)[row]
        return row[kept], at[kept]


def _turned(lon: np.ndarray) -> np.ndarray:
    """Longitudes from -180 to 180."""
    return lon if not len(lon) or np.abs(lon).max() <= 180 else (lon + 180) % 360 - 180


def nearest_nodes(points: DataFrame, nodes: DataFrame, *, start_m: float | None = None, local_nodes: int = 2_000_000) -> DataFrame:
    """``points`` (lat, lon and any columns) with ``node_id`` and ``distance_m`` of the nearest node, however far; ties, to a micrometre, go to the smaller id.  A point without a position stays, with nulls.

    Up to ``local_nodes`` nodes (130 MB as a tree) every task gets their tree, and
    points stay where they are: nothing is shuffled or written, however far the
    points lie.  Beyond that, or from bins of a given width, see ``nearest_by_bins``.
    """
    if nodes.isEmpty():
        raise ValueError("the graph has no node")
    if start_m or nodes.limit(local_nodes + 1).count() > local_nodes:
        return nearest_by_bins(points, nodes, start_m=start_m)
    return nearest_by_tree(points, nodes)


def nearest_by_tree(points: DataFrame, nodes: DataFrame) -> DataFrame:
    """The same with a broadcast tree.  Python names the nodes that may be nearest, nearly always one; their distances are Spark's."""
    position = lambda name: F.col(name).cast("double")
    table = nodes.select("node_id", position("lat").alias("lat"), position("lon").alias("lon")).where("lat IS NOT NULL AND lon IS NOT NULL AND NOT isnan(lat) AND NOT isnan(lon)").toArrow()
    if not table.num_rows:
        raise ValueError("the graph has no node with a position")
    sent = nodes.sparkSession.sparkContext.broadcast(NodeTree(*(table[c].to_numpy() for c in ("node_id", "lat", "lon"))))

    @F.arrow_udf(_CANDIDATES)
    def candidates(lat: pa.Array, lon: pa.Array) -> pa.Array:
        tree = sent.value
        ys, xs = (a.to_numpy(zero_copy_only=False).astype(float) for a in (lat, lon))  # nulls are NaN
        whole = np.flatnonzero(np.isfinite(ys) & np.isfinite(xs))
        found = [(whole[i + row], at) for i in range(0, len(whole), 4096) for row, at in [tree.nearest(ys[whole[i : i + 4096]], xs[whole[i : i + 4096]])]]
        row, at = (np.concatenate([np.empty(0, int), *parts]) for parts in (zip(*found, strict=True) if found else ((), ())))
        ends = np.concatenate(([0], np.cumsum(np.bincount(row, minlength=len(ys))))).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays([pa.array(a[at]) for a in (tree.ids, tree.lat, tree.lon)], ["node_id", "lat", "lon"]))

    near = points.withColumn("__near", candidates(position("lat"), position("lon")))
    judged = F.transform("__near", lambda n: F.struct(F.round(haversine_m(position("lat"), position("lon"), n["lat"], n["lon"]), 6).alias("distance_m"), n["node_id"].alias("node_id")))
    return near.withColumn("__near", F.array_min(judged)).select(*(F.col(c) for c in points.columns), "__near.node_id", "__near.distance_m")


def nearest_by_bins(points: DataFrame, nodes: DataFrame, *, start_m: float | None = None) -> DataFrame:
    """The same without a broadcast.

    Points and nodes meet in an equi-join on bins: each point looks into the 3 x 3
    bins around it and its best is final if it lies within one bin's width, as
    no node outside can be nearer.  The others go on with bins four times as
    wide, until a bin spans everything.
    """
    north, south, east, west, count = nodes.select(F.max("lat"), F.min("lat"), F.max("lon"), F.min("lon"), F.count("*")).first()
    p_north, p_south, p_east, p_west = points.select(F.max("lat"), F.min("lat"), F.max("lon"), F.min("lon")).first()
    placed = F.col("lat").isNotNull() & F.col("lon").isNotNull()
    nowhere = points.where(~placed).withColumns({"node_id": F.lit(None).cast("long"), "distance_m": F.lit(None).cast("double")})
    if p_north is None or p_east is None:
        return nowhere
    kept = points.where(placed).withColumn("__point", F.monotonically_increasing_id())
    high, low = max(north, p_north), min(south, p_south)
    shrink = max(0.01, math.cos(math.radians(max(abs(high), abs(low)))))
    extent = max(1.0, (high - low) * _DEGREE_M, (max(east, p_east) - min(west, p_west)) * _DEGREE_M)
    width = start_m or max(1.0, math.sqrt(max(1.0, (north - south) * _DEGREE_M) * max(1.0, (east - west) * _DEGREE_M * shrink) / count) * 2)
    todo, done = written(kept, "snap"), [nowhere]
    node = written(nodes.select(F.col("node_id").alias("__node"), F.col("lat").cast("double").alias("__lat"), F.col("lon").cast("double").alias("__lon")), "nodes")
    while True:
        by, bx = width / _DEGREE_M, width / _DEGREE_M / shrink
        bins = lambda lat, lon: (F.floor((lat - low) / by).cast("long"), F.floor((lon - min(west, p_west)) / bx).cast("long"))  # noqa: E731, B023
        ny, nx = bins(F.col("__lat"), F.col("__lon"))
        py, px = bins(F.col("lat").cast("double"), F.col("lon").cast("double"))
        around = F.array(F.lit(-1), F.lit(0), F.lit(1))
        looked = todo.select("__point", F.col("lat").cast("double").alias("__plat"), F.col("lon").cast("double").alias("__plon"), py.alias("__y"), px.alias("__x"))
        looked = looked.withColumn("__dy", F.explode(around)).withColumn("__dx", F.explode(around)).select("__point", "__plat", "__plon", (F.col("__y") + F.col("__dy")).alias("__y"), (F.col("__x") + F.col("__dx")).alias("__x"))
        met = looked.join(node.withColumns({"__y": ny, "__x": nx}), ["__y", "__x"])
        far = F.round(haversine_m(F.col("__plat"), F.col("__plon"), F.col("__lat"), F.col("__lon")), 6)
        best = met.groupBy("__point").agg(F.min(F.struct(far.alias("distance_m"), F.col("__node").alias("node_id"))).alias("__best"))
        last = width > extent * 2
        final = best if last else best.where(F.col("__best.distance_m") <= width * 0.99)
        final = written(final.select("__point", "__best.node_id", "__best.distance_m"), "snapped")
        done.append(todo.join(final, "__point").drop("__point"))
        todo = todo.join(final.select("__point"), "__point", "left_anti")
        if last or todo.isEmpty():
            return reduce(DataFrame.unionByName, done)
        todo, width = written(todo, "snap"), width * 4
