"""Metric grids over a study area, clipping, and scores of cells.

A study area is a list of polygons; a polygon is a list of rings of (x, y), the
first the outer one, closed or not.  Being inside any polygon is being inside.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strideframe import config
from strideframe.config import CAPS, CATEGORIES
from strideframe.functions.geo import cell_id
from strideframe.functions.scoring import scores
from strideframe.operators.polygon import clip_polygon, clip_rings, crossing, interior_point, polygon_area, side_array
from strideframe.storage import written


def rectangle(minx: float, miny: float, maxx: float, maxy: float) -> list:
    return [[[(minx, miny), (maxx, miny), (maxx, maxy), (minx, maxy)]]]


def area_bounds(area: list) -> tuple[float, float, float, float]:
    xs, ys = zip(*(p for polygon in area for ring in polygon for p in ring), strict=True)
    return min(xs), min(ys), max(xs), max(ys)


class RowGrid:
    """The cells of a row of a grid over an area; outlines are arrays, and a row looks at the sides that pass it only."""

    def __init__(self, area: list, size: float, keep: str, clip: bool):
        self.area, self.size, self.keep, self.clip = area, float(size), keep, clip
        self.minx, self.miny, self.maxx, self.maxy = area_bounds(area)
        self.nx, self.ny = (max(0, -int(-(b - a) // size)) for a, b in ((self.minx, self.maxx), (self.miny, self.maxy)))
        self.sides = [side_array([polygon]) for polygon in area]

    def _columns(self, edges: np.ndarray, low: float, high: float) -> np.ndarray:
        """Columns that a side in the strip may touch."""
        x1, y1, x2, y2 = edges.T
        flat = y1 == y2
        with np.errstate(divide="ignore", invalid="ignore"):
            at = [np.where(flat, np.where(k, x2, x1), x1 + (x2 - x1) * np.clip((y - y1) / (y2 - y1), 0, 1)) for k, y in enumerate((low, high))]
        first, last = (np.clip(np.floor((f(*at) - self.minx) / self.size).astype(int) + d, 0, self.nx - 1) for f, d in ((np.minimum, -1), (np.maximum, 1)))
        edge = np.zeros(self.nx + 1, int)
        np.add.at(edge, first, 1)
        np.add.at(edge, last + 1, -1)
        return np.flatnonzero(np.cumsum(edge)[:-1] > 0)

    def row(self, j: int) -> list[tuple]:
        low = self.miny + j * self.size
        high, middle = low + self.size, low + self.size / 2
        left = self.minx + np.arange(self.nx) * self.size
        full, touched = np.zeros(self.nx, bool), np.zeros(self.nx, bool)
        meets: list[tuple[int, np.ndarray]] = []
        for p, edges in enumerate(self.sides):
            here = edges[(np.maximum(edges[:, 1], edges[:, 3]) >= low) & (np.minimum(edges[:, 1], edges[:, 3]) <= high)]
            if not len(here):
                continue
            own = np.zeros(self.nx, bool)
            for c in self._columns(here, low, high):
                own[c] = crossing(here, (left[c], low, left[c] + self.size, high)).any()
            x1, y1, x2, y2 = here[(here[:, 1] > middle) != (here[:, 3] > middle)].T
            cuts = np.sort((x2 - x1) * (middle - y1) / (y2 - y1) + x1)
            inside = (len(cuts) - np.searchsorted(cuts, left + self.size / 2, side="right")) % 2 == 1
            full |= inside & ~own
            touched |= own
            meets.append((p, own))
        strips: dict[int, list | None] = {}
        out = []
        for c in np.flatnonzero(full if self.keep == "within" else full | touched).tolist():
            a, b = float(left[c]), float(left[c]) + self.size
            x, y, share = (a + b) / 2, middle, 1.0
            if not full[c] and self.clip:
                pieces = []
                for p, own in meets:
                    if own[c]:
                        if p not in strips:
                            strips[p] = clip_polygon(self.area[p], [(self.minx, low), (self.maxx, low), (self.maxx, high), (self.minx, high)])
                        if strips[p] and (piece := clip_polygon(strips[p], [(a, low), (b, low), (b, high), (a, high)])):
                            pieces.append(piece)
                if not pieces:
                    continue
                share = min(1.0, sum(map(polygon_area, pieces)) / self.size**2)
                best = max(pieces, key=polygon_area)
                x, y = interior_point(best[0], best[1:])
            out.append((a, low, b, high, bool(not full[c] and self.clip), x, y, share))
        return out


def grid_cells(spark: SparkSession, size: float, area: list, *, keep: str = "intersects", clip: bool = True) -> DataFrame:
    """cell_id, resolution_m, bounds, clip_required and the anchor's x, y of the cells that meet the area (``intersects``) or lie in it (``within``).

    Rows of cells are cut into tasks.  A cell is whole if it lies in one of the
    polygons; its part of the area and its anchor leave holes out.
    """
    if keep not in ("intersects", "within"):
        raise ValueError(f"keep: {keep!r}")
    grid = RowGrid(area, size, keep, clip)

    def judge(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for j in frame["id"].tolist():
                yield pd.DataFrame(grid.row(j), columns=["minx", "miny", "maxx", "maxy", "clip_required", "x", "y", "share"]).astype({"clip_required": bool, **{k: float for k in ("minx", "miny", "maxx", "maxy", "x", "y", "share")}})

    kept = spark.range(grid.ny).mapInPandas(judge, "minx double, miny double, maxx double, maxy double, clip_required boolean, x double, y double, share double")
    return kept.select(cell_id(F.lit(int(size)), F.col("minx"), F.col("miny")).alias("cell_id"), F.lit(int(size)).alias("resolution_m"), "minx", "miny", "maxx", "maxy", "clip_required", "x", "y", "share")


def with_geometry(cells: DataFrame, area: list) -> DataFrame:
    """``cells`` with ``geometry``, polygons of rings of points: one that is there stays, a cell that needs clipping (null counts as yes) gets its part of the area, others their box.

    Only cells that need clipping reach Python; one that has no part of the area raises an error with its id.
    """
    ring = lambda *xy: F.array(*(F.array(F.col(x), F.col(y)) for x, y in xy))
    box = F.array(F.array(ring(("minx", "miny"), ("maxx", "miny"), ("maxx", "maxy"), ("minx", "maxy"))))

    @F.pandas_udf("array<array<array<array<double>>>>")
    def clipped(cell: pd.Series, minx: pd.Series, miny: pd.Series, maxx: pd.Series, maxy: pd.Series) -> pd.Series:
        out = []
        for name, *bounds in zip(cell, minx, miny, maxx, maxy, strict=True):
            found = clip_rings(area, tuple(bounds))
            if not found:
                raise ValueError(f"cell {name} has no part of the area")
            out.append([[[list(p) for p in r] for r in polygon] for polygon in found])
        return pd.Series(out)

    known = F.col("geometry") if "geometry" in cells.columns else F.lit(None).cast("array<array<array<array<double>>>>")
    needs = known.isNull() & F.coalesce(F.col("clip_required"), F.lit(True))
    cut = cells.where(needs).withColumn("geometry", clipped("cell_id", "minx", "miny", "maxx", "maxy"))
    return cut.unionByName(cells.where(~needs).withColumn("geometry", F.coalesce(known, box)))


def rect_places(spark: SparkSession, size: int, box: tuple[float, float, float, float]) -> DataFrame:
    """resolution_m and the column i and row j of all cells over a rectangle: what a cell needs to be stored as, see ``rect_cells``."""
    minx, miny, maxx, maxy = box
    nx, ny = (max(1, -int(-(b - a) // size)) for a, b in ((minx, maxx), (miny, maxy)))
    return spark.range(nx * ny).select(F.lit(size).alias("resolution_m"), (F.col("id") % F.lit(nx)).alias("i"), F.floor(F.col("id") / F.lit(nx)).alias("j"))


def rect_cells(places: DataFrame, box: tuple[float, float, float, float]) -> DataFrame:
    """The cells of ``rect_places`` with the columns of ``grid_cells`` but the share, and all of ``places``: cells at the far sides are clipped, anchors are the clipped cells' centres."""
    minx, miny, maxx, maxy = box
    size, others = F.col("resolution_m").cast("double"), [c for c in places.columns if c != "resolution_m"]
    cells = places.select("resolution_m", (F.lit(minx) + F.col("i") * size).alias("minx"), (F.lit(miny) + F.col("j") * size).alias("miny"), *others)
    right, top = F.least(F.col("minx") + size, F.lit(maxx)), F.least(F.col("miny") + size, F.lit(maxy))
    clipped = (F.col("minx") + size > maxx) | (F.col("miny") + size > maxy)
    return cells.select(cell_id(F.col("resolution_m"), F.col("minx"), F.col("miny")).alias("cell_id"), "resolution_m", "minx", "miny", (F.col("minx") + size).alias("maxx"), (F.col("miny") + size).alias("maxy"), clipped.alias("clip_required"), ((F.col("minx") + right) / 2).alias("x"), ((F.col("miny") + top) / 2).alias("y"), *others)


def grid_cells_rect(spark: SparkSession, size: int, box: tuple[float, float, float, float]) -> DataFrame:
    """The cells of a rectangle (minx, miny, maxx, maxy), in expressions alone."""
    return rect_cells(rect_places(spark, size, box), box).drop("i", "j")


def category_order(found: list[str], configured: tuple[str, ...] = CATEGORIES) -> list[str]:
    """Configured categories in their order, then others by name."""
    return [*configured, *sorted(set(found) - set(configured))]


def pivot_counts(counts: DataFrame, key: str, *, others: list[str] = ()) -> DataFrame:
    """One row a key with ``count_<category>`` of all configured categories, then of the ``others`` that are named, 0 where there is none."""
    names = category_order(list(others))
    wide = counts.groupBy(key).pivot("category", names).agg(F.sum("n"))
    return wide.select(key, *(F.coalesce(F.col(config.quoted(c)), F.lit(0)).cast("long").alias(f"count_{c}") for c in names))


def score_rows(rows: DataFrame, caps: dict[str, int] = CAPS) -> DataFrame:
    """``rows`` with ``score_<category>`` and ``total_score`` from ``count_<category>``."""
    made: dict[str, Column] = scores({c: F.col(f"count_{c}") for c in caps}, caps)
    return rows.select("*", *(v.alias(k) for k, v in made.items()))


def score_cells(cells: DataFrame, counts: DataFrame, caps: dict[str, int] = CAPS, *, local_nodes: int = 500_000) -> DataFrame:
    """Cells (with node_id) and the counts and scores of their nodes; nodes are scored once each, and a node without counts gives zeros.

    The scores of up to ``local_nodes`` nodes (60 MB) are broadcast, so that cells stay where they are.
    """
    scored = written(score_rows(pivot_counts(counts, "origin"), caps).withColumnRenamed("origin", "node_id"), "scores")
    if scored.count() <= local_nodes:
        scored = F.broadcast(scored)
    zero = {f"count_{c}": F.lit(0).cast("long") for c in caps} | {f"score_{c}": F.lit(0.0) for c in caps} | {"total_score": F.lit(0.0)}
    joined = cells.join(scored, "node_id", "left")
    return joined.select(*(F.col(c) for c in cells.columns), *(F.coalesce(F.col(k), v).alias(k) for k, v in zero.items()))


def score_summary(scored: DataFrame, by: str = "resolution_m") -> DataFrame:
    """Lowest, mean and highest total by grid size, and the number of cells."""
    return scored.groupBy(by).agg(F.count("*").alias("cells"), F.min("total_score").alias("min_score"), F.avg("total_score").alias("avg_score"), F.max("total_score").alias("max_score"))
