"""Plane geometry on rings, and its column forms for points."""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Point = tuple[float, float]
Box = tuple[float, float, float, float]


def flat(ring: list) -> list[Point]:
    """A ring's points in two dimensions, without a repeated last one."""
    points = [(p[0], p[1]) for p in ring]
    return points[:-1] if len(points) > 1 and points[0] == points[-1] else points


def is_flat(ring: list) -> bool:
    return all(len(p) == 2 for p in ring)


def ring_area(ring: list) -> float:
    points = flat(ring)
    return abs(sum(x1 * y2 - x2 * y1 for (x1, y1), (x2, y2) in zip(points, points[1:] + points[:1], strict=True))) / 2


def ring_centroid(ring: list) -> Point:
    points = flat(ring)
    x0, y0 = points[0]
    area = cx = cy = 0.0
    for (x1, y1), (x2, y2) in zip(points, points[1:] + points[:1], strict=True):
        cross = (x1 - x0) * (y2 - y0) - (x2 - x0) * (y1 - y0)
        area, cx, cy = area + cross, cx + cross * (x1 + x2 - 2 * x0), cy + cross * (y1 + y2 - 2 * y0)
    return (x0 + cx / (3 * area), y0 + cy / (3 * area)) if area else points[0]


def sides(area: list) -> list[tuple[float, float, float, float]]:
    return [(*a, *b) for polygon in area for ring in polygon for points in [flat(ring)] for a, b in zip(points, points[1:] + points[:1], strict=True)]


def inside(area: list, x: float, y: float) -> bool:
    """Whether a point lies in any polygon: odd crossings of a ray over its rings."""
    return any(sum((y1 > y) != (y2 > y) and x < (x2 - x1) * (y - y1) / (y2 - y1) + x1 for x1, y1, x2, y2 in sides([polygon])) % 2 for polygon in area)


def inside_expr(area: list, x: Column, y: Column) -> Column:
    """The same as an expression: bounds first, then the crossings.  For outlines of up to some thousand sides."""

    def one(polygon: list) -> Column:
        edges = sides([polygon])
        xs, ys = [e[0] for e in edges], [e[1] for e in edges]
        near = x.between(min(xs), max(xs)) & y.between(min(ys), max(ys))
        made = F.array(*(F.struct(*(F.lit(float(v)).alias(n) for v, n in zip(e, ("x1", "y1", "x2", "y2"), strict=True))) for e in edges if e[1] != e[3]))
        hits = F.size(F.filter(made, lambda e: ((e["y1"] > y) != (e["y2"] > y)) & (x < (e["x2"] - e["x1"]) * (y - e["y1"]) / (e["y2"] - e["y1"]) + e["x1"])))
        return F.when(near, hits % 2 == 1).otherwise(False)

    return reduce(lambda a, b: a | b, map(one, area))


#: Sides of an outline up to which it is part of an expression; beyond, points meet its sides in a join.
INLINE_SIDES = 512


def within_area(points: DataFrame, area: list, x: Column, y: Column, *, inline: int = INLINE_SIDES) -> DataFrame:
    """``points`` in the area.  A long outline is cut into horizontal strips of a few sides each; a point meets the sides of its strip only, in an equi-join whose right side has a row a strip."""
    edges = [(p, *map(float, e)) for p, polygon in enumerate(area) for e in sides([polygon]) if e[1] != e[3]]
    if len(edges) <= inline:
        return points.where(inside_expr(area, x, y))
    low, high = min(min(e[2], e[4]) for e in edges), max(max(e[2], e[4]) for e in edges)
    count = max(1, len(edges) // 8)
    height = (high - low) / count
    spark = points.sparkSession
    listed = spark.createDataFrame(edges, "p int, x1 double, y1 double, x2 double, y2 double")
    strip = lambda v: F.floor((v - low) / height).cast("long")
    spread = listed.withColumn("__strip", F.explode(F.sequence(strip(F.least("y1", "y2")), strip(F.greatest("y1", "y2")))))
    strips = spread.groupBy("__strip").agg(F.collect_list(F.struct("p", "x1", "y1", "x2", "y2")).alias("__sides"))
    met = points.withColumns({"__x": x.cast("double"), "__y": y.cast("double")}).withColumn("__strip", strip(F.col("__y"))).join(strips, "__strip")
    px, py = F.col("__x"), F.col("__y")
    hits = F.transform(F.filter("__sides", lambda e: ((e["y1"] > py) != (e["y2"] > py)) & (px < (e["x2"] - e["x1"]) * (py - e["y1"]) / (e["y2"] - e["y1"]) + e["x1"])), lambda e: e["p"])
    return met.where(F.exists(F.array_distinct(hits), lambda p: F.size(F.filter(hits, lambda q: q == p)) % 2 == 1)).select(points.columns)


def line_distance(line: list[Point], x: Column, y: Column) -> Column:
    """Distance of a point from a polyline, in the plane."""

    def part(a: Point, b: Point) -> Column:
        dx, dy = b[0] - a[0], b[1] - a[1]
        size = dx * dx + dy * dy
        t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((x - a[0]) * dx + (y - a[1]) * dy) / (size or 1.0)))
        return F.sqrt(F.pow(x - a[0] - t * dx, 2) + F.pow(y - a[1] - t * dy, 2))

    parts = [part(a, b) for a, b in zip(line, line[1:])]  # noqa: B905
    return F.least(*parts) if len(parts) > 1 else parts[0]


def in_corridor(area: list, line: list[Point], width: float, x: Column, y: Column) -> Column:
    """In the area and within ``width`` of a line."""
    return inside_expr(area, x, y) & (line_distance(line, x, y) <= width)


def side_array(area: list) -> np.ndarray:
    """Sides as rows x1, y1, x2, y2."""
    return np.array(sides(area), np.float64).reshape(-1, 4)


def crossing(edges: np.ndarray, box: Box) -> np.ndarray:
    """Which of the sides pass through a box's inside."""
    x1, y1, x2, y2 = edges.T
    first, last, out = np.zeros(len(edges)), np.ones(len(edges)), np.zeros(len(edges), bool)
    for p, q in ((x1 - x2, x1 - box[0]), (x2 - x1, box[2] - x1), (y1 - y2, y1 - box[1]), (y2 - y1, box[3] - y1)):
        with np.errstate(divide="ignore", invalid="ignore"):
            t = q / p
        first = np.where(p < 0, np.maximum(first, t), first)
        last = np.where(p > 0, np.minimum(last, t), last)
        out |= (p == 0) & (q <= 0)
    return ~out & (first < last)


def crosses_box(area: list, box: Box) -> bool:
    """Whether any side passes through a box's inside."""
    return bool(crossing(side_array(area), box).any())


def clip_half(points: np.ndarray, a: float, b: float, c: float) -> np.ndarray:
    """A ring's part where a x + b y <= c."""
    if not len(points):
        return points
    away = points @ np.array([a, b]) - c
    inner = away <= 0
    if inner.all():
        return points
    after = np.roll(np.arange(len(points)), -1)
    cut = inner != inner[after]
    share = np.divide(away, away - away[after], out=np.zeros(len(points)), where=cut)[:, None]
    met = points + share * (points[after] - points)
    if a == 0 or b == 0:  # on the limit itself, whatever rounding says
        met[:, 0 if b == 0 else 1] = c / (a or b)
    both = np.stack([points, met], axis=1).reshape(-1, 2)
    return both[np.stack([inner, cut], axis=1).reshape(-1)]


def clip_convex(ring: list | np.ndarray, corners: list[Point]) -> np.ndarray:
    """A ring's part in a convex outline, counterclockwise."""
    points = np.array(flat(ring), np.float64) if isinstance(ring, list) else ring
    for (x1, y1), (x2, y2) in zip(corners, corners[1:] + corners[:1], strict=True):
        a, b = y2 - y1, x1 - x2
        points = clip_half(points, a, b, a * x1 + b * y1)
    return points


def clip_polygon(polygon: list, corners: list[Point]) -> list[list[Point]] | None:
    """A polygon's part in a convex outline, holes included; None where it has no area."""
    rings = [[tuple(p) for p in clip_convex(r, corners).tolist()] for r in polygon]
    rings = [r for r in rings if len(r) > 2 and ring_area(r) > 0]
    return rings if rings and polygon_area(rings) > 0 else None


def polygon_area(polygon: list) -> float:
    return ring_area(polygon[0]) - sum(map(ring_area, polygon[1:]))


def stadium(a: Point, b: Point, width: float, steps: int = 32) -> list[Point]:
    """What lies within ``width`` of a line from a to b: its corners, counterclockwise, ``steps`` a half circle."""
    turn = math.atan2(b[1] - a[1], b[0] - a[0])
    around = lambda p, start: [(p[0] + width * math.cos(start + math.pi * k / steps), p[1] + width * math.sin(start + math.pi * k / steps)) for k in range(steps + 1)]
    return around(b, turn - math.pi / 2) + around(a, turn + math.pi / 2)


def corridor(area: list, line: list[Point], width: float) -> list:
    """The area within ``width`` of a line, as polygons that may overlap; being in any of them is being in it."""
    parts = [clip_polygon(polygon, stadium(a, b, width)) for a, b in zip(line, line[1:]) for polygon in area]  # noqa: B905
    found = [p for p in parts if p]
    if not found:
        raise ValueError("the corridor doesn't meet the area")
    return found


def clip_ring(ring: list, box: Box) -> list[Point]:
    """A ring cut to a box, side by side."""
    points = np.array(flat(ring), np.float64).reshape(-1, 2)
    for a, b, c in ((-1.0, 0.0, -box[0]), (1.0, 0.0, box[2]), (0.0, -1.0, -box[1]), (0.0, 1.0, box[3])):
        points = clip_half(points, a, b, c)
    return [tuple(p) for p in points.tolist()]


def clip_rings(area: list, box: Box) -> list[list[list[Point]]]:
    """The polygons' parts in a box that have an area, each with its holes' parts."""
    minx, miny, maxx, maxy = box
    corners = [(minx, miny), (maxx, miny), (maxx, maxy), (minx, maxy)]
    return [p for polygon in area if (p := clip_polygon(polygon, corners))]


def interior_point(ring: list, holes: list = ()) -> Point:
    """A point inside and in no hole: the middle of the widest run on a horizontal line."""
    rings = [flat(r) for r in (ring, *holes)]
    edges = [(*a, *b) for points in rings for a, b in zip(points, points[1:] + points[:1], strict=True)]
    levels = sorted({y for points in rings for _, y in points})
    best = None
    for y in {(a + b) / 2 for a, b in zip(levels, levels[1:])}:  # noqa: B905
        cuts = sorted((x2 - x1) * (y - y1) / (y2 - y1) + x1 for x1, y1, x2, y2 in edges if (y1 > y) != (y2 > y))
        for left, right in zip(cuts[::2], cuts[1::2], strict=False):
            if best is None or (right - left, -y) > best[0]:
                best = ((right - left, -y), ((left + right) / 2, y))
    return best[1] if best else rings[0][0]
