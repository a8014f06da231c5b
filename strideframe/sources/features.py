"""Features and ways from the elements of an extract.

A node is a point; a closed way is a polygon, any other way a line; a relation
is a multipolygon of its closed rings, whose ways may come in any order and
direction.  A geometry is a list of polygons (or of lines), each a list of rings
(or one line) of points (lon, lat); a point has none.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strideframe.functions.scoring import feature_category
from strideframe.operators.polygon import inside, interior_point, polygon_area, ring_area, side_array, within_area

GEOMETRY = "array<array<array<array<double>>>>"


def ways(elements: DataFrame) -> DataFrame:
    """way_id, tags, refs."""
    return elements.where("osm_type = 'W'").select(F.col("osm_id").alias("way_id"), "tags", "refs")


def nodes(elements: DataFrame) -> DataFrame:
    """node_id, lat, lon in single precision."""
    return elements.where("osm_type = 'N'").select(F.col("osm_id").alias("node_id"), *(F.col(c).cast("float").alias(c) for c in ("lat", "lon")))


def categorised(elements: DataFrame) -> DataFrame:
    """Elements with a category; tags decide before any geometry is built."""
    return elements.withColumn("category", feature_category(F.col("tags"))).where("category IS NOT NULL")


def closed_rings(lines: list[list]) -> list[list] | None:
    """Rings of lines of (node, lon, lat) whose ends meet, in any order and direction; None where one stays open."""
    open_, rings = [list(x) for x in lines if len(x) > 1], []
    while open_:
        ring = open_.pop()
        while ring[0][0] != ring[-1][0]:
            at = next((i for i, x in enumerate(open_) if ring[-1][0] in (x[0][0], x[-1][0])), None)
            if at is None:
                return None
            more = open_.pop(at)
            ring += more[1:] if more[0][0] == ring[-1][0] else more[-2::-1]
        if len(ring) > 3:
            rings.append([[p[1], p[2]] for p in ring])
    return rings


def multipolygon(members: list[tuple[str, list]]) -> list | None:
    """Polygons with holes from (role, line) pairs; None where a ring stays open or no outer one has an area."""
    outer = closed_rings([line for role, line in members if role != "inner"])
    inner = closed_rings([line for role, line in members if role == "inner"])
    if not outer or inner is None:
        return None
    found = [[r] for r in outer if ring_area(r) > 0]
    for hole in inner:
        home = next((p for p in found if inside([p[:1]], *hole[0])), None)
        if home is not None and ring_area(hole) > 0:
            home.append(hole)
    return found or None


def surface_point(geometry: list, kind: str) -> tuple[float, float]:
    """A point of the geometry: in the largest polygon and in none of its holes, or a line's middle corner."""
    if kind == "line":
        line = geometry[0][0]
        return tuple(line[(len(line) - 1) // 2])
    best = max(geometry, key=polygon_area)
    return interior_point(best[0], best[1:])


def features(elements: DataFrame) -> DataFrame:
    """Categorised features with kind (point, line, polygon), geometry and a point of it."""
    found = categorised(elements).select("osm_type", "osm_id", "category", F.col("tags")["name"].alias("name"), "tags", "lat", "lon", "refs", "members")
    places = elements.where("osm_type = 'N'").select(F.col("osm_id").alias("ref"), F.col("lon").alias("x"), F.col("lat").alias("y"))
    keep = ["osm_type", "osm_id", "category", "name", "tags", "lat", "lon"]
    points = found.where("osm_type = 'N'").select(*keep, F.lit("point").alias("kind"), F.lit(None).cast(GEOMETRY).alias("geometry"))
    parts = found.where("osm_type = 'R'").select("osm_id", F.explode(F.filter("members", lambda m: m["type"] == "W")).alias("m")).select(F.lit("R").alias("osm_type"), "osm_id", F.col("m.ref").alias("way"), F.coalesce("m.role", F.lit("")).alias("role"))
    of_relations = parts.join(elements.where("osm_type = 'W'").select(F.col("osm_id").alias("way"), "refs"), "way", "left")
    drawn = found.where("osm_type = 'W'").select("osm_type", "osm_id", F.col("osm_id").alias("way"), F.lit("").alias("role"), "refs").unionByName(of_relations.select("osm_type", "osm_id", "way", "role", "refs"))
    # a way's line; nodes that the extract lacks are left out, a relation's way that it lacks makes it incomplete
    spread = drawn.select("osm_type", "osm_id", "way", "role", F.posexplode_outer("refs").alias("at", "ref")).join(places, "ref", "left")
    lines = spread.groupBy("osm_type", "osm_id", "way", "role").agg(F.sort_array(F.collect_list(F.when(F.col("x").isNotNull(), F.struct("at", "ref", "x", "y")))).alias("line"))
    whole = lines.groupBy("osm_type", "osm_id").agg(F.collect_list(F.struct("role", "line")).alias("lines"))

    @F.pandas_udf(f"kind string, geometry {GEOMETRY}, lon double, lat double")
    def shaped(kinds: pd.Series, groups: pd.Series) -> pd.DataFrame:
        out = []
        for osm_type, group in zip(kinds, groups, strict=True):
            members = [(m["role"], [(p["ref"], p["x"], p["y"]) for p in m["line"]]) for m in group]
            geometry, kind = None, "polygon"
            if osm_type == "R":
                geometry = multipolygon(members) if all(line for _, line in members) else None
            elif (line := members[0][1]) and len(line) > 1:
                ring = [[p[1], p[2]] for p in line]
                if line[0][0] == line[-1][0] and len(line) > 3 and ring_area(ring) > 0:
                    geometry = [[ring]]
                else:
                    geometry, kind = [[ring]], "line"
            out.append((kind, geometry, *surface_point(geometry, kind)) if geometry else (None, None, None, None))
        return pd.DataFrame(out, columns=["kind", "geometry", "lon", "lat"])

    made = whole.select("osm_type", "osm_id", shaped("osm_type", "lines").alias("s")).select("osm_type", "osm_id", "s.*").where("kind IS NOT NULL")
    return points.unionByName(found.drop("lat", "lon").join(made, ["osm_type", "osm_id"]).select(*keep, "kind", "geometry"))


def geometry_meets(geometry: list, kind: str, area: list, edges: np.ndarray, corners: np.ndarray) -> bool:
    """Whether a geometry and an area share a point.  ``edges`` and ``corners`` are the area's."""
    own = side_array(geometry) if kind == "polygon" else np.array([(*a, *b) for polygon in geometry for line in polygon for a, b in zip(line, line[1:])], float).reshape(-1, 4)  # noqa: B905
    low, high = own.reshape(-1, 2).min(axis=0), own.reshape(-1, 2).max(axis=0)
    near = edges[(edges[:, [0, 2]].min(axis=1) <= high[0]) & (edges[:, [0, 2]].max(axis=1) >= low[0]) & (edges[:, [1, 3]].min(axis=1) <= high[1]) & (edges[:, [1, 3]].max(axis=1) >= low[1])]
    if inside(area, *own[0, :2]):
        return True
    for x1, y1, x2, y2 in own:
        if not len(near):
            break
        ax, ay, bx, by = near.T
        s1, s2 = (bx - ax) * (y1 - ay) - (by - ay) * (x1 - ax), (bx - ax) * (y2 - ay) - (by - ay) * (x2 - ax)
        t1, t2 = (x2 - x1) * (ay - y1) - (y2 - y1) * (ax - x1), (x2 - x1) * (by - y1) - (y2 - y1) * (bx - x1)
        if ((s1 * s2 <= 0) & (t1 * t2 <= 0) & ~((s1 == 0) & (s2 == 0) & (t1 == 0) & (t2 == 0))).any():
            return True
    here = corners[(corners >= low).all(axis=1) & (corners <= high).all(axis=1)]
    return kind == "polygon" and any(inside(geometry, *c) for c in here.tolist())


def meeting(found: DataFrame, area: list) -> DataFrame:
    """Features that share a point with the area: points by a join with the outline's sides, lines and polygons by their own sides, once their boxes meet the area's."""
    edges = side_array(area)
    corners = edges[:, :2]
    (west, south), (east, north) = corners.min(axis=0).tolist(), corners.max(axis=0).tolist()

    @F.pandas_udf("boolean")
    def meets(geometry: pd.Series, kind: pd.Series) -> pd.Series:
        return pd.Series([geometry_meets([[[tuple(p) for p in r] for r in polygon] for polygon in g], k, area, edges, corners) for g, k in zip(geometry, kind, strict=True)], dtype=bool)

    xy = F.flatten(F.flatten(F.col("geometry")))
    least = lambda i, f: f(F.transform(xy, lambda p: p[i]))
    boxed = (least(0, F.array_min) <= east) & (least(0, F.array_max) >= west) & (least(1, F.array_min) <= north) & (least(1, F.array_max) >= south)
    areas = found.where((F.col("kind") != "point") & boxed).where(meets("geometry", "kind"))
    return within_area(found.where("kind = 'point'"), area, F.col("lon"), F.col("lat")).unionByName(areas)
