"""Study areas from GeoJSON files and as named kinds.

A boundary is one value: it is read by Spark's store access and parsed on the
driver.  An area is a list of polygons; being in any of them is being in it, so
a union is their list.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from strideframe import storage
from strideframe.functions.geo import IRISH_GRID
from strideframe.operators.polygon import corridor, flat, ring_area, ring_centroid

#: The corridor's line (lon, lat) and half width in metres.
CORRIDOR_LINE = [(-6.2267, 53.4238), (-6.2180, 53.4610), (-6.2560, 53.5870), (-6.3470, 53.7170), (-6.3910, 54.0180), (-6.3390, 54.1750), (-6.0830, 54.4720), (-5.9300, 54.5970)]
CORRIDOR_M = 10_000
#: Reference systems by their code: degrees, and the metric grid.
DEGREES, METRES = ("4326", "CRS84"), ("2157",)


def clean_union(areas: list[list]) -> list:
    """The polygons of several areas in two dimensions, without empty rings and polygons; raises where none is left."""
    found = []
    for polygon in (p for area in areas for p in area):
        rings = [flat(r) for r in polygon]
        if rings and len(rings[0]) > 2 and ring_area(rings[0]) > 0:
            found.append([rings[0], *(r for r in rings[1:] if len(r) > 2 and ring_area(r) > 0)])
    if not found:
        raise ValueError("no polygon with an area")
    return found


def load_boundary(spark: SparkSession, path: str, row_filter: Callable[[dict], bool] | None = None, *, layer: str | None = None, source_crs: str | None = None) -> list:
    """The polygons of a GeoJSON file in degrees.  ``layer``: the collection's name, if the file gives one; ``source_crs``: in place of the file's reference system (degrees, where it names none)."""
    text = storage.read_text(spark, path)
    if not text:
        raise ValueError(f"{path} is missing or empty")
    data = json.loads(text)
    if layer and data.get("name", layer) != layer:
        raise ValueError(f"{path} has no layer {layer}")
    named = ((data.get("crs") or {}).get("properties") or {}).get("name")
    code = (source_crs or named or DEGREES[0]).replace("::", ":").rsplit(":", 1)[-1]
    if code not in DEGREES + METRES:
        raise ValueError(f"{path}: reference system {source_crs or named} isn't known")
    parts = []
    for feature in data["features"] if data["type"] == "FeatureCollection" else [data]:
        geometry = feature.get("geometry")
        if not geometry or row_filter and not row_filter(feature.get("properties") or {}):
            continue
        polygons = {"Polygon": [geometry["coordinates"]], "MultiPolygon": geometry["coordinates"]}.get(geometry["type"])
        if polygons is None:
            raise ValueError(f"{path}: {geometry['type']} is no area")
        parts.append([p for p in polygons if p])
    try:
        area = clean_union(parts)
    except ValueError:
        raise ValueError(f"{path} has no area") from None
    return area if code in DEGREES else from_metric(spark, area)


def load_island(spark: SparkSession, paths: list[str]) -> list:
    """The union of boundaries."""
    return clean_union([load_boundary(spark, p) for p in paths])


def boundary_state(spark: SparkSession, paths: list[str]) -> tuple:
    """What names the boundaries' contents in hashes: each file's path, size and time."""
    return tuple(tuple(sorted((storage.file_state(spark, p) or {"path": p}).items())) for p in paths)


def _moved(spark: SparkSession, area: list, by) -> list:
    points = [(i, j, k, float(x), float(y)) for i, p in enumerate(area) for j, r in enumerate(p) for k, (x, y) in enumerate(r)]
    x, y = by(F.col("x"), F.col("y"))
    moved = {(r.i, r.j, r.k): (r.mx, r.my) for r in spark.createDataFrame(points, "i int, j int, k int, x double, y double").select("i", "j", "k", x.alias("mx"), y.alias("my")).collect()}
    return [[[moved[i, j, k] for k in range(len(r))] for j, r in enumerate(p)] for i, p in enumerate(area)]


def to_metric(spark: SparkSession, area: list) -> list:
    """The area in the metric grid."""
    return _moved(spark, area, IRISH_GRID.forward)


def from_metric(spark: SparkSession, area: list) -> list:
    """The area in degrees."""
    return _moved(spark, area, IRISH_GRID.inverse)


def centroid(area: list) -> tuple[float, float]:
    """The area-weighted centroid of the outer rings."""
    sizes = [ring_area(p[0]) for p in area]
    points = [ring_centroid(p[0]) for p in area]
    return tuple(sum(s * c[k] for s, c in zip(sizes, points, strict=True)) / sum(sizes) for k in range(2))


def study_area(kind: str, island: list) -> dict:
    """What a point has to meet: the area, and for the corridor a line and a width."""
    if kind == "ireland":
        return {"area": island}
    if kind == "m1_corridor":
        return {"area": island, "line": CORRIDOR_LINE, "width_m": CORRIDOR_M}
    raise ValueError(f"study area: {kind!r}")


def study_polygons(spark: SparkSession, kind: str, island: list) -> tuple[list, list]:
    """The study area in the metric grid and in degrees; the corridor is the island's part within its width of the line."""
    wanted, metric = study_area(kind, island), to_metric(spark, island)
    if "line" not in wanted:
        return metric, island
    found = corridor(metric, to_metric(spark, [[wanted["line"]]])[0][0], float(wanted["width_m"]))
    return found, from_metric(spark, found)
