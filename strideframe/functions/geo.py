"""Geometry as column expressions: great-circle distance, projections, tiles, cell ids."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from strideframe.config import EARTH_RADIUS_M, ZOOM_BREAKS


def haversine_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle metres in doubles."""
    half = lambda a, b: F.pow(F.sin(F.radians(b - a) / 2), 2)
    h = half(lat1, lat2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * half(lon1, lon2)
    return F.lit(2 * EARTH_RADIUS_M) * F.atan2(F.sqrt(h), F.sqrt(1 - h))


def in_box(lat: Column, lon: Column, box: tuple[float, float, float, float]) -> Column:
    """Inclusive at all sides; box: south, west, north, east."""
    return lat.between(box[0], box[2]) & lon.between(box[1], box[3])


class TransverseMercator:
    """Krueger's n-series to the fourth order, both ways, from an ellipsoid and a grid's origin."""

    def __init__(self, a: float, inverse_flattening: float, lat0: float, lon0: float, k0: float, east: float, north: float):
        f = 1 / inverse_flattening
        n = f / (2 - f)
        self.e = math.sqrt(f * (2 - f))
        self.lon0, self.east = math.radians(lon0), east
        self.scale = k0 * a / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
        # series coefficients of the public n-series, by powers of n
        self.alpha = [
            n / 2 - 2 / 3 * n**2 + 5 / 16 * n**3 + 41 / 180 * n**4,
            13 / 48 * n**2 - 3 / 5 * n**3 + 557 / 1440 * n**4,
            61 / 240 * n**3 - 103 / 140 * n**4,
            49561 / 161280 * n**4,
        ]
        self.beta = [
            n / 2 - 2 / 3 * n**2 + 37 / 96 * n**3 - 1 / 360 * n**4,
            1 / 48 * n**2 + 1 / 15 * n**3 - 437 / 1440 * n**4,
            17 / 480 * n**3 - 37 / 840 * n**4,
            4397 / 161280 * n**4,
        ]
        t = math.sinh(math.atanh(math.sin(math.radians(lat0))) - self.e * math.atanh(self.e * math.sin(math.radians(lat0))))
        xi = math.atan(t)
        self.north = north - self.scale * (xi + sum(c * math.sin(2 * j * xi) for j, c in enumerate(self.alpha, 1)))

    def forward(self, lon: Column, lat: Column) -> tuple[Column, Column]:
        """Easting and northing."""
        s = F.sin(F.radians(lat))
        t = F.sinh(F.atanh(s) - F.lit(self.e) * F.atanh(F.lit(self.e) * s))
        away = F.radians(lon) - F.lit(self.lon0)
        xi, eta = F.atan2(t, F.cos(away)), F.asinh(F.sin(away) / F.sqrt(t * t + F.cos(away) * F.cos(away)))
        x, y = eta, xi
        for j, c in enumerate(self.alpha, 1):
            x = x + F.lit(c) * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
            y = y + F.lit(c) * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
        return F.lit(self.east) + F.lit(self.scale) * x, F.lit(self.north) + F.lit(self.scale) * y

    def inverse(self, x: Column, y: Column) -> tuple[Column, Column]:
        """Longitude and latitude; the last step of the latitude is a fixed-point iteration."""
        xi0, eta0 = (y - F.lit(self.north)) / F.lit(self.scale), (x - F.lit(self.east)) / F.lit(self.scale)
        xi, eta = xi0, eta0
        for j, c in enumerate(self.beta, 1):
            xi = xi - F.lit(c) * F.sin(2 * j * xi0) * F.cosh(2 * j * eta0)
            eta = eta - F.lit(c) * F.cos(2 * j * xi0) * F.sinh(2 * j * eta0)
        lon = F.lit(self.lon0) + F.atan2(F.sinh(eta), F.cos(xi))
        t = F.sin(xi) / F.sqrt(F.sinh(eta) * F.sinh(eta) + F.cos(xi) * F.cos(xi))
        iso = F.asinh(t)
        s = F.tanh(iso)
        for _ in range(4):
            s = F.tanh(iso + F.lit(self.e) * F.atanh(F.lit(self.e) * s))
        return F.degrees(lon), F.degrees(F.asin(s))


#: The Irish metric grid (GRS80).
IRISH_GRID = TransverseMercator(6378137.0, 298.257222101, 53.5, -8.0, 0.99982, 600000.0, 750000.0)


def web_mercator(lon: Column, lat: Column) -> tuple[Column, Column]:
    r = 6378137.0
    return F.radians(lon) * r, F.lit(r) * F.ln(F.tan(F.lit(math.pi / 4) + F.radians(lat) / 2))


def tile_x(lon: Column, zoom: Column) -> Column:
    last = F.pow(F.lit(2.0), zoom) - 1
    return F.greatest(F.lit(0.0), F.least(last, F.floor((lon + 180) / 360 * F.pow(F.lit(2.0), zoom)))).cast("int")


def tile_y(lat: Column, zoom: Column) -> Column:
    last, r = F.pow(F.lit(2.0), zoom) - 1, F.radians(lat)
    return F.greatest(F.lit(0.0), F.least(last, F.floor((1 - F.ln(F.tan(r) + 1 / F.cos(r)) / math.pi) / 2 * F.pow(F.lit(2.0), zoom)))).cast("int")


def zoom_resolution(zoom: Column, breaks: list[tuple[int, int]] = ZOOM_BREAKS) -> Column:
    """The grid size that is drawn at a zoom: that of the highest break it reaches."""
    return F.coalesce(*(F.when(zoom >= at, F.lit(size)) for at, size in sorted(breaks, reverse=True)))


def cell_id(size: Column, minx: Column, miny: Column) -> Column:
    """``size:minx:miny`` with the corner in millimetres, rounded half to even."""
    mm = lambda c: F.bround(c * 1000, 0).cast("long").cast("string")
    return F.concat_ws(":", size.cast("string"), mm(minx), mm(miny))


def cell_bounds(cell: Column) -> tuple[Column, Column, Column, Column]:
    """minx, miny, maxx, maxy in metres from a cell id."""
    parts = F.split(cell, ":")
    at = lambda i: F.get(parts, F.lit(i)).cast("double")
    minx, miny = at(1) / 1000, at(2) / 1000
    return minx, miny, minx + at(0), miny + at(0)


def hilbert_id(zoom: Column, x: Column, y: Column) -> Column:
    """The tile's number in the archive format: all tiles of lower zooms, then the Hilbert curve's position, as a fold over bits."""
    start = F.struct(F.shiftleft(F.lit(1).cast("long"), 0).alias("unused"), x.cast("long").alias("x"), y.cast("long").alias("y"), ((F.pow(F.lit(4.0), zoom) - 1) / 3).cast("long").alias("d"))
    bits = F.when(zoom > 0, F.sequence(zoom.cast("int") - 1, F.lit(0), F.lit(-1))).otherwise(F.array().cast("array<int>"))

    def step(s: Column, k: Column) -> Column:
        half = F.pow(F.lit(2.0), k).cast("long")
        rx, ry = F.when(s["x"].bitwiseAND(half) > 0, 1).otherwise(0), F.when(s["y"].bitwiseAND(half) > 0, 1).otherwise(0)
        flip = (ry == 0) & (rx == 1)
        fx, fy = F.when(flip, half - 1 - s["x"].bitwiseAND(half - 1)).otherwise(s["x"].bitwiseAND(half - 1)), F.when(flip, half - 1 - s["y"].bitwiseAND(half - 1)).otherwise(s["y"].bitwiseAND(half - 1))
        swap = ry == 0
        return F.struct(s["unused"].alias("unused"), F.when(swap, fy).otherwise(fx).alias("x"), F.when(swap, fx).otherwise(fy).alias("y"), (s["d"] + half * half * F.when(rx == 1, F.when(ry == 1, 2).otherwise(3)).otherwise(ry)).alias("d"))

    return F.aggregate(bits, start, step, lambda s: s["d"])
