"""Geometry as columns: distances, projections, cells, points against polygons.

A polygon table has one row per ring edge: id columns, part, hole, x1, y1, x2, y2.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EARTH_M = 6_371_000.0
LON_M, LAT_M = 111_320.0, 110_540.0


def haversine_m(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Great-circle metres on a sphere of 6,371 km."""
    a = F.sin(F.radians(lat2 - lat1) / 2) ** 2 + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.sin(F.radians(lon2 - lon1) / 2) ** 2
    return 2 * EARTH_M * F.asin(F.least(F.lit(1.0), F.sqrt(a)))


def check_lon_lat(df: DataFrame, lon: str, lat: str) -> DataFrame:
    """df with a check, when it runs, that points lie in lon 124 to 132 and lat 33 to 39.5 (PRJ-35)."""
    good = F.col(lon).between(124, 132) & F.col(lat).between(33, 39.5)
    return df.filter(F.when(F.coalesce(good, F.lit(False)), F.lit(True)).otherwise(F.raise_error(F.lit("coordinates out of bounds")).cast("boolean")))


def transverse_mercator(lon: Column, lat: Column, lon0: float, lat0: float, scale: float, east: float, north: float) -> tuple[Column, Column]:
    """x and y in metres on the GRS80 ellipsoid, by the Krueger series to the third order."""
    a, f = 6_378_137.0, 1 / 298.257222101
    n = f / (2 - f)
    radius = a / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    alpha = [n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16, 13 * n**2 / 48 - 3 * n**3 / 5, 61 * n**3 / 240]
    k = 2 * math.sqrt(n) / (1 + n)

    def conformal(phi):
        s = F.sin(phi)
        return F.sinh(F.atanh(s) - k * F.atanh(k * s))

    s0 = math.sin(math.radians(lat0))
    xi0 = math.atan(math.sinh(math.atanh(s0) - k * math.atanh(k * s0)))
    base = xi0 + sum(alpha[j] * math.sin(2 * (j + 1) * xi0) for j in range(3))
    t, d = conformal(F.radians(lat)), F.radians(lon - lon0)
    xi, eta = F.atan2(t, F.cos(d)), F.atanh(F.sin(d) / F.sqrt(1 + t * t))
    x, y = eta, xi
    for j in range(3):
        m = 2 * (j + 1)
        x = x + alpha[j] * F.cos(m * xi) * F.sinh(m * eta)
        y = y + alpha[j] * F.sin(m * xi) * F.cosh(m * eta)
    return scale * radius * x + east, scale * radius * (y - base) + north


def inverse_transverse_mercator(x: Column, y: Column, lon0: float, lat0: float, scale: float, east: float, north: float) -> Column:
    """Longitude and latitude, as an array of two, of x and y in metres on the GRS80 ellipsoid, by the Krueger series to the third order.

    Each step's value is bound once, as a lambda's variable, so that it may stand in lambdas over long rings.
    """
    a, f = 6_378_137.0, 1 / 298.257222101
    n = f / (2 - f)
    radius = a / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    alpha = [n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16, 13 * n**2 / 48 - 3 * n**3 / 5, 61 * n**3 / 240]
    beta = [n / 2 - 2 * n**2 / 3 + 37 * n**3 / 96, n**2 / 48 + n**3 / 15, 17 * n**3 / 480]
    delta = [2 * n - 2 * n**2 / 3 - 2 * n**3, 7 * n**2 / 3 - 8 * n**3 / 5, 56 * n**3 / 15]
    k, s0 = 2 * math.sqrt(n) / (1 + n), math.sin(math.radians(lat0))
    xi0 = math.atan(math.sinh(math.atanh(s0) - k * math.atanh(k * s0)))
    base = xi0 + sum(alpha[j] * math.sin(2 * (j + 1) * xi0) for j in range(3))
    bound = lambda values, then: F.transform(F.array(F.array(*values)), then)[0]

    def straight(p: Column) -> Column:
        xi, eta = p[0], p[1]
        u = xi - sum(beta[j] * F.sin(2 * (j + 1) * xi) * F.cosh(2 * (j + 1) * eta) for j in range(3))
        v = eta - sum(beta[j] * F.cos(2 * (j + 1) * xi) * F.sinh(2 * (j + 1) * eta) for j in range(3))
        return bound([u, v], conformal)

    def conformal(p: Column) -> Column:
        return bound([F.asin(F.sin(p[0]) / F.cosh(p[1])), lon0 + F.degrees(F.atan2(F.sinh(p[1]), F.cos(p[0])))], geodetic)

    def geodetic(p: Column) -> Column:
        return F.array(p[1], F.degrees(p[0] + sum(delta[j] * F.sin(2 * (j + 1) * p[0]) for j in range(3))))

    return bound([(y - north) / (scale * radius) + base, (x - east) / (scale * radius)], straight)


def to_5181(lon: Column, lat: Column) -> tuple[Column, Column]:
    return transverse_mercator(lon, lat, 127.0, 38.0, 1.0, 200_000.0, 500_000.0)


def to_5179(lon: Column, lat: Column) -> tuple[Column, Column]:
    return transverse_mercator(lon, lat, 127.5, 38.0, 0.9996, 1_000_000.0, 2_000_000.0)


def from_5181(x: Column, y: Column) -> Column:
    return inverse_transverse_mercator(x, y, 127.0, 38.0, 1.0, 200_000.0, 500_000.0)


def from_5179(x: Column, y: Column) -> Column:
    return inverse_transverse_mercator(x, y, 127.5, 38.0, 0.9996, 1_000_000.0, 2_000_000.0)


def reproject(geometry: Column, change: Callable[[Column, Column], Column]) -> Column:
    """A GeoJSON point, polygon or multipolygon, as text, with changed coordinates: change gives an array of two; null for a null or another kind."""
    kind, raw = F.get_json_object(geometry, "$.type"), F.get_json_object(geometry, "$.coordinates")
    point = lambda p: change(p[0], p[1])
    ring = lambda r: F.transform(r, point)
    shape = lambda s: F.transform(s, ring)
    of = [("Point", "array<double>", point), ("Polygon", "array<array<array<double>>>", shape), ("MultiPolygon", "array<array<array<array<double>>>>", lambda m: F.transform(m, shape))]
    told = reduce(lambda rest, x: F.when(kind == x[0], F.to_json(x[2](F.from_json(raw, x[1])))).otherwise(rest), of, F.lit(None).cast("string"))
    return F.concat(F.lit('{"type":"'), kind, F.lit('","coordinates":'), told, F.lit("}"))


def segment_distance(px: Column, py: Column, x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """Distance of a point to a segment in the plane."""
    dx, dy = x2 - x1, y2 - y1
    size = dx * dx + dy * dy
    t = F.when(size > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((px - x1) * dx + (py - y1) * dy) / size))).otherwise(F.lit(0.0))
    ex, ey = px - (x1 + t * dx), py - (y1 + t * dy)
    return F.sqrt(ex * ex + ey * ey)


def segment_distance_degrees(px: Column, py: Column, x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """The same in metres from degrees, on a plane that touches at the point."""
    k = F.cos(F.radians(py)) * LON_M
    return segment_distance(F.lit(0.0), F.lit(0.0), (x1 - px) * k, (y1 - py) * LAT_M, (x2 - px) * k, (y2 - py) * LAT_M)


def crosses(px: Column, py: Column, x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """Whether a ray to the right of the point crosses the edge."""
    return ((y1 > py) != (y2 > py)) & (px < (x2 - x1) * (py - y1) / F.nullif(y2 - y1, F.lit(0.0)) + x1)


def on_edge(px: Column, py: Column, x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    inside = px.between(F.least(x1, x2), F.greatest(x1, x2)) & py.between(F.least(y1, y2), F.greatest(y1, y2))
    return inside & (((x2 - x1) * (py - y1) - (y2 - y1) * (px - x1)) == 0)


def cells(x: Column, y: Column, size: float, reach: int) -> Column:
    """Array of the grid cells within `reach` cells of a point's own."""
    steps = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in range(-reach, reach + 1) for j in range(-reach, reach + 1)])
    return F.transform(steps, lambda s: F.struct((F.floor(x / size) + s["i"]).alias("cx"), (F.floor(y / size) + s["j"]).alias("cy")))


def cell(x: Column, y: Column, size: float) -> Column:
    return F.struct(F.floor(x / size).alias("cx"), F.floor(y / size).alias("cy"))


def polygon_edges(df: DataFrame, geometry: str, keys: list[str]) -> DataFrame:
    """One row per ring edge of a GeoJSON geometry string: keys, part, hole, ring, x1, y1, x2, y2.

    Polygon and MultiPolygon both read; rings close themselves. A null or other geometry gives no rows.
    """
    kind = F.get_json_object(geometry, "$.type")
    raw = F.get_json_object(geometry, "$.coordinates")
    multi = "array<array<array<array<double>>>>"
    parts = F.when(kind == "MultiPolygon", F.from_json(raw, multi)).when(kind == "Polygon", F.array(F.from_json(raw, "array<array<array<double>>>")))
    rings = df.select(*keys, F.posexplode(parts).alias("part", "rings")).select(*keys, "part", F.posexplode("rings").alias("ring", "points"))
    following = F.concat(F.slice("points", F.lit(2), F.size("points") - 1), F.slice("points", 1, 1))
    edges = rings.select(*keys, "part", "ring", (F.col("ring") > 0).alias("hole"), F.explode(F.arrays_zip(F.col("points").alias("a"), following.alias("b"))).alias("e"))
    return edges.select(*keys, "part", "ring", "hole", F.col("e.a")[0].alias("x1"), F.col("e.a")[1].alias("y1"), F.col("e.b")[0].alias("x2"), F.col("e.b")[1].alias("y2")).filter("x1 <> x2 or y1 <> y2")
