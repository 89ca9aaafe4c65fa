"""Geometry as column expressions: projections, polygon tests, distances, grid cells, point encoding."""

from __future__ import annotations

import math
import struct
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import BinaryType, DoubleType, StructField, StructType

Ring = Sequence[tuple[float, float]]

EARTH_RADIUS = 6371008.8
METRES_PER_MILE = 1609.344
POLAR_LATITUDE = 70.0
#: Rings with more edges are tested by a fold over a literal array instead of an expression for each edge.
INLINE_EDGES = 64

NORTH, SOUTH, PLATE = "north_polar", "south_polar", "plate_carree"


def projection_of(ring: Ring) -> str:
    """The projection a region is tested in: polar if its first vertex lies beyond 70 degrees."""
    lat = ring[0][1]
    return NORTH if lat > POLAR_LATITUDE else SOUTH if lat < -POLAR_LATITUDE else PLATE


def project(lon: Column, lat: Column, kind: str) -> tuple[Column, Column]:
    """Planar x, y of degrees: polar stereographic on a unit sphere, or plate carree in radians."""
    lam, phi = F.radians(lon), F.radians(lat)
    if kind == NORTH:
        r = 2 * F.tan(math.pi / 4 - phi / 2)
        return r * F.cos(lam), r * F.sin(lam)
    if kind == SOUTH:
        r = -2 * F.tan(-math.pi / 4 - phi / 2)
        return r * F.cos(-lam), r * F.sin(-lam)
    if kind == PLATE:
        return lam, phi
    raise ValueError(f"unknown projection {kind!r}")


def unproject(x: Column, y: Column, kind: str) -> tuple[Column, Column]:
    """Degrees of planar x, y."""
    if kind == PLATE:
        return F.degrees(x), F.degrees(y)
    r = F.sqrt(x * x + y * y)
    if kind == NORTH:
        return F.degrees(F.atan2(y, x)), F.degrees(math.pi / 2 - 2 * F.atan(r / 2))
    return F.degrees(-F.atan2(y, x)), F.degrees(-(math.pi / 2) + 2 * F.atan(r / 2))


def project_point(lon: float, lat: float, kind: str) -> tuple[float, float]:
    """`project` of one point."""
    lam, phi = math.radians(lon), math.radians(lat)
    if kind == PLATE:
        return lam, phi
    sign = 1 if kind == NORTH else -1
    r = 2 * math.tan(math.pi / 4 - sign * phi / 2)
    return r * math.cos(lam), sign * r * math.sin(lam)


def in_ring(x: Column, y: Column, ring: Ring) -> Column:
    """Even-odd test against a planar ring, closed or not; points on an edge follow the strict comparison."""
    edges = list(zip(ring, [*ring[-1:], *ring[:-1]], strict=True))
    if len(edges) <= INLINE_EDGES:
        crossings = [F.when(((yi > y) != (yj > y)) & (x < (xj - xi) * (y - yi) / (yj - yi) + xi), 1).otherwise(0) for (xi, yi), (xj, yj) in ((tuple(map(F.lit, map(float, a))), tuple(map(F.lit, map(float, b)))) for a, b in edges if a[1] != b[1])]
        total = crossings[0]
        for c in crossings[1:]:
            total = total + c
        return total % 2 == 1
    table = F.array(*[F.struct(F.lit(float(a[0])).alias("xi"), F.lit(float(a[1])).alias("yi"), F.lit(float(b[0])).alias("xj"), F.lit(float(b[1])).alias("yj")) for a, b in edges])
    crosses = lambda e: ((e["yi"] > y) != (e["yj"] > y)) & (x < F.try_divide((e["xj"] - e["xi"]) * (y - e["yi"]), e["yj"] - e["yi"]) + e["xi"])
    return F.aggregate(table, F.lit(0), lambda n, e: n + F.when(crosses(e), 1).otherwise(0)) % 2 == 1


def in_polygon(lon: Column, lat: Column, ring: Ring) -> Column:
    """Polygon predicate on degrees. For plate carree, plain range conditions come first, so scans can use them to skip row groups."""
    kind = projection_of(ring)
    planar = [project_point(*p, kind) for p in ring]
    x, y = project(lon, lat, kind)
    exact = in_ring(x, y, planar)
    if kind != PLATE:
        return exact
    # a hair wider than the ring, as conversion to radians rounds
    pad = 1e-9
    lons, lats = [p[0] for p in ring], [p[1] for p in ring]
    return (lon >= min(lons) - pad) & (lon <= max(lons) + pad) & (lat >= min(lats) - pad) & (lat <= max(lats) + pad) & exact


def signed_area(ring: Ring) -> float:
    return sum((b[0] - a[0]) * (b[1] + a[1]) for a, b in zip(ring, [*ring[1:], ring[0]], strict=True)) / -2


def clean_ring(ring: Ring) -> list[tuple[float, float]]:
    """Closed and counter-clockwise; fewer than four points, the closing one included, raise."""
    out = [tuple(map(float, p)) for p in ring]
    if out and out[0] != out[-1]:
        out.append(out[0])
    if len(out) < 4:
        raise ValueError("a polygon needs at least three corners")
    return out if signed_area(out) >= 0 else out[::-1]


def simplify(ring: Ring, tolerance: float) -> list[tuple[float, float]]:
    """Douglas-Peucker on a closed ring."""
    ring = clean_ring(ring)

    def keep(part: list[tuple[float, float]]) -> list[tuple[float, float]]:
        (ax, ay), (bx, by) = part[0], part[-1]
        length = math.hypot(bx - ax, by - ay)
        off = [abs((bx - ax) * (ay - y) - (ax - x) * (by - ay)) / length if length else math.hypot(x - ax, y - ay) for x, y in part]
        k = max(range(len(part)), key=off.__getitem__)
        return [part[0], part[-1]] if off[k] <= tolerance else keep(part[: k + 1])[:-1] + keep(part[k:])

    half = len(ring) // 2
    out = keep(ring[: half + 1])[:-1] + keep(ring[half:])
    return out if len(out) >= 4 else ring


def haversine(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Metres on the sphere."""
    p1, p2 = F.radians(lat1), F.radians(lat2)
    a = F.pow(F.sin((p2 - p1) / 2), 2) + F.cos(p1) * F.cos(p2) * F.pow(F.sin((F.radians(lon2) - F.radians(lon1)) / 2), 2)
    return F.lit(2 * EARTH_RADIUS) * F.asin(F.sqrt(a))


def wrap_longitude(lon: Column) -> Column:
    """Into [-180, 180)."""
    return lon - 360 * F.floor((lon + 180) / 360)


def utm_zone(lon: Column) -> Column:
    return (F.floor((wrap_longitude(lon) + 180) / 6) + 1).cast("int")


def utm(lon: Column, lat: Column) -> tuple[Column, Column, Column]:
    """zone, easting, northing on WGS 84, by the series to the sixth order."""
    a, f, k0 = 6378137.0, 1 / 298.257223563, 0.9996
    e2 = f * (2 - f)
    ep = e2 / (1 - e2)
    zone = utm_zone(lon)
    phi, lam = F.radians(lat), F.radians(wrap_longitude(lon) - (zone * 6 - 183))
    n = a / F.sqrt(1 - e2 * F.pow(F.sin(phi), 2))
    t, c, m = F.pow(F.tan(phi), 2), ep * F.pow(F.cos(phi), 2), F.cos(phi) * lam
    arc = a * ((1 - e2 / 4 - 3 * e2**2 / 64 - 5 * e2**3 / 256) * phi - (3 * e2 / 8 + 3 * e2**2 / 32 + 45 * e2**3 / 1024) * F.sin(2 * phi) + (15 * e2**2 / 256 + 45 * e2**3 / 1024) * F.sin(4 * phi) - (35 * e2**3 / 3072) * F.sin(6 * phi))
    east = k0 * n * (m + (1 - t + c) * F.pow(m, 3) / 6 + (5 - 18 * t + t * t + 72 * c - 58 * ep) * F.pow(m, 5) / 120) + 500000
    north = k0 * (arc + n * F.tan(phi) * (m * m / 2 + (5 - t + 9 * c + 4 * c * c) * F.pow(m, 4) / 24 + (61 - 58 * t + t * t + 600 * c - 330 * ep) * F.pow(m, 6) / 720))
    return zone, east, north + F.when(lat < 0, 10_000_000.0).otherwise(0.0)


def cell(x: Column, size: float) -> Column:
    """Number of the grid cell of x."""
    return F.floor(x / size).cast("long")


@pandas_udf(BinaryType())
def wkb_point(x: pd.Series, y: pd.Series) -> pd.Series:
    """Well-known binary of a point, little-endian."""
    return pd.Series([struct.pack("<BIdd", 1, 1, a, b) for a, b in zip(x, y, strict=True)])


@pandas_udf(StructType([StructField("x", DoubleType()), StructField("y", DoubleType())]))
def wkb_xy(blob: pd.Series) -> pd.DataFrame:
    """Coordinates of a point's well-known binary, of either byte order."""
    points = [struct.unpack(("<" if b[0] == 1 else ">") + "dd", b[5:21]) if b is not None else (None, None) for b in blob]
    return pd.DataFrame(points, columns=["x", "y"])
