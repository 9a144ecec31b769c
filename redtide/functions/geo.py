"""Geometry as Column expressions: keys, buckets, polygons, projection, distances."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_RADIUS_M = 6370997.0  # sphere used for the swath search
SEMI_MAJOR_M = 6378137.0  # WGS84
FLATTENING = 1 / 298.257223563
UTM_SCALE = 0.9996


def micro_key(degrees: Column, dp: int = 4) -> Column:
    """Integer key of a coordinate at `dp` decimals; joins never compare doubles."""
    return F.round(degrees * (10**dp)).cast("bigint")


def cell_of(value: Column, size: float) -> Column:
    return F.floor(value / size).cast("bigint")


def cells_around(value: Column, reach: Column | float, size: float) -> Column:
    """Array of all cells of width `size` that meet [value - reach, value + reach].

    The reach is stretched by a billionth so that rounding cannot lose a pair on a border;
    callers test the true predicate afterwards.
    """
    reach = F.lit(reach) if isinstance(reach, (int, float)) else reach
    padded = reach * (1 + 1e-9) + 1e-9 * size
    return F.sequence(cell_of(value - padded, size), cell_of(value + padded, size))


def inside_polygon(lon: Column, lat: Column, ring: list[tuple[float, float]]) -> Column:
    """True strictly inside the ring; points on an edge or a corner are outside.

    Even-odd ray casting written out over the edges of a small literal polygon.
    """
    crossings = F.lit(0)
    on_edge = F.lit(False)
    for (x1, y1), (x2, y2) in zip(ring, ring[1:] + ring[:1]):
        # which side of the edge the point is on; one expression decides crossing and touching
        side = (lon - x1) * (y2 - y1) - (lat - y1) * (x2 - x1)
        if y1 != y2:
            straddles = (F.lit(y1) > lat) != (F.lit(y2) > lat)
            left = side < 0 if y2 > y1 else side > 0
            crossings = crossings + F.when(straddles & left, 1).otherwise(0)
        on_edge = on_edge | (
            (side == 0)
            & lon.between(min(x1, x2), max(x1, x2))
            & lat.between(min(y1, y2), max(y1, y2))
        )
    lons = [x for x, _ in ring]
    lats = [y for _, y in ring]
    boxed = lon.between(min(lons), max(lons)) & lat.between(min(lats), max(lats))
    return boxed & (crossings % 2 == 1) & ~on_edge


def utm_xy(lat: Column, lon: Column, zone: int = 19) -> tuple[Column, Column]:
    """Easting and northing in metres, northern hemisphere (transverse Mercator series,
    Snyder 1987, USGS Professional Paper 1395, equations 8-9 to 8-15 and 3-21)."""
    e2 = FLATTENING * (2 - FLATTENING)
    ep2 = e2 / (1 - e2)
    phi = F.radians(lat)
    sin_phi, cos_phi, tan_phi = F.sin(phi), F.cos(phi), F.tan(phi)
    n = SEMI_MAJOR_M / F.sqrt(1 - e2 * sin_phi * sin_phi)
    t = tan_phi * tan_phi
    c = ep2 * cos_phi * cos_phi
    a = F.radians(lon - (6 * zone - 183)) * cos_phi
    meridian = SEMI_MAJOR_M * (
        (1 - e2 / 4 - 3 * e2**2 / 64 - 5 * e2**3 / 256) * phi
        - (3 * e2 / 8 + 3 * e2**2 / 32 + 45 * e2**3 / 1024) * F.sin(2 * phi)
        + (15 * e2**2 / 256 + 45 * e2**3 / 1024) * F.sin(4 * phi)
        - (35 * e2**3 / 3072) * F.sin(6 * phi)
    )
    a2 = a * a
    east = a * (1 + a2 * ((1 - t + c) / 6 + a2 * (5 - 18 * t + t * t + 72 * c - 58 * ep2) / 120))
    north = a2 * (
        0.5 + a2 * ((5 - t + 9 * c + 4 * c * c) / 24 + a2 * (61 - 58 * t + t * t + 600 * c - 330 * ep2) / 720)
    )
    return UTM_SCALE * n * east + 500000.0, UTM_SCALE * (meridian + n * tan_phi * north)


def chord_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Straight-line distance through the sphere in metres."""

    def xyz(lat: Column, lon: Column) -> tuple[Column, Column, Column]:
        phi, lam = F.radians(lat), F.radians(lon)
        return F.cos(phi) * F.cos(lam), F.cos(phi) * F.sin(lam), F.sin(phi)

    squares = [(p - q) * (p - q) for p, q in zip(xyz(lat1, lon1), xyz(lat2, lon2))]
    return EARTH_RADIUS_M * F.sqrt(squares[0] + squares[1] + squares[2])


def degrees_of(metres: float) -> float:
    """Latitude span of a distance on the sphere, rounded up a little."""
    return math.degrees(metres / EARTH_RADIUS_M) * 1.0001
