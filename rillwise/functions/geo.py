"""Positions: validity, projection, distances. All are column expressions, so they stay in generated code."""

from __future__ import annotations

from math import sqrt

import numpy as np
from pyspark.sql import Column, functions as F

# The WGS84 ellipsoid, UTM zone 45 N, the sphere of the haversine distance, local metres of a degree.
A_WGS84, F_WGS84 = 6378137.0, 1 / 298.257223563
SCALE, EAST, LON0 = 0.9996, 500000.0, 87.0
EARTH_M = 6371000.0
M_PER_DEGREE = (111320.0, 110540.0)
CITY_BOX = (88.20, 22.40, 88.55, 22.75)

_n = F_WGS84 / (2 - F_WGS84)
_RADIUS = A_WGS84 / (1 + _n) * (1 + _n**2 / 4 + _n**4 / 64)
_ALPHA = (_n / 2 - 2 * _n**2 / 3 + 5 * _n**3 / 16, 13 * _n**2 / 48 - 3 * _n**3 / 5, 61 * _n**3 / 240)
_BETA = (_n / 2 - 2 * _n**2 / 3 + 37 * _n**3 / 96, _n**2 / 48 + _n**3 / 15, 17 * _n**3 / 480)
_DELTA = (2 * _n - 2 * _n**2 / 3 - 2 * _n**3, 7 * _n**2 / 3 - 8 * _n**3 / 5, 56 * _n**3 / 15)
_E = 2 * sqrt(_n) / (1 + _n)


def valid_latlon(lat: Column, lon: Column) -> Column:
    """Numeric, finite and on the globe; never null."""
    lat, lon = (c.cast("string").try_cast("double") for c in (lat, lon))
    ok = ~F.isnan(lat) & ~F.isnan(lon) & (F.abs(lat) <= 90) & (F.abs(lon) <= 180)
    return F.coalesce(ok, F.lit(False))


def utm_xy(lat: Column, lon: Column) -> tuple[Column, Column]:
    """UTM 45 N easting and northing."""
    sin = F.sin(F.radians(lat))
    t = F.sinh(F.atanh(sin) - _E * F.atanh(_E * sin))
    d = F.radians(lon - LON0)
    xi, eta = F.atan2(t, F.cos(d)), F.atanh(F.sin(d) / F.sqrt(1 + t * t))
    x, y = eta, xi
    for j, a in enumerate(_ALPHA, 1):
        x = x + a * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
        y = y + a * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
    return EAST + SCALE * _RADIUS * x, SCALE * _RADIUS * y


def utm_to_latlon(x: Column, y: Column) -> tuple[Column, Column]:
    """Latitude and longitude, 6 decimals."""
    xi, eta = y / (SCALE * _RADIUS), (x - EAST) / (SCALE * _RADIUS)
    a, b = xi, eta
    for j, c in enumerate(_BETA, 1):
        a = a - c * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
        b = b - c * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
    chi = F.asin(F.sin(a) / F.cosh(b))
    lat = chi
    for j, c in enumerate(_DELTA, 1):
        lat = lat + c * F.sin(2 * j * chi)
    return F.round(F.degrees(lat), 6), F.round(LON0 + F.degrees(F.atan2(F.sinh(b), F.cos(a))), 6)


def haversine_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * EARTH_M * F.asin(F.sqrt(F.when(a > 1, 1.0).otherwise(a)))


def local_xy_m(lat: Column, lon: Column, lat0: Column, lon0: Column) -> tuple[Column, Column]:
    """Metres east and north of an origin near by (equirectangular)."""
    return (lon - lon0) * M_PER_DEGREE[0] * F.cos(F.radians(lat0)), (lat - lat0) * M_PER_DEGREE[1]


def _lambert(m, lat1, lon1, lat2, lon2):
    """What is 0 where two places are one, and their distance where they aren't, by the functions of module m: of columns or of arrays."""
    b1, b2 = (m.atan((1 - F_WGS84) * m.tan(m.radians(c))) for c in (lat1, lat2))
    a = m.pow(m.sin((b2 - b1) / 2), 2) + m.cos(b1) * m.cos(b2) * m.pow(m.sin(m.radians(lon2 - lon1) / 2), 2)
    s = 2 * m.asin(m.sqrt(a))
    p, q = (b1 + b2) / 2, (b2 - b1) / 2
    x = (s - m.sin(s)) * m.pow(m.sin(p) * m.cos(q) / m.cos(s / 2), 2)
    y = (s + m.sin(s)) * m.pow(m.cos(p) * m.sin(q) / m.sin(s / 2), 2)
    return a, A_WGS84 * (s - F_WGS84 / 2 * (x + y))


def geodesic_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Distance on the ellipsoid by Lambert's formula: metres per 100 km off at most, made for short ranges."""
    a, d = _lambert(F, lat1, lon1, lat2, lon2)
    return F.when(a == 0, 0.0).otherwise(d)


def geodesic_of(lat1: np.ndarray, lon1: np.ndarray, lat2: np.ndarray, lon2: np.ndarray) -> np.ndarray:
    """geodesic_m of arrays."""
    with np.errstate(invalid="ignore", divide="ignore"):
        a, d = _lambert(np, lat1, lon1, lat2, lon2)
    return np.where(a == 0, 0.0, d)


def extent_m(south: Column, west: Column, north: Column, east: Column) -> Column:
    """Half the diagonal of a bounding box."""
    return geodesic_m(south, west, north, east) / 2


def in_bbox(lat: Column, lon: Column, box: tuple[float, float, float, float] = CITY_BOX) -> Column:
    """(west, south, east, north), edges included; null for a missing position."""
    west, south, east, north = box
    return lat.between(south, north) & lon.between(west, east)


def segment_distance(px: Column, py: Column, x0: Column, y0: Column, x1: Column, y1: Column) -> tuple[Column, Column]:
    """Distance from a point to a segment, and where along it (0 to 1) the nearest place lies."""
    dx, dy = x1 - x0, y1 - y0
    square = dx * dx + dy * dy
    t = F.when(square == 0, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((px - x0) * dx + (py - y0) * dy) / square)))
    east, north = px - x0 - t * dx, py - y0 - t * dy
    return F.sqrt(east * east + north * north), t  # a power of 2 is this product too, but takes many times as long
