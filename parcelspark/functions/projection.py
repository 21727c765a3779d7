"""WGS84 projections as column expressions.

Equal-area cylindrical axes give ellipsoidal areas by the shoelace sum; the
UTM series (Krueger, 4th order in n) gives metric lengths. Both are closed
forms in longitude and latitude, so a whole layer is projected in one map.
"""

from __future__ import annotations

from math import sqrt

from pyspark.sql import Column
from pyspark.sql import functions as F

from .geometry import map_points, point, polygon_area

# WGS84 ellipsoid and UTM constants.
WGS84_A = 6378137.0
WGS84_F = 1 / 298.257223563
UTM_K0 = 0.9996
UTM_FALSE_EASTING = 500000.0

_E2 = WGS84_F * (2 - WGS84_F)
_E = sqrt(_E2)
_N = WGS84_F / (2 - WGS84_F)
_RECTIFYING = WGS84_A / (1 + _N) * (1 + _N**2 / 4 + _N**4 / 64)
_ALPHA = (
    _N / 2 - 2 * _N**2 / 3 + 5 * _N**3 / 16 + 41 * _N**4 / 180,
    13 * _N**2 / 48 - 3 * _N**3 / 5 + 557 * _N**4 / 1440,
    61 * _N**3 / 240 - 103 * _N**4 / 140,
    49561 * _N**4 / 161280,
)
_BETA = (
    _N / 2 - 2 * _N**2 / 3 + 37 * _N**3 / 96 - _N**4 / 360,
    _N**2 / 48 + _N**3 / 15 - 437 * _N**4 / 1440,
    17 * _N**3 / 480 - 37 * _N**4 / 840,
    4397 * _N**4 / 161280,
)
_DELTA = (
    2 * _N - 2 * _N**2 / 3 - 2 * _N**3 + 116 * _N**4 / 45,
    7 * _N**2 / 3 - 8 * _N**3 / 5 - 227 * _N**4 / 45,
    56 * _N**3 / 15 - 136 * _N**4 / 35,
    4279 * _N**4 / 630,
)


def _authalic_q(lat: Column) -> Column:
    s = F.sin(F.radians(lat))
    return (1 - _E2) * (s / (1 - _E2 * s * s) + F.atanh(_E * s) / _E)


def equal_area(lon: Column, lat: Column) -> Column:
    """Ellipsoidal equal-area cylindrical position in metres."""
    return point(WGS84_A * F.radians(lon), WGS84_A * _authalic_q(lat) / 2)


def geodesic_area(rings: Column | str) -> Column:
    """Ellipsoidal area of a lon/lat polygon in square metres."""
    return polygon_area(map_points(rings, equal_area))


def utm_forward(lon: Column, lat: Column, zone: int, south: bool = False) -> Column:
    lon0 = -183.0 + 6 * zone
    s = F.sin(F.radians(lat))
    t = F.sinh(F.atanh(s) - _E * F.atanh(_E * s))
    dl = F.radians(lon - lon0)
    xi = F.atan2(t, F.cos(dl))
    eta = F.asinh(F.sin(dl) / F.sqrt(t * t + F.cos(dl) * F.cos(dl)))
    x, y = eta, xi
    for j, alpha in enumerate(_ALPHA, start=1):
        x = x + alpha * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
        y = y + alpha * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
    scale = UTM_K0 * _RECTIFYING
    return point(
        UTM_FALSE_EASTING + scale * x, scale * y + (10_000_000.0 if south else 0.0)
    )


def utm_inverse(easting: Column, northing: Column, zone: int, south: bool = False) -> Column:
    lon0 = -183.0 + 6 * zone
    scale = UTM_K0 * _RECTIFYING
    xi = (northing - (10_000_000.0 if south else 0.0)) / scale
    eta = (easting - UTM_FALSE_EASTING) / scale
    xp, ep = xi, eta
    for j, beta in enumerate(_BETA, start=1):
        xp = xp - beta * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
        ep = ep - beta * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
    chi = F.asin(F.sin(xp) / F.cosh(ep))
    lat = chi
    for j, delta in enumerate(_DELTA, start=1):
        lat = lat + delta * F.sin(2 * j * chi)
    lon = F.lit(lon0) + F.degrees(F.atan2(F.sinh(ep), F.cos(xp)))
    return point(lon, F.degrees(lat))


def to_utm(rings: Column | str, zone: int = 45, south: bool = False) -> Column:
    return map_points(rings, lambda x, y: utm_forward(x, y, zone, south))


def from_utm(rings: Column | str, zone: int = 45, south: bool = False) -> Column:
    return map_points(rings, lambda x, y: utm_inverse(x, y, zone, south))


def round_trip_shift(rings: Column | str, zone: int = 45) -> Column:
    """Largest coordinate change of metres -> lon/lat -> metres, per polygon."""
    from .geometry import exterior

    back = to_utm(from_utm(rings, zone), zone)
    return F.array_max(
        F.zip_with(
            exterior(rings), exterior(back),
            lambda p, q: F.greatest(F.abs(p["x"] - q["x"]), F.abs(p["y"] - q["y"])),
        )
    )
