"""Coordinates: affine pixels, UTM, web Mercator and distances on the sphere, all as columns."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

HAVERSINE_KM, GREAT_CIRCLE_M = 6367.0, 6371009.0
# WGS 84 and the UTM scale, as fixed values.
_A, _F, _K0 = 6378137.0, 1 / 298.257223563, 0.9996


def utm_zone(lon: Column, legacy: bool = False) -> Column:
    """The zone of a longitude; `legacy` leaves out the + 1."""
    return ((lon + 180) / 6).cast("int") if legacy else (F.floor((lon + 180) / 6) % 60 + 1).cast("int")


def utm_epsg(lat: Column, lon: Column, legacy: bool = False) -> Column:
    return F.when(lat >= 0, 32600).otherwise(32700) + utm_zone(lon, legacy)


def utm(lat: Column, lon: Column, zone: Column) -> tuple[Column, Column]:
    """(east, north) in a UTM zone, by the transverse Mercator series of third order in the flattening (under a millimetre)."""
    n = _F / (2 - _F)
    a = _A / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    alpha = (n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16, 13 * n**2 / 48 - 3 * n**3 / 5, 61 * n**3 / 240)
    e = 2 * math.sqrt(n) / (1 + n)
    s = F.sin(F.radians(lat))
    t = F.sinh(F.atanh(s) - e * F.atanh(e * s))
    d = F.radians(lon - (zone * 6 - 183))
    xi, eta = F.atan2(t, F.cos(d)), F.atanh(F.sin(d) / F.sqrt(1 + t * t))
    east, north = eta, xi
    for j, c in enumerate(alpha, 1):
        east = east + c * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
        north = north + c * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
    return 500000 + _K0 * a * east, F.when(lat < 0, 10000000.0).otherwise(0.0) + _K0 * a * north


def pixel_to_geo(x: Column, y: Column, transform: Column) -> tuple[Column, Column]:
    """Affine map by (xmin, xres, 0, ymax, 0, yres)."""
    return x * F.get(transform, F.lit(1)) + F.get(transform, F.lit(0)), y * F.get(transform, F.lit(5)) + F.get(transform, F.lit(3))


def geo_to_pixel(lon: Column, lat: Column, transform: Column, whole: bool = True) -> tuple[Column, Column]:
    """The inverse; `whole` cuts toward zero."""
    x = (lon - F.get(transform, F.lit(0))) / F.get(transform, F.lit(1))
    y = (lat - F.get(transform, F.lit(3))) / F.get(transform, F.lit(5))
    return (x.cast("int"), y.cast("int")) if whole else (x, y)


def mercator_to_lonlat(x: Column, y: Column) -> tuple[Column, Column]:
    """EPSG:3857 to degrees."""
    return F.degrees(x / _A), F.degrees(2 * F.atan(F.exp(y / _A)) - math.pi / 2)


def _half_chord(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    s, t = F.sin(F.radians(lat2 - lat1) / 2), F.sin(F.radians(lon2 - lon1) / 2)
    return s * s + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * t * t


def haversine(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Metres on a sphere of 6367 km."""
    return 2 * F.asin(F.sqrt(_half_chord(lat1, lon1, lat2, lon2))) * HAVERSINE_KM * 1000


def great_circle(lat1: Column, lon1: Column, lat2: Column, lon2: Column, radius: float = GREAT_CIRCLE_M) -> Column:
    """Metres on a sphere of `radius`; antipodes are kept in range."""
    return 2 * F.asin(F.sqrt(F.least(F.lit(1.0), _half_chord(lat1, lon1, lat2, lon2)))) * radius


def pixel_size(transform: Column, rows: Column, cols: Column) -> tuple[Column, Column]:
    """Metres a pixel is wide and high, over the whole extent."""
    x0, y0 = F.get(transform, F.lit(0)), F.get(transform, F.lit(3))
    x1, y1 = pixel_to_geo(cols, rows, transform)
    return haversine(x0, y0, x1, y0) / cols, haversine(x0, y0, x0, y1) / rows


def footprint(transform: Column, rows: Column, cols: Column) -> Column:
    """The closed ring of a tile's corners, as points."""
    zero = F.lit(0)
    corners = [pixel_to_geo(x, y, transform) for x, y in ((zero, zero), (cols, zero), (cols, rows), (zero, rows), (zero, zero))]
    return F.array(*(F.struct(x.cast("double").alias("x"), y.cast("double").alias("y")) for x, y in corners))
