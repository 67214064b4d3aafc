"""Coordinates as native column expressions: local systems, datum conversion, plausibility of pairs."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Ellipsoids (semi-major axis, inverse flattening) and Helmert parameters to WGS84
#: (metres, arc seconds, parts per million) of national datums.
ELLIPSOIDS = {"WGS84": (6378137.0, 298.257223563), "SK-42": (6378245.0, 298.3), "GSK-2011": (6378136.5, 298.2564151)}
TO_WGS84 = {"WGS84": (0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0), "SK-42": (23.57, -140.95, -79.8, 0.0, -0.35, -0.79, -0.22), "GSK-2011": (0.013, -0.092, -0.03, -0.001738, 0.003559, -0.004263, 0.0074)}


def to_local(x: Column, y: Column, dx: float, dy: float, rotation: float, scale: float) -> tuple[Column, Column]:
    """Shift, then rotation (radians) and scale."""
    c, s = math.cos(rotation) * scale, math.sin(rotation) * scale
    return (x - dx) * c - (y - dy) * s, (x - dx) * s + (y - dy) * c


def from_local(x: Column, y: Column, dx: float, dy: float, rotation: float, scale: float) -> tuple[Column, Column]:
    c, s = math.cos(rotation) / scale, math.sin(rotation) / scale
    return x * c + y * s + dx, -x * s + y * c + dy


def _geocentric(lat: Column, lon: Column, datum: str) -> tuple[Column, Column, Column]:
    a, f = ELLIPSOIDS[datum]
    e2 = (2 - 1 / f) / f
    phi, lam = F.radians(lat), F.radians(lon)
    n = a / F.sqrt(1 - e2 * F.sin(phi) * F.sin(phi))
    return n * F.cos(phi) * F.cos(lam), n * F.cos(phi) * F.sin(lam), n * (1 - e2) * F.sin(phi)


def _geodetic(x: Column, y: Column, z: Column, datum: str) -> tuple[Column, Column]:
    """Bowring's closed form for points near the ellipsoid."""
    a, f = ELLIPSOIDS[datum]
    e2 = (2 - 1 / f) / f
    b = a * (1 - 1 / f)
    p = F.sqrt(x * x + y * y)
    theta = F.atan2(z * a, p * b)
    lat = F.atan2(z + (a * a - b * b) / b * F.pow(F.sin(theta), 3), p - e2 * a * F.pow(F.cos(theta), 3))
    return F.degrees(lat), F.degrees(F.atan2(y, x))


def convert(lat: Column, lon: Column, source: str, target: str) -> tuple[Column, Column]:
    """Seven-parameter conversion by way of WGS84."""
    x, y, z = _geocentric(lat, lon, source)
    for datum, sign in ((source, 1), (target, -1)):
        tx, ty, tz, rx, ry, rz, m = (sign * v for v in TO_WGS84[datum])
        rx, ry, rz = (math.radians(v / 3600) for v in (rx, ry, rz))
        k = 1 + m * 1e-6
        x, y, z = k * (x + rz * y - ry * z) + tx, k * (y - rz * x + rx * z) + ty, k * (z + ry * x - rx * y) + tz
    return _geodetic(x, y, z, target)


def bare_pair_plausible(a: Column, b: Column) -> Column:
    """Whether two decimals as text look like a coordinate pair rather than prices, dates or table cells."""
    x, y = a.try_cast("double"), b.try_cast("double")
    fa, fb = F.length(F.split_part(a, F.lit("."), F.lit(2))), F.length(F.split_part(b, F.lit("."), F.lit(2)))
    month_year = a.rlike(r"^(0?[1-9]|1[0-2])\.(19|20)[0-9]{2}$") | b.rlike(r"^(0?[1-9]|1[0-2])\.(19|20)[0-9]{2}$")
    padded = a.rlike(r"\.[0-9]*00000$") | b.rlike(r"\.[0-9]*00000$")
    high, low = F.greatest(x, y), F.least(x, y)
    ratio = F.when(low != 0, F.abs(high / low - F.round(high / low)) < 1e-9)
    ok = (F.abs(x) <= 90) & (F.abs(y) <= 180) & (F.abs(x) >= 1) & (F.abs(y) >= 1) & (x != y) & (fa >= 4) & (fb >= 4) & (F.abs(fa - fb) <= 1)
    return F.coalesce(ok & ~month_year & ~padded & ~F.coalesce(ratio, F.lit(False)), F.lit(False))
