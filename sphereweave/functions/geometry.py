"""Column builders for points on the unit sphere. Angles are in degrees, areas in steradians."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

POLE_DEGREES = 1e-6
POLE_UNIT = 1e-12
EARTH_KM = 6371.0


def lonlat_to_xyz(lon: Column, lat: Column) -> tuple[Column, Column, Column]:
    x, y = F.radians(lon), F.radians(lat)
    return F.cos(y) * F.cos(x), F.cos(y) * F.sin(x), F.sin(y)


def xyz_to_lonlat(x: Column, y: Column, z: Column) -> tuple[Column, Column]:
    """lon in [0, 360); at a pole lon is 0 and lat exactly +-90."""
    n = F.sqrt(x * x + y * y + z * z)
    u = z / n
    pole = F.abs(u) >= 1 - POLE_UNIT
    lon = F.degrees(F.atan2(y, x))
    return (F.when(pole, F.lit(0.0)).otherwise(F.when(lon < 0, lon + 360.0).otherwise(lon)),
            F.when(pole, F.signum(u) * 90.0).otherwise(F.degrees(F.asin(u))))


def normalize_longitude(lon: Column) -> Column:
    return F.pmod(lon, F.lit(360.0))


def is_at_pole(lat: Column) -> Column:
    return F.abs(F.abs(lat) - 90.0) < POLE_DEGREES


def area_radius(area: Column, alpha: float = 1.0) -> Column:
    """The angle (radians) of the disk that stands for an area."""
    return F.lit(float(alpha)) * F.sqrt(area / math.pi)


def angle_to_chord(angle: Column) -> Column:
    """Grows up to the angle pi and stays there."""
    return 2.0 * F.sin(F.least(angle, F.lit(math.pi)) / 2.0)


def chord_to_angle(chord: Column) -> Column:
    return 2.0 * F.asin(F.least(chord / 2.0, F.lit(1.0)))


def chord(x1: Column, y1: Column, z1: Column, x2: Column, y2: Column, z2: Column) -> Column:
    dx, dy, dz = x1 - x2, y1 - y2, z1 - z2
    return F.sqrt(dx * dx + dy * dy + dz * dz)


def haversine_degrees(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    s, t = F.sin(F.radians(lat2 - lat1) / 2.0), F.sin(F.radians(lon2 - lon1) / 2.0)
    a = s * s + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * t * t
    a = F.least(a, F.lit(1.0))
    return F.degrees(2.0 * F.atan2(F.sqrt(a), F.sqrt(1.0 - a)))


def lonlat_chord(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    return chord(*lonlat_to_xyz(lon1, lat1), *lonlat_to_xyz(lon2, lat2))


METRICS = {"haversine": haversine_degrees, "cartesian": lonlat_chord}


def distance(metric: str, lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """By the metric's name: degrees of the great circle, or the chord."""
    if metric not in METRICS:
        raise ValueError(f"the metric is one of {sorted(METRICS)}")
    return METRICS[metric](lon1, lat1, lon2, lat2)


def great_circle(x1: Column, y1: Column, z1: Column, x2: Column, y2: Column, z2: Column, radius: float = 1.0) -> Column:
    dot = x1 * x2 + y1 * y2 + z1 * z2
    return F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot))) * radius


def linear_index(ilat: Column, ilon: Column, nlon: int) -> Column:
    return ilat * nlon + ilon


def grid_indices(pid: Column, nlon: int) -> tuple[Column, Column]:
    return F.floor(pid / nlon).cast("long"), F.pmod(pid, F.lit(nlon))


def km2_to_sr(km2: float) -> float:
    return km2 / EARTH_KM ** 2
