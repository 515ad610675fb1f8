"""Distances and directions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_M = 6_371_000.0


def haversine_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance in metres."""
    half = lambda a, b: F.pow(F.sin(F.radians(b - a) / 2), F.lit(2))
    return 2 * EARTH_M * F.asin(F.sqrt(half(lat1, lat2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * half(lon1, lon2)))


def within_degrees(a: Column, b: Column, limit: float) -> Column:
    """Whether two bearings differ by at most ``limit`` around the circle."""
    d = F.pmod(a - b + 180, F.lit(360)) - 180
    return F.abs(d) <= limit


def opposite(bearing: Column) -> Column:
    return F.pmod(bearing + 180, F.lit(360))
