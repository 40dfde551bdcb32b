"""Distances and lengths on the sphere, as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_RADIUS_KM = 6371.0
EARTH_AREA_KM2 = 4 * math.pi * EARTH_RADIUS_KM**2
#: Kilometres of a degree of latitude in gradients.
KM_PER_DEGREE = 111.32
#: A lower bound of the kilometres of a degree along a great circle of EARTH_RADIUS_KM; bands made with it lose no pair.
KM_PER_DEGREE_AT_LEAST = 111.19


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance in kilometres."""
    half_lat, half_lon = F.radians(lat2 - lat1) / 2, F.radians(lon2 - lon1) / 2
    a = F.pow(F.sin(half_lat), F.lit(2.0)) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(half_lon), F.lit(2.0))
    return F.lit(2 * EARTH_RADIUS_KM) * F.asin(F.sqrt(F.least(F.lit(1.0), a)))


def wrapped(lon: Column) -> Column:
    """A longitude in [-180, 180)."""
    return F.pmod(lon + 180.0, F.lit(360.0)) - 180.0


def no_nan(x: Column) -> Column:
    """NaN becomes null: Spark takes NaN for larger than any number."""
    return F.when(~F.isnan(x), x)
