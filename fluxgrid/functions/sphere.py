"""Cells of the sphere, as column expressions: for joins by distance that work alike at all latitudes.

Latitudes are cut into rings of one width, and each ring into as many cells as its longest circle has room for, so that
no cell is narrower than the width, and few are needed near the poles. A cell is a number; what lies within a reach of a
place is covered by a few of them, across the date line and over the poles as well.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

_RING = 1 << 22


def width(reach_deg: float) -> float:
    """The width of cells, in degrees, for searches of a reach; 180 is one ring."""
    return min(180.0, max(reach_deg, 0.01))


def _ring(lat: Column, size: float) -> Column:
    last = max(0, math.ceil(180.0 / size) - 1)
    return F.greatest(F.lit(0), F.least(F.lit(last), F.floor((lat + 90.0) / size))).cast("int")


def _cells_of(ring: Column, size: float) -> Column:
    """How many cells a ring has."""
    south = ring * size - 90.0
    north = south + size
    widest = F.when((south <= 0) & (north >= 0), F.lit(0.0)).otherwise(F.least(F.abs(south), F.abs(north)))
    return F.greatest(F.lit(1), F.floor(360.0 * F.cos(F.radians(widest)) / size)).cast("int")


def cell(lat: Column, lon: Column, size: float) -> Column:
    """The number of a place's cell; null for a place without a latitude or longitude."""
    ring = _ring(lat, size)
    n = _cells_of(ring, size)
    return (ring * F.lit(_RING) + F.pmod(F.floor(F.pmod(lon + 180.0, F.lit(360.0)) / 360.0 * n), n)).cast("bigint")


def cover(lat: Column, lon: Column, reach_deg: float, size: float) -> Column:
    """An array of the numbers of all cells that hold any place within the reach; each once. Empty for a place without latitude or longitude."""
    reach = reach_deg + 1e-6
    half = F.when(F.abs(lat) + reach < 90.0, F.degrees(F.asin(F.least(F.lit(1.0), F.sin(F.radians(F.lit(min(reach, 90.0)))) / F.cos(F.radians(lat)))))).otherwise(F.lit(180.0)) + 1e-6

    def ring_cells(ring: Column) -> Column:
        n = _cells_of(ring, size)
        first = F.floor((lon - half + 180.0) / 360.0 * n)
        last = F.least(F.floor((lon + half + 180.0) / 360.0 * n), first + n - 1)
        return F.transform(F.sequence(first, last), lambda k: (ring * F.lit(_RING) + F.pmod(k, n)).cast("bigint"))

    known = lat.isNotNull() & lon.isNotNull() & ~F.isnan(lat) & ~F.isnan(lon)
    rings = F.sequence(_ring(lat - reach, size), _ring(lat + reach, size))
    return F.when(known, F.flatten(F.transform(rings, ring_cells))).otherwise(F.array().cast("array<bigint>"))
