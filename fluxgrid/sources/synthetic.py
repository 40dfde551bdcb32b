"""Synthetic terrain and temperature with a planted event, as column expressions; noise is a hash of place and day."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass
from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fluxgrid.config import Domain
from fluxgrid.operators.grid import centres, grid
from fluxgrid.operators.spatial import gradient
from fluxgrid.session import small

GRAVITY = 9.80665
# Fixed values of the synthetic scene: mountains (lat, lon, height m, width deg), and the planted event.
MOUNTAINS = ((35.0, 80.0, 5000.0, 12.0), (45.0, -110.0, 3500.0, 14.0), (-20.0, -65.0, 4500.0, 10.0))
EVENT = {"lat": 33.0, "lon": 78.0, "width_deg": 6.0, "ramp_days": 25, "kelvin": 14.0}


def normal(*keys: Column, seed: int) -> Column:
    """A standard normal number of the keys by Box and Muller; the same however rows are dealt."""
    uniform = lambda n: (F.pmod(F.xxhash64(*keys, F.lit(seed), F.lit(n)), F.lit(1 << 40)) + 0.5) / float(1 << 40)
    return F.sqrt(-2.0 * F.ln(uniform(1))) * F.cos(2 * math.pi * uniform(2))


def terrain(spark: SparkSession, lats: Sequence[float], lons: Sequence[float], seed: int = 42, noise: float = 50.0) -> DataFrame:
    """(cell, lat, lon, elevation, slope) of the scene's mountains."""
    height = F.lit(0.0)
    for lat, lon, top, width in MOUNTAINS:
        away = F.pow(F.col("lat") - lat, F.lit(2.0)) + F.pow(F.col("lon") - lon, F.lit(2.0))
        height = height + top * F.exp(-away / (2 * width**2))
    rough = F.greatest(F.lit(-200.0), F.least(F.lit(200.0), noise * normal(F.col("lat_i"), F.col("lon_i"), seed=seed)))
    high = grid(spark, lats, lons).withColumn("elevation", F.greatest(F.lit(0.0), height + rough)).withColumn("map", F.lit(0))
    return gradient(high, "elevation", ["map"], "slope", km=False).drop("map")


def temperature(spark: SparkSession, lats: Sequence[float], lons: Sequence[float], start: str, end: str, seed: int = 42, noise: float = 1.2) -> DataFrame:
    """A cube of temperatures: warm at the equator, seasons by hemisphere, and a heat wave that grows and fades."""
    n, t = (date.fromisoformat(end) - date.fromisoformat(start)).days + 1, F.col("id").cast("int")
    days = spark.range(max(n, 0)).select(F.date_add(F.lit(start).cast("date"), t).alias("day"), t.alias("t"))  # dealt to all tasks
    lat, lon = F.col("lat"), F.col("lon")
    season = F.sin(2 * math.pi * (F.dayofyear("day") - 80) / 365.25)
    away = F.pow(lat - EVENT["lat"], F.lit(2.0)) + F.pow(lon - EVENT["lon"], F.lit(2.0))
    ramp = F.greatest(F.lit(0.0), 1 - F.abs(F.col("t") - n // 3) / EVENT["ramp_days"])
    value = (
        288.0 - 0.45 * F.abs(lat) + (2.0 + 0.25 * F.abs(lat)) * season * F.signum(lat)
        + EVENT["kelvin"] * ramp * F.exp(-away / (2 * EVENT["width_deg"] ** 2))
    )
    if noise:
        value = value + noise * normal(F.col("t"), F.col("lat_i"), F.col("lon_i"), seed=seed)
    return days.crossJoin(small(grid(spark, lats, lons))).select("day", "t", "lat_i", "lon_i", "lat", "lon", value.alias("value"))


@dataclass(frozen=True)
class Scene:
    """A synthetic cube, the terrain below it, and one row (lat, lon, width_deg, ramp_days, kelvin, peak_day) of the planted event."""

    cube: DataFrame
    terrain: DataFrame
    event: DataFrame


def scene(spark: SparkSession, domain: Domain, start: str, end: str, seed: int = 42, noise: bool = True) -> Scene:
    """Temperature, terrain and planted event on the grid of a domain."""
    lats, lons = centres(domain.lat_min, domain.lat_max, domain.resolution_deg), centres(domain.lon_min, domain.lon_max, domain.resolution_deg)
    first, last = F.lit(start).cast("date"), F.lit(end).cast("date")
    event = spark.range(1).select(*(F.lit(v).alias(k) for k, v in EVENT.items()), F.date_add(first, F.floor((F.datediff(last, first) + 1) / 3).cast("int")).alias("peak_day"))
    own = {} if noise else {"noise": 0.0}
    return Scene(temperature(spark, lats, lons, start, end, seed, **own), terrain(spark, lats, lons, seed, **own), event)
