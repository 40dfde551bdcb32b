"""The stress field, its threshold and the flagged cells."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fluxgrid.functions import permittivity as P
from fluxgrid.functions.geo import no_nan
from fluxgrid.functions.stats import quantile
from fluxgrid.operators.grid import CELL
from fluxgrid.session import small

LEAST_EPS = 1e-6


def with_permittivity(terrain: DataFrame, method: str, eps_min: float, eps_max: float, params: dict[str, float], slope: str | None = "slope") -> DataFrame:
    """terrain(cell, elevation, slope) with eps."""
    if slope is None or method in ("linear", "log"):
        column = P.permittivity(method, P.Terrain(F.col("elevation"), params=params), eps_min, eps_max)
        return terrain.withColumn("eps", column)
    steep = quantile(terrain, slope, 0.99, "_p99")
    column = P.permittivity(method, P.Terrain(F.col("elevation"), F.col(slope), F.col("_p99"), params), eps_min, eps_max)
    return terrain.crossJoin(F.broadcast(steep)).withColumn("eps", column).drop("_p99")


def breakdown(charged: DataFrame, terrain: DataFrame) -> DataFrame:
    """The cube with eps and E, the gradient of its charge over the permittivity; cells that either side lacks are left out."""
    joined = charged.join(small(terrain.select(*CELL, "eps")), list(CELL))
    return joined.withColumn("E", no_nan(F.col("gradient") / F.greatest("eps", F.lit(LEAST_EPS))))


def within(field: DataFrame, lat_limit: float | None) -> DataFrame:
    return field if lat_limit is None else field.where(F.abs("lat") <= lat_limit)


def threshold(field: DataFrame, mode: str, value: float, lat_limit: float | None) -> DataFrame:
    """One row with thr: a percentile of E over all days within the latitudes, or the value itself."""
    if mode == "percentile":
        return quantile(within(field, lat_limit).select("E"), "E", value / 100.0, "thr")
    if mode == "absolute":
        return field.sparkSession.range(1).select(F.lit(float(value)).alias("thr"))
    raise ValueError(f"unknown threshold mode {mode!r}; 'percentile' or 'absolute'")


def flagged(field: DataFrame, thr: DataFrame, lat_limit: float | None) -> DataFrame:
    """The cells within the latitudes whose E is over the threshold."""
    return within(field, lat_limit).crossJoin(F.broadcast(thr)).where("E > thr").drop("thr")
