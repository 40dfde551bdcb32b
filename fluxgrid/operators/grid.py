"""Grids and cubes: axes, cells, densifying, slicing, regridding.

A cube is a long table (day, t, lat_i, lon_i, lat, lon, value): one row for each day and cell, t counting days from 0.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fluxgrid.functions.geo import wrapped
from fluxgrid.session import cut, small

CELL = ("lat_i", "lon_i")
# The statistics that a daily resample may ask for by name.
STATISTICS = {"mean": F.avg, "max": F.max, "min": F.min, "sum": F.sum, "median": F.median, "std": F.stddev_samp}


def centres(low: float, high: float, resolution: float) -> list[float]:
    """Cell centres of an axis."""
    return [float(x) for x in np.arange(low + resolution / 2, high, resolution)]


def grid(spark: SparkSession, lats: Sequence[float], lons: Sequence[float]) -> DataFrame:
    """All cells (lat_i, lon_i, lat, lon) of two axes, by their number in row-major order."""
    n, wide = len(lats) * len(lons), max(1, len(lons))
    cell = spark.range(0, n, 1, max(1, min(n // 100_000, 1000)))
    at = cell.select(F.floor(F.col("id") / wide).cast("int").alias("lat_i"), (F.col("id") % wide).cast("int").alias("lon_i"))
    pick = lambda axis, i: F.element_at(F.lit([float(x) for x in axis]), F.col(i) + 1)
    return at.select("lat_i", "lon_i", pick(lats, "lat_i").alias("lat"), pick(lons, "lon_i").alias("lon"))


def normalized_longitudes(df: DataFrame, lon: str = "lon") -> DataFrame:
    """Longitudes from 0 to 360 brought to [-180, 180); a table without any over 180 stays as it is."""
    above = df.agg((F.max(lon) > 180).alias("_above"))
    return df.crossJoin(F.broadcast(above)).withColumn(lon, F.when(F.col("_above"), wrapped(F.col(lon))).otherwise(F.col(lon))).drop("_above")


def domain_slice(cube: DataFrame, lat: tuple[float, float], lon: tuple[float, float], days: tuple[str, str], time: str = "day") -> DataFrame:
    """The rows within a box and within days, all ends included; the conditions reach the scan."""
    start, end = (F.lit(x).cast("date") for x in days)
    return cube.where(F.col("lat").between(*lat) & F.col("lon").between(*lon) & (F.col(time) >= start) & (F.col(time) < F.date_add(end, 1)))


def daily(df: DataFrame, statistic: str, time: str = "ts", value: str = "value", by: Sequence[str] = CELL) -> DataFrame:
    """(day, cell, value): a statistic of each day and cell."""
    if statistic not in STATISTICS:
        raise ValueError(f"unknown statistic {statistic!r}; one of {', '.join(STATISTICS)}")
    return df.groupBy(F.to_date(time).alias("day"), *by).agg(STATISTICS[statistic](value).alias("value"))


#: Days that a task makes at least, of a dense cube.
DAYS = 16


def densified(observed: DataFrame, cells: DataFrame, value: str = "value") -> DataFrame:
    """A cube with a row for each day from the first to the last and each cell; what wasn't observed is null.

    Days are dealt to tasks before each is crossed with the cells.
    """
    spark = observed.sparkSession
    span = observed.agg(F.min("day").alias("a"), F.max("day").alias("b")).first()
    n = (span.b - span.a).days + 1 if span.a else 0
    count = F.col("id").cast("int")
    days = spark.range(0, n, 1, max(1, min(n // DAYS, 4 * spark.sparkContext.defaultParallelism))).select(F.date_add(F.lit(span.a).cast("date"), count).alias("day"), count.alias("t"))
    return days.join(small(cells)).join(observed.select("day", *CELL, value), ["day", *CELL], "left").select("day", "t", *CELL, "lat", "lon", value)


def _along(values: DataFrame, source: Sequence[float], target: Sequence[float], name: str, by: Sequence[str]) -> DataFrame:
    """values(by, _{name}_i, _v) brought to the target's points along one axis, as {name}_i; those outside the hull, or next to a missing value, are left out."""
    rows, x = [], np.asarray(source, float)
    for i, at in enumerate(target):
        if len(x) > 1 and x[0] <= at <= x[-1]:
            k = min(int(np.searchsorted(x, at, "right")) - 1, len(x) - 2)
            w = (at - x[k]) / (x[k + 1] - x[k])
            rows += [(k, i, float(1 - w)), (k + 1, i, float(w))]
    band = values.sparkSession.createDataFrame(rows, f"_{name}_i int, {name}_i int, _w double").coalesce(1)  # two rows for a target
    joined = values.where("_v is not null").join(small(band), f"_{name}_i")
    return joined.groupBy(*by, f"{name}_i").agg(F.when(F.count("*") == 2, F.sum(F.col("_w") * F.col("_v"))).alias("_v"))


def regridded(field: DataFrame, source: tuple[Sequence[float], Sequence[float]], target: tuple[Sequence[float], Sequence[float]], value: str = "value", by: Sequence[str] = (), wrap: bool = False) -> DataFrame:
    """(by, lat_i, lon_i, lat, lon, value): a field brought to other axes, linear along each axis.

    A target outside the source's hull, or with a missing corner, has no value. wrap: the longitudes close to a
    circle, so that a target between the last and the first one has a value. A field whose axes are the target's,
    latitudes within half a step, comes back as it is, so that nothing is smoothed. Latitudes and longitudes are brought
    over one after the other, each value going to the targets that it is next to, after maps are dealt once by what tells
    them apart.
    """
    lats, lons = list(source[0]), list(source[1])
    if same_axes(source, target):
        return field.select(*by, "lat_i", "lon_i", "lat", "lon", value)
    values = field.select(*by, F.col("lat_i").alias("_lat_i"), F.col("lon_i").alias("_lon_i"), F.col(value).cast("double").alias("_v"))
    if wrap:
        n = len(lons)
        lons = [lons[-1] - 360, *lons, lons[0] + 360]
        again = F.when(F.col("_lon_i") == n - 1, F.array(F.lit(n), F.lit(0))).when(F.col("_lon_i") == 0, F.array(F.lit(1), F.lit(n + 1)))
        values = values.withColumn("_lon_i", F.explode(F.coalesce(again, F.array(F.col("_lon_i") + 1))))
    dealt = values.repartition(*by) if by else values
    across = _along(_along(dealt, lats, target[0], "lat", [*by, "_lon_i"]), lons, target[1], "lon", [*by, "lat_i"])
    cells = grid(field.sparkSession, target[0], target[1])
    wanted = cells if not by else values.select(*by).distinct().join(small(cells))
    return wanted.join(across, [*by, *CELL], "left").select(*by, "lat_i", "lon_i", "lat", "lon", F.col("_v").alias(value))


def same_axes(source: tuple[Sequence[float], Sequence[float]], target: tuple[Sequence[float], Sequence[float]]) -> bool:
    """Whether axes have the target's lengths, and its latitudes within half of its step."""
    if any(len(a) != len(b) for a, b in zip(source, target, strict=True)):
        return False
    lats = list(target[0])
    step = lats[1] - lats[0] if len(lats) > 1 else 1.0
    return all(abs(a - b) <= step / 2 for a, b in zip(source[0], lats, strict=True))


def at_level(df: DataFrame, level: int = 0, column: str = "level") -> DataFrame:
    """One level of a table of several, by its place from the lowest value on, without the column; a table without levels stays as it is."""
    if column not in df.columns:
        return df
    order = df.select(column).distinct().orderBy(column).offset(level).limit(1).withColumnRenamed(column, "_level")
    return df.join(F.broadcast(order), F.col(column) == F.col("_level"), "left_semi").drop(column)


def ranked(df: DataFrame, *order: str | Column, name: str = "rank") -> DataFrame:
    """df with the place of each row in an order of all rows, from 1 on, which no two rows may share.

    Rows are dealt by ranges of the order and numbered within each; the numbers of the ranges before are then added, so
    that no task holds more than one range.
    """
    dealt = cut(df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    sizes = dealt.groupBy("_range").agg(F.count("*").alias("_n"))
    starts = sizes.select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    own = F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    return dealt.join(F.broadcast(starts), "_range").withColumn(name, (F.col("_before") + own).cast("bigint")).drop("_range", "_before")


#: Ranks of a block of running sums.
BLOCK = 1 << 16


def running(df: DataFrame, rank: str, *columns: str) -> DataFrame:
    """df with each column as its sum over all rows up to its own rank, nulls as 0; blocks of ranks are added up first."""
    blocked = df.withColumn("_block", F.floor(F.col(rank) / BLOCK))
    filled = {c: F.coalesce(F.col(c), F.lit(0)) for c in columns}
    sums = blocked.groupBy("_block").agg(*(F.sum(x).alias(f"_{c}") for c, x in filled.items()))
    before = Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)  # a row for each block
    starts = sums.select("_block", *(F.coalesce(F.sum(f"_{c}").over(before), F.lit(0)).alias(f"_{c}") for c in columns))
    inside = Window.partitionBy("_block").orderBy(rank).rowsBetween(Window.unboundedPreceding, 0)
    own = {c: F.col(f"_{c}") + F.sum(x).over(inside) for c, x in filled.items()}
    return blocked.join(F.broadcast(starts), "_block").withColumns(own).drop("_block", *(f"_{c}" for c in columns))


def first_by(df: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """The first row of each key in an explicit order; nothing depends on how rows are dealt."""
    rank = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    return df.withColumn("_rank", rank).where("_rank = 1").drop("_rank")
