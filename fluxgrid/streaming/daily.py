"""Daily statistics of a stream of readings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fluxgrid.operators.grid import CELL, STATISTICS


def daily_stream(readings: DataFrame, statistic: str, late: str = "1 day", time: str = "ts", value: str = "value") -> DataFrame:
    """(day, cell, value) of a stream: a day is given once its watermark has passed; readings later than that are dropped."""
    grouped = readings.withWatermark(time, late).groupBy(F.window(time, "1 day").alias("w"), *CELL)
    return grouped.agg(STATISTICS[statistic](value).alias("value")).select(F.to_date("w.start").alias("day"), *CELL, "value")
