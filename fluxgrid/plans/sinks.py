"""What a run leaves behind: cubes, catalogs, reports, and tables to draw from."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from fluxgrid.config import Validation
from fluxgrid.functions.stats import quantiles


def write_cube(cube: DataFrame, path: str) -> None:
    """A cube as Parquet by year and month, so that slices of time read their own files."""
    parts = cube.withColumn("year", F.year("day")).withColumn("month", F.month("day"))
    parts.repartition("year", "month").sortWithinPartitions("lat_i", "lon_i", "day").write.mode("overwrite").partitionBy("year", "month").parquet(path)


def write_catalog(catalog: DataFrame, path: str) -> None:
    """A catalog as one CSV file with a head, strongest events first."""
    catalog.orderBy(F.desc("peak_E"), "event_id").coalesce(1).write.mode("overwrite").csv(path, header=True)


def report_lines(report: DataFrame) -> list[str]:
    """A report of a few rows as lines of text."""
    return [", ".join(f"{k} {v:.4g}" if isinstance(v, float) else f"{k} {v}" for k, v in row.asDict().items()) for row in report.collect()]


def validation_lines(row: Row, targets: Validation) -> list[str]:
    """A scored report, with meets_targets() columns, as lines to read."""
    share = lambda x: "none" if x is None else f"{100 * x:.2f} %"
    mark = lambda met: "met" if met else "not met"
    return [
        f"within {row.radius_km:.0f} km and {24 * row.window_days:.0f} h either way: {row.n_predicted} events, {row.n_incidents} incidents",
        f"recall {share(row.recall)}, {row.incidents_hit} incidents; target {share(targets.min_recall)} {mark(row.recall_met)}",
        f"precision {share(row.precision)}, {row.predictions_that_hit} events; target {share(targets.min_precision)} {mark(row.precision_met)}",
        f"null recall {share(row.null_recall)}, p-value {'none' if row.p_value is None else f'{row.p_value:.2e}'}; target {targets.max_pvalue} {mark(row.significant)}",
    ]


def write_summary(report: DataFrame, path: str | Path) -> None:
    Path(path).write_text("\n".join(report_lines(report)) + "\n", encoding="utf-8")


def drawn(field: DataFrame, value: str, diverging: bool = False, zones: DataFrame | None = None) -> DataFrame:
    """(lat, lon, value, vmin, vmax, zone) of a map: the range by percentiles, symmetric if diverging, and flagged cells."""
    if diverging:
        span = quantiles(field, {"b": (F.abs(value), 0.99)}).select(F.coalesce(F.nullif("b", F.lit(0.0)), F.lit(1.0)).alias("b"))
        span = span.select((-F.col("b")).alias("vmin"), F.col("b").alias("vmax"))
    else:
        span = quantiles(field, {"vmin": (value, 0.01), "vmax": (value, 0.99)})
    out = field.select("lat_i", "lon_i", "lat", "lon", F.col(value).alias("value")).crossJoin(F.broadcast(span))
    if zones is None:
        return out.withColumn("zone", F.lit(False))
    marks = zones.select("lat_i", "lon_i").distinct().withColumn("_zone", F.lit(True))
    return out.join(marks, ["lat_i", "lon_i"], "left").withColumn("zone", F.coalesce("_zone", F.lit(False))).drop("_zone")
