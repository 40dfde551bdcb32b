"""The catalog of events: when and where each began, how it grew, and what set it off."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fluxgrid.functions.stats import quantile
from fluxgrid.operators.field import LEAST_EPS
from fluxgrid.operators.grid import CELL
from fluxgrid.session import BROADCAST_BYTES, cut

#: What the two places of an event take in a broadcast table, at most.
PLACE_BYTES = 256


def references(field: DataFrame, terrain: DataFrame) -> DataFrame:
    """One row (g_ref, inv_ref): the 99th percentiles of the gradient over the cube and of 1 / eps over the grid, 1 for 0."""
    inverse = terrain.select((1.0 / F.greatest("eps", F.lit(LEAST_EPS))).alias("inv"))
    both = quantile(field.select("gradient"), "gradient", 0.99, "g_ref").crossJoin(quantile(inverse, "inv", 0.99, "inv_ref"))
    return both.select(*(F.coalesce(F.nullif(c, F.lit(0.0)), F.when(F.col(c).isNotNull(), 1.0)).alias(c) for c in ("g_ref", "inv_ref")))


def summaries(linked: DataFrame) -> DataFrame:
    """One row for each event: its first blob's place and day, its last day, its largest E and size."""
    first = F.struct("day_index", "first_lat_i", "first_lon_i")
    return linked.groupBy("event_id").agg(
        F.min("day").alias("date_start"), F.max("day").alias("date_end"),
        (F.max("day_index") - F.min("day_index") + 1).cast("int").alias("duration_days"),
        F.min_by(F.struct("lat", "lon", "day_index", "at_lat_i", "at_lon_i"), first).alias("_at"),
        F.max("peak_E").alias("peak_E"), F.max("n_cells").alias("max_cells"),
    ).select(
        "event_id", "date_start", "date_end", "duration_days", F.col("_at.lat").alias("incept_lat"), F.col("_at.lon").alias("incept_lon"), F.col("_at.day_index").alias("_t"),
        F.col("_at.at_lat_i").alias("_lat_i"), F.col("_at.at_lon_i").alias("_lon_i"), "peak_E", "max_cells",
    )


def catalog(linked: DataFrame, field: DataFrame, terrain: DataFrame, window: int) -> DataFrame:
    """The summaries with trigger, heat_score, terrain_score and precursor_ramp at each event's first place and day.

    heat_score is the gradient there over its reference, terrain_score 1 / eps over its own; the larger one names the
    trigger. precursor_ramp is the change of charge for each day since window days before, or since the first day. Both
    moments of all events are looked up in one pass over the field, which isn't shuffled while the events are few.
    """
    events = cut(summaries(linked).withColumn("_from", F.greatest(F.lit(0), F.col("_t") - window)))
    moment = F.explode(F.array(F.struct(F.lit(True).alias("now"), F.col("_t").alias("t")), F.struct(F.lit(False).alias("now"), F.col("_from").alias("t"))))
    places = events.select("event_id", moment.alias("m"), F.col("_lat_i").alias("lat_i"), F.col("_lon_i").alias("lon_i")).select("event_id", "m.*", "lat_i", "lon_i")
    if events.count() * PLACE_BYTES <= BROADCAST_BYTES:
        places = F.broadcast(places)
    met = field.select("t", *CELL, "gradient", "eps", "charge").join(places, ["t", *CELL])
    at = lambda now, c: F.max(F.when(F.col("now") == now, F.col(c)))
    looked = met.groupBy("event_id").agg(*(at(True, c).alias(c) for c in ("gradient", "eps")), at(True, "charge").alias("_now"), at(False, "charge").alias("_then"))
    joined = events.join(looked, "event_id", "left").crossJoin(F.broadcast(references(field, terrain)))
    heat = F.col("gradient") / F.col("g_ref")
    ground = 1.0 / F.greatest("eps", F.lit(LEAST_EPS)) / F.col("inv_ref")
    ramp = (F.col("_now") - F.col("_then")) / F.greatest(F.lit(1), F.col("_t") - F.col("_from"))
    return joined.select(
        "event_id", "date_start", "date_end", "duration_days", "incept_lat", "incept_lon", "peak_E", "max_cells",
        F.when(heat >= ground, "heat-driven").otherwise("terrain-driven").alias("trigger"),
        F.bround(heat, 3).alias("heat_score"), F.bround(ground, 3).alias("terrain_score"),
        F.bround(F.coalesce(ramp, F.lit(0.0)), 4).alias("precursor_ramp"),
    )
