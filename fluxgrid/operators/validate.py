"""Scores of an event catalog against incidents."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fluxgrid.config import Validation
from fluxgrid.functions import sphere
from fluxgrid.functions.geo import KM_PER_DEGREE_AT_LEAST, haversine
from fluxgrid.functions.stats import binomial_tail, null_recall
from fluxgrid.operators.grid import ranked, running
from fluxgrid.session import cut


def coverage(catalog: DataFrame, incidents: DataFrame, radius_km: float, lookback: float, lookahead: float) -> DataFrame:
    """(event_id, incident_id, km, lead): the incidents that each event covers.

    An event covers an incident within the radius of its first place, if it lasts into the days from lookback before
    to lookahead after the incident. lead: days from the event's end to the incident, at most 0 if it hasn't ended;
    late: days from the incident to the event's start.

    Incidents lie in one bucket of days and one cell of the sphere each; events go to all buckets and cells that they can
    reach. That makes a range join an equality join, each pair is found once, and neither events nor incidents far away
    are looked at, east or west as little as north or south. A cell with very many of either is split by the adaptive join.
    """
    days, reach_deg = max(1, int(lookback + lookahead) + 1), radius_km / KM_PER_DEGREE_AT_LEAST
    bucket = lambda c: F.floor(F.unix_date(c) / days).cast("int")
    size = sphere.width(reach_deg)
    targets = incidents.select("incident_id", F.col("date_start").alias("_day"), F.col("lat").alias("_lat"), F.col("lon").alias("_lon"))
    targets = targets.withColumn("_bucket", bucket("_day")).withColumn("_cell", sphere.cell(F.col("_lat"), F.col("_lon"), size))
    start = F.date_sub("date_start", int(lookahead) + (lookahead > int(lookahead)))
    end = F.date_add("date_end", int(lookback) + (lookback > int(lookback)))
    reach = catalog.select("event_id", "date_start", "date_end", "incept_lat", "incept_lon")
    reach = reach.withColumn("_bucket", F.explode(F.sequence(bucket(start), bucket(end))))
    reach = reach.withColumn("_cell", F.explode(sphere.cover(F.col("incept_lat"), F.col("incept_lon"), reach_deg, size)))
    km = haversine(F.col("incept_lat"), F.col("incept_lon"), F.col("_lat"), F.col("_lon"))
    late, lead = F.datediff("date_start", "_day"), F.datediff("_day", "date_end")
    pairs = reach.join(targets, ["_bucket", "_cell"]).withColumns({"km": km, "late": late, "lead": lead})
    return pairs.where((F.col("km") <= radius_km) & (F.col("late") <= lookahead) & (F.col("lead") <= lookback)).select("event_id", "incident_id", "km", "lead", "late")


def hit_incidents(incidents: DataFrame, pairs: DataFrame) -> DataFrame:
    return incidents.join(pairs.select("incident_id").distinct(), "incident_id", "left_semi")


def missed_incidents(incidents: DataFrame, pairs: DataFrame) -> DataFrame:
    return incidents.join(pairs.select("incident_id").distinct(), "incident_id", "left_anti")


def hitting_events(catalog: DataFrame, pairs: DataFrame) -> DataFrame:
    return catalog.join(pairs.select("event_id").distinct(), "event_id", "left_semi")


def totals(catalog: DataFrame, incidents: DataFrame) -> DataFrame:
    """One row (n_predicted, n_incidents, total_days)."""
    span = F.greatest(F.lit(1), F.datediff(F.max("date_start"), F.min("date_start")))
    return catalog.agg(F.count("*").alias("n_predicted")).crossJoin(incidents.agg(F.count("*").alias("n_incidents"), span.alias("total_days")))


def _share(hits: Column, of: Column) -> Column:
    return hits / F.nullif(of.cast("double"), F.lit(0.0))


def scores(catalog: DataFrame, incidents: DataFrame, pairs: DataFrame, radius_km: float, lookback: float, lookahead: float) -> DataFrame:
    """One row with recall, precision and what a uniform null model expects; with no events or incidents, null scores."""
    hits = pairs.agg(F.countDistinct("incident_id").alias("incidents_hit"), F.countDistinct("event_id").alias("predictions_that_hit"))
    expected = null_recall(F.lit(float(radius_km)), F.lit(float(lookback)), F.lit(float(lookahead)), F.col("total_days"), F.col("n_predicted"))
    return totals(catalog, incidents).crossJoin(hits).select(
        F.lit(float(radius_km)).alias("radius_km"), F.lit((lookback + lookahead) / 2).alias("window_days"), "n_predicted", "n_incidents",
        _share(F.col("incidents_hit"), F.col("n_incidents")).alias("recall"), _share(F.col("predictions_that_hit"), F.col("n_predicted")).alias("precision"),
        "incidents_hit", "predictions_that_hit", "total_days", expected.alias("null_recall"),
    )


def with_p_value(report: DataFrame) -> DataFrame:
    """A report of a few rows with p_value, the probability of as many hits under the null model."""
    rows = [(*r, None if r.null_recall is None else binomial_tail(r.incidents_hit, r.n_incidents, r.null_recall)) for r in report.collect()]
    schema = report.schema.add("p_value", "double")
    return report.sparkSession.createDataFrame(rows, schema)


def recall_by_precision(incidents: DataFrame, pairs: DataFrame) -> DataFrame:
    """(geo_precision, n, recall) for each precision that is there."""
    hit = pairs.select("incident_id").distinct().withColumn("_hit", F.lit(1))
    each = incidents.join(hit, "incident_id", "left")
    return each.groupBy("geo_precision").agg(F.count("*").alias("n"), (F.count("_hit") / F.count("*")).alias("recall"))


def _corners(pairs: DataFrame, key: str, radii: Sequence[float], lookbacks: Sequence[float]) -> DataFrame:
    """(i, j, n): numbers whose sums over all places up to a pair of settings are the keys that the settings reach.

    Each pair stands at the first radius and the first lookback, both in ascending order, that reach it. Of a key's
    pairs only the front counts: those that no other one is reached before. A key is reached where any point of its front
    is: that is 1 at each point, less 1 where two points next to each other on the front are both reached.
    """
    first = lambda c, steps: F.size(F.filter(F.array(*map(F.lit, map(float, steps))), lambda x: x < F.col(c)))
    placed = pairs.select(key, first("km", radii).alias("i"), first("lead", lookbacks).alias("j"))
    least = placed.groupBy(key, "i").agg(F.min("j").alias("j"))
    before = F.min("j").over(Window.partitionBy(key).orderBy("i").rowsBetween(Window.unboundedPreceding, -1))
    front = least.withColumn("_j", before).where(F.col("_j").isNull() | (F.col("j") < F.col("_j")))
    point = F.struct("i", "j", F.lit(1).alias("n"))
    both = F.when(F.col("_j").isNotNull(), F.struct("i", F.col("_j").alias("j"), F.lit(-1).alias("n")))
    return front.select(F.inline(F.array_compact(F.array(point, both)))).groupBy("i", "j").agg(F.sum("n").alias("n"))


def sweep(catalog: DataFrame, incidents: DataFrame, radii: Sequence[float], lookbacks: Sequence[float], lookahead: float) -> DataFrame:
    """(k, radius_km, lookback, incidents_hit, predictions_that_hit, recall, precision) of each pair of settings.

    One join at the widest setting. What each incident and each event is reached by comes down to the front of its pairs,
    whatever the number of settings, and a table of sums over settings counts those reached. k numbers the settings in order.
    """
    pairs = cut(coverage(catalog, incidents, max(radii), max(lookbacks), lookahead).select("event_id", "incident_id", "km", "lead"))
    across, back = sorted(set(map(float, radii))), sorted(set(map(float, lookbacks)))
    grid = [(k, r, b, across.index(r), back.index(b)) for k, (r, b) in enumerate((float(r), float(b)) for r in radii for b in lookbacks)]
    out = catalog.sparkSession.createDataFrame(grid, "k int, radius_km double, lookback double, i int, j int")
    every = catalog.sparkSession.createDataFrame([(i, j) for i in range(len(across)) for j in range(len(back))], "i int, j int")
    up = lambda by, along: Window.partitionBy(by).orderBy(along).rowsBetween(Window.unboundedPreceding, 0)
    for key, name in (("incident_id", "_i"), ("event_id", "_e")):
        table = every.join(F.broadcast(_corners(pairs, key, across, back)), ["i", "j"], "left")  # no more rows than settings
        sums = table.withColumn("n", F.sum(F.coalesce("n", F.lit(0))).over(up("i", "j"))).withColumn("n", F.sum("n").over(up("j", "i")))
        out = out.join(F.broadcast(sums.withColumnRenamed("n", name)), ["i", "j"])
    hit = lambda c: F.col(c).cast("bigint")
    return out.crossJoin(F.broadcast(totals(catalog, incidents))).select(
        "k", "radius_km", "lookback", hit("_i").alias("incidents_hit"), hit("_e").alias("predictions_that_hit"),
        _share(hit("_i"), F.col("n_incidents")).alias("recall"), _share(hit("_e"), F.col("n_predicted")).alias("precision"),
    )


def best(grid: DataFrame) -> DataFrame:
    """The row with the largest recall, the first of equals."""
    return grid.orderBy(F.desc("recall"), "k").limit(1)


def pr_curve(catalog: DataFrame, incidents: DataFrame, pairs: DataFrame) -> DataFrame:
    """(rank, recall, precision) as events are added from the strongest on, at every hundredth of them and at the last."""
    order = ranked(catalog.select("event_id", (-F.col("peak_E")).alias("_weakness")), "_weakness", "event_id").select("event_id", "rank")
    places = cut(order)
    reach = pairs.join(places, "event_id")
    caught = reach.groupBy("incident_id").agg(F.min("rank").alias("rank")).groupBy("rank").agg(F.count("*").alias("_caught"))
    hit = reach.select("rank").distinct().withColumn("_hit", F.lit(1))
    steps = running(places.join(caught, "rank", "left").join(hit, "rank", "left"), "rank", "_caught", "_hit")
    n = F.col("n_predicted")
    told = steps.crossJoin(F.broadcast(totals(catalog, incidents)))
    return told.where((F.col("rank") % F.greatest(F.lit(1), F.floor(n / 100)) == 0) | (F.col("rank") == n)).select(
        "rank", _share(F.col("_caught"), F.col("n_incidents")).alias("recall"), (F.col("_hit") / F.col("rank")).alias("precision")
    )


def in_period(incidents: DataFrame, start: str, end: str) -> DataFrame:
    """The incidents that begin from start to end, both days included; those without a date are left out."""
    return incidents.where(F.col("date_start").between(F.lit(start).cast("date"), F.lit(end).cast("date")))


def meets_targets(report: DataFrame, targets: Validation) -> DataFrame:
    """A report with its p_value, and whether recall and precision are over their targets and the p-value under its own."""
    over = lambda c, least: F.coalesce(F.col(c) > F.lit(least), F.lit(False))
    return report.withColumns({
        "recall_met": over("recall", targets.min_recall), "precision_met": over("precision", targets.min_precision),
        "significant": F.coalesce(F.col("p_value") < F.lit(targets.max_pvalue), F.lit(False)),
    })


def predicted_and_actual(catalog: DataFrame, incidents: DataFrame) -> DataFrame:
    """(kind, lat, lon): what a map of both shows, predicted events by their first place and incidents by how well theirs is known."""
    events = catalog.select(F.lit("predicted").alias("kind"), F.col("incept_lat").alias("lat"), F.col("incept_lon").alias("lon"))
    return events.union(incidents.select(F.concat(F.lit("incident, "), "geo_precision"), "lat", "lon"))


def experiment(catalogs: dict[str, DataFrame], incidents: DataFrame, radii: Sequence[float], lookbacks: Sequence[float], lookahead: float) -> DataFrame:
    """The sweep of each recipe's catalog, with its name in recipe and the number of its events in n_predicted."""
    parts = []
    for name, catalog in catalogs.items():
        size = catalog.agg(F.count("*").alias("n_predicted"))
        parts.append(sweep(catalog, incidents, radii, lookbacks, lookahead).crossJoin(F.broadcast(size)).withColumn("recipe", F.lit(name)))
    return reduce(DataFrame.union, parts)
