"""The registry of queries over the test tables; each reads its whole tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fluxgrid.config import Domain, Permittivity
from fluxgrid.functions import geo, records
from fluxgrid.functions.stats import quantile, quantiles
from fluxgrid.operators import catalog, cluster, field, grid, temporal, validate
from fluxgrid.plans.model import CONFIG, LATS, LONS, LOOKAHEAD, LOOKBACK, RADIUS_KM, cube, incidents, long_cube, model, observations, table, terrain
from fluxgrid.session import cut, remove, shared_folder
from fluxgrid.sources import incidents as places
from fluxgrid.sources import synthetic
from fluxgrid.sources.chunks import read_chunks, write_chunks

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
RADII, LOOKBACKS = (500.0, 1000.0, 1500.0), (0, 2, 5)
DBSCAN_EPS = 30.0
PERIOD = ("2024-01-05", "2024-01-20")
RECIPES = {"none": Permittivity("linear", 1.0, 1.0), "strong": Permittivity("linear", 0.2, 1.0), "weak": Permittivity("linear", 0.8, 1.0)}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def r(name: str, digits: int, alias: str | None = None) -> Column:
    return F.round(name, digits).alias(alias or name)


def _at(*columns: str) -> list[str]:
    return ["t", "lat_i", "lon_i", *columns]


# Sources


@query
def scan_cube(spark: SparkSession, d: str) -> DataFrame:
    return cube(spark, d).select("day", *_at("lat", "lon", r("value", 5)))


CHUNKS = (8, 4, 6)


@contextmanager
def _stores(spark: SparkSession) -> Iterator[str]:
    """A folder of the shared store that goes at the end."""
    path = f"{shared_folder(spark)}/stores-{uuid.uuid4().hex}"
    try:
        yield path
    finally:
        remove(spark, path)


@query
def chunk_scan(spark: SparkSession, d: str) -> DataFrame:
    """The cube, written as a store of chunks and read again."""
    with _stores(spark) as path:
        write_chunks(cube(spark, d), path, LATS, LONS, CHUNKS)
        return cut(read_chunks(spark, path).select("day", *_at("lat", "lon", r("value", 5))))


@query
def chunk_slice(spark: SparkSession, d: str) -> DataFrame:
    """A box and some days of the cube's store; the other chunks stay closed."""
    box = {"lat": (-45.0, 45.0), "lon": (-100.0, 100.0), "days": ("2024-01-05", "2024-01-12")}
    with _stores(spark) as path:
        write_chunks(cube(spark, d), path, LATS, LONS, CHUNKS)
        return cut(read_chunks(spark, path, **box).select("day", *_at(r("value", 5))))


def _csv(df: DataFrame, path: str) -> str:
    df.write.csv(path, header=True, encoding="ISO-8859-1", quoteAll=True)
    return path


def _record_columns() -> dict[str, Column]:
    """Customers as dated records: numbers, and parts of dates, some of them missing or no numbers."""
    key = F.col("c_custkey")
    year = F.when(key % 11 == 0, "n/a").otherwise((1990 + key % 30).cast("string"))
    return {
        "DisNo.": F.format_string("%d-%04d-%s", 2000 + F.floor(key / 10000), key % 10000, F.col("c_mktsegment")), "Start Year": year,
        "Start Month": F.when(key % 7 != 0, (key % 15).cast("string")), "Start Day": F.when(key % 5 != 0, (key % 33).cast("string")),
        "End Year": year, "End Month": F.lit("12"), "End Day": (key % 40).cast("string"),
    }


BOX = Domain(lat_min=-50.0, lat_max=50.0, lon_min=-120.0, lon_max=120.0)


@query
def incidents_located(spark: SparkSession, d: str) -> DataFrame:
    """Orders as a CSV file of places, in Latin-1, with the dates of another file's records."""
    key, record = F.col("o_orderkey"), F.col("o_custkey")
    own = table(spark, d, "orders").select(
        _kind().alias("disastertype"), F.format_string("%d-%04d", 2000 + F.floor(record / 10000), record % 10000).alias("disasterno"), key.alias("geo_id"),
        F.lit("C\u00f4te").alias("country"), F.when(key % 9 != 0, (-60.0 + record * 37 % 121).cast("string")).otherwise("unknown").alias("latitude"),
        (-180.0 + key * 53 % 360).alias("longitude"),
    )
    with _stores(spark) as path:
        files = _csv(own, f"{path}/places"), _csv(table(spark, d, "customer").select(*(c.alias(n) for n, c in _record_columns().items())), f"{path}/dates")
        return cut(places.incidents(spark, "located", files[1], files[0], domain=BOX))


@query
def incidents_recorded(spark: SparkSession, d: str) -> DataFrame:
    """Customers as a CSV file of dated records, their places filled in from a file of centroids."""
    key = F.col("c_custkey")
    own = table(spark, d, "customer").withColumn("o_orderkey", key).select(
        *(c.alias(n) for n, c in _record_columns().items()), _kind().alias("Disaster Type"), F.col("c_mktsegment").alias("Disaster Subtype"), F.lit("land").alias("Country"),
        F.concat(F.lit(" N"), F.col("c_nationkey").cast("string")).alias("ISO"),
        F.when(key % 3 != 0, (key % 90).cast("string")).otherwise("?").alias("Latitude"), F.when(key % 4 != 0, (key % 180).cast("string")).alias("Longitude"),
    )
    centres = table(spark, d, "nation").select(
        F.concat(F.lit("N"), F.col("n_nationkey").cast("string")).alias("iso3"), F.col("n_name").alias("country"),
        F.when(F.col("n_nationkey") != 7, -48.0 + 4.0 * F.col("n_nationkey")).alias("lat"), (-150.0 + 12.0 * F.col("n_nationkey")).alias("lon"),
    )
    with _stores(spark) as path:
        files = _csv(own, f"{path}/records"), _csv(centres, f"{path}/centroids")
        return cut(places.incidents(spark, "recorded", files[0], centres=files[1], domain=BOX))


@query
def normalize_lon(spark: SparkSession, d: str) -> DataFrame:
    wide = table(spark, d, "orders").select("o_orderkey", (F.col("o_orderkey") * 53 % 360).cast("double").alias("lon"))
    return grid.normalized_longitudes(wide)


@query
def domain_slice(spark: SparkSession, d: str) -> DataFrame:
    part = grid.domain_slice(cube(spark, d), (-45.0, 45.0), (-100.0, 100.0), ("2024-01-05", "2024-01-12"))
    return part.select("day", *_at(r("value", 5)))


def _daily(statistic: str) -> Query:
    return lambda spark, d: grid.daily(observations(spark, d), statistic).select("day", "lat_i", "lon_i", r("value", 5))


for _statistic in ("mean", "max", "min"):
    QUERIES[f"daily_{_statistic}"] = _daily(_statistic)


@query
def regrid_bilinear(spark: SparkSession, d: str) -> DataFrame:
    target = grid.centres(-90, 90, 10), grid.centres(-180, 180, 20)
    return grid.regridded(terrain(spark, d), (LATS, LONS), target, "elevation").select("lat_i", "lon_i", "lat", "lon", r("elevation", 5))


@query
def terrain_fields(spark: SparkSession, d: str) -> DataFrame:
    return terrain(spark, d).select("lat_i", "lon_i", "lat", "lon", r("elevation", 5), r("slope", 7))


@query
def gen_grid(spark: SparkSession, d: str) -> DataFrame:
    return grid.grid(spark, grid.centres(-90, 90, 10), grid.centres(-180, 180, 10))


@query
def gen_terrain(spark: SparkSession, d: str) -> DataFrame:
    made = synthetic.terrain(spark, grid.centres(-90, 90, 10), grid.centres(-180, 180, 10), noise=0.0)
    return made.select("lat_i", "lon_i", "lat", "lon", r("elevation", 6), r("slope", 6))


@query
def gen_temperature_det(spark: SparkSession, d: str) -> DataFrame:
    made = synthetic.temperature(spark, grid.centres(-90, 90, 15), grid.centres(-180, 180, 15), "2015-01-01", "2015-03-31", noise=0.0)
    return made.select("day", *_at(r("value", 6)))


# Projections


@query
def elevation(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "supplier").select("s_suppkey", F.round(F.col("s_acctbal") / synthetic.GRAVITY, 6).alias("elevation"))


@query
def anomaly(spark: SparkSession, d: str) -> DataFrame:
    return model(spark, d).anomaly.select(_at(r("anomaly", 5)))


def _eps(method: str) -> Query:
    def run(spark: SparkSession, d: str) -> DataFrame:
        p = CONFIG.permittivity
        return field.with_permittivity(terrain(spark, d), method, p.eps_min, p.eps_max, p.params).select("lat_i", "lon_i", r("eps", 7))

    return run


for _method in ("linear", "log", "slope", "combined"):
    QUERIES[f"permittivity_{_method}"] = _eps(_method)


@query
def breakdown_field(spark: SparkSession, d: str) -> DataFrame:
    return model(spark, d).field.select(_at(r("E", 8, "e")))


@query
def disno_key(spark: SparkSession, d: str) -> DataFrame:
    number = F.format_string("%d-%04d-%s", F.col("o_orderkey") % 9000 + 900, F.col("o_orderkey") % 10000, F.substring("o_orderpriority", 3, 3))
    return table(spark, d, "orders").select("o_orderkey", records.record_key(number).alias("key"))


@query
def concat_id(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", places.incident_id("l_orderkey", "l_linenumber").alias("id"))


def _parts() -> tuple[Column, Column, Column]:
    """Year, month and day strings, some of them missing or no numbers."""
    key = F.col("o_orderkey")
    year = F.when(key % 11 == 0, "n/a").otherwise((1990 + key % 30).cast("string"))
    return year, F.when(key % 7 != 0, (key % 15).cast("string")), F.when(key % 5 != 0, (key % 33).cast("string"))


@query
def assemble_date(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select("o_orderkey", records.assembled_date(*_parts()).alias("date_start"))


@query
def geo_precision(spark: SparkSession, d: str) -> DataFrame:
    lat = F.when(F.col("o_orderkey") % 3 != 0, 1.0)
    lon = F.when(F.col("o_orderkey") % 4 != 0, 1.0)
    return table(spark, d, "orders").select("o_orderkey", records.geo_precision(lat, lon).alias("geo_precision"))


@query
def haversine(spark: SparkSession, d: str) -> DataFrame:
    own = incidents(spark, d).select("incident_id", F.round(geo.haversine(F.lit(10.0), F.lit(20.0), F.col("lat"), F.col("lon")), 5).alias("km"))
    return own


# Filters


@query
def flag_zones_percentile(spark: SparkSession, d: str) -> DataFrame:
    return model(spark, d).flagged.select(_at(r("E", 8, "e")))


@query
def flag_zones_absolute(spark: SparkSession, d: str) -> DataFrame:
    absolute = replace(CONFIG, breakdown=replace(CONFIG.breakdown, threshold_mode="absolute", threshold_value=0.00512345))
    return model(spark, d, absolute).flagged.select(_at(r("E", 8, "e")))


def _kind() -> Column:
    names = (" Flood", "Earthquake", "Extreme temperature ", "Ash fall", "Tropical STORM", "Epidemic", "Wildfire (forest)", "Drought")
    return F.element_at(F.array(*map(F.lit, names)), (F.col("o_orderkey") % 8 + 1).cast("int"))


@query
def type_filter(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select("o_orderkey", F.trim(_kind()).alias("type")).where(records.is_climate(F.col("type")))


@query
def domain_box(spark: SparkSession, d: str) -> DataFrame:
    return incidents(spark, d).where(F.col("lat").between(-30, 30) & F.col("lon").between(-100, 100)).select("incident_id", "lat", "lon")


@query
def day_snapshot(spark: SparkSession, d: str) -> DataFrame:
    return model(spark, d).charge.where(F.col("day") == F.lit("2024-01-15").cast("date")).select(_at(r("charge", 5)))


# Joins


@query
def gdis_join(spark: SparkSession, d: str) -> DataFrame:
    """Places with a record key, and the dates of the first record of each key; a third of the records has no year."""
    number = F.format_string("2010-%04d", F.col("o_custkey") % 10000)
    own = table(spark, d, "orders").select("o_orderkey", records.record_key(number).alias("key"))
    year = F.when(F.col("c_custkey") % 3 != 0, "2010")
    dated = table(spark, d, "customer").select(
        records.record_key(F.format_string("2010-%04d-AAA", F.col("c_custkey") % 10000)).alias("key"), F.col("c_custkey").alias("_row"),
        records.assembled_date(year, (F.col("c_custkey") % 14).cast("string"), (F.col("c_custkey") % 31).cast("string")).alias("date_start"),
    )
    return places.with_dates(own, places.first_dates(dated)).select("o_orderkey", "key", "date_start")


@query
def centroid_fallback(spark: SparkSession, d: str) -> DataFrame:
    own = table(spark, d, "customer").select(
        "c_custkey", F.concat(F.lit("N"), F.col("c_nationkey").cast("string")).alias("iso"),
        F.when(F.col("c_custkey") % 3 != 0, (F.col("c_custkey") % 90).cast("double")).alias("lat"),
        F.when(F.col("c_custkey") % 4 != 0, (F.col("c_custkey") % 180).cast("double")).alias("lon"),
    )
    centroids = table(spark, d, "nation").select(
        F.concat(F.lit("N"), F.col("n_nationkey").cast("string")).alias("iso3"), F.when(F.col("n_nationkey") != 7, -48.0 + 4.0 * F.col("n_nationkey")).alias("lat"),
        (-150.0 + 12.0 * F.col("n_nationkey")).alias("lon"), F.col("n_nationkey").alias("_row"),
    )
    return places.with_centroids(own, places.last_places(centroids)).select("c_custkey", "iso", "lat", "lon", "geo_precision")


def _blob_key(prefix: str) -> Column:
    c = F.col(prefix)
    return F.concat_ws("-", *((F.shiftright(c, n) % (1 << 20)).cast("string") for n in (40, 20, 0))).alias(prefix)


@query
def link_pairs(spark: SparkSession, d: str) -> DataFrame:
    return cluster.links(model(spark, d).blobs, CONFIG.clustering.link_radius_km).select(_blob_key("a"), _blob_key("b"), r("km", 4))


@query
def adjacency_pairs(spark: SparkSession, d: str) -> DataFrame:
    return cluster.adjacency(model(spark, d).flagged, cluster.merge_steps(CONFIG.clustering.dbscan_eps_cells))


def _covered(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(events, incidents, pairs); scores need places and days of events, and their strength."""
    events, found = cut(catalog.summaries(model(spark, d).events)), incidents(spark, d)
    return events, found, validate.coverage(events, found, RADIUS_KM, LOOKBACK, LOOKAHEAD)


@query
def coverage_pairs(spark: SparkSession, d: str) -> DataFrame:
    return _covered(spark, d)[2].select("event_id", "incident_id", r("km", 4), "lead", "late")


@query
def disasters_hit(spark: SparkSession, d: str) -> DataFrame:
    _, found, pairs = _covered(spark, d)
    return validate.hit_incidents(found, pairs)


@query
def disasters_missed(spark: SparkSession, d: str) -> DataFrame:
    _, found, pairs = _covered(spark, d)
    return validate.missed_incidents(found, pairs)


@query
def predictions_hit(spark: SparkSession, d: str) -> DataFrame:
    events, _, pairs = _covered(spark, d)
    return validate.hitting_events(events, pairs).select("event_id", "date_start", "date_end", r("peak_E", 7, "peak_e"))


# Aggregations


@query
def doy_climatology(spark: SparkSession, d: str) -> DataFrame:
    return temporal.climatology(long_cube(spark, d)).select("doy", "lat_i", "lon_i", r("clim", 5))


@query
def climatology_smooth(spark: SparkSession, d: str) -> DataFrame:
    return temporal.smoothed(temporal.climatology(long_cube(spark, d)), 15).select("doy", "lat_i", "lon_i", r("clim", 5))


@query
def threshold_percentile(spark: SparkSession, d: str) -> DataFrame:
    return model(spark, d).threshold.select(r("thr", 8))


@query
def trigger_refs(spark: SparkSession, d: str) -> DataFrame:
    m = model(spark, d)
    return catalog.references(m.field, m.ground).select(r("g_ref", 8), r("inv_ref", 7))


@query
def plot_range(spark: SparkSession, d: str) -> DataFrame:
    own = model(spark, d).anomaly.select("anomaly")
    wanted = {"vabs": (F.abs("anomaly"), 0.99), "vmin": ("anomaly", 0.01), "vmax": ("anomaly", 0.99)}
    return quantiles(own, wanted).select(r("vabs", 5), r("vmin", 5), r("vmax", 5))


@query
def daily_blobs(spark: SparkSession, d: str) -> DataFrame:
    return model(spark, d).blobs.select("day_index", "day", "lat", "lon", "n_cells", r("peak_E", 8, "peak_e"))


@query
def dbscan_blobs(spark: SparkSession, d: str) -> DataFrame:
    found = model(spark, d).flagged
    return cluster.blobs(found, cluster.dbscan(found, DBSCAN_EPS, 3)).select("day_index", "day", "lat", "lon", "n_cells", r("peak_E", 8, "peak_e"))


@query
def link_events(spark: SparkSession, d: str) -> DataFrame:
    return model(spark, d).events.select("event_id", "day_index", "lat", "lon", "n_cells")


@query
def event_catalog(spark: SparkSession, d: str) -> DataFrame:
    return model(spark, d).catalog.withColumn("peak_E", F.round("peak_E", 8)).withColumnRenamed("peak_E", "peak_e")


@query
def trigger_scores(spark: SparkSession, d: str) -> DataFrame:
    return model(spark, d).catalog.select("event_id", "heat_score", "terrain_score")


@query
def trigger_label(spark: SparkSession, d: str) -> DataFrame:
    return model(spark, d).catalog.select("event_id", "trigger")


@query
def trigger_counts(spark: SparkSession, d: str) -> DataFrame:
    return model(spark, d).catalog.groupBy("trigger").agg(F.count("*").alias("n"))


@query
def precursor_ramp(spark: SparkSession, d: str) -> DataFrame:
    return model(spark, d).catalog.select("event_id", r("precursor_ramp", 4))


@query
def top_events(spark: SparkSession, d: str) -> DataFrame:
    return catalog.summaries(model(spark, d).events).orderBy(F.desc("peak_E"), "event_id").limit(10).select("event_id", "date_start", "date_end", "max_cells", r("peak_E", 8, "peak_e"))


@query
def active_days(spark: SparkSession, d: str) -> DataFrame:
    return model(spark, d).blobs.agg(F.countDistinct("day_index").alias("active_days"))


@query
def field_summary(spark: SparkSession, d: str) -> DataFrame:
    own, v = model(spark, d).anomaly.select("anomaly"), F.col("anomaly")
    told = own.agg(F.min(v).alias("lo"), F.max(v).alias("hi"), F.avg(v).alias("mean"), F.count_if(v > 0).alias("positive"), F.count(v).alias("n"))
    both = told.crossJoin(F.broadcast(quantile(own, "anomaly", 0.5, "median")))
    return both.select(*(r(c, 5) for c in ("lo", "hi", "mean", "median")), "positive", "n")


@query
def dedup_first(spark: SparkSession, d: str) -> DataFrame:
    return grid.first_by(table(spark, d, "lineitem"), "l_orderkey", ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity"]).select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity")


# Windows


@query
def charge(spark: SparkSession, d: str) -> DataFrame:
    return model(spark, d).charge.select(_at(r("charge", 5)))


@query
def charge_nodecay(spark: SparkSession, d: str) -> DataFrame:
    return temporal.charge(model(spark, d).anomaly, CONFIG.charge.window_days, 0.0).select(_at(r("charge", 5)))


@query
def charge_month(spark: SparkSession, d: str) -> DataFrame:
    """A charge of thirty days over several years of line items."""
    own = long_cube(spark, d)
    dense = grid.densified(own, grid.grid(spark, [0.0, 1.0], [float(j) for j in range(5)]))
    return temporal.charge(dense, 30, 0.02, "value").select(_at(r("charge", 5)))


@query
def gradient_magnitude(spark: SparkSession, d: str) -> DataFrame:
    return model(spark, d).gradient.select(_at(r("gradient", 9)))


@query
def terrain_slope(spark: SparkSession, d: str) -> DataFrame:
    return terrain(spark, d).select("lat_i", "lon_i", r("slope", 7))


# Scores


@query
def recall_precision(spark: SparkSession, d: str) -> DataFrame:
    report = validate.scores(*_covered(spark, d), RADIUS_KM, LOOKBACK, LOOKAHEAD)
    return report.select("n_predicted", "n_incidents", r("recall", 7), F.round("precision", 7).alias("prec"), "incidents_hit", "predictions_that_hit")


@query
def recall_by_precision(spark: SparkSession, d: str) -> DataFrame:
    _, found, pairs = _covered(spark, d)
    return validate.recall_by_precision(found, pairs).select("geo_precision", "n", r("recall", 7))


@query
def null_model(spark: SparkSession, d: str) -> DataFrame:
    report = validate.scores(*_covered(spark, d), RADIUS_KM, LOOKBACK, LOOKAHEAD)
    return report.select(F.col("total_days").cast("bigint").alias("total_days"), "n_predicted", r("null_recall", 9))


@query
def binom_pvalue(spark: SparkSession, d: str) -> DataFrame:
    report = validate.with_p_value(validate.scores(*_covered(spark, d), RADIUS_KM, LOOKBACK, LOOKAHEAD))
    return report.select("incidents_hit", "n_incidents", r("null_recall", 9), r("p_value", 9), (F.col("p_value") < CONFIG.validation.max_pvalue).alias("significant"))


@query
def pr_curve(spark: SparkSession, d: str) -> DataFrame:
    return validate.pr_curve(*_covered(spark, d)).select(F.col("rank").cast("bigint").alias("rank"), r("recall", 7), F.round("precision", 7).alias("prec"))


@query
def radius_lookback_grid(spark: SparkSession, d: str) -> DataFrame:
    events, found = cut(catalog.summaries(model(spark, d).events)), incidents(spark, d)
    out = validate.sweep(events, found, RADII, LOOKBACKS, LOOKAHEAD)
    return out.select("radius_km", "lookback", "incidents_hit", "predictions_that_hit", r("recall", 7), F.round("precision", 7).alias("prec"))


@query
def best_sweep_cell(spark: SparkSession, d: str) -> DataFrame:
    events, found = cut(catalog.summaries(model(spark, d).events)), incidents(spark, d)
    return validate.best(validate.sweep(events, found, RADII, LOOKBACKS, LOOKAHEAD)).select("radius_km", "lookback", r("recall", 7))


@query
def signal_ratio(spark: SparkSession, d: str) -> DataFrame:
    """The largest E near the strongest reading over the median of all."""
    own = model(spark, d).field
    near = F.col("lat").between(7.5, 37.5) & F.col("lon").between(-24, 24)
    peak = own.agg(F.max(F.when(near, F.col("E"))).alias("peak")).crossJoin(quantile(own.select("E"), "E", 0.5, "median"))
    return peak.select(F.round(F.col("peak") / (F.col("median") + 1e-9), 5).alias("ratio"), (F.col("peak") / (F.col("median") + 1e-9) > 3).alias("ok"))



# Further filters, sweeps and tables


@query
def level_slice(spark: SparkSession, d: str) -> DataFrame:
    """The lowest level of line items, with their numbers as levels."""
    own = table(spark, d, "lineitem").select("l_orderkey", "l_partkey", F.col("l_linenumber").alias("level"), "l_quantity")
    return grid.at_level(own)


@query
def regrid_same(spark: SparkSession, d: str) -> DataFrame:
    """Axes of the target's lengths, half a step off at most: nothing is interpolated."""
    target = [x + 7.0 for x in LATS], LONS
    return grid.regridded(terrain(spark, d), (LATS, LONS), target, "elevation").select("lat_i", "lon_i", "lat", "lon", r("elevation", 5))


@query
def incident_period(spark: SparkSession, d: str) -> DataFrame:
    return validate.in_period(incidents(spark, d), *PERIOD)


@query
def target_comparison(spark: SparkSession, d: str) -> DataFrame:
    report = validate.with_p_value(validate.scores(*_covered(spark, d), RADIUS_KM, LOOKBACK, LOOKAHEAD))
    told = validate.meets_targets(report, CONFIG.validation)
    return told.select(r("recall", 7), F.round("precision", 7).alias("prec"), r("p_value", 9), "recall_met", "precision_met", "significant")


@query
def predicted_actual(spark: SparkSession, d: str) -> DataFrame:
    return validate.predicted_and_actual(catalog.summaries(model(spark, d).events), incidents(spark, d))


@query
def recipe_grid(spark: SparkSession, d: str) -> DataFrame:
    """The sweep for several recipes of permittivity; the charge is computed once."""
    own = model(spark, d).by_permittivity(RECIPES)
    catalogs = {name: cut(catalog.summaries(m.events)) for name, m in own.items()}
    out = validate.experiment(catalogs, incidents(spark, d), RADII, LOOKBACKS, LOOKAHEAD)
    return out.select("recipe", "n_predicted", "radius_km", "lookback", "incidents_hit", "predictions_that_hit", r("recall", 7), F.round("precision", 7).alias("prec"))
