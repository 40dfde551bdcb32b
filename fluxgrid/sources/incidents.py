"""Tables of observed incidents from files: places with a record number, dated records, and centroids of countries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from fluxgrid.config import Domain
from fluxgrid.functions import records
from fluxgrid.functions.records import find_column
from fluxgrid.operators.grid import first_by
from fluxgrid.session import small
from fluxgrid.sources.files import exists, read_table

CENTROIDS = StructType([StructField(c, t) for c, t in (("iso3", StringType()), ("country", StringType()), ("lat", DoubleType()), ("lon", DoubleType()))])


def centroids(spark: SparkSession, path: str) -> DataFrame:
    """(iso3, lat, lon) of a CSV file; no rows if it isn't there. Rows with a gap are left out; of a repeated code the file's last row counts."""
    if not exists(spark, path):
        return spark.createDataFrame([], CENTROIDS).select("iso3", "lat", "lon")
    return last_places(spark.read.csv(path, header=True, schema=CENTROIDS).withColumn("_row", F.monotonically_increasing_id()))


def last_places(rows: DataFrame) -> DataFrame:
    """(iso3, lat, lon) of rows(iso3, lat, lon, _row) without a gap; of a repeated code the row with the largest _row."""
    whole = rows.dropna(subset=["iso3", "lat", "lon"])
    return whole.groupBy("iso3").agg(F.max_by(F.struct("lat", "lon"), "_row").alias("at")).select("iso3", "at.*")


def with_centroids(incidents: DataFrame, places: DataFrame) -> DataFrame:
    """incidents with geo_precision; where either coordinate is missing, both are the country's, or null if it has none."""
    near = small(places.select(F.col("iso3").alias("_iso"), F.col("lat").alias("_lat"), F.col("lon").alias("_lon")))
    told = incidents.withColumn("geo_precision", records.geo_precision(F.col("lat"), F.col("lon")))
    joined = told.join(near, told["iso"] == F.col("_iso"), "left")
    exact = F.col("geo_precision") == "exact"
    return joined.withColumn("lat", F.when(exact, F.col("lat")).otherwise(F.col("_lat"))).withColumn("lon", F.when(exact, F.col("lon")).otherwise(F.col("_lon"))).drop("_iso", "_lat", "_lon")


def in_domain(incidents: DataFrame, domain: Domain) -> DataFrame:
    """Incidents with a place and a date within the domain, its edges included."""
    placed = incidents.dropna(subset=["lat", "lon", "date_start"])
    return placed.where(F.col("lat").between(domain.lat_min, domain.lat_max) & F.col("lon").between(domain.lon_min, domain.lon_max))


def _named(df: DataFrame, *candidates: str) -> Column | None:
    name = find_column(df.columns, *candidates)
    return None if name is None else F.col(f"`{name}`").cast("string")


def _date(df: DataFrame, side: str) -> Column | None:
    year, month, day = (_named(df, f"{side} {part}") for part in ("year", "month", "day"))
    none = F.lit(None).cast("string")
    return None if year is None else records.assembled_date(year, none if month is None else month, none if day is None else day)


def dated_records(spark: SparkSession, path: str) -> DataFrame:
    """(key, date_start, date_end) of a table of dated records; of a repeated key the file's first row counts."""
    rows = read_table(spark, path)
    number = _named(rows, "disno", "dis no", "event")
    start, end = _date(rows, "start"), _date(rows, "end")
    return first_dates(rows.select(records.record_key(number).alias("key"), start.alias("date_start"), (start if end is None else end).alias("date_end"), "_row"))


def first_dates(keyed: DataFrame) -> DataFrame:
    """keyed(key, ..., _row) with the first row of each key."""
    return first_by(keyed.where("key is not null"), "key", ["_row"]).drop("_row")


def with_dates(places: DataFrame, dates: DataFrame) -> DataFrame:
    """places(key, ...) with the dates of their records; those without a start are left out."""
    return places.join(dates, "key", "left").dropna(subset=["date_start"])


def incident_id(record: str, place: str) -> Column:
    """What names a place of a record."""
    return F.concat_ws("_", record, place)


def located(spark: SparkSession, places: str, dates: str, domain: Domain = Domain()) -> DataFrame:
    """Incidents of a table of places (disastertype, disasterno, geo_id, country, latitude, longitude) with dates by record key."""
    rows = read_table(spark, places, encoding="ISO-8859-1")
    kind = F.trim("disastertype")
    own = rows.where(records.is_climate(kind)).withColumn("key", F.trim(F.col("disasterno").cast("string")))
    joined = with_dates(own, dated_records(spark, dates)).select(
        incident_id("disasterno", "geo_id").alias("incident_id"), kind.alias("type"), F.col("country").cast("string").alias("country"),
        "date_start", "date_end", F.col("latitude").try_cast("double").alias("lat"), F.col("longitude").try_cast("double").alias("lon"), F.lit("exact").alias("geo_precision"),
    )
    return in_domain(joined, domain)


def recorded(spark: SparkSession, path: str, places: DataFrame, domain: Domain = Domain()) -> DataFrame:
    """Incidents of a table of dated records by itself; columns are found by name, coordinates filled in from centroids."""
    rows = read_table(spark, path)
    empty = F.lit("")
    text = lambda *names: F.coalesce(F.trim(c), F.lit("nan")) if (c := _named(rows, *names)) is not None else empty
    number = lambda *names: c.try_cast("double") if (c := _named(rows, *names)) is not None else F.lit(None).cast("double")
    start, end = _date(rows, "start"), _date(rows, "end")
    start = F.lit(None).cast("date") if start is None else start
    own_id = _named(rows, "disno", "dis no", "event")
    own = rows.select(
        (F.col("_row").cast("string") if own_id is None else own_id).alias("incident_id"), text("disaster type", "type").alias("type"), text("disaster subtype", "subtype").alias("subtype"),
        text("country").alias("country"), text("iso").alias("iso"), number("latitude", "lat").alias("lat"), number("longitude", "lon").alias("lon"),
        start.alias("date_start"), (start if end is None else end).alias("date_end"),
    )
    return in_domain(with_centroids(own, places), domain).where(records.is_climate(F.col("type")))


def incidents(spark: SparkSession, source: str, dates: str, places: str | None = None, centres: str | None = None, domain: Domain = Domain()) -> DataFrame:
    """Incidents by the kind of source: 'located', a table of places and one of dated records, or 'recorded', dated records with centroids."""
    if source == "located":
        if places is None:
            raise ValueError("a located source needs its table of places")
        return located(spark, places, dates, domain)
    if source == "recorded":
        known = centroids(spark, centres) if centres else spark.createDataFrame([], CENTROIDS).select("iso3", "lat", "lon")
        return recorded(spark, dates, known, domain)
    raise ValueError(f"no source of incidents is called {source!r}; 'located' or 'recorded'")
