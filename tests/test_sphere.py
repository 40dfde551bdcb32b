"""Cells of the sphere cover all that is within reach, and little else."""

import collections

import numpy as np
import pytest
from pyspark.sql import functions as F

from fluxgrid.functions import sphere
from fluxgrid.functions.geo import KM_PER_DEGREE_AT_LEAST, haversine
from fluxgrid.operators import validate


@pytest.fixture(scope="module")
def places(spark):
    rng = np.random.default_rng(6)
    lat = np.concatenate((np.degrees(np.arcsin(rng.uniform(-1, 1, 500))), rng.choice([90.0, -90.0, 89.9, -89.5, 0.0, 60.0], 60)))
    lon = np.concatenate((rng.uniform(-180, 180, 500), rng.choice([180.0, -180.0, 179.9, -179.9, 0.0, 360.0], 60)))
    rows = [(k, float(a), float(b)) for k, (a, b) in enumerate(zip(lat, lon, strict=True))]
    return rows, spark.createDataFrame(rows, "id int, lat double, lon double").persist()


@pytest.mark.parametrize("km", [50.0, 700.0, 3000.0, 12000.0, 25000.0])
def test_no_pair_is_lost(places, km):
    _, df = places
    reach = km / KM_PER_DEGREE_AT_LEAST
    size = sphere.width(reach)
    at = (F.col("lat"), F.col("lon"))
    a = df.select("id", *at, F.explode(sphere.cover(*at, reach, size)).alias("cell"))
    assert a.groupBy("id", "cell").count().where("count > 1").isEmpty()
    b = df.select(F.col("id").alias("to"), F.col("lat").alias("lat2"), F.col("lon").alias("lon2"), sphere.cell(*at, size).alias("cell"))
    near = haversine(F.col("lat"), F.col("lon"), F.col("lat2"), F.col("lon2")) <= km
    met = a.join(b, "cell")
    found = collections.Counter(map(tuple, met.where(near).select("id", "to").collect()))
    every = collections.Counter(map(tuple, a.select("id", "lat", "lon").distinct().crossJoin(b.drop("cell")).where(near).select("id", "to").collect()))
    assert found == every


def test_places_without_coordinates(spark):
    df = spark.createDataFrame([(None, 1.0), (1.0, None), (float("nan"), 1.0)], "lat double, lon double")
    assert [r[0] for r in df.select(F.size(sphere.cover(F.col("lat"), F.col("lon"), 5.0, 5.0))).collect()] == [0, 0, 0]


def test_few_candidates(spark):
    """Events meet about the incidents around them, less than a tenth of those in their band of latitudes."""
    rng = np.random.default_rng(8)
    lat, lon = np.degrees(np.arcsin(rng.uniform(-1, 1, 4000))), rng.uniform(-180, 180, 4000)
    df = spark.createDataFrame([(k, float(a), float(b)) for k, (a, b) in enumerate(zip(lat, lon, strict=True))], "id int, lat double, lon double").persist()
    reach = 500.0 / KM_PER_DEGREE_AT_LEAST
    size, at = sphere.width(reach), (F.col("lat"), F.col("lon"))
    met = df.select(F.explode(sphere.cover(*at, reach, size)).alias("cell")).join(df.select(sphere.cell(*at, size).alias("cell")), "cell").count()
    strip = F.floor((F.col("lat") + 90) / reach)
    banded = df.select(F.explode(F.sequence(strip - 1, strip + 1)).alias("s")).join(df.select(strip.alias("s")), "s").count()
    assert met < banded / 10


@pytest.mark.parametrize("radius", [300.0, 2500.0])
def test_coverage_equals_all_pairs(spark, places, radius):
    rows, df = places
    day = F.date_add(F.lit("2024-01-01").cast("date"), F.col("id") % 17)
    incidents = df.select(F.col("id").alias("incident_id"), day.alias("date_start"), "lat", "lon")
    events = df.select((F.col("id") + 1).alias("event_id"), F.date_add(day, 3).alias("date_start"), F.date_add(day, 5).alias("date_end"), (-F.col("lat")).alias("incept_lat"), F.col("lon").alias("incept_lon"))
    got = {(r.event_id, r.incident_id) for r in validate.coverage(events, incidents, radius, 2, 1).collect()}
    both = events.crossJoin(incidents.withColumnRenamed("date_start", "d"))
    ok = (haversine(F.col("incept_lat"), F.col("incept_lon"), F.col("lat"), F.col("lon")) <= radius) & (F.datediff("date_start", "d") <= 1) & (F.datediff("d", "date_end") <= 2)
    assert got == {(r.event_id, r.incident_id) for r in both.where(ok).collect()}


def test_sweep_equals_each_setting(spark, places):
    rows, df = places
    day = F.date_add(F.lit("2024-01-01").cast("date"), F.col("id") % 17)
    incidents = df.select(F.col("id").alias("incident_id"), day.alias("date_start"), "lat", "lon")
    events = df.where("id % 3 = 0").select("id", F.col("id").alias("event_id"), F.date_sub(day, 4).alias("date_start"), F.date_sub(day, 3).alias("date_end"), F.col("lat").alias("incept_lat"), (F.col("lon") + 3).alias("incept_lon"))
    radii, lookbacks = [900.0, 100.0, 400.0, 3000.0, 900.0], [6, 0, 3, 4]
    out = validate.sweep(events, incidents, radii, lookbacks, 1).orderBy("k").collect()
    assert [(r.radius_km, r.lookback) for r in out] == [(float(a), float(b)) for a in radii for b in lookbacks]
    for r in out:
        pairs = validate.coverage(events, incidents, r.radius_km, r.lookback, 1)
        hits = pairs.agg(F.countDistinct("incident_id"), F.countDistinct("event_id")).first()
        assert (r.incidents_hit, r.predictions_that_hit) == tuple(hits)
    none = validate.sweep(events.limit(0), incidents, [1.0], [2], 1).first()
    assert (none.incidents_hit, none.predictions_that_hit, none.precision) == (0, 0, None)
