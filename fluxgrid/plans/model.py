"""The whole model as lazy tables, over any inputs, and the projections of the test tables onto its inputs."""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fluxgrid.config import Breakdown, Charge, Clustering, Config, Domain, Permittivity
from fluxgrid.operators import catalog, cluster, field, grid, spatial, temporal
from fluxgrid.session import cut, written


@dataclass
class Model:
    """From a daily cube (day, t, cell, lat, lon, value) and terrain (cell, lat, lon, elevation, slope) to the catalog.

    Nothing runs before a table is used. The field and the events are then written once; what is read of them several
    times isn't computed again.
    """

    cube: DataFrame
    terrain: DataFrame
    config: Config

    @cached_property
    def climatology(self) -> DataFrame:
        return temporal.smoothed(temporal.climatology(self.cube), self.config.charge.climatology_smooth_days)

    @cached_property
    def anomaly(self) -> DataFrame:
        return temporal.anomaly(self.cube, self.climatology)

    @cached_property
    def charge(self) -> DataFrame:
        c = self.config.charge
        return temporal.charge(self.anomaly, c.window_days, c.decay_per_day)

    @cached_property
    def gradient(self) -> DataFrame:
        return spatial.gradient(self.charge, "charge")

    @cached_property
    def ground(self) -> DataFrame:
        p = self.config.permittivity
        return field.with_permittivity(self.terrain, p.method, p.eps_min, p.eps_max, p.params)

    @cached_property
    def field(self) -> DataFrame:
        """Written once to the shared folder: the threshold, the flags, the references and the catalog all read it."""
        return written(field.breakdown(self.gradient, self.ground))

    @cached_property
    def threshold(self) -> DataFrame:
        b = self.config.breakdown
        return field.threshold(self.field, b.threshold_mode, b.threshold_value, self.config.domain.analysis_lat_max)

    @cached_property
    def flagged(self) -> DataFrame:
        return field.flagged(self.field, self.threshold, self.config.domain.analysis_lat_max)

    @cached_property
    def blobs(self) -> DataFrame:
        c = self.config.clustering
        if c.algorithm == "dbscan":
            labels = cluster.dbscan(self.flagged, c.dbscan_eps_cells * self.config.domain.resolution_deg, c.dbscan_min_samples)
            return cluster.blobs(self.flagged, labels)
        labels = cluster.components(self.flagged, cluster.merge_steps(c.dbscan_eps_cells))
        return cluster.blobs(self.flagged, labels, c.dbscan_min_samples)

    @cached_property
    def events(self) -> DataFrame:
        return cut(cluster.linked(self.blobs, self.config.clustering.link_radius_km))

    @cached_property
    def catalog(self) -> DataFrame:
        return catalog.catalog(self.events, self.field, self.ground, self.config.charge.window_days)

    def by_permittivity(self, recipes: dict[str, Permittivity]) -> dict[str, Model]:
        """A model for each recipe of permittivity; all share what comes before it, which is written once."""
        shared, out = written(self.gradient), {}
        for name, recipe in recipes.items():
            out[name] = Model(self.cube, self.terrain, replace(self.config, permittivity=recipe))
            out[name].__dict__["gradient"] = shared  # where cached_property keeps it
        return out


#: The settings for the test tables, whose grid is coarse and whose days are few.
CONFIG = Config(
    domain=Domain(resolution_deg=15.0), charge=Charge(7, 0.02, 15), permittivity=Permittivity("linear", 0.5, 1.0),
    breakdown=Breakdown("percentile", 90.0), clustering=Clustering("components", 2.0, 3, 2000.0),
)
RADIUS_KM, LOOKBACK, LOOKAHEAD = 1500.0, 2, 2
LATS, LONS = [-67.5 + 15.0 * i for i in range(10)], [-168.0 + 24.0 * j for j in range(15)]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cells(spark: SparkSession) -> DataFrame:
    return grid.grid(spark, LATS, LONS)


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(ts, lat_i, lon_i, value): events as readings of a cell of 10 x 15, by user."""
    place = F.col("user_id") % 150
    return table(spark, sf_dir, "events").select(
        "ts", (place % 10).cast("int").alias("lat_i"), F.floor(place / 10).cast("int").alias("lon_i"), (F.col("value") / 9.7).alias("value")
    )


def cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid.densified(grid.daily(observations(spark, sf_dir), "mean"), cells(spark))


def long_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(day, lat_i, lon_i, value): line items as a cube of 2 x 5 cells over several years."""
    return table(spark, sf_dir, "lineitem").groupBy(
        F.to_date("l_shipdate").alias("day"), (F.col("l_suppkey") % 2).cast("int").alias("lat_i"), (F.floor(F.col("l_suppkey") / 2) % 5).cast("int").alias("lon_i")
    ).agg(F.avg("l_quantity").alias("value"))


def terrain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(cell, lat, lon, elevation, slope): suppliers as heights; cells without one are at sea level."""
    place = F.col("s_suppkey") % 150
    heights = table(spark, sf_dir, "supplier").groupBy((place % 10).cast("int").alias("lat_i"), F.floor(place / 10).cast("int").alias("lon_i")).agg(
        F.max(F.greatest("s_acctbal", F.lit(0.0)) / 2.3).alias("height")
    )
    flat = cells(spark).join(heights, ["lat_i", "lon_i"], "left").select("lat_i", "lon_i", "lat", "lon", F.coalesce("height", F.lit(0.0)).alias("elevation"))
    return spatial.gradient(flat.withColumn("map", F.lit(0)), "elevation", ["map"], "slope", km=False).drop("map")


def incidents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(incident_id, date_start, lat, lon, geo_precision): each order as an incident."""
    key = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(
        key.alias("incident_id"), F.date_add(F.lit("2024-01-01").cast("date"), (F.floor(key / 10) % 30).cast("int")).alias("date_start"),
        (-60.0 + F.col("o_custkey") * 37 % 121).alias("lat"), (-180.0 + key * 53 % 360).alias("lon"),
        F.when(key % 3 == 0, "estimated").otherwise("exact").alias("geo_precision"),
    )


def model(spark: SparkSession, sf_dir: str, config: Config = CONFIG) -> Model:
    return Model(cube(spark, sf_dir), terrain(spark, sf_dir), config)
