"""Operators over a grid: gradients."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fluxgrid.functions.geo import KM_PER_DEGREE


def derivative(value: str, x: str, by: Sequence[str], order: str) -> Column:
    """d value / d x along an axis: second order inside, also on uneven steps, and one-sided at both ends.

    Where a value that it needs is null, so is the result.
    """
    w = Window.partitionBy(F.xxhash64(*by), *by).orderBy(order)  # sorted by the hash, mostly: one number, where the columns of lines repeat
    f, at = F.col(value), F.col(x)
    f0, f1, x0, x1 = (g(c).over(w) for c in (value, x) for g in (F.lag, F.lead))
    hs, hd = at - x0, x1 - at
    inside = (hs * hs * f1 + (hd * hd - hs * hs) * f - hd * hd * f0) / (hs * hd * (hs + hd))
    return F.when(x0.isNull(), (f1 - f) / hd).when(x1.isNull(), (f - f0) / hs).otherwise(inside)


#: Rows and columns of a tile; a map of up to so many is one tile.
TILE = 256


def tiled(df: DataFrame, tile: int = TILE, reach: int = 1, corners: bool = False) -> DataFrame:
    """df with _p and _q, the row and column of each cell's tile, and _own; and copies of cells for the tiles that they border on.

    A cell within reach of a tile's edge is copied to the tile beyond it; with corners, also to the one across the corner.
    _own is false for copies.
    """
    side = lambda c: F.floor(F.col(c) / tile).cast("int")
    at = lambda c: F.pmod(F.col(c), F.lit(tile))
    steps = lambda c: [(-1, at(c) < reach), (0, F.lit(True)), (1, at(c) >= tile - reach)]
    places = [
        F.when(down & across, F.struct(F.lit(p).alias("p"), F.lit(q).alias("q")))
        for p, down in steps("lat_i") for q, across in steps("lon_i") if (p, q) != (0, 0) and (corners or not p or not q)
    ]
    every = F.array_compact(F.array(F.struct(F.lit(0).alias("p"), F.lit(0).alias("q")), *places))
    copies = df.withColumn("_to", F.explode(every))
    own = (F.col("_to.p") == 0) & (F.col("_to.q") == 0)
    return copies.withColumn("_p", side("lat_i") + F.col("_to.p")).withColumn("_q", side("lon_i") + F.col("_to.q")).withColumn("_own", own).drop("_to")


def gradient(df: DataFrame, value: str, by: Sequence[str] = ("t",), name: str = "gradient", km: bool = True, tile: int = TILE) -> DataFrame:
    """df with the length of the gradient, for each kilometre, or for each degree on both axes. Maps have all their cells.

    Rows are dealt once, by map and tile, with copies of the rows and columns next to each tile; both axes' windows use
    that, and no task needs a whole map.
    """
    dealt = tiled(df, tile).repartition(*by, "_p", "_q")
    where = [*by, "_p", "_q"]
    both = dealt.withColumn("_dy", derivative(value, "lat", [*where, "lon_i"], "lat_i")).withColumn("_dx", derivative(value, "lon", [*where, "lat_i"], "lon_i"))
    dy, dx = F.col("_dy"), F.col("_dx")
    if km:
        dy, dx = dy / KM_PER_DEGREE, dx / (KM_PER_DEGREE * F.greatest(F.cos(F.radians("lat")), F.lit(0.01)))
    return both.where("_own").withColumn(name, F.sqrt(dy * dy + dx * dx)).drop("_dy", "_dx", "_p", "_q", "_own")
