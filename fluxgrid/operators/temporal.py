"""Operators along time: climatology, anomaly, charge."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fluxgrid.operators.grid import CELL
from fluxgrid.session import BROADCAST_BYTES, estimated_bytes, written


def climatology(cube: DataFrame, value: str = "value") -> DataFrame:
    """(doy, cell, clim): the mean over all years of each ordinal day of the year, nulls skipped."""
    return cube.groupBy(F.dayofyear("day").alias("doy"), *CELL).agg(F.avg(value).alias("clim"))


def smoothed(clim: DataFrame, size: int) -> DataFrame:
    """A circular moving mean over the days of the year that are present, in their order; nulls are skipped.

    A day on which a cell has no value of its own has the mean of those near it, or null if there are none. An even
    size reaches one day further back than ahead.
    """
    if size <= 1:
        return clim
    clim = written(clim.select("doy", *CELL, "clim"))  # read three times; it has no more rows than a year of the cube
    order = Window.orderBy("doy")  # of 366 rows at most
    places = clim.select("doy").distinct().withColumn("pos", F.row_number().over(order) - 1)
    places = places.withColumn("n", F.count("*").over(Window.partitionBy()))
    back, ahead = size // 2, size - size // 2 - 1
    copies = F.sequence(-F.ceil(F.lit(back) / F.col("n")).cast("int"), F.ceil(F.lit(max(ahead, 1)) / F.col("n")).cast("int"))
    own = clim.join(F.broadcast(places), "doy")
    every = clim.select(*CELL).distinct().crossJoin(F.broadcast(places)).withColumn("clim", F.lit(None).cast("double"))
    dealt = own.unionByName(every).repartition(*CELL)  # the only shuffle: the aggregation and the window use it
    dense = dealt.groupBy(*CELL, "doy", "pos", "n").agg(F.max("clim").alias("clim"))
    rows = dense.withColumn("turn", F.explode(copies))
    rows = rows.withColumn("at", F.col("pos") + F.col("turn") * F.col("n")).where(F.col("at").between(-back, F.col("n") - 1 + ahead))
    near = Window.partitionBy(*CELL).orderBy("at").rowsBetween(-back, ahead)  # each cell has all places
    return rows.withColumn("clim", F.avg("clim").over(near)).where("turn = 0").select("doy", *CELL, "clim")


def anomaly(cube: DataFrame, clim: DataFrame, value: str = "value") -> DataFrame:
    """The cube with anomaly, the value less the climatology of its day of the year; what that lacks is left out.

    A climatology that is too large to broadcast is dealt by cell together with the cube, in the one shuffle that
    windows over a cell's days use too.
    """
    doy, clim = cube.withColumn("doy", F.dayofyear("day")), clim.select("doy", *CELL, "clim")
    columns = [*cube.columns, (F.col(value) - F.col("clim")).alias("anomaly")]
    if estimated_bytes(clim) <= BROADCAST_BYTES:
        return doy.join(F.broadcast(clim), ["doy", *CELL]).select(columns)
    same = Window.partitionBy(*CELL, "doy")
    both = doy.withColumn("_own", F.lit(True)).unionByName(clim.withColumn("_own", F.lit(False)), allowMissingColumns=True).repartition(*CELL)
    known = both.withColumn("_known", F.count_if(~F.col("_own")).over(same)).withColumn("clim", F.max("clim").over(same))
    return known.where(F.col("_own") & (F.col("_known") > 0)).select(columns)


#: Largest power of the decay that a block's weights may reach, as a natural logarithm; doubles end at about 709.
LARGEST_WEIGHT = 500.0


def scan_block(window: int, decay: float) -> int:
    """Days of a block of a decayed scan: eight windows, or fewer where the weights of a block would grow out of bounds."""
    rate = -math.log1p(-decay)
    return 8 * window if rate <= 0 else max(1, min(8 * window, int(LARGEST_WEIGHT / rate) - window))


def charge(cube: DataFrame, window: int, decay: float, value: str = "anomaly", block: int | None = None) -> DataFrame:
    """The cube with charge, the sum of the last window days' values, each lessened by the decay for each day since.

    A null counts as 0, and so do the days before the first. The cube has to be dense in days.

    The sum is the state of the recurrence s(t) = q s(t - 1) + v(t), with q = 1 - decay, less what its window has left
    behind, q^window s(t - window). States are running sums of v(t) / q^t, so that each row costs the same whatever the
    window. They start anew in each block of days; a block is preceded by a copy of the last window of the block before,
    with which every state that it needs is its own. So the days of a cell may lie in as many tasks as it has blocks, and
    a cube that is dealt by cell already isn't dealt again.
    """
    q, own = 1.0 - decay, F.coalesce(F.nanvl(F.col(value).cast("double"), F.lit(0.0)), F.lit(0.0))
    if q > 0.0:
        window = max(1, min(window, int(LARGEST_WEIGHT / 2 / -math.log(q)))) if q < 1.0 else window  # what is older has no weight left
    if window <= 1 or q <= 0.0:
        return cube.withColumn("charge", own)
    block = block or scan_block(window, decay)
    if block < window:
        raise ValueError(f"a block of {block} days is shorter than the window of {window}")
    number = F.floor(F.col("t") / block).cast("int")
    ahead = F.when(F.pmod("t", F.lit(block)) >= block - window, F.array(number, number + 1)).otherwise(F.array(number))
    rows = cube.withColumn("_own", own).withColumn("_block", F.explode(ahead))
    days = Window.partitionBy(F.xxhash64(*CELL, "_block"), *CELL, "_block").orderBy("t")  # sorted by one number, mostly
    since = F.col("t") - F.col("_block") * block  # from -window on
    weighted = F.sum(F.col("_own") * F.pow(F.lit(1.0 / q), since)).over(days.rowsBetween(Window.unboundedPreceding, 0))
    states = rows.withColumn("_since", since).withColumn("_state", weighted * F.pow(F.lit(q), since))
    left = F.lag("_state", window, 0.0).over(days)
    return states.withColumn("charge", F.col("_state") - left * F.lit(q**window)).where("_since >= 0").drop("_own", "_block", "_since", "_state")
