"""Operators over tiles and blocks give what whole maps and series give, wherever the tiles' edges lie."""

import collections
import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from fluxgrid.operators import cluster, grid, spatial, temporal


@pytest.fixture(scope="module")
def cells(spark):
    """Flagged cells of some days, from sparse to dense, with their places."""
    rng = np.random.default_rng(7)
    rows = []
    for t, share in enumerate((0.03, 0.1, 0.2, 0.35, 0.6)):
        for i, j in np.argwhere(rng.random((23, 31)) < share).tolist():
            rows.append((t, i, j, -40.0 + 1.5 * i, -60.0 + 1.5 * j))
    return rows, spark.createDataFrame(rows, "t int, lat_i int, lon_i int, lat double, lon double").repartition(4).persist()


def flood(points, near):
    """The parts of points that links of near pairs connect, as sets."""
    left, out = set(points), []
    while left:
        part, todo = set(), [min(left)]
        while todo:
            p = todo.pop()
            if p in left:
                left.discard(p)
                part.add(p)
                todo += [q for q in left if near(p, q)]
        out.append(frozenset(part))
    return out


def grouped(df):
    out = collections.defaultdict(set)
    for r in df.collect():
        assert (r.lat_i, r.lon_i) not in out[r.t, r.label]
        out[r.t, r.label].add((r.lat_i, r.lon_i))
    for (_, label), part in out.items():
        assert label <= min(i << 20 | j for i, j in part) or label in {i << 20 | j for i, j in part}
    return collections.Counter((t, frozenset(part)) for (t, _), part in out.items())


@pytest.mark.parametrize("tile", [3, 4, 7, 256])
@pytest.mark.parametrize("steps", [0, 1])
def test_components_over_tiles(cells, tile, steps):
    rows, df = cells
    reach = 2 * steps + 1
    days = collections.defaultdict(list)
    for t, i, j, *_ in rows:
        days[t].append((i, j))
    want = collections.Counter((t, part) for t, own in days.items() for part in flood(own, lambda p, q: abs(p[0] - q[0]) <= reach and abs(p[1] - q[1]) <= reach))
    found = cluster.components(df, steps, tile)
    assert grouped(found) == want
    for r in found.groupBy("t", "label").agg(F.min(F.col("lat_i") * (1 << 20) + F.col("lon_i")).alias("first")).collect():
        assert r.label == r.first


@pytest.mark.parametrize("tile", [2, 3, 256])
@pytest.mark.parametrize(("eps", "least"), [(1.5, 3), (2.2, 5), (3.0, 6)])
def test_dbscan_over_tiles(cells, tile, eps, least):
    rows, df = cells
    want = {}
    for t in {r[0] for r in rows}:
        at = {(i, j): (lat, lon) for d, i, j, lat, lon in rows if d == t}
        near = lambda p, q, at=at: np.hypot(at[p][0] - at[q][0], at[p][1] - at[q][1]) <= eps + 1e-9
        beside = {p: [q for q in at if near(p, q)] for p in at}
        core = {p for p in at if len(beside[p]) >= least}
        first = {p: min(part) for part in flood(core, near) for p in part}
        for p in at:
            reached = [first[q] for q in beside[p] if q in core]
            if reached:
                want[t, *p] = first[p] if p in core else min(reached)
    found = {(r.t, r.lat_i, r.lon_i): (r.label >> 20, r.label & (1 << 20) - 1) for r in cluster.dbscan(df, eps, least, tile).collect()}
    assert found == want


def test_empty_days(cells):
    _, df = cells
    assert cluster.components(df.limit(0), 1, 4).isEmpty() and cluster.dbscan(df.limit(0), 2.0, 3, 4).isEmpty()


@pytest.mark.parametrize("km", [True, False])
def test_gradient_over_tiles(spark, km):
    rng = np.random.default_rng(3)
    lat, lon = np.sort(rng.uniform(-80, 80, 13)), np.sort(rng.uniform(-170, 170, 17))
    value = rng.normal(size=(2, 13, 17))
    rows = [(t, i, j, float(lat[i]), float(lon[j]), None if t and (i, j) == (5, 8) else float(value[t, i, j])) for t in range(2) for i in range(13) for j in range(17)]
    df = spark.createDataFrame(rows, "t int, lat_i int, lon_i int, lat double, lon double, v double").repartition(3)
    made = [{(r.t, r.lat_i, r.lon_i): r.gradient for r in spatial.gradient(df, "v", km=km, tile=tile).collect()} for tile in (1, 4, 5, 256)]
    assert all(len(m) == len(rows) for m in made) and all(m == made[-1] for m in made)
    dy, dx = np.gradient(value[0], lat, lon)
    if km:
        dy, dx = dy / spatial.KM_PER_DEGREE, dx / (spatial.KM_PER_DEGREE * np.maximum(np.cos(np.radians(lat)), 0.01)[:, None])
    want = np.hypot(dy, dx)
    assert all(made[1][0, i, j] == pytest.approx(want[i, j], rel=1e-9) for i in range(13) for j in range(17))
    assert made[1][1, 5, 8] is None and made[1][1, 4, 8] is None and made[1][1, 7, 8] is not None


def test_a_map_lies_in_several_tasks(spark):
    rows = [(0, i, j, float(i), float(j), float(i * j)) for i in range(40) for j in range(40)]
    df = spark.createDataFrame(rows, "t int, lat_i int, lon_i int, lat double, lon double, v double")
    conf = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        tasks = [r.n for r in spatial.gradient(df, "v", tile=8).groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", conf)
    assert len(tasks) > 1 and max(tasks) < 1600


@pytest.mark.parametrize(("window", "decay"), [(30, 0.02), (7, 0.0), (5, 0.5), (40, 0.9), (3, 1.0), (1, 0.1)])
@pytest.mark.parametrize("block", [None, 40, 64])
def test_charge_in_blocks(spark, window, decay, block):
    rng = np.random.default_rng(9)
    x = rng.normal(size=(2, 400)) * 5
    start = dt.date(2020, 1, 1)
    rows = [(start + dt.timedelta(t), t, c, 0, None if t == 50 else float(x[c, t]), "k") for c in range(2) for t in range(400)]
    df = spark.createDataFrame(rows, "day date, t int, lat_i int, lon_i int, anomaly double, _x string").repartition(5)
    made = temporal.charge(df, window, decay, block=block)
    assert made.columns == [*df.columns, "charge"]
    found = {(r.lat_i, r.t): r.charge for r in made.collect()}
    x[:, 50] = 0
    assert len(found) == 800
    for c in range(2):
        want = np.convolve(x[c], (1 - decay) ** np.arange(window))[:400]
        assert np.allclose([found[c, t] for t in range(400)], want, rtol=1e-9, atol=1e-9)


def test_dense_days_are_made_in_several_tasks(spark):
    cells = grid.grid(spark, [float(i) for i in range(20)], [float(j) for j in range(30)])
    seen = spark.createDataFrame([(dt.date(2020, 1, 1), 0, 0, 1.0), (dt.date(2022, 1, 1), 3, 4, 2.0)], "day date, lat_i int, lon_i int, value double")
    tasks = [r["count"] for r in grid.densified(seen, cells).groupBy(F.spark_partition_id()).count().collect()]
    assert sum(tasks) == 732 * 600 and len(tasks) > 1 and max(tasks) < 0.5 * sum(tasks)
    assert grid.densified(seen.limit(0), cells).isEmpty()


def test_blocks_stay_in_range():
    for window, decay in ((30, 0.02), (30, 0.0), (5, 0.9), (100, 0.5)):
        block = temporal.scan_block(window, decay)
        assert block >= 1 and (decay == 0 or (block + window) * -np.log(1 - decay) <= 709)


def test_a_series_lies_in_several_tasks(spark):
    rows = [(t, 0, 0, 1.0) for t in range(2000)]
    df = spark.createDataFrame(rows, "t int, lat_i int, lon_i int, anomaly double")
    conf = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        tasks = temporal.charge(df, 30, 0.02).groupBy(F.spark_partition_id()).count().collect()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", conf)
    assert len(tasks) > 1
