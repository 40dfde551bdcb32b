"""The model's operators on small inputs with results known by hand or by numpy."""

import datetime as dt
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from fluxgrid.config import Config, load_config
from fluxgrid.functions import permittivity, records
from fluxgrid.functions.stats import binomial_tail, quantile
from fluxgrid.operators import cluster, field, grid, spatial, temporal, validate
from fluxgrid.operators.graph import connected_components
from fluxgrid.plans.model import Model
from fluxgrid.sources import synthetic


@pytest.fixture(scope="module")
def toy(spark):
    """120 days of a 6 x 8 grid of noise around 280."""
    rng = np.random.default_rng(0)
    values = 280 + rng.normal(size=(120, 6, 8))
    lats, lons = np.linspace(-50, 50, 6), np.linspace(-100, 100, 8)
    first = dt.date(2020, 1, 1)
    rows = [
        (first + dt.timedelta(t), t, i, j, float(lats[i]), float(lons[j]), float(values[t, i, j]))
        for t in range(120) for i in range(6) for j in range(8)
    ]
    cube = spark.createDataFrame(rows, "day date, t int, lat_i int, lon_i int, lat double, lon double, value double").coalesce(2).persist()
    return cube, values, lats, lons


def _array(df, name, shape):
    out = np.full(shape, np.nan)
    for r in df.select("t", "lat_i", "lon_i", F.col(name).alias("x")).collect():
        out[r.t, r.lat_i, r.lon_i] = np.nan if r.x is None else r.x
    return out


def test_toy_chain_equals_numpy(toy):
    cube, values, lats, lons = toy
    own = temporal.anomaly(cube, temporal.smoothed(temporal.climatology(cube), 5))
    smooth = np.mean([np.roll(values, k, axis=0) for k in range(-2, 3)], axis=0)
    anomaly = values - smooth
    charge = np.zeros_like(anomaly)
    for k in range(30):
        charge[k:] += anomaly[: 120 - k] * 0.98**k
    gy = np.gradient(charge, lats, axis=1) / 111.32
    gx = np.gradient(charge, lons, axis=2) / (111.32 * np.maximum(np.cos(np.radians(lats)), 0.01))[None, :, None]
    found = spatial.gradient(temporal.charge(own, 30, 0.02), "charge").persist()
    np.testing.assert_allclose(_array(found, "charge", values.shape), charge, atol=1e-9)
    np.testing.assert_allclose(_array(found, "gradient", values.shape), np.hypot(gx, gy), atol=1e-11)
    plain = temporal.charge(own, 30, 0.1)
    assert plain.agg(F.avg(F.abs("charge"))).first()[0] < found.agg(F.avg(F.abs("charge"))).first()[0]
    ground = cube.where("t = 0").select("lat_i", "lon_i", F.lit(0.5).alias("eps"))
    stress = field.breakdown(found, ground)
    thr = field.threshold(stress, "percentile", 97.5, None)
    n = field.flagged(stress, thr, None).count()
    assert stress.where("E < 0").isEmpty() and 0 < n / (120 * 48) < 0.1
    assert math.isclose(thr.first()[0], np.percentile(2 * np.hypot(gx, gy), 97.5), rel_tol=1e-9)
    assert math.isclose(quantile(stress, "E", 0.975, "x", narrow=True).first()[0], thr.first()[0], rel_tol=1e-12)


def test_anomaly_is_the_same_by_broadcast_and_dealt_by_cell(toy, spark, monkeypatch):
    cube = toy[0].withColumn("value", F.when(F.col("t") % 7 > 0, F.col("value"))).withColumn("more", F.col("t") * 2)
    clim = temporal.climatology(cube).where("doy <> 5 and lat_i <> 2").withColumn("clim", F.when(F.col("doy") != 9, F.col("clim")))
    want = temporal.anomaly(cube, clim)
    rows = sorted(map(tuple, want.drop("anomaly").collect()), key=str)
    values = _array(want, "anomaly", toy[1].shape)
    monkeypatch.setattr(temporal, "BROADCAST_BYTES", -1)
    got = temporal.anomaly(cube, clim)
    assert got.columns == want.columns and sorted(map(tuple, got.drop("anomaly").collect()), key=str) == rows
    np.testing.assert_allclose(_array(got, "anomaly", toy[1].shape), values, atol=1e-12)
    assert len(rows) == 119 * 5 * 8 and np.isnan(values[8]).all()
    plan = temporal.charge(got, 30, 0.02)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(lat_i" in plan and plan.count("REPARTITION_BY_COL") == 1 and "Join" not in plan


def test_even_smoothing_reaches_further_back(spark):
    clim = spark.createDataFrame([(d, 0, 0, float(d * d)) for d in range(1, 6)], "doy int, lat_i int, lon_i int, clim double")
    got = {r.doy: r.clim for r in temporal.smoothed(clim, 4).collect()}
    x = np.array([1, 4, 9, 16, 25.0])
    assert got == {d: pytest.approx(np.mean([x[(d - 1 + k) % 5] for k in range(-2, 2)])) for d in range(1, 6)}


def test_permittivity(spark):
    assert {"linear", "log", "slope", "combined"} <= set(permittivity.names())
    ground = spark.createDataFrame([(0, i, 100.0 * i, float(i)) for i in range(50)], "lat_i int, lon_i int, elevation double, slope double")
    for method in permittivity.names():
        eps = [r.eps for r in field.with_permittivity(ground, method, 0.2, 1.0, {"elevation_ref_m": 4000.0}).orderBy("lon_i").collect()]
        assert all(0.2 - 1e-9 <= x <= 1.0 for x in eps) and eps[0] > eps[-1]
    with pytest.raises(KeyError, match="linear"):
        permittivity.permittivity("none", permittivity.Terrain(F.lit(1.0)))
    with pytest.raises(ValueError):
        permittivity.permittivity("slope", permittivity.Terrain(F.lit(1.0)))


def test_blobs_equal_dilation(spark):
    """Blobs of random maps equal components of the dilated map, and density clusters a direct search."""
    rng, rows = np.random.default_rng(3), []
    maps = [rng.random((9, 12)) < 0.18 for _ in range(12)]
    for t, m in enumerate(maps):
        rows += [(t, int(i), int(j), float(i), float(j)) for i, j in zip(*np.nonzero(m), strict=True)]
    cells = spark.createDataFrame(rows, "t int, lat_i int, lon_i int, lat double, lon double")
    got = {(r.t, r.lat_i, r.lon_i): r.label for r in cluster.components(cells, 1).collect()}
    for t, m in enumerate(maps):
        wide = np.zeros((13, 16), bool)
        for di in range(-1, 2):
            for dj in range(-1, 2):
                wide[2 + di : 11 + di, 2 + dj : 14 + dj] |= m
        label = np.zeros(wide.shape, int)
        for i, j in zip(*np.nonzero(wide), strict=True):
            if label[i, j] == 0:
                label[i, j] = label.max() + 1
                todo = [(i, j)]
                while todo:
                    p, q = todo.pop()
                    for x in range(p - 1, p + 2):
                        for y in range(q - 1, q + 2):
                            if 0 <= x < 13 and 0 <= y < 16 and wide[x, y] and not label[x, y]:
                                label[x, y] = label[i, j]
                                todo.append((x, y))
        own = [(got[t, i, j], label[i + 2, j + 2]) for i, j in zip(*np.nonzero(m), strict=True)]
        assert len(set(own)) == len({a for a, _ in own}) == len({b for _, b in own})
    dense = cluster.dbscan(cells, 1.5, 3).collect()
    assert 0 < len(dense) < len(rows)
    steps = cluster.adjacency(cells, 1).count()
    assert steps == sum(1 for a in rows for b in rows if a[0] == b[0] and a[1:3] < b[1:3] and max(abs(a[1] - b[1]), abs(a[2] - b[2])) <= 3)


@pytest.mark.parametrize("in_one_task", [0, 1000])
def test_connected_components(spark, in_one_task):
    random.seed(5)
    edges = [(random.randrange(200), random.randrange(200)) for _ in range(120)] + [(1000 + k, 1001 + k) for k in range(40)] + [(7, 7), (None, 3)]
    root = {x: x for e in edges if None not in e for x in e}
    for _ in root:
        for a, b in edges:
            if a is not None:
                root[a] = root[b] = min(root[a], root[b])
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long"), in_one_task=in_one_task).collect()}
    assert got == root


def test_coverage_equals_all_pairs(spark):
    random.seed(2)
    day = lambda k: dt.date(2024, 1, 1) + dt.timedelta(k)
    events = [(k, day(s := random.randrange(40)), day(s + random.randrange(5)), random.uniform(-80, 80), random.uniform(-180, 180), random.random(), 1) for k in range(60)]
    found = [(k, day(random.randrange(45)), random.uniform(-80, 80), random.uniform(-180, 180), random.choice(["exact", "estimated"])) for k in range(300)]
    catalog = spark.createDataFrame(events, "event_id long, date_start date, date_end date, incept_lat double, incept_lon double, peak_E double, n int").persist()
    incidents = spark.createDataFrame(found, "incident_id long, date_start date, lat double, lon double, geo_precision string").persist()

    def km(a, b, c, d):
        x = math.sin(math.radians(c - a) / 2) ** 2 + math.cos(math.radians(a)) * math.cos(math.radians(c)) * math.sin(math.radians(d - b) / 2) ** 2
        return 2 * 6371 * math.asin(math.sqrt(min(1, x)))

    expected = {(e[0], i[0]) for e in events for i in found if km(e[3], e[4], i[2], i[3]) <= 2500 and e[1] <= i[1] + dt.timedelta(2) and e[2] >= i[1] - dt.timedelta(4)}
    pairs = validate.coverage(catalog, incidents, 2500.0, 4, 2).persist()
    got = [(r.event_id, r.incident_id) for r in pairs.collect()]
    assert len(got) == len(set(got)) and set(got) == expected
    report = validate.with_p_value(validate.scores(catalog, incidents, pairs, 2500.0, 4, 2)).first()
    assert report.incidents_hit == len({b for _, b in expected}) and 0 <= report.p_value <= 1
    curve = validate.pr_curve(catalog, incidents, pairs).orderBy("rank").collect()
    assert curve[-1].recall == pytest.approx(report.recall) and curve[-1].precision == pytest.approx(report.precision)
    none = validate.scores(catalog.limit(0), incidents, pairs.limit(0), 2500.0, 4, 2).first()
    assert none.precision is None and none.recall == 0


def test_binomial_tail():
    for n, p, k in ((10, 0.3, 4), (50, 0.9, 48), (200, 0.01, 0), (200, 0.01, 7)):
        exact = sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k, n + 1))
        assert binomial_tail(k, n, p) == pytest.approx(exact, rel=1e-9)
    assert binomial_tail(1, 5, 0.0) == 0.0


def test_dates_and_names(spark):
    given = [("2001", "2", "31"), ("2001", None, None), ("x", "1", "1"), ("2001", "14", "0"), (None, "1", "1")]
    rows = spark.createDataFrame(given, "y string, m string, d string").select(records.assembled_date(F.col("y"), F.col("m"), F.col("d")).alias("x")).collect()
    assert [r.x for r in rows] == [dt.date(2001, 2, 28), dt.date(2001, 1, 1), None, dt.date(2001, 12, 1), None]
    assert records.find_column(["Type A", "Disaster Type"], "disaster type", "type") == "Disaster Type"


def test_regrid_edges(spark):
    rows = [(i, j, float(10 * i + j)) for i in range(3) for j in range(4)]
    own = spark.createDataFrame(rows, "lat_i int, lon_i int, value double")
    axes = [-10.0, 0.0, 10.0], [-135.0, -45.0, 45.0, 135.0]
    got = {(r.lat, r.lon): r.value for r in grid.regridded(own, axes, ([-5.0, 10.0, 12.0], [-90.0, 135.0, 170.0])).collect()}
    assert got == {(-5.0, -90.0): 5.5, (-5.0, 135.0): 8.0, (-5.0, 170.0): None, (10.0, -90.0): 20.5, (10.0, 135.0): 23.0, (10.0, 170.0): None, (12.0, -90.0): None, (12.0, 135.0): None, (12.0, 170.0): None}
    assert grid.regridded(own, axes, ([0.0], [180.0]), wrap=True).first().value == pytest.approx(11.5)


def test_settings(tmp_path):
    (tmp_path / "c.yaml").write_text("charge: {window_days: 5}\nvalidation: {success: {min_recall: 0.5}}\nrun: {seed: 1}\n")
    config = load_config(tmp_path / "c.yaml")
    assert config.charge.window_days == 5 and config.charge.decay_per_day == 0.02 and config.validation.min_recall == 0.5
    assert load_config() == Config() and len(config.key()) == 8 != config.key() != Config().key()


def test_planted_event_stands_out(spark):
    lats, lons = grid.centres(15, 51, 4), grid.centres(60, 96, 4)
    cube = synthetic.temperature(spark, lats, lons, "2015-01-01", "2016-12-31")
    made = Model(cube, synthetic.terrain(spark, lats, lons), Config())
    own = made.field.where("day between '2015-08-20' and '2015-09-10'").agg(F.max("E")).first()[0]
    assert own / made.field.agg(F.percentile("E", 0.5)).first()[0] > 3


def test_smoothing_fills_days_without_a_value(spark):
    """A place and day without a value of its own has the mean of its neighbours in the circle of days that are present."""
    rows = [(doy, 0, 0, float(doy)) for doy in (1, 2, 10)] + [(2, 0, 1, 5.0)]
    found = {(r.doy, r.lon_i): r.clim for r in temporal.smoothed(spark.createDataFrame(rows, "doy int, lat_i int, lon_i int, clim double"), 3).collect()}
    assert found == {(1, 0): 13 / 3, (2, 0): 13 / 3, (10, 0): 13 / 3, (1, 1): 5.0, (2, 1): 5.0, (10, 1): 5.0}
    apart = [(k, 0, 0, 1.0) for k in range(1, 12)] + [(1, 0, 1, 2.0)]
    found = {(r.doy, r.lon_i): r.clim for r in temporal.smoothed(spark.createDataFrame(apart, "doy int, lat_i int, lon_i int, clim double"), 3).collect()}
    assert len(found) == 22 and found[11, 1] == found[2, 1] == 2.0 and found[6, 1] is None


def test_ranks_and_running_sums_over_ranges(spark, monkeypatch):
    monkeypatch.setattr(grid, "BLOCK", 7)
    rng = random.Random(4)
    values = rng.sample(range(1000), 100)
    rows = spark.createDataFrame([(v, v % 5 if v % 3 else None) for v in values], "v int, n int").repartition(6)
    out = grid.running(grid.ranked(rows, F.desc("v")), "rank", "n").orderBy("rank").collect()
    want, total = [], 0
    for k, v in enumerate(sorted(values, reverse=True), 1):
        total += v % 5 if v % 3 else 0
        want.append((k, v, total))
    assert [(r["rank"], r.v, r.n) for r in out] == want
    assert grid.ranked(rows.limit(0), "v").isEmpty()


def test_links_in_bands_lose_no_pair(spark):
    rng = random.Random(9)
    rows = [(t, dt.date(2020, 1, 1), rng.uniform(-90, 90), rng.uniform(-180, 180), 5, 1.0, k, 0) for t in range(3) for k in range(60)]
    found = spark.createDataFrame(rows, "day_index int, day date, lat double, lon double, n_cells long, peak_E double, first_lat_i int, first_lon_i int")
    for radius in (50.0, 700.0, 30000.0):
        got = {(r.a, r.b) for r in cluster.links(found, radius).collect()}
        key = lambda r: (r[0] << 40) + (r[6] << 20)
        km = lambda a, b: 2 * 6371.0 * math.asin(min(1.0, math.sqrt(math.sin(math.radians(b[2] - a[2]) / 2) ** 2 + math.cos(math.radians(a[2])) * math.cos(math.radians(b[2])) * math.sin(math.radians(b[3] - a[3]) / 2) ** 2)))
        assert got == {(key(a), key(b)) for a in rows for b in rows if a[0] == b[0] + 1 and km(a, b) <= radius}


def test_scene_levels_and_targets(spark):
    made = synthetic.scene(spark, Config().domain.__class__(resolution_deg=30.0), "2015-01-01", "2015-03-31", noise=False)
    assert made.cube.count() == 90 * 6 * 12 and made.terrain.count() == 72 and str(made.event.first().peak_day) == "2015-01-31"
    plain = spark.createDataFrame([(1, 10.0), (2, 20.0)], "level int, v double")
    assert [r.v for r in grid.at_level(plain, 1).collect()] == [20.0] and grid.at_level(plain.drop("level")).count() == 2
    report = spark.createDataFrame([(0.5, 0.05, 0.01), (None, None, None)], "recall double, precision double, p_value double")
    told = [tuple(r)[3:] for r in validate.meets_targets(report, Config().validation).collect()]
    assert told == [(True, False, True), (False, False, False)]
