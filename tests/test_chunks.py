"""Chunk stores: round trips, pruning to the chunks that are touched, stores of others, failures that leave nothing."""

import datetime as dt
import gzip
import json
import zlib
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from fluxgrid.operators import grid
from fluxgrid.sources.chunks import read_chunks, write_chunks

LATS, LONS = [-45.0 + 10 * i for i in range(10)], [-170.0 + 20 * j for j in range(17)]
START = dt.date(2024, 2, 25)


@pytest.fixture(scope="module")
def cube(spark):
    rng = np.random.default_rng(1)
    rows = [(START + dt.timedelta(t), i, j, LATS[i], LONS[j], None if rng.random() < 0.1 else float(rng.normal())) for t in range(23) for i in range(10) for j in range(17) if not (t < 8 and i < 4)]
    return spark.createDataFrame(rows, "day date, lat_i int, lon_i int, lat double, lon double, value double").repartition(5).persist()


def cells(df):
    rows = [(r.day, r.t, r.lat_i, r.lon_i, r.lat, r.lon, r.value) for r in df.select("day", "t", "lat_i", "lon_i", "lat", "lon", "value").collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def dense(spark, cube):
    return cells(grid.densified(cube, grid.grid(spark, LATS, LONS)))


@pytest.mark.parametrize("codec", ["zlib", None])
@pytest.mark.parametrize("chunks", [(8, 4, 6), (1, 10, 17), (100, 100, 100)])
def test_round_trip(spark, cube, tmp_path, codec, chunks):
    path = f"file://{tmp_path}/store"
    write_chunks(cube, path, LATS, LONS, chunks, codec=codec)
    back = read_chunks(spark, path)
    assert cells(back) == dense(spark, cube)
    assert back.select(F.max("ts")).first()[0] == dt.datetime(2024, 3, 18)
    assert not (tmp_path / "store" / "_temporary").exists()
    if chunks == (8, 4, 6):
        assert len(list((tmp_path / "store" / "value").glob("[0-9]*"))) == 3 * 3 * 3 - 3  # one block of days and latitudes holds nothing


def _spoil(store, but):
    """Replaces all chunks but some by what can't be read."""
    for f in Path(store).glob("value/[0-9]*"):
        if f.name not in but:
            f.write_bytes(b"not a chunk")


def test_only_touched_chunks_are_opened(spark, cube, tmp_path):
    path = str(tmp_path / "store")
    write_chunks(cube, path, LATS, LONS, (8, 4, 6))
    box = {"lat": (-5.0, 24.0), "lon": (-60.0, 40.0), "days": ("2024-03-04", "2024-03-11")}
    want = cells(grid.domain_slice(grid.densified(cube, grid.grid(spark, LATS, LONS)), box["lat"], box["lon"], box["days"]))
    assert want
    _spoil(path, {f"1.1.{k}" for k in (0, 1)})  # latitudes 4 to 6 and longitudes 6 to 10 lie in these
    _spoil(path, {"1.1.1"})
    assert cells(grid.domain_slice(read_chunks(spark, path, **box), box["lat"], box["lon"], box["days"])) == want
    with pytest.raises(Exception, match="incorrect header check|Error -3"):
        read_chunks(spark, path).count()


def test_conditions_are_pushed_down(spark, cube, tmp_path):
    path = str(tmp_path / "store")
    write_chunks(cube, path, LATS, LONS, (8, 4, 6))
    _spoil(path, {"1.1.1"})
    before = spark.conf.get("spark.sql.python.filterPushdown.enabled")
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        day = F.lit("2024-03-04").cast("date")
        part = read_chunks(spark, path).where((F.col("lat") >= -5.0) & (F.col("lat") < 25) & F.col("lon").isin(-50.0, 10.0) & (F.col("day") >= day) & (F.col("day") <= F.date_add(day, 7)))
        assert cells(part) == {r for r in dense(spark, cube) if -5 <= r[4] < 25 and r[5] in (-50.0, 10.0) and dt.date(2024, 3, 4) <= r[0] <= dt.date(2024, 3, 11)}
    finally:
        spark.conf.set("spark.sql.python.filterPushdown.enabled", before)


def _put(store, name, values, dims, attrs, chunks, codec=None, fill=None, pack=lambda b: b, order="C", skip=()):
    folder = Path(store) / name
    folder.mkdir(parents=True)
    (folder / ".zarray").write_text(json.dumps({"zarr_format": 2, "shape": values.shape, "chunks": chunks, "dtype": values.dtype.str, "compressor": codec, "fill_value": fill, "order": order, "filters": None}))
    (folder / ".zattrs").write_text(json.dumps({"_ARRAY_DIMENSIONS": dims, **attrs}))
    for at in np.ndindex(*[-(-n // c) for n, c in zip(values.shape, chunks, strict=True)]):
        block = np.zeros(chunks, values.dtype)
        part = values[tuple(slice(c * k, c * (k + 1)) for c, k in zip(chunks, at, strict=True))]
        block[tuple(slice(n) for n in part.shape)] = part
        if at not in skip:
            (folder / ".".join(map(str, at))).write_bytes(pack(block.tobytes(order=order)))


def test_a_foreign_store(spark, tmp_path):
    """Latitudes from the north, longitudes from 0, hours, packed integers, a level axis, another order of axes, a missing chunk."""
    store = tmp_path / "foreign"
    lats, lons = np.array([60.0, 20.0, -20.0], ">f4"), np.array([0, 90, 180, 270], "<f8")
    hours = np.array([6, 18, 30, 42], "<i4")
    raw = np.arange(2 * 3 * 4 * 4).reshape(2, 3, 4, 4).astype("<i2")
    raw[1, 2, 3, 1] = -999
    _put(store, "latitude", lats, ["latitude"], {}, [2])
    _put(store, "longitude", lons, ["longitude"], {}, [4])
    _put(store, "time", hours, ["time"], {"units": "hours since 1999-12-31 00:00:00"}, [4])
    _put(store, "level", np.array([500, 850], "<i4"), ["level"], {}, [2])
    _put(store, "t2m", raw, ["level", "latitude", "longitude", "time"], {"scale_factor": 0.5, "add_offset": 10, "_FillValue": -999}, [1, 2, 3, 3], {"id": "gzip"}, -999, gzip.compress, "F", {(1, 0, 0, 1)})
    _put(store, "z", raw[0, :, :, 0].astype("<f4"), ["latitude", "longitude"], {}, [2, 2], {"id": "zlib"}, pack=zlib.compress)
    got = {(r.ts, r.lat, r.lon): (r.lat_i, r.lon_i, r.t, r.day, r.value) for r in read_chunks(spark, str(store), "t2m", level=1).collect()}
    assert len(got) == 48
    for i in range(3):
        for j in range(4):
            for t in range(4):
                gone = raw[1, i, j, t] == -999 or (i < 2 and j < 3 and t == 3)
                at = dt.datetime(1999, 12, 31) + dt.timedelta(hours=int(hours[t]))
                lon = [0.0, 90.0, -180.0, -90.0][j]
                assert got[at, float(lats[i]), lon] == (2 - i, [2, 3, 0, 1][j], t // 2, at.date(), None if gone else 10 + 0.5 * raw[1, i, j, t])
    flat = {(r.lat_i, r.lon_i, r.day, r.ts, r.t): r.value for r in read_chunks(spark, str(store), "z", lat=(0, 90)).collect()}
    assert flat == {(2 - i, [2, 3, 0, 1][j], None, None, 0): float(raw[0, i, j, 0]) for i in range(2) for j in range(4)}
    days = grid.daily(read_chunks(spark, str(store), "t2m"), "max")
    assert days.count() == 24
    with pytest.raises(Exception, match="variable '' of t2m, z"):
        read_chunks(spark, str(store)).count()


def test_maps_without_time(spark, tmp_path):
    ground = grid.grid(spark, LATS, LONS).withColumn("value", F.col("lat") * F.col("lon"))
    write_chunks(ground, str(tmp_path / "s"), LATS, LONS, (4, 5), variable="elevation")
    back = read_chunks(spark, str(tmp_path / "s"))
    assert {(r.lat_i, r.lon_i, r.value) for r in back.collect()} == {(r.lat_i, r.lon_i, r.value) for r in ground.collect()}


@pytest.mark.parametrize("fault", ["twice", "outside"])
def test_a_failing_task_leaves_no_store(spark, cube, tmp_path, fault):
    path = tmp_path / "store"
    bad = cube.limit(1).withColumn("value", F.lit(1.0)) if fault == "twice" else cube.limit(1).withColumn("lat_i", F.lit(99)).withColumn("value", F.lit(1.0))
    broken = cube.where("value is not null").unionByName(cube.where("value is not null").limit(1) if fault == "twice" else bad)
    with pytest.raises(Exception, match="twice|outside"):
        write_chunks(broken, str(path), LATS, LONS, (8, 4, 6))
    assert not path.exists()


def test_stores_are_replaced_only_if_asked(spark, cube, tmp_path):
    path = str(tmp_path / "store")
    write_chunks(cube, path, LATS, LONS, (8, 4, 6))
    with pytest.raises(Exception, match="is a store already"):
        write_chunks(cube, path, LATS, LONS)
    later = cube.withColumn("day", F.date_add("day", 400)).where("lat_i < 5")
    write_chunks(later, path, LATS, LONS, (30, 5, 17), overwrite=True)
    assert cells(read_chunks(spark, path)) == dense(spark, later)


def test_an_empty_cube(spark, cube, tmp_path):
    write_chunks(cube.limit(0), str(tmp_path / "s"), LATS, LONS)
    assert read_chunks(spark, str(tmp_path / "s")).isEmpty()
