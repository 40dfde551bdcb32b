"""Files in and out."""

import datetime as dt
import zipfile

from pyspark.sql import functions as F

from fluxgrid.config import Config
from fluxgrid.plans import sinks
from fluxgrid.sources import files, incidents
from fluxgrid.streaming.daily import daily_stream


def _workbook(path, rows):
    cells = lambda r, n: "".join(f'<c r="{chr(65 + k)}{n}" t="inlineStr"><is><t>{x}</t></is></c>' for k, x in enumerate(r) if x is not None)
    body = "".join(f'<row r="{n}">{cells(r, n)}</row>' for n, r in enumerate(rows, 1))
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData>{body}</sheetData></worksheet>')


def test_incidents_from_files(spark, tmp_path):
    (tmp_path / "places.csv").write_bytes("disastertype,disasterno,geo_id,country,latitude,longitude\nflood ,2010-0001,7,Côte,1.5,2.5\nquake,2010-0001,8,X,1,2\nstorm,2010-0009,9,Y,1,2\n".encode("latin-1"))
    head = ["DisNo.", "Disaster Type", "Country", "ISO", "Latitude", "Longitude", "Start Year", "Start Month", "Start Day"]
    _workbook(tmp_path / "dates.xlsx", [head, ["2010-0001-CIV", "Flood", "Côte", "CIV", None, None, "2010", "3", "31"], ["2010-0001-GHA", "Drought", "Ghana", "GHA", "5", "6", "2011", "1", "1"]])
    (tmp_path / "centroids.csv").write_text("iso3,country,lat,lon\nCIV,Côte,8,-5\n")
    own = incidents.located(spark, str(tmp_path / "places.csv"), str(tmp_path / "dates.xlsx")).collect()
    assert [(r.incident_id, r.country, r.date_start) for r in own] == [("2010-0001_7", "Côte", dt.date(2010, 3, 28))]
    places = incidents.centroids(spark, str(tmp_path / "centroids.csv"))
    told = {r.iso: (r.lat, r.lon, r.geo_precision) for r in incidents.recorded(spark, str(tmp_path / "dates.xlsx"), places).collect()}
    assert told == {"CIV": (8.0, -5.0, "estimated"), "GHA": (5.0, 6.0, "exact")}
    assert incidents.centroids(spark, str(tmp_path / "none.csv")).isEmpty()


def test_sinks_and_store(spark, tmp_path):
    made = []

    def make():
        made.append(1)
        return spark.createDataFrame([(dt.date(2020, 1, 1), 0, 0, 1.0, 2.0, 3.0)], "day date, lat_i int, lon_i int, lat double, lon double, value double")

    for _ in range(2):
        cube = files.stored(spark, str(tmp_path), "cube", Config(), make, "source")
    assert cube.count() == 1 and len(made) == 1
    sinks.write_cube(cube, str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).where("year = 2020 and month = 1").count() == 1
    assert sinks.drawn(cube, "value", diverging=True, zones=cube).first().zone
    sinks.write_summary(cube.select("value"), tmp_path / "s.txt")
    assert (tmp_path / "s.txt").read_text() == "value 3\n"


def test_stream(spark, tmp_path):
    rows = [(dt.datetime(2024, 1, d, 5), 0, 0, float(d)) for d in (1, 1, 2, 5)]
    spark.createDataFrame(rows, "ts timestamp, lat_i int, lon_i int, value double").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = daily_stream(spark.readStream.schema("ts timestamp, lat_i int, lon_i int, value double").parquet(str(tmp_path / "in")), "mean")
    q = stream.writeStream.format("memory").queryName("daily").outputMode("append").trigger(availableNow=True).start()
    assert q.awaitTermination(60)
    assert {r.day.day for r in spark.table("daily").collect()} <= {1, 2, 5} and spark.table("daily").where(F.dayofmonth("day") == 1).first().value == 1.0
