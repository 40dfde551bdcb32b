"""Files: CSV, workbook and Parquet tables, and stored results."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Callable
from xml.etree import ElementTree

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fluxgrid.config import Config

_NS = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main"}


def exists(spark: SparkSession, path: str) -> bool:
    """Whether there is a file or folder, in whatever store the path names."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def workbook_rows(data: bytes) -> list[list[str | None]]:
    """The cells of a workbook's first sheet as strings; formulas count by their stored values."""
    with zipfile.ZipFile(io.BytesIO(data)) as book:
        names = book.namelist()
        shared = []
        if "xl/sharedStrings.xml" in names:
            root = ElementTree.fromstring(book.read("xl/sharedStrings.xml"))
            shared = ["".join(t.text or "" for t in item.iter(f"{{{_NS['m']}}}t")) for item in root.findall("m:si", _NS)]
        sheet = min(n for n in names if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n))
        rows = []
        for row in ElementTree.fromstring(book.read(sheet)).iterfind(".//m:row", _NS):
            cells: list[str | None] = []
            for cell in row.findall("m:c", _NS):
                letters = re.match("[A-Z]*", cell.get("r", ""))[0]
                at = len(cells)
                if letters:
                    at = 0
                    for c in letters:
                        at = at * 26 + ord(c) - 64
                    at -= 1
                cells += [None] * (at + 1 - len(cells))
                value = cell.find("m:v", _NS)
                if cell.get("t") == "inlineStr":
                    cells[at] = "".join(t.text or "" for t in cell.iter(f"{{{_NS['m']}}}t"))
                elif value is not None and value.text is not None:
                    cells[at] = shared[int(value.text)] if cell.get("t") == "s" else value.text
            rows.append(cells)
        return rows


def read_table(spark: SparkSession, path: str, encoding: str = "UTF-8") -> DataFrame:
    """A table of strings from a CSV file or a workbook, with _row, the place of each row in its file.

    A workbook is read as one file by the driver, which is where its format has to be taken apart.
    """
    if not exists(spark, path):
        raise FileNotFoundError(f"{path} isn't there; the data directory of the settings has to hold it")
    if re.search(r"\.xlsx?$", path, re.I):
        content = spark.read.format("binaryFile").load(path).select("content").first()[0]
        head, *rows = workbook_rows(bytes(content))
        names = [h or f"column {i}" for i, h in enumerate(head)]
        rows = [(i, *(row + [None] * len(names))[: len(names)]) for i, row in enumerate(rows)]
        return spark.createDataFrame(rows, "_row bigint, " + ", ".join(f"`{n}` string" for n in names))
    rows = spark.read.csv(path, header=True, encoding=encoding, inferSchema=False)
    return rows.withColumn("_row", F.monotonically_increasing_id())


def stored(spark: SparkSession, folder: str, name: str, config: Config, make: Callable[[], DataFrame], *source: str) -> DataFrame:
    """A result kept as Parquet under a name of its settings and sources; made and written if it isn't there."""
    path = f"{folder}/{name}_{config.key(*source)}"
    if not exists(spark, f"{path}/_SUCCESS"):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
