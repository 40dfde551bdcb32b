"""Chunked array stores (Zarr, version 2 of the format) as a Spark data source, to read and to write.

A store is a folder with an array for each variable and each axis; an array is a file of metadata and a file for each
chunk, raw or compressed. The reader plans chunks: an input partition is a few of them, and conditions on days, latitudes
and longitudes leave out the chunks that they don't touch before any is opened. The writer gets the cells of a chunk in one
task, which writes them to a folder of its attempt; the driver moves what successful attempts wrote and adds the metadata
last, so that a store without metadata is none and an aborted job leaves nothing.

Files are reached through pyarrow's file systems, by path or URI, from the driver and from all executors.
"""

from __future__ import annotations

import datetime as dt
import gzip
import json
import re
import uuid
import zlib
from collections.abc import Iterable, Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from itertools import product

import numpy as np
import pyarrow as pa
from pyarrow import fs as afs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan,
    LessThanOrEqual, WriterCommitMessage,
)

NAME = "fluxgrid_chunks"
SCHEMA = "ts timestamp_ntz, day date, t int, lat_i int, lon_i int, lat double, lon double, value double"
#: Cells, about, that an input partition holds; a larger chunk is one by itself.
TASK_CELLS = 4 << 20
# The names that the axes have in stores, and the seconds of their units of time.
AXES = {"time": "time", "day": "time", "lat": "lat", "latitude": "lat", "lon": "lon", "longitude": "lon", "level": "level"}
SECONDS = {"day": 86400, "hour": 3600, "minute": 60, "second": 1}
DECODERS = {"zlib": zlib.decompress, "gzip": gzip.decompress}


def _opened(path: str) -> tuple[afs.FileSystem, str]:
    return afs.FileSystem.from_uri(path)


def _bytes(fs: afs.FileSystem, path: str) -> bytes | None:
    """A file's content; None if it isn't there."""
    try:
        with fs.open_input_stream(path) as f:
            return f.read()
    except FileNotFoundError:
        return None


@dataclass
class Array:
    """An array of a store, by its metadata."""

    path: str
    shape: tuple[int, ...]
    chunks: tuple[int, ...]
    dtype: np.dtype
    order: str
    codec: str | None
    fill: float
    separator: str
    dims: tuple[str, ...]
    attrs: dict[str, object]

    def key(self, at: Sequence[int]) -> str:
        return f"{self.path}/{self.separator.join(map(str, at)) or '0'}"

    def grid(self) -> list[int]:
        """How many chunks there are along each axis."""
        return [-(-n // c) for n, c in zip(self.shape, self.chunks, strict=True)]

    def chunk(self, fs: afs.FileSystem, at: Sequence[int]) -> np.ndarray:
        """A chunk's values without what lies beyond the array; a chunk that was never written holds the fill value."""
        size = [min(c, n - c * k) for n, c, k in zip(self.shape, self.chunks, at, strict=True)]
        data = _bytes(fs, self.key(at))
        if data is None:
            return np.full(size, self.fill, self.dtype if self.fill == self.fill else float)
        if self.codec:
            data = DECODERS[self.codec](data)
        return np.frombuffer(data, self.dtype).reshape(self.chunks, order=self.order)[tuple(slice(n) for n in size)]

    def whole(self, fs: afs.FileSystem) -> np.ndarray:
        """All values; for axes."""
        out = np.empty(self.shape, self.dtype if self.fill == self.fill else float)
        for at in product(*map(range, self.grid())):
            out[tuple(slice(c * k, c * (k + 1)) for c, k in zip(self.chunks, at, strict=True))] = self.chunk(fs, at)
        return out

    def values(self, stored: np.ndarray) -> np.ndarray:
        """Stored values as doubles, NaN for missing ones, by the attributes for packing."""
        out = stored.astype(float)
        for name in ("_FillValue", "missing_value"):
            if isinstance(self.attrs.get(name), int | float):
                out[stored == self.attrs[name]] = np.nan
        return out * float(self.attrs.get("scale_factor", 1.0)) + float(self.attrs.get("add_offset", 0.0))


def _array(fs: afs.FileSystem, root: str, name: str) -> Array | None:
    data = _bytes(fs, f"{root}/{name}/.zarray")
    if data is None:
        return None
    meta, attrs = json.loads(data), json.loads(_bytes(fs, f"{root}/{name}/.zattrs") or b"{}")
    codec = (meta.get("compressor") or {}).get("id")
    if codec not in (None, *DECODERS) or meta.get("filters"):
        raise ValueError(f"{root}/{name}: compressor {codec!r} with filters {meta.get('filters')!r}; raw, {' and '.join(DECODERS)} chunks without filters can be read")
    fill = meta.get("fill_value")
    dims = attrs.get("_ARRAY_DIMENSIONS") or ["time", "lat", "lon"][-len(meta["shape"]) :]
    return Array(
        f"{root}/{name}", tuple(meta["shape"]), tuple(meta["chunks"]), np.dtype(meta["dtype"]), meta.get("order", "C"), codec,
        float("nan") if fill in (None, "NaN") else float(fill), meta.get("dimension_separator", "."), tuple(dims), attrs,
    )


def _times(array: Array, stored: np.ndarray) -> np.ndarray:
    """Microseconds since 1970 of a time axis in 'days since ...' and the like."""
    found = re.fullmatch(r"(day|hour|minute|second)s? since (\d+)-(\d+)-(\d+)(?:[T ](\d+):(\d+)(?::(\d+)[.\d]*)?)?.*", str(array.attrs.get("units", "")))
    if not found:
        raise ValueError(f"{array.path}: units {array.attrs.get('units')!r}")
    start = dt.datetime(*(int(x or 0) for x in found.groups()[1:]))
    base = round((start - dt.datetime(1970, 1, 1)).total_seconds()) * 1_000_000
    return base + np.round(stored.astype(float) * SECONDS[found[1]] * 1e6).astype(np.int64)


@dataclass
class Plan:
    """A variable with its axes, and what is wanted of each."""

    array: Array
    dims: list[str]
    #: By axis: its coordinates, and the places they have when sorted, longitudes from -180 on.
    axes: dict[str, np.ndarray]
    places: dict[str, np.ndarray]
    wanted: dict[str, np.ndarray] = field(default_factory=dict)

    def chunks(self) -> list[tuple[int, ...]]:
        """The chunks that hold anything wanted."""
        along = []
        for dim, size, count in zip(self.dims, self.array.chunks, self.array.grid(), strict=True):
            along.append([k for k in range(count) if self.wanted[dim][k * size : (k + 1) * size].any()])
        return list(product(*along))


def planned(path: str, options: dict[str, str], limits: dict[str, tuple[float, float]]) -> Plan:
    """The plan of a store's variable; limits are inclusive, by lat, lon and time in microseconds."""
    fs, root = _opened(path)
    names = [f.base_name for f in fs.get_file_info(afs.FileSelector(root)) if f.type == afs.FileType.Directory]
    arrays = {n: a for n in sorted(names) if (a := _array(fs, root, n))}
    fields = [n for n, a in arrays.items() if n not in AXES]
    name = options.get("variable") or (fields[0] if len(fields) == 1 else "")
    if name not in arrays:
        raise ValueError(f"{path}: variable {name!r} of {', '.join(fields) or 'none'}")
    array = arrays[name]
    plan = Plan(array, [AXES[d] for d in array.dims], {}, {})
    for own, dim in zip(array.dims, plan.dims, strict=True):
        if dim == "level":
            plan.wanted[dim] = np.arange(arrays[own].shape[0] if own in arrays else 1 << 20) == int(options.get("level", 0))
            continue
        axis = arrays[own].whole(fs)
        x = _times(arrays[own], axis) if dim == "time" else arrays[own].values(axis)
        if dim == "lon" and len(x) and x.max() > 180:
            x = (x + 180.0) % 360.0 - 180.0
        plan.axes[dim], plan.places[dim] = x, np.argsort(np.argsort(x, kind="stable"), kind="stable")
        low, high = limits.get(dim, (-np.inf, np.inf))
        plan.wanted[dim] = (x >= low) & (x <= high)
    return plan


class _Chunks(InputPartition):
    def __init__(self, chunks: list[tuple[int, ...]]) -> None:
        self.chunks = chunks


def _limit(column: str, value: object) -> tuple[str, float, float]:
    """(axis, least and largest coordinate) of a value of a column; a day is all its moments."""
    if column == "day":
        start = (value - dt.date(1970, 1, 1)).days * 86_400_000_000
        return "time", start, start + 86_400_000_000 - 1
    if column == "ts":
        at = round((value.replace(tzinfo=None) - dt.datetime(1970, 1, 1)) / dt.timedelta(microseconds=1))
        return "time", at, at
    return column, float(value), float(value)


class ChunkReader(DataSourceReader):
    """Reads the chunks that the limits of the options touch."""

    def __init__(self, options: dict[str, str]) -> None:
        self.options, self.limits, self.plan = options, {}, None
        for axis in ("lat", "lon"):
            self._narrow(axis, float(options.get(f"{axis}_min", "-inf")), float(options.get(f"{axis}_max", "inf")))
        for end, name in ((0, "first_day"), (1, "last_day")):
            if options.get(name):
                axis, *both = _limit("day", dt.date.fromisoformat(options[name]))
                self._narrow(axis, *((both[0], np.inf) if end == 0 else (-np.inf, both[1])))

    def _narrow(self, axis: str, low: float, high: float) -> None:
        a, b = self.limits.get(axis, (-np.inf, np.inf))
        self.limits[axis] = (max(a, low), min(b, high))

    def partitions(self) -> Sequence[InputPartition]:
        chunks, most = self._planned().chunks(), max(1, TASK_CELLS // int(np.prod(self._planned().array.chunks)))
        return [_Chunks(chunks[i : i + most]) for i in range(0, len(chunks), most)] or [_Chunks([])]

    def _planned(self) -> Plan:
        """The plan of the options; goes to the tasks with the reader, once and not with each partition."""
        if self.plan is None:
            self.plan = planned(self.options["path"], self.options, self.limits)
        return self.plan

    def read(self, partition: _Chunks) -> Iterator[pa.RecordBatch]:
        plan, (fs, _) = self._planned(), _opened(self.options["path"])
        days = plan.axes["time"] // 86_400_000_000 if "time" in plan.axes else np.zeros(1, np.int64)
        for at in partition.chunks:
            stored = plan.array.chunk(fs, at)
            inside = {d: np.flatnonzero(plan.wanted[d][k * c : k * c + n]) for d, k, c, n in zip(plan.dims, at, plan.array.chunks, stored.shape, strict=True)}
            values = plan.array.values(stored[np.ix_(*(inside[d] for d in plan.dims))])
            index = {d: inside[d] + k * c for d, k, c in zip(plan.dims, at, plan.array.chunks, strict=True)}
            flat = dict(zip(plan.dims, (x.ravel() for x in np.meshgrid(*(index[d] for d in plan.dims), indexing="ij")), strict=True))
            value, n = values.ravel(), values.size
            time = flat.get("time")
            none = lambda kind, n=n: pa.nulls(n, kind)
            yield pa.RecordBatch.from_arrays([
                none(pa.timestamp("us")) if time is None else pa.array(plan.axes["time"][time], pa.timestamp("us")),
                none(pa.date32()) if time is None else pa.array(days[time].astype(np.int32), pa.date32()),
                pa.array(np.zeros(n, np.int32) if time is None else (days[time] - days.min()).astype(np.int32)),
                *(pa.array(plan.places[d][flat[d]].astype(np.int32)) for d in ("lat", "lon")),
                *(pa.array(plan.axes[d][flat[d]]) for d in ("lat", "lon")),
                pa.array(value, mask=np.isnan(value)),
            ], ["ts", "day", "t", "lat_i", "lon_i", "lat", "lon", "value"])


class PushedReader(ChunkReader):
    """Limited by conditions on day, ts, lat and lon as well; Spark still applies them to the rows."""

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            column = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else ""
            if column in ("day", "ts", "lat", "lon") and getattr(f, "value", None) not in (None, ()):
                spans = [_limit(column, v) for v in (f.value if isinstance(f, In) else [f.value]) if v is not None]
                low, high, axis = min(s[1] for s in spans), max(s[2] for s in spans), spans[0][0]
                if isinstance(f, EqualTo | In):
                    self._narrow(axis, low, high)
                elif isinstance(f, GreaterThan | GreaterThanOrEqual):
                    self._narrow(axis, low, np.inf)
                elif isinstance(f, LessThan | LessThanOrEqual):
                    self._narrow(axis, -np.inf, high)
            yield f


@dataclass
class _Written(WriterCommitMessage):
    folder: str
    keys: list[str]


class ChunkWriter(DataSourceArrowWriter):
    """Writes cells that come chunk by chunk: see write_chunks()."""

    def __init__(self, options: dict[str, str], overwrite: bool) -> None:
        self.path, self.overwrite, self.layout = options["path"], overwrite, json.loads(options["layout"])
        fs, root = _opened(self.path)
        if not overwrite and fs.get_file_info(f"{root}/.zgroup").type != afs.FileType.NotFound:
            raise FileExistsError(f"{self.path} is a store already")
        self.job = f"{root}/_temporary/{uuid.uuid4().hex}"

    def write(self, batches: Iterator[pa.RecordBatch]) -> _Written:
        fs, _ = _opened(self.path)
        size, shape, folder = self.layout["chunks"], np.array(self.layout["shape"]), f"{self.job}/{uuid.uuid4().hex}"
        made, done, at, block, seen = _Written(folder, []), set(), None, None, None
        fs.create_dir(folder)

        def flush() -> None:
            key = ".".join(map(str, at))
            if key in done:
                raise ValueError(f"the cells of chunk {key} don't come together")
            data = np.ascontiguousarray(block).tobytes()
            with fs.open_output_stream(f"{folder}/{key}") as f:
                f.write(zlib.compress(data, 1) if self.layout["codec"] == "zlib" else data)
            made.keys.append(key)
            done.add(key)

        for batch in batches:
            cells = np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in self.layout["index"]], axis=1).astype(np.int64)
            values = batch.column("value").to_numpy(zero_copy_only=False)
            if ((cells < 0) | (cells >= shape)).any():
                raise ValueError("a cell lies outside of the axes")
            chunk = cells // size
            turns = np.flatnonzero((np.diff(chunk, axis=0, prepend=chunk[:1] - 1) != 0).any(axis=1))
            for a, b in zip(turns, np.append(turns[1:], len(chunk)), strict=True):
                if at is None or tuple(chunk[a]) != at:
                    if at is not None:
                        flush()
                    at, block, seen = tuple(chunk[a].tolist()), np.full(size, np.nan), np.zeros(size, bool)
                inner = tuple((cells[a:b] % size).T)
                if seen[inner].any() or len(np.unique(cells[a:b], axis=0)) < b - a:
                    raise ValueError(f"a cell of chunk {at} comes twice")
                block[inner], seen[inner] = values[a:b], True
        if at is not None:
            flush()
        return made

    def commit(self, messages: list[_Written | None]) -> None:
        fs, root = _opened(self.path)
        layout, target = self.layout, f"{root}/{self.layout['variable']}"
        if self.overwrite:
            for name in (".zgroup", layout["variable"], *layout["axes"]):
                kind = fs.get_file_info(f"{root}/{name}").type
                if kind != afs.FileType.NotFound:
                    (fs.delete_dir if kind == afs.FileType.Directory else fs.delete_file)(f"{root}/{name}")
        fs.create_dir(target)
        moves = [(f"{m.folder}/{key}", f"{target}/{key}") for m in messages if m for key in m.keys]
        with ThreadPoolExecutor(16) as pool:
            list(pool.map(lambda move: fs.move(*move), moves))
        codec = {"id": "zlib", "level": 1} if layout["codec"] == "zlib" else None

        def put(name: str, content: object) -> None:
            with fs.open_output_stream(f"{root}/{name}") as f:
                f.write(content if isinstance(content, bytes) else json.dumps(content).encode())

        def describe(name: str, shape: list[int], chunks: list[int], dtype: str, dims: list[str], codec: object, attrs: dict) -> None:
            put(f"{name}/.zarray", {
                "zarr_format": 2, "shape": shape, "chunks": chunks, "dtype": dtype, "compressor": codec, "fill_value": "NaN" if dtype == "<f8" else None,
                "order": "C", "filters": None,
            })
            put(f"{name}/.zattrs", {"_ARRAY_DIMENSIONS": dims, **attrs})

        for name, axis in layout["axes"].items():
            fs.create_dir(f"{root}/{name}")
            n, kind = max(1, len(axis["values"])), "<i8" if name == "time" else "<f8"
            put(f"{name}/0", np.array(axis["values"] or [0], kind).tobytes())
            describe(name, [len(axis["values"])], [n], kind, [name], None, axis["attrs"])
        describe(layout["variable"], layout["shape"], layout["chunks"], "<f8", list(layout["axes"]), codec, {})
        put(".zgroup", {"zarr_format": 2})
        self._clear(fs, root)

    def abort(self, messages: list[_Written | None]) -> None:
        fs, root = _opened(self.path)
        self._clear(fs, root)
        if not fs.get_file_info(afs.FileSelector(root, allow_not_found=True)):
            if fs.get_file_info(root).type == afs.FileType.Directory:
                fs.delete_dir(root)

    def _clear(self, fs: afs.FileSystem, root: str) -> None:
        if fs.get_file_info(self.job).type == afs.FileType.Directory:
            fs.delete_dir(self.job)
        if not fs.get_file_info(afs.FileSelector(f"{root}/_temporary", allow_not_found=True)):
            if fs.get_file_info(f"{root}/_temporary").type == afs.FileType.Directory:
                fs.delete_dir(f"{root}/_temporary")


class ChunkSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: object) -> ChunkReader:
        return (PushedReader if self.options.get("pushed") == "true" else ChunkReader)(dict(self.options))

    def writer(self, schema: object, overwrite: bool) -> ChunkWriter:
        return ChunkWriter(dict(self.options), overwrite)


def read_chunks(
    spark: SparkSession, path: str, variable: str | None = None, lat: tuple[float, float] | None = None, lon: tuple[float, float] | None = None,
    days: tuple[str, str] | None = None, level: int = 0,
) -> DataFrame:
    """(ts, day, t, lat_i, lon_i, lat, lon, value) of a store's variable within a box and days, all ends included.

    Only chunks that the box and the days touch are opened. The same holds for conditions on the columns day, ts, lat and
    lon of what is returned where spark.sql.python.filterPushdown.enabled is set. t counts days from the store's first;
    lat_i counts from the south and lon_i from -180, also where a store goes down or runs from 0 to 360. Missing values
    and chunks are null. A variable without time has no day and t 0; of a level axis, one place is read.
    """
    spark.dataSource.register(ChunkSource)
    pushed = spark.conf.get("spark.sql.python.filterPushdown.enabled")  # without it, Spark refuses readers that take conditions
    options = {"path": path, "variable": variable or "", "level": str(level), "pushed": pushed}
    for axis, span in (("lat", lat), ("lon", lon)):
        if span:
            options |= {f"{axis}_min": repr(float(span[0])), f"{axis}_max": repr(float(span[1]))}
    if days:
        options |= {"first_day": days[0], "last_day": days[1]}
    return spark.read.format(NAME).options(**options).load()


def write_chunks(
    cube: DataFrame, path: str, lats: Sequence[float], lons: Sequence[float], chunks: Sequence[int] = (64, 64, 64), variable: str = "value",
    codec: str | None = "zlib", overwrite: bool = False,
) -> None:
    """A cube (day, lat_i, lon_i, value) as a store with the given axes, in chunks of so many days, latitudes and longitudes.

    Without a column day the variable has no time, and chunks two sizes. Days are dense from the first to the last; cells
    and days without a row, and nulls, are missing, and chunks of such alone aren't written. A cell that comes twice or
    lies outside of the axes fails the job, which then leaves nothing. All cells of a chunk meet in one task, so a chunk
    has to fit in a worker.
    """
    spark, timed = cube.sparkSession, "day" in cube.columns
    spark.dataSource.register(ChunkSource)
    axes = {"lat": {"values": [float(x) for x in lats], "attrs": {}}, "lon": {"values": [float(x) for x in lons], "attrs": {}}}
    own = cube.select(*(["day"] if timed else []), "lat_i", "lon_i", F.col("value").cast("double").alias("value"))
    index = ["lat_i", "lon_i"]
    if timed:
        span = own.agg(F.min("day").alias("a"), F.max("day").alias("b")).first()
        start = span.a or dt.date(1970, 1, 1)
        n = (span.b - span.a).days + 1 if span.a else 0
        axes = {"time": {"values": list(range(n)), "attrs": {"units": f"days since {start.isoformat()}", "calendar": "proleptic_gregorian"}}, **axes}
        own, index = own.withColumn("t", F.datediff("day", F.lit(start))), ["t", *index]
    size = [min(int(c), max(1, len(a["values"]))) for c, a in zip(chunks, axes.values(), strict=True)]
    layout = {"variable": variable, "codec": codec, "axes": axes, "shape": [len(a["values"]) for a in axes.values()], "chunks": size, "index": index}
    keys = [F.floor(F.col(c) / s) for c, s in zip(index, size, strict=True)]
    dealt = own.where("value is not null").select(*index, "value").repartition(*keys).sortWithinPartitions(*keys)
    dealt.write.format(NAME).options(path=path, layout=json.dumps(layout)).mode("overwrite" if overwrite else "append").save()
