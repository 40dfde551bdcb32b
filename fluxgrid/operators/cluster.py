"""Blobs of flagged cells within a day, and events of blobs over days."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fluxgrid.functions import sphere
from fluxgrid.functions.geo import KM_PER_DEGREE_AT_LEAST, haversine
from fluxgrid.operators.graph import connected_components, smallest_linked
from fluxgrid.operators.grid import ranked
from fluxgrid.operators.spatial import TILE, tiled
from fluxgrid.session import cut

_LABELS = "t int, lat_i int, lon_i int, label long"


def merge_steps(eps_cells: float) -> int:
    """How far cells are dilated before they are joined."""
    return max(0, round(eps_cells) - 1)


def adjacency(cells: DataFrame, steps: int, by: str = "t") -> DataFrame:
    """Pairs of one day's cells that touch when each is dilated so many steps: at most 2 * steps + 1 rows and columns apart.

    Cells are joined by squares of that size, each with its eight neighbours, so the pairs grow as the cells.
    """
    reach = 2 * steps + 1
    square = lambda c: F.floor(F.col(c) / reach).cast("int")
    a = cells.select(by, F.col("lat_i").alias("a_lat_i"), F.col("lon_i").alias("a_lon_i"), square("lat_i").alias("_p"), square("lon_i").alias("_q"))
    around = F.array(*(F.struct(F.lit(p).alias("p"), F.lit(q).alias("q")) for p in (-1, 0, 1) for q in (-1, 0, 1)))
    b = cells.select(by, F.col("lat_i").alias("b_lat_i"), F.col("lon_i").alias("b_lon_i"), F.explode(around).alias("_d"))
    b = b.select(by, "b_lat_i", "b_lon_i", (square("b_lat_i") + F.col("_d.p")).alias("_p"), (square("b_lon_i") + F.col("_d.q")).alias("_q"))
    apart = (F.abs(F.col("a_lat_i") - F.col("b_lat_i")) <= reach) & (F.abs(F.col("a_lon_i") - F.col("b_lon_i")) <= reach)
    order = (F.col("a_lat_i") < F.col("b_lat_i")) | ((F.col("a_lat_i") == F.col("b_lat_i")) & (F.col("a_lon_i") < F.col("b_lon_i")))
    return a.join(b, [by, "_p", "_q"]).where(apart & order).select(by, "a_lat_i", "a_lon_i", "b_lat_i", "b_lon_i")


def _near(p: np.ndarray, q: np.ndarray, near: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray:
    """Pairs of positions, each once, whose squares (p, q) are the same or touch and for which near(positions, positions) holds."""
    if not len(p):
        return np.empty((0, 2), np.int64)
    q = (q - q.min()).astype(np.int64)
    width = int(q.max()) + 2
    code = (p - p.min()).astype(np.int64) * width + q
    order = np.argsort(code, kind="stable")
    code, own, found = code[order], np.arange(len(code)), []
    for step in (0, 1, width - 1, width, width + 1):  # half of a square's neighbours; the other half are those it is one of
        begin = np.searchsorted(code, code + step) if step else own + 1
        count = np.searchsorted(code, code + step, "right") - begin
        a = np.repeat(own, count)
        b = np.arange(len(a)) + np.repeat(begin - np.cumsum(count) + count, count)
        a, b = order[a], order[b]
        hit = near(a, b)
        found.append(np.stack((a[hit], b[hit]), axis=1))
    return np.concatenate(found)


def _node(lat_i: np.ndarray, lon_i: np.ndarray) -> np.ndarray:
    """Numbers of a day's cells, in row-major order."""
    return (lat_i.astype(np.int64) << 20) | lon_i.astype(np.int64)


def _day_node(label: str) -> Column:
    """A number of a day's cell among all days."""
    return F.col("t").cast("bigint") * F.lit(1 << 40) + F.col(label)


def _merged(rows: DataFrame, edges: DataFrame, label: str = "label") -> DataFrame:
    """rows(t, label, ..) with the labels that edges(a, b), of day nodes, connect brought down to the smallest of them."""
    edges = cut(edges.distinct())
    if edges.isEmpty():
        return rows
    joined = connected_components(edges, in_one_task=200_000)
    to = joined.where("node != component").select(F.col("node").alias("_node"), (F.col("component") % F.lit(1 << 40)).alias("_to"))
    return rows.withColumn("_node", _day_node(label)).join(to, "_node", "left").withColumn(label, F.coalesce("_to", label)).drop("_node", "_to")


def components(cells: DataFrame, steps: int, tile: int = TILE) -> DataFrame:
    """(t, lat_i, lon_i, label): flagged cells with their blob of the day; a label is the number of the blob's first cell.

    Cells are labelled within tiles of a day. Those next to a tile's edge are then paired with the cells within reach
    beyond it, and what such pairs connect becomes one, as components of an edge table. No task holds more than a tile.
    """
    reach = 2 * steps + 1
    tile = max(tile, reach)

    def label(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["lat_i", "lon_i"], ignore_index=True)
        i, j = part["lat_i"].to_numpy(), part["lon_i"].to_numpy()
        pairs = _near(i // reach, j // reach, lambda a, b: (abs(i[a] - i[b]) <= reach) & (abs(j[a] - j[b]) <= reach))
        return part.assign(label=_node(i, j)[smallest_linked(len(part), pairs)])[["t", "lat_i", "lon_i", "label"]]

    own = cells.select("t", "lat_i", "lon_i", *(F.floor(F.col(c) / tile).cast("int").alias(n) for c, n in (("lat_i", "_p"), ("lon_i", "_q"))))
    local = cut(own.groupBy("t", "_p", "_q").applyInPandas(label, _LABELS))
    every = tiled(local, tile, reach, corners=True)
    at = [F.pmod(F.col(c), F.lit(tile)) for c in ("lat_i", "lon_i")]
    square = lambda c: F.floor(F.col(c) / reach).cast("int")
    edge = every.where(F.col("_own") & ((F.least(*at) < reach) | (F.greatest(*at) >= tile - reach))).withColumn("_a", square("lat_i")).withColumn("_b", square("lon_i"))
    near = every.where(~F.col("_own")).select("t", "_p", "_q", F.col("lat_i").alias("_i"), F.col("lon_i").alias("_j"), F.col("label").alias("_label"))
    around = lambda c: F.explode(F.sequence(square(c) - 1, square(c) + 1))
    near = near.withColumn("_a", around("_i")).withColumn("_b", around("_j"))
    apart = (F.abs(F.col("lat_i") - F.col("_i")) <= reach) & (F.abs(F.col("lon_i") - F.col("_j")) <= reach)
    meet = edge.join(near, ["t", "_p", "_q", "_a", "_b"]).where(apart)
    return _merged(local, meet.select(_day_node("label").alias("a"), _day_node("_label").alias("b")))


def dbscan(cells: DataFrame, eps: float, min_samples: int, tile: int = TILE) -> DataFrame:
    """(t, lat_i, lon_i, label) by density, without noise: core cells within eps degrees are joined, and any other cell
    near a core one belongs to the cluster with the smallest first core cell. A cell counts among its own neighbours.

    A tile, some degrees wide, gets copies of the cells within two eps of it: whatever is within one eps of its own cells
    then has all of its neighbours there, so that core cells are told exactly. Core cells that two tiles hold tie their
    clusters together, as components of an edge table; a cell at several clusters' borders waits for that.
    """
    far = eps + 1e-9
    width = max(2, tile) * far

    def label(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["lat_i", "lon_i"], ignore_index=True)
        lat, lon, own = part["lat"].to_numpy(), part["lon"].to_numpy(), part["own"].to_numpy()
        pairs = _near(lat // far, lon // far, lambda a, b: np.hypot(lat[a] - lat[b], lon[a] - lon[b]) <= far)
        south, west = part["_p"].iloc[0] * width, part["_q"].iloc[0] * width
        sure = (lat >= south - far) & (lat < south + width + far) & (lon >= west - far) & (lon < west + width + far)
        core = sure & (1 + np.bincount(pairs.ravel(), minlength=len(part)) >= min_samples)
        node = _node(part["lat_i"].to_numpy(), part["lon_i"].to_numpy())
        root = node[smallest_linked(len(part), pairs[core[pairs].all(axis=1)])]
        at, to = [np.flatnonzero(core)], [root[core]]
        for a, b in (pairs.T, pairs.T[::-1]):
            edge = own[a] & ~core[a] & core[b]
            at.append(a[edge])
            to.append(root[b[edge]])
        at = np.concatenate(at)
        found = part.iloc[at][["t", "lat_i", "lon_i", "own"]].assign(core=core[at], label=np.concatenate(to))
        return found.drop_duplicates(ignore_index=True)

    side = lambda c, d: F.floor((F.col(c) + d) / width).cast("int")
    every = lambda c: F.explode(F.sequence(side(c, -2 * far), side(c, 2 * far)))
    rows = cells.select("t", "lat_i", "lon_i", "lat", "lon", every("lat").alias("_p")).withColumn("_q", every("lon"))
    rows = rows.withColumn("own", (F.col("_p") == side("lat", 0.0)) & (F.col("_q") == side("lon", 0.0)))
    local = cut(rows.groupBy("t", "_p", "_q").applyInPandas(label, "t int, lat_i int, lon_i int, own boolean, core boolean, label long"))
    number = F.col("lat_i").cast("bigint") * F.lit(1 << 20) + F.col("lon_i")
    shared = local.where("core").withColumn("cell", number)
    copied = shared.where("not own").select("t", "cell", F.col("label").alias("_label"))
    ties = shared.where("own").join(copied, ["t", "cell"])
    kept = _merged(local.where("own"), ties.select(_day_node("label").alias("a"), _day_node("_label").alias("b")))
    return kept.groupBy("t", "lat_i", "lon_i").agg(F.min("label").alias("label"))


def blobs(cells: DataFrame, labels: DataFrame, min_cells: int = 1) -> DataFrame:
    """(day_index, day, lat, lon, n_cells, peak_E, first_lat_i, first_lon_i, at_lat_i, at_lon_i) of blobs of enough cells.

    lat and lon, and at_lat_i and at_lon_i, are the cell with the largest E, the first in row-major order of equals.
    """
    best = F.struct("E", -F.col("lat_i"), -F.col("lon_i"))
    first = F.min(F.struct("lat_i", "lon_i"))
    own = cells.join(labels, ["t", "lat_i", "lon_i"]).groupBy("t", "label").agg(
        F.min("day").alias("day"), F.max_by(F.struct("lat", "lon", "lat_i", "lon_i"), best).alias("_at"), F.count("*").alias("n_cells"),
        F.max("E").alias("peak_E"), first.alias("_first"),
    )
    return own.where(F.col("n_cells") >= min_cells).select(
        F.col("t").alias("day_index"), "day", F.col("_at.lat").alias("lat"), F.col("_at.lon").alias("lon"), "n_cells", "peak_E",
        F.col("_first.lat_i").alias("first_lat_i"), F.col("_first.lon_i").alias("first_lon_i"),
        F.col("_at.lat_i").alias("at_lat_i"), F.col("_at.lon_i").alias("at_lon_i"),
    )


def blob_id(lat_i: str = "first_lat_i", lon_i: str = "first_lon_i") -> Column:
    """A number that orders blobs by day and first cell."""
    return F.col("day_index").cast("bigint") * F.lit(1 << 40) + F.col(lat_i).cast("bigint") * F.lit(1 << 20) + F.col(lon_i)


def links(found: DataFrame, radius_km: float) -> DataFrame:
    """(a, b, day_index, km): blobs of a day and blobs of the day before within the radius.

    Blobs of a day lie in one cell of the sphere each; those of the day before go to all cells that they can reach, so
    that blobs far apart never meet.
    """
    own = found.withColumn("blob", blob_id())
    reach = radius_km / KM_PER_DEGREE_AT_LEAST
    size, at = sphere.width(reach), (F.col("lat"), F.col("lon"))
    today = own.select("day_index", sphere.cell(*at, size).alias("_cell"), F.col("blob").alias("a"), F.col("lat").alias("_lat"), F.col("lon").alias("_lon"))
    before = own.select((F.col("day_index") + 1).alias("day_index"), F.explode(sphere.cover(*at, reach, size)).alias("_cell"), F.col("blob").alias("b"), "lat", "lon")
    km = haversine(F.col("_lat"), F.col("_lon"), F.col("lat"), F.col("lon"))
    return today.join(before, ["day_index", "_cell"]).withColumn("km", km).where(F.col("km") <= radius_km).select("a", "b", "day_index", "km")


def linked(found: DataFrame, radius_km: float, in_one_task: int = 200_000) -> DataFrame:
    """The blobs with event_id: blobs that links connect make one event, numbered from 1 by their first blob."""
    found = cut(found.withColumn("blob", blob_id()))
    own = connected_components(links(found, radius_km), in_one_task=in_one_task).withColumnRenamed("node", "blob")
    named = found.join(own, "blob", "left").withColumn("component", F.coalesce("component", "blob"))
    number = ranked(named.select("component").distinct(), "component", name="event_id")
    return named.join(number, "component").drop("component", "blob")
