"""Connected components of an edge table, as DataFrame operations."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fluxgrid.session import cut

_ROUNDS = 60


def smallest_linked(n: int, pairs: np.ndarray) -> np.ndarray:
    """The smallest index of each of n nodes' component; pairs is an (m, 2) array of linked indices.

    In each round the components that a link joins to one with a smaller index go over to it, and links within one are left out.
    """
    root = np.arange(n, dtype=np.int64)
    while len(pairs):
        a, b = root[pairs[:, 0]], root[pairs[:, 1]]
        apart = a != b
        np.minimum.at(root, np.maximum(a, b)[apart], np.minimum(a, b)[apart])
        while not np.array_equal(up := root[root], root):
            root = up
        pairs = pairs[apart]
    return root


def _in_one_task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    edges = pd.concat([pd.DataFrame({"u": [], "v": []}, dtype="int64"), *batches])
    nodes, codes = np.unique(edges[["u", "v"]].to_numpy(dtype=np.int64), return_inverse=True)
    labels = smallest_linked(len(nodes), codes.reshape(-1, 2))
    yield pd.DataFrame({"node": nodes, "component": nodes[labels]}, dtype="int64")


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", in_one_task: int = 0) -> DataFrame:
    """(node, component) of each node of the undirected edges (a, b), both BIGINT; the component is its smallest node.

    Loops, repeated edges and edges in both directions are allowed; edges with a null end are ignored.

    Alternates large-star and small-star steps: in each, a node passes the smallest of its neighbours on to its larger
    or smaller ones, which halves the depth of the trees, so that the rounds grow as the logarithm of the diameter.
    Minima are aggregated before the shuffle, no list of neighbours is ever built, and each round's edges are written
    to the shared checkpoint folder. So are the minima, as a join with a table can be split where a node has many
    neighbours, and one with an aggregation over the same exchange can't.

    in_one_task: up to so many distinct edges, a single task replaces the rounds.
    """
    u, v = F.greatest(a, b).cast("bigint"), F.least(a, b).cast("bigint")
    own = edges.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(u.alias("u"), v.alias("v"))
    own = cut(own.distinct())
    if in_one_task and own.limit(in_one_task + 1).count() <= in_one_task:
        return own.coalesce(1).mapInPandas(_in_one_task, "node bigint, component bigint")

    loops = own.where("u = v").select("u")
    tree, before = own.where("u > v"), None
    for _ in range(_ROUNDS):
        tree = cut(_small_star(cut(_large_star(tree))))
        now = tree.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components didn't settle in {_ROUNDS} rounds")
    leaves = tree.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = tree.select(F.col("v").alias("node")).union(loops.select("u")).distinct()
    return leaves.union(roots.join(leaves, "node", "left_anti").select("node", F.col("node").alias("component")))


def _large_star(tree: DataFrame) -> DataFrame:
    """Each node's larger neighbours are linked to the smallest of its neighbours and itself."""
    both = tree.select("u", "v").union(tree.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = cut(both.groupBy("u").agg(F.min("v").alias("m")))
    return (
        both.where("v > u").join(least, "u")
        .select(F.col("v").alias("u"), F.least("u", "m").alias("v"))
        .distinct()
    )


def _small_star(tree: DataFrame) -> DataFrame:
    """Each node and its smaller neighbours are linked to the smallest of them."""
    least = cut(tree.groupBy("u").agg(F.min("v").alias("m")))
    return (
        tree.join(least, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        .union(least.select("u", F.col("m").alias("v")))
        .distinct()
    )
