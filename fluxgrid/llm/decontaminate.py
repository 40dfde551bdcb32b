"""Benchmark decontamination: containment search by size-partitioned MinHash, verified by exact shingle containment.

A word is a run of ASCII letters and digits and of characters outside ASCII, with A-Z in lower case; a shingle is five
words. An item is contained in a document if at least 0.8 of its distinct shingles occur there. An item of fewer than
five words has one shingle, all its words.

Items are partitioned by size: the width of their shingles, and the power of two that their number n of distinct ones
lies under. Each partition has its own sketch, of the k smallest hashes (bottom-k MinHash) of each item's shingles with
k = n - ceil(0.8 n) + 1. A document that contains the item lacks at most n - ceil(0.8 n) of its shingles, so it has one
of these k: the search has no false negatives, however long the document is. A sketch of the document couldn't do that,
as few of its smallest hashes belong to a short item; so all its shingles are looked up, in the sketches of those
partitions whose smallest item it has shingles enough to contain. Where one is found, the item's and the document's
shingles are compared as strings.

The items are the query set. They reach the executors in blocks of a bounded number of characters, as flat arrays of
hashes and their texts, so any number of them can be searched, with one pass over the documents for each block. Items
are dealt to blocks by hash and never split, so one that is longer than a block makes its block longer.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fluxgrid.llm import words as W

WIDTH = 5
LEAST = 0.8
#: Characters of items that one pass over the documents takes; larger sets of items take more passes.
BLOCK_CHARS = 16 << 20
SCHEMA = "doc_id bigint, item_id bigint, n_shingles bigint, n_found bigint, containment double"


@dataclass(frozen=True)
class Partition:
    """Items of one width of shingles and one class of sizes."""

    width: int
    #: How many shingles a document needs to contain the smallest item.
    least: int
    #: The sorted distinct hashes of the sketches; the items that have hash k are items[first[k] : first[k + 1]].
    sketch: np.ndarray
    first: np.ndarray
    items: np.ndarray


@dataclass(frozen=True)
class Items:
    """A block of items: their partitions, and what verifies them."""

    ids: list[int | None]
    texts: list[str]
    partitions: list[Partition]
    #: By width: the sorted hashes that any item's shingles have.
    all_hashes: dict[int, np.ndarray]


def least_found(n: int) -> int:
    """How many of n distinct shingles a document needs."""
    return math.ceil(n * LEAST - 1e-9)


def _bytes(folded: np.ndarray, starts: np.ndarray, ends: np.ndarray, at: int, width: int) -> bytes:
    return b" ".join(folded[s:e].tobytes() for s, e in zip(starts[at : at + width], ends[at : at + width], strict=True))


def _hashed(texts: pa.Array) -> Iterator[tuple]:
    """For each block of texts: (first row, rows, bytes, word starts, word ends, word hashes, first word of each row)."""
    for row, n, data, offsets in W.blocks(texts):
        folded = W.BY_SIGN[data]
        starts, ends = W.spans(folded, offsets)
        yield row, n, folded, starts, ends, W.word_hashes(folded, starts, ends), np.append(np.searchsorted(starts, offsets[:-1]), len(starts))


def index(ids: list[int | None], texts: list[str | None]) -> Items:
    """The partitions of the items; items without a word are left out, as no document can contain them."""
    kept, sizes, sketches, every = [], [], defaultdict(list), defaultdict(list)
    for row, n, _, starts, _, hashes, first in _hashed(pa.array(texts, pa.large_string())):
        for k in range(n):
            a, b = int(first[k]), int(first[k + 1])
            if a == b:
                continue
            width = min(WIDTH, b - a)
            own = np.unique(W.shingle_hashes(hashes[a:b], np.array([0, b - a]), width)[1])
            sketches[width, len(own).bit_length()].append((len(kept), own[: len(own) - least_found(len(own)) + 1]))
            every[width].append(own)
            kept.append(row + k)
            sizes.append(len(own))
    partitions = []
    for (width, _), own in sorted(sketches.items()):
        flat, holder = np.concatenate([x for _, x in own]), np.repeat([i for i, _ in own], [len(x) for _, x in own])
        order = np.lexsort((holder, flat))
        sketch, first = np.unique(flat[order], return_index=True)
        partitions.append(Partition(width, least_found(min(sizes[i] for i, _ in own)), sketch, np.append(first, len(flat)), holder[order]))
    flat = {w: np.unique(np.concatenate(x)) for w, x in every.items()}
    return Items([ids[k] for k in kept], [texts[k] for k in kept], partitions, flat)


@lru_cache(maxsize=4096)
def _strings(text: str, width: int) -> frozenset[bytes]:
    """The distinct shingles of an item."""
    _, _, folded, starts, ends, _, _ = next(_hashed(pa.array([text], pa.large_string())))
    return frozenset(_bytes(folded, starts, ends, at, width) for at in range(len(starts) - width + 1))


def _inside(hashes: np.ndarray, among: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """Positions of those hashes that are in the sorted array; bits: its 20-bit prefixes, which drop nearly all others first."""
    at = np.flatnonzero(bits[(hashes >> np.uint64(44)).astype(np.int64)])
    place = np.minimum(np.searchsorted(among, hashes[at]), len(among) - 1)
    return at[among[place] == hashes[at]]


def _prefixes(among: np.ndarray) -> np.ndarray:
    bits = np.zeros(1 << 20, bool)
    bits[(among >> np.uint64(44)).astype(np.int64)] = True
    return bits


def search(texts: pa.Array, items: Items) -> Iterator[tuple[int, int, int, int]]:
    """(row, item, its distinct shingles, those found in the row) of each contained item."""
    bits = [_prefixes(p.sketch) for p in items.partitions]
    every_bits = {w: _prefixes(x) for w, x in items.all_hashes.items()}
    for row, n, folded, starts, ends, hashes, first in _hashed(texts):
        for width, every in items.all_hashes.items():
            at, found = W.shingle_hashes(hashes, first, width)
            size, wanted = np.maximum(np.diff(first) - width + 1, 0), defaultdict(set)
            for partition, own_bits in zip(items.partitions, bits, strict=True):
                if partition.width != width or not (size >= partition.least).any():
                    continue
                hit = _inside(found, partition.sketch, own_bits)
                owner = np.searchsorted(first, at[hit], "right") - 1
                fits = size[owner] >= partition.least
                for k, place in zip(owner[fits].tolist(), np.searchsorted(partition.sketch, found[hit[fits]]).tolist(), strict=True):
                    wanted[k].update(partition.items[partition.first[place] : partition.first[place + 1]].tolist())
            if not wanted:
                continue
            near = _inside(found, every, every_bits[width])
            owner = np.searchsorted(first, at[near], "right") - 1
            begin, end = np.searchsorted(owner, np.arange(n)), np.searchsorted(owner, np.arange(n), "right")
            for k, candidates in wanted.items():
                own = near[begin[k] : end[k]]
                own = own[np.unique(found[own], return_index=True)[1]]
                texts_found = {_bytes(folded, starts, ends, int(x), width) for x in at[own]}
                for item in candidates:
                    shingles = _strings(items.texts[item], width)
                    both = len(shingles & texts_found)
                    if both >= least_found(len(shingles)):
                        yield row + k, item, len(shingles), both


def _shared_blocks(docs: DataFrame, benchmark: DataFrame, block_chars: int) -> Iterator[Broadcast]:
    """The items, one broadcast for each block of them; a block has about block_chars characters."""
    listed = benchmark.select(F.col("item_id").cast("bigint").alias("item_id"), F.col("text").cast("string").alias("text"))
    size = listed.agg(F.sum(F.length("text"))).first()[0] or 0
    passes = max(1, math.ceil(size / block_chars))
    for k in range(passes):
        rows = listed.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(passes)) == k).collect() if passes > 1 else listed.collect()
        yield docs.sparkSession.sparkContext.broadcast(index([r.item_id for r in rows], [r.text for r in rows]))


def contained(docs: DataFrame, benchmark: DataFrame, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """(doc_id, item_id, n_shingles, n_found, containment) of each item of benchmark(item_id, text) and each row of
    docs(doc_id, text) that contains it.

    Null and empty texts contain nothing and are contained nowhere. Repeated rows, on either side, give repeated
    pairs, and null ids come out as null.
    """
    source = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string"))
    parts = [source.mapInArrow(_pairs(shared), SCHEMA) for shared in _shared_blocks(docs, benchmark, block_chars)]
    return reduce(DataFrame.union, parts)


def clean(docs: DataFrame, benchmark: DataFrame, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """The rows of docs, with all columns, that contain no item of the benchmark; needs no shuffle and no ids."""
    for shared in _shared_blocks(docs, benchmark, block_chars):
        docs = docs.mapInArrow(_without(shared), docs.schema)
    return docs


def _pairs(shared: Broadcast) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = shared.value
        for batch in batches:
            hits = np.array(list(search(batch.column(1), items)), np.int64).reshape(-1, 4)
            n, both = hits[:, 2], hits[:, 3]
            ids = pa.array([items.ids[x] for x in hits[:, 1]], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(hits[:, 0])), ids, pa.array(n), pa.array(both), pa.array(both / np.maximum(n, 1))],
                ["doc_id", "item_id", "n_shingles", "n_found", "containment"],
            )

    return run


def _without(shared: Broadcast) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = shared.value
        for batch in batches:
            stays = np.ones(batch.num_rows, bool)
            stays[[h[0] for h in search(batch.column("text"), items)]] = False
            yield batch.filter(pa.array(stays))

    return run
