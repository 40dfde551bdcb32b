"""Near-duplicates by SimHash: Golay-code fuzzy hashing of fingerprint segments.

A fingerprint is cut into three segments of at most 23 bits. The perfect binary Golay code (23, 12, 7) gives each
segment the indices of all codewords within 4 bits: one if the nearest is at most 2 bits away, six if it is 3 away.
Two words that differ in 2 bits share an index, because the codeword nearest to the word between them is within 3 + 1
bits of both. By the pigeonhole principle, fingerprints with at most 4 differing bits have either

* no segment with over 2 errors, and then share a key of three codeword indices, or
* one segment with 3 or 4 errors, and then one other segment is equal and the third has at most 1 error; they share a
  key of that segment itself and the third one's codeword index.

So equality joins on these keys find every such pair, and an exact count of the differing bits decides.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator
from functools import cache
from itertools import combinations, permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fluxgrid.llm import words as W
from fluxgrid.llm.xxh64 import xxh64
from fluxgrid.operators.graph import connected_components
from fluxgrid.session import cut, scratch

BITS = 4
WIDTH = 4
SEED = 42
#: First bit and width of each segment.
SEGMENTS = ((0, 22), (22, 21), (43, 21))
#: Fingerprints of one key that are compared within one task; larger buckets are cut into blocks, each pair of blocks a task of its own.
BUCKET = 4096
_GENERATOR = 0b101011100011  # of the Golay code: x^11 + x^9 + x^7 + x^6 + x^5 + x + 1


@cache
def _syndromes() -> tuple[np.ndarray, np.ndarray]:
    """The syndromes of all words of 12 bits, and of those with 11 zeros below; a word's is the exclusive or of both its parts'."""
    left = np.concatenate((np.arange(1 << 12, dtype=np.uint32), np.arange(1 << 11, dtype=np.uint32) << 12))
    for bit in range(22, 10, -1):
        left ^= np.where(left >> bit & 1, np.uint32(_GENERATOR << (bit - 11)), np.uint32(0))
    return left[: 1 << 12].astype(np.int16), left[1 << 12 :].astype(np.int16)


def syndromes(words: np.ndarray) -> np.ndarray:
    low, high = _syndromes()
    return low[words & 4095] ^ high[words >> 12]


@cache
def _golay() -> tuple[np.ndarray, np.ndarray]:
    """(all error patterns of up to 4 bits by syndrome, their number)."""
    patterns = [sum(1 << b for b in bits) for n in range(5) for bits in combinations(range(23), n)]
    by = defaultdict(list)
    for p, s in zip(patterns, syndromes(np.array(patterns)).tolist(), strict=True):
        by[s].append(p)
    table = np.zeros((2048, 6), np.uint32)
    count = np.zeros(2048, np.int64)
    for s, found in by.items():
        table[s, : len(found)], count[s] = found, len(found)
    return table, count


def codewords(segment: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(position in the input, index) of each codeword within 4 bits of each 23-bit word."""
    table, count = _golay()
    s = syndromes(segment)
    n = count[s]
    at = np.repeat(np.arange(len(segment)), n)
    rank = np.arange(len(at)) - np.repeat(np.cumsum(n) - n, n)
    return at, (segment[at] ^ table[s[at], rank]) >> 11


def keys(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(position in the input, key) for all keys of each fingerprint; the top bits tell kinds of keys apart."""
    part = [(prints >> np.uint64(at) & np.uint64((1 << width) - 1)).astype(np.int64) for at, width in SEGMENTS]
    near = [codewords(x) for x in part]
    rows, found = [], []

    def product(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """All keys of a with all of b of the same position; positions ascend in both."""
        n = np.bincount(b[0], minlength=len(prints))
        start = np.cumsum(n) - n
        times = n[a[0]]
        left = np.repeat(np.arange(len(a[0])), times)
        right = np.arange(len(left)) - np.repeat(np.cumsum(times) - times, times) + start[a[0]][left]
        return a[0][left], a[1][left].astype(np.int64) << 12 | b[1][right].astype(np.int64)

    three = product(product(near[0], near[1]), near[2])
    rows.append(three[0])
    found.append(three[1])
    for kind, (equal, fuzzy) in enumerate(permutations(range(3), 2), 1):
        at, index = near[fuzzy]
        rows.append(at)
        found.append(part[equal][at] << 12 | index.astype(np.int64) | kind << 56)
    return np.concatenate(rows), np.concatenate(found)


def fingerprints(texts: pa.Array) -> np.ndarray:
    """The 64-bit SimHash of each text: of its 4-word shingles, repeats included; 0 without words."""
    out = np.zeros(len(texts), np.uint64)
    for row, n, data, offsets in W.blocks(texts):
        folded = W.BY_SPACE[data]
        if data.size and (nul := data == 0).any():
            folded[nul] = 1  # a word character; its hash is taken from the text itself
        starts, ends = W.spans(folded, offsets)
        if not len(starts):
            continue
        first = np.searchsorted(starts, offsets)
        # The words of a row, each but the last followed by one space.
        keep = folded != 0
        keep[ends[ends < len(keep)]] = True
        text = np.where(folded == 0, np.uint8(32), folded)
        if data.size and nul.any():
            text[nul] = 0
        place = np.concatenate(([0], np.cumsum(keep)))
        flat = text[keep]
        a, b = place[starts], place[ends]
        counts = np.diff(first)
        whole = np.flatnonzero((counts > 0) & (counts < WIDTH))
        index = np.arange(len(starts))
        full = index[np.repeat(first[1:], counts) - index >= WIDTH]
        lo = np.concatenate((a[full], a[first[whole]]))
        hi = np.concatenate((b[full + WIDTH - 1], b[first[whole + 1] - 1]))
        owner = np.concatenate((np.searchsorted(first, full, "right") - 1, whole))
        hashes = xxh64(flat, lo, hi, SEED)
        if len(whole):
            order = np.argsort(owner, kind="stable")
            owner, hashes = owner[order], hashes[order]
        begin = np.flatnonzero(np.diff(owner, prepend=-1))
        rows, size = owner[begin], np.diff(begin, append=len(owner))
        ones = _ones(hashes, begin)
        out[row + rows] = np.packbits(2 * ones > size[:, None], axis=1, bitorder="little").view("<u8").ravel()
    return out


def set_fingerprints(sets: list[np.ndarray]) -> np.ndarray:
    """The 64-bit SimHash of each set of hashes; 0 of an empty one."""
    size = np.array([len(x) for x in sets], np.int64)
    hashes = np.concatenate(sets) if len(sets) else np.zeros(0, np.uint64)
    begin = np.cumsum(size) - size
    return np.packbits(2 * _ones(hashes, begin) > size[:, None], axis=1, bitorder="little").view("<u8").ravel()


def _ones(hashes: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """How often each of the 64 bits is set, for each run of hashes."""
    spread = _spread()
    out = np.zeros((len(begin), 64), np.int64)
    ends = np.append(begin[1:], len(hashes))
    eight = hashes.astype("<u8").view(np.uint8).reshape(-1, 8)
    for row, (s, e) in enumerate(zip(begin.tolist(), ends.tolist(), strict=True)):
        for at in range(s, e, 255):  # sums of up to 255 bytes of 0 or 1 fit a byte each
            out[row] += spread[eight[at : min(e, at + 255)]].sum(axis=0, dtype=np.uint64).view(np.uint8)
    return out


@cache
def _spread() -> np.ndarray:
    """The bits of each byte as eight bytes of 0 or 1, in a 64-bit word."""
    return np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").view("<u8").ravel()


def _prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = fingerprints(batch.column(1)).view(np.int64)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found)], ["doc_id", "print"])


def with_fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, print) of each row of docs; print is the unsigned fingerprint's bits as a BIGINT."""
    return docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).mapInArrow(_prints, "doc_id bigint, print bigint")


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 2000):
            own = np.asarray(batch.column(0).slice(at, 2000)).view(np.uint64)
            rows, found = keys(own)
            yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(own[rows].view(np.int64))], ["key", "print"])


def _close(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b) <= BITS


class _Forest:
    """Links found within a task, as a forest; what leaves the task is one link a fingerprint and not one a pair."""

    def __init__(self) -> None:
        self.up: dict[int, int] = {}
        self.made: list[tuple[int, int]] = []

    def root(self, x: int) -> int:
        up, path = self.up, []
        while (y := up.get(x, x)) != x:
            path.append(x)
            x = y
        for y in path:
            up[y] = x
        return x

    def link(self, a: int, b: int) -> None:
        x, y = self.root(a), self.root(b)
        if x != y:
            self.up[max(x, y)] = min(x, y)
            self.made.append((a, b))

    def edges(self) -> pa.RecordBatch:
        own = np.array(self.made, np.int64).reshape(-1, 2)
        self.up.clear()
        self.made.clear()
        return pa.RecordBatch.from_arrays([pa.array(own[:, 0]), pa.array(own[:, 1]), pa.nulls(len(own), pa.int64())], ["a", "b", "key"])


def _grow(members: np.ndarray, forest: _Forest) -> None:
    """Links the members of one bucket: a search from each that is left, over those not reached so far."""
    left = members
    while len(left) > 1:
        front, left = left[:1], left[1:]
        while len(front) and len(left):
            x, front = front[0], front[1:]
            near = _close(left, x)
            if near.any():
                found, left = left[near], left[~near]
                for y in found.view(np.int64).tolist():
                    forest.link(int(x.view(np.int64)), y)
                front = np.concatenate((front, found))


def _linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges (a, b) from rows (key, print) sorted by both; the rows of a key with over BUCKET prints come out again as (print, null, key)."""
    forest, held_key, held, spilt = _Forest(), None, np.zeros(0, np.uint64), False

    def runs(key: np.ndarray, value: np.ndarray) -> None:
        begin = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        size = np.diff(np.append(begin, len(key)))
        for n in (2, 3):  # most buckets: all their pairs at once
            at = begin[size == n]
            for i, j in combinations(range(n), 2):
                a, b = value[at + i], value[at + j]
                close = _close(a, b)
                for x, y in zip(a[close].view(np.int64).tolist(), b[close].view(np.int64).tolist(), strict=True):
                    forest.link(x, y)
        for s, n in zip(begin[size > 3].tolist(), size[size > 3].tolist(), strict=True):
            _grow(value[s : s + n], forest)

    def again(key: int, value: np.ndarray) -> pa.RecordBatch:
        none = pa.nulls(len(value), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(value.view(np.int64)), none, pa.array(np.full(len(value), key, np.int64))], ["a", "b", "key"])

    for batch in batches:
        key, value = np.asarray(batch.column(0)), np.asarray(batch.column(1)).view(np.uint64)
        if not len(key):
            continue
        last = int(np.searchsorted(key, key[-1]))
        head = int(np.searchsorted(key, held_key, "right")) if held_key is not None else 0
        if head:
            held = np.concatenate((held, value[:head]))
        if held_key is not None and head < len(key):  # the held bucket is complete
            if spilt or len(held) > BUCKET:
                yield again(held_key, held)
            else:
                runs(np.full(len(held), held_key), held)
            held, spilt = np.zeros(0, np.uint64), False
        if head < len(key):
            if last > head:
                inner, at = key[head:last], value[head:last]
                begin = np.flatnonzero(np.concatenate(([True], inner[1:] != inner[:-1])))
                size = np.diff(np.append(begin, len(inner)))
                for s, n in zip(begin[size > BUCKET].tolist(), size[size > BUCKET].tolist(), strict=True):
                    yield again(int(inner[s]), at[s : s + n])
                fits = np.repeat(size <= BUCKET, size)
                runs(inner[fits], at[fits])
            held_key, held = int(key[-1]), value[last:]
        if len(held) > BUCKET:
            yield again(held_key, held)
            held, spilt = np.zeros(0, np.uint64), True
        if len(forest.up) > 1_000_000:
            yield forest.edges()
    if held_key is not None and len(held):
        if spilt:
            yield again(held_key, held)
        else:
            runs(np.full(len(held), held_key), held)
    yield forest.edges()


def _across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges of one pair of blocks (key, i, j) a run of rows; the blocks' sizes are bounded."""
    forest, held = _Forest(), None
    for batch in batches:
        frame = batch.to_pandas()
        frame = frame if held is None else held._append(frame, ignore_index=True)
        mark = frame[["key", "i", "j"]].ne(frame[["key", "i", "j"]].shift()).any(axis=1).cumsum()
        for group, part in frame.groupby(mark, sort=False):
            if group == mark.iloc[-1]:
                held = part
            else:
                _grow(part["print"].to_numpy(np.int64).view(np.uint64), forest)
    if held is not None:
        _grow(held["print"].to_numpy(np.int64).view(np.uint64), forest)
    yield forest.edges()


def links(prints: DataFrame) -> DataFrame:
    """Edges (a, b) between distinct fingerprints (column print) that connect all those with at most 4 differing bits.

    Rows are dealt by key and compared in the order of the keys, so that a task holds one bucket at a time. A bucket
    of over BUCKET fingerprints is dealt again: each of its fingerprints gets a block by its hash, each pair of blocks
    is a bucket of its own, and so no task holds more than two blocks.
    """
    tasks = int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # a fingerprint becomes some 180 keys
    keyed = prints.repartition(tasks).mapInArrow(_keyed, "key bigint, print bigint")
    dealt = keyed.repartition("key").sortWithinPartitions("key", "print")
    found = cut(dealt.mapInArrow(_linked, "a bigint, b bigint, key bigint"))
    edges, large = found.where("key is null").select("a", "b"), found.where("key is not null").select("key", F.col("a").alias("print"))
    if large.isEmpty():
        return edges
    count = large.groupBy("key").agg(F.ceil(2 * F.count("*") / BUCKET).cast("int").alias("n"))
    block = F.pmod(F.xxhash64("print"), F.col("n")).cast("int")
    pairs = (
        large.join(count, "key").withColumn("own", block)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
        .select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "print")
    )
    more = pairs.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j").mapInArrow(_across, "a bigint, b bigint, key bigint")
    return edges.union(more.select("a", "b"))


def components(docs: DataFrame) -> DataFrame:
    """(doc_id, fingerprint, component_id) of each row of docs(doc_id, text).

    fingerprint: 16 hexadecimal digits. component_id: the smallest doc_id that is reachable over links, its own
    included. A null text has no words, and texts without words have fingerprint 0, linked like any other. A row with
    a null doc_id gets the component of its fingerprint, which is null if no row of it has an id. Repeated rows come
    out repeated, columns of other names are left out, and an empty table gives no row. Rows of the same fingerprint are
    aggregated before anything is joined, so copies cost nothing more.
    """
    rows = cut(with_fingerprints(docs))
    groups = cut(rows.groupBy("print").agg(F.min("doc_id").alias("doc_id")))
    labels = connected_components(links(groups.select("print"))).withColumnRenamed("node", "print")
    named = cut(groups.join(labels, "print", "left").withColumn("component", F.coalesce("component", "print")))
    # Tables, as a join with an aggregation over the same exchange can't be split where a component has many fingerprints.
    least = cut(named.groupBy("component").agg(F.min("doc_id").alias("component_id")))
    by_print = named.join(least, "component").select("print", "component_id")
    return rows.join(by_print, "print").select(
        "doc_id", F.lpad(F.lower(F.hex("print")), 16, "0").alias("fingerprint"), "component_id"
    )


def deduplicated(docs: DataFrame) -> DataFrame:
    """The rows of docs(doc_id, text), one of each component: that with its smallest doc_id.

    Components are of texts with a similarity of at least 0.8 (fluxgrid.llm.neardup). Near fingerprints are candidates for
    them, which sets verify, and the exact join by first shingles adds what fingerprints miss. Rows are
    told apart as rows: others with the same doc_id but another text are judged by their text. Of several rows of a
    component with its smallest id, that with the smallest hash of all its columns stays, and of equal rows one; a row
    without an id stays only where no row of its component has one. A null text counts as empty, and an empty table
    gives no row.
    """
    from fluxgrid.llm import neardup  # it searches by this module's fingerprints

    names = docs.columns
    tag = "_tag_" + "_".join(names)  # no column of docs has a name that holds all names
    tagged = docs.withColumn(tag, F.xxhash64(*(c for c in names if not docs.schema[c].dataType.simpleString().startswith(("map", "variant")))))
    with scratch(docs.sparkSession) as write:
        source = tagged.select("doc_id", "text", F.col(tag).alias("tag"))
        rows = write(neardup.prints(source))
        order = F.struct(F.isnull("doc_id").alias("none"), "doc_id", "tag")
        groups = write(rows.groupBy("print").agg(F.min(order).alias("first")))
        labels = write(connected_components(neardup.links(source, rows, write))).withColumnRenamed("node", "print")
        named = write(groups.join(labels, "print", "left").select(F.coalesce("component", "print").alias("component"), "first"))
        first = named.groupBy("component").agg(F.min("first").alias("first")).select("first.doc_id", "first.tag")
        counted = rows.groupBy("doc_id", "tag").agg(F.count("*").alias("n"))
        same = (F.col("doc_id").eqNullSafe(F.col("id"))) & (F.col("tag") == F.col("own"))
        kept = counted.join(first.select(F.col("doc_id").alias("id"), F.col("tag").alias("own")), same)
        stays = cut(kept.select(*(F.col(c).alias(f"{tag}_{c}") for c in ("id", "own", "n"))))
    here = (docs["doc_id"].cast("bigint").eqNullSafe(F.col(f"{tag}_id"))) & (F.col(tag) == F.col(f"{tag}_own"))
    number = F.col(f"{tag}_n")
    once = tagged.join(stays.where(number == 1), here, "left_semi").select(names)
    repeated = stays.where(number > 1)
    if repeated.isEmpty():
        return once
    return once.union(tagged.join(repeated, here, "left_semi").dropDuplicates(["doc_id", tag]).select(names))
