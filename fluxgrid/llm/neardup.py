"""Near-duplicates by similarity: an exact join of texts whose shingles have a Jaccard similarity of at least 0.8.

A word is a run of ASCII letters and digits and of characters outside ASCII, with A-Z in lower case; a shingle is five
words. A text of fewer than five words has one shingle, all its words; one without any has what stands between white
space for words. Texts with the same shingles are one print, a 64-bit hash of the set.

The search has three steps, and whole sets decide in each.

* SimHash: fingerprints of the sets within 4 bits, by Golay codeword keys (fluxgrid.llm.simhash). Most pairs at 0.8 differ
  in more bits than any keys allow, so this step alone would lose links.
* Two sets with a similarity of 0.8 share at least 0.8 of the larger one's n shingles. So, in any order that is the same
  for all sets, they share one of the first n - ceil(0.8 n) + 1 shingles of each: equality on these finds every pair.
  Shingles that are rare in a sample come first in that order, so that common passages make few candidates. All prints
  that have a shingle among their first ones are compared with one of them.
* Those that are still in different components are compared with each other, within the task that holds the shingle. A pair
  goes unless its sizes, the shingle's places and two sketches leave room for a similarity of 0.8. A print's most similar
  one by the sketches comes first; what that links needs no other pair.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fluxgrid.llm import simhash
from fluxgrid.llm import words as W
from fluxgrid.operators.graph import connected_components
from fluxgrid.session import BROADCAST_BYTES

WIDTH = 5
#: Texts in the sample that tells which shingles are common, and the number of shingles that it tells. They change the cost only.
SAMPLE, COMMON = 10_000, 200_000
#: Prints of a bucket that are compared with each other within one task; larger buckets are cut into blocks, each pair of blocks a task's group of its own.
BLOCK = 512
#: Bytes of a sketch that goes along with each of a print's keys; longer sketches are folded for that.
CARRIED = 256
#: Pairs of a task whose sketches are compared at once.
PAIRS = 1 << 16
_SALT = np.uint64(0xA24BAED4963EE407)


def _own_sets(texts: pa.Array, table: np.ndarray) -> list[np.ndarray]:
    out = []
    for _, n, data, offsets in W.blocks(texts):
        folded = table[data]
        starts, ends = W.spans(folded, offsets)
        hashes, first = W.word_hashes(folded, starts, ends), np.searchsorted(starts, offsets)
        at, found = W.shingle_hashes(hashes, first, WIDTH)
        begin = np.searchsorted(at, first)
        for k in range(n):
            a, b = int(first[k]), int(first[k + 1])
            if 0 < b - a < WIDTH:
                out.append(W.shingle_hashes(hashes[a:b], np.array([0, b - a]), b - a)[1])
            else:
                out.append(np.unique(found[begin[k] : begin[k + 1]]))
    return out


def shingle_sets(texts: pa.Array) -> list[np.ndarray]:
    """The sorted hashes of each text's distinct shingles; none for texts of white space alone."""
    out = _own_sets(texts, W.BY_SIGN)
    bare = [k for k, own in enumerate(out) if not len(own)]
    for k, own in zip(bare, _own_sets(texts.take(pa.array(bare, pa.int64())), W.BY_SPACE), strict=True):
        out[k] = own
    return out


def _print(own: np.ndarray) -> int:
    """A hash of a set that doesn't depend on any order."""
    total = np.array([len(own)], np.uint64) + W.mix(own ^ _SALT).sum(dtype=np.uint64)
    return int(W.mix(total).view(np.int64)[0])


def _lists(own: list[np.ndarray]) -> pa.Array:
    values = np.concatenate(own) if own else np.zeros(0, np.uint64)
    return pa.LargeListArray.from_arrays(pa.array(np.cumsum([0, *map(len, own)]), pa.int64()), pa.array(values.view(np.int64))).cast(pa.list_(pa.int64()))


def _parts(batches: Iterator[pa.RecordBatch], size: int = 1000) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, size):
            yield batch.slice(at, size)


def _sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in _parts(batches):
        own = shingle_sets(batch.column(0))
        seen, n = np.unique(np.concatenate(own), return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(seen.view(np.int64)), pa.array(n)], ["shingle", "n"])


def _common(docs: DataFrame) -> Broadcast:
    """(sorted hashes, counts) of the shingles that several texts of a sample have."""
    share = max(1, docs.count() // SAMPLE)
    sample = docs.select("text").where(F.pmod(F.xxhash64("text"), F.lit(share)) == 0).distinct()
    counted = sample.mapInArrow(_sampled, "shingle bigint, n bigint").groupBy("shingle").agg(F.sum("n").alias("n")).where("n > 1")
    found = counted.orderBy(F.desc("n"), "shingle").limit(COMMON).toArrow()
    hashes, n = (found.column(k).to_numpy() for k in range(2))
    order = np.argsort(hashes.view(np.uint64))
    return docs.sparkSession.sparkContext.broadcast((hashes.view(np.uint64)[order], n[order]))


def first_shingles(own: np.ndarray, common: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Those of a set's shingles of which any set with a similarity of at least 0.8 has one among its own."""
    n = len(own)
    number = n - -(-8 * n // 10) + 1 if n else 0
    often = np.zeros(n, np.int64)
    if len(common):
        place = np.minimum(np.searchsorted(common, own), len(common) - 1)
        often = np.where(common[place] == own, counts[place], 0)
    return own[np.argsort(often, kind="stable")[:number]]


def _sketch(own: np.ndarray) -> bytes:
    """For each class of hashes, by their last bits, whether the set has an odd number of them: two to four classes a hash.

    Each element that is in one of two sets only flips one bit, so they differ in as many elements at least as their
    sketches in bits. The sketch of half as many classes is one half with exclusive or of the other.
    """
    bits = max(64, 1 << (2 * len(own) - 1).bit_length())
    number = np.bincount((own & np.uint64(bits - 1)).astype(np.int64), minlength=bits)
    return np.packbits((number & 1).astype(np.uint8), bitorder="little").tobytes()


def _folded(rows: np.ndarray, words: int) -> np.ndarray:
    return rows if rows.shape[1] == words else np.bitwise_xor.reduce(rows.reshape(len(rows), -1, words), axis=1)


def _carried(sketch: bytes) -> bytes:
    return sketch if len(sketch) <= CARRIED else _folded(np.frombuffer(sketch, "<u8")[None], CARRIED // 8).tobytes()


def _differing(sketches: list[bytes], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """In how many elements the sets of each pair of positions differ at least."""
    size, place, rows = np.array([len(x) // 8 for x in sketches], np.int64), np.zeros(len(sketches), np.int64), {}
    for words in np.unique(size).tolist():
        at = np.flatnonzero(size == words)
        rows[words], place[at] = np.frombuffer(b"".join([sketches[k] for k in at.tolist()]), "<u8").reshape(-1, words), np.arange(len(at))
    out = np.zeros(len(left), np.int64)
    for a, b in np.unique(np.stack((size[left], size[right]), axis=1), axis=0).tolist():
        those, words = np.flatnonzero((size[left] == a) & (size[right] == b)), min(a, b)
        step = max(1, (1 << 20) // max(a, b))
        for at in range(0, len(those), step):
            one = those[at : at + step]
            bits = _folded(rows[a][place[left[one]]], words) ^ _folded(rows[b][place[right[one]]], words)
            out[one] = np.bitwise_count(bits).sum(axis=1, dtype=np.int64)
    return out


def _possible(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pairs (a, b) whose sizes and whole sketches leave room for a similarity of 0.8."""
    for batch in _parts(batches):
        n = batch.num_rows
        sketches = batch.column(4).to_pylist() + batch.column(5).to_pylist()
        most = np.asarray(batch.column(2)) + np.asarray(batch.column(3))
        yield batch.select([0, 1]).filter(pa.array(9 * _differing(sketches, np.arange(n), np.arange(n, 2 * n)) <= most))


Write = Callable[[DataFrame], DataFrame]


def _prefixed(shared: Broadcast) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _parts(batches):
            own = shingle_sets(batch.column(1))
            whole = [_sketch(x) for x in own]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(map(_print, own), pa.int64()), pa.array(map(len, own), pa.int64()),
                 _lists([first_shingles(x, *shared.value) for x in own]), pa.array(map(_carried, whole), pa.binary()),
                 pa.array([x if len(x) > CARRIED else None for x in whole], pa.binary()), pa.array(simhash.set_fingerprints(own).view(np.int64))],
                ["doc_id", "tag", "print", "n", "first", "sketch", "whole", "fingerprint"],
            )

    return run


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in _parts(batches):
        own = shingle_sets(batch.column(0))
        yield pa.RecordBatch.from_arrays([pa.array(map(_print, own), pa.int64()), _lists(own)], ["print", "shingles"])


def _buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, hub, hub_n, print, n, ...) of the keys with two prints or more, from rows (key, print, n, ...) sorted by key; a key's first print is its hub."""
    last = None  # the last row, and its hub's print and n
    alone = False  # whether that row is the first of its key, and hasn't come out so far
    for batch in batches:
        columns = [np.asarray(x) for x in batch.columns]
        if not batch.num_rows:
            continue
        if last is not None:
            columns = [np.concatenate(([x], y)) for x, y in zip(last, columns, strict=True)]
        key, own, n, *more = columns
        new = np.concatenate(([True], key[1:] != key[:-1]))
        hub = np.maximum.accumulate(np.where(new, np.arange(len(key)), 0))
        out = ~new
        out[:-1] |= new[:-1] & ~new[1:]
        if last is not None and not alone:
            out[0] = False
        alone = not out[-1]
        names = ["key", "hub", "hub_n", "print", "n", *batch.schema.names[3:]]
        yield pa.RecordBatch.from_arrays([pa.array(x[out]) for x in (key, own[hub], n[hub], own, n, *more)], names)
        last = (key[-1], own[hub[-1]], n[hub[-1]], *(x[-1] for x in more))


def _in_group(table: pa.Table, nearest: bool) -> pa.RecordBatch:
    """The possible pairs (a, b) of different components within each group (key, i, j) of sorted rows."""
    key, i, j, side, own, n, component, place = (table.column(k).to_numpy() for k in range(8))
    sketches, rows = table.column(8).to_pylist(), len(key)
    new = np.concatenate(([True], (key[1:] != key[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])))
    begin = np.flatnonzero(new)
    end = np.repeat(np.append(begin[1:], rows), np.diff(np.append(begin, rows)))
    kept, waiting, held = [], [], 0

    def compared() -> None:
        left, right = (np.concatenate(x) for x in zip(*waiting, strict=True))
        waiting.clear()
        most, least = n[left] + n[right], _differing(sketches, left, right)
        fits = 9 * least <= most
        left, right, share = left[fits], right[fits], least[fits] / most[fits]
        if nearest and len(left):  # of each row the one that is most like it
            row, other, both = np.concatenate((left, right)), np.concatenate((right, left)), np.concatenate((share, share))
            order = np.lexsort((own[other], both, row))
            first = order[np.concatenate(([True], row[order][1:] != row[order][:-1]))]
            left, right = row[first], other[first]
        a, b = own[left], own[right]
        kept.append(np.stack((np.minimum(a, b), np.maximum(a, b)), axis=1))

    left, step = np.arange(rows), 0
    while True:
        step += 1
        left = left[left + step < end[left]]
        if not len(left):
            break
        right = left + step
        # Where the key is the first shingle that both share, those before it in either are in one set only.
        fits = (component[left] != component[right]) & ((i[left] == j[left]) | (side[left] != side[right]))
        fits &= (9 * (place[left] + place[right]) <= n[left] + n[right]) & (10 * np.minimum(n[left], n[right]) >= 8 * np.maximum(n[left], n[right]))
        waiting.append((left[fits], right[fits]))
        held += int(fits.sum())
        if held >= PAIRS:
            compared()
            held = 0
    if waiting:
        compared()
    found = np.unique(np.concatenate(kept), axis=0) if kept else np.zeros((0, 2), np.int64)
    return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(found[:, k])) for k in (0, 1)], ["a", "b"])


def _apart(nearest: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Possible pairs from rows (key, i, j, side, print, n, component, place, sketch) sorted by key, i and j; a group has two blocks' rows at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in _parts(batches, 10_000):
            table = pa.Table.from_batches([batch])
            table = table if held is None else pa.concat_tables([held, table])
            key, i, j = (table.column(k).to_numpy() for k in range(3))
            other = np.flatnonzero((key != key[-1]) | (i != i[-1]) | (j != j[-1]))
            last = int(other[-1]) + 1 if len(other) else 0
            if last:
                yield _in_group(table.slice(0, last), nearest)
            held = table.slice(last)
        if held is not None:
            yield _in_group(held, nearest)

    return run


def _sizes_fit(a: str, b: str) -> Column:
    return 10 * F.least(a, b) >= 8 * F.greatest(a, b)


def _hinted(prints: DataFrame) -> DataFrame:
    """prints, of one short column, with a broadcast hint if they are few."""
    return F.broadcast(prints) if prints.count() * 16 <= BROADCAST_BYTES else prints


def _verified(pairs: DataFrame, docs: DataFrame, rows: DataFrame, write: Write) -> DataFrame:
    """The pairs (a, b) whose sets have a similarity of at least 0.8."""
    sketch = F.coalesce("whole", "sketch")
    left = rows.select(F.col("print").alias("a"), F.col("n").alias("n_a"), sketch.alias("own"))
    right = rows.select(F.col("print").alias("b"), F.col("n").alias("n_b"), sketch.alias("other"))
    sized = pairs.join(right, "b").join(left, "a").where(_sizes_fit("n_a", "n_b"))
    pairs = write(sized.select("a", "b", "n_a", "n_b", "own", "other").mapInArrow(_possible, "a bigint, b bigint"))
    wanted = write(pairs.select(F.explode(F.array("a", "b")).alias("print")).distinct())
    sets = docs.select(F.col("text").cast("string")).mapInArrow(_sets, "print bigint, shingles array<bigint>")
    sets = write(sets.join(_hinted(wanted), "print", "left_semi").dropDuplicates(["print"]))
    left, right = sets.select(F.col("print").alias("a"), F.col("shingles").alias("own")), sets.select(F.col("print").alias("b"), F.col("shingles").alias("other"))
    both = F.size(F.array_intersect("own", "other"))
    return write(pairs.join(right, "b").join(left, "a").where(9 * both >= 4 * (F.size("own") + F.size("other"))).select("a", "b"))


def prints(docs: DataFrame) -> DataFrame:
    """(doc_id, tag, print, n, first, sketch, whole, fingerprint) of each row of docs(doc_id, text, tag): its set's hash, size, first shingles, sketch (whole, if it isn't carried so) and SimHash."""
    source = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string"), "tag")
    kinds = "doc_id bigint, tag bigint, print bigint, n bigint, first array<bigint>, sketch binary, whole binary, fingerprint bigint"
    return source.mapInArrow(_prefixed(_common(source)), kinds)


def near_fingerprints(rows: DataFrame, write: Write) -> DataFrame:
    """Pairs (a, b) of prints that connect all those whose fingerprints differ in 4 bits or fewer.

    rows: (print, fingerprint), each print once. A fingerprint's least print stands for it, and others with it are linked to that one.
    """
    least = write(rows.groupBy("fingerprint").agg(F.min("print").alias("a")))
    linked = simhash.links(least.select(F.col("fingerprint").alias("print")))
    left, right = (least.select(F.col("fingerprint").alias(x), F.col("a").alias(f"{x}_")) for x in ("a", "b"))
    across = linked.join(left, "a").join(right, "b").select(F.least("a_", "b_").alias("a"), F.greatest("a_", "b_").alias("b"))
    same = rows.join(least, "fingerprint").where(F.col("print") != F.col("a")).select("a", F.col("print").alias("b"))
    return across.union(same)


def _components(edges: DataFrame, held: DataFrame, rows: DataFrame, write: Write) -> DataFrame:
    """held(key, print, n, place) with components, of those keys that have prints of several, in blocks: (key, i, j, side, print, n, component, place, sketch)."""
    labels = write(connected_components(edges)).withColumnRenamed("node", "print")
    named = write(held.select("key", "print", "n", "place").join(labels, "print", "left").withColumn("component", F.coalesce("component", "print")))
    keys = named.groupBy("key").agg(F.count("*").alias("m"), F.min("component").alias("c"), F.max("component").alias("d"))
    keys = write(keys.where("c < d").select("key", F.ceil(F.col("m") / BLOCK).cast("int").alias("blocks")))
    block = F.pmod(F.xxhash64("print"), F.col("blocks")).cast("int")
    dealt = named.join(keys, "key").withColumn("own", block).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), (F.col("own") < F.col("other")).cast("int").alias("side"), "print", "n", "component", "place")
    return dealt.join(rows.select("print", "sketch"), "print").select("key", "i", "j", "side", "print", "n", "component", "place", "sketch")


def links(docs: DataFrame, rows: DataFrame, write: Write) -> DataFrame:
    """Edges (a, b) between prints that connect all those with a similarity of at least 0.8.

    rows: prints(docs), written. write: writes a table and reads it again (session.scratch). Near fingerprints, and all prints of a
    bucket with its hub, are compared first; then, of those that are still in different components, each with the one that
    its sketch is nearest to; and then all those that are in different components even so. A crowd of near copies costs
    some comparisons of sets a copy, not one a pair. Sketches of a bucket are compared in its task, with a number that
    grows with its square where hardly any of its prints are linked. Of equal prints one is dealt; only repeated
    ones are shuffled for that.
    """
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    repeated = _hinted(write(rows.groupBy("print").agg(F.count("*").alias("_n")).where("_n > 1").select("print")))
    rows = rows.select("print", "n", "first", "sketch", "whole", "fingerprint")
    rows = rows.join(repeated, "print", "left_anti").union(rows.join(repeated, "print", "left_semi").dropDuplicates(["print"]))
    keyed = rows.select(F.posexplode("first").alias("place", "key"), "print", "n").select("key", "print", "n", F.col("place").cast("bigint"))
    dealt = keyed.repartition(tasks, "key").sortWithinPartitions("key", "print")
    held = write(dealt.mapInArrow(_buckets, "key bigint, hub bigint, hub_n bigint, print bigint, n bigint, place bigint"))
    rows = write(rows.drop("first"))
    star = held.where("print <> hub").where(_sizes_fit("hub_n", "n")).select(F.col("hub").alias("a"), F.col("print").alias("b"))
    done = write(star.union(near_fingerprints(rows.select("print", "fingerprint"), write)).distinct())
    edges = _verified(done, docs, rows, write)
    for nearest in (True, False):
        apart = _components(edges, held, rows, write)
        sorted_ = apart.repartition(tasks, "key", "i", "j").sortWithinPartitions("key", "i", "j")
        found = write(sorted_.mapInArrow(_apart(nearest), "a bigint, b bigint").distinct().join(done, ["a", "b"], "left_anti"))
        edges = write(edges.union(_verified(found, docs, rows, write)))
        done = done.union(found)
    return edges
