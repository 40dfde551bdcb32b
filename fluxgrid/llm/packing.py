"""Packing of documents into sequences: first-fit decreasing in randomised groups.

A document's ids are cut into pieces of the sequence's length and a rest. Full pieces are sequences by themselves. The
others are dealt to groups at random, about GROUP to each, and each group is packed by itself: the longest piece first,
into the first sequence with room. A tournament tree over the sequences' free room finds that sequence in a logarithm
of their number. Groups are as many as pieces ask for, not documents, so long documents make more groups, not larger ones.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fluxgrid.llm.encoder import vocabulary_path
from fluxgrid.llm.tokens import encoded
from fluxgrid.session import written

LENGTH = 4096
END = 2
#: Pieces of a group on average. The last sequences of a group are the ones with padding.
GROUP = 8192
SEED = 17
PIECES = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint"
PACKED = f"{PIECES}, sequence_id bigint, offset bigint"


def first_fit(sizes: list[int], capacity: int) -> tuple[list[int], list[int]]:
    """(bin, offset) of each size, in the order given: the first bin with room."""
    leaves = 1 << max(0, len(sizes) - 1).bit_length()
    room = [capacity] * (2 * leaves)  # room[i] is the most room of the bins below node i; leaf k is node leaves + k
    bins, offsets = [], []
    for size in sizes:
        node = 1
        while node < leaves:
            node *= 2
            if room[node] < size:
                node += 1
        bins.append(node - leaves)
        offsets.append(capacity - room[node])
        room[node] -= size
        while node > 1:
            node //= 2
            best = max(room[2 * node], room[2 * node + 1])
            if room[node] == best:
                break
            room[node] = best
    return bins, offsets


def pieces(docs: DataFrame, path: str, length: int = LENGTH, end: int = END, keep_ids: bool = False) -> DataFrame:
    """The pieces of each row of docs(doc_id, text), and with keep_ids their ids (little-endian unsigned 32-bit)."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, ids, sizes in encoded(batch, "text", path):
                flat = memoryview(np.insert(ids, np.cumsum(sizes), end).astype("<u4")).cast("B")
                total = sizes + 1
                n = -(-total // length)
                doc = np.repeat(np.arange(len(total)), n)
                start = (np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)) * length
                size = np.minimum(length, total[doc] - start)
                at = (np.cumsum(total) - total)[doc] + start
                slices = [flat[4 * s : 4 * e] for s, e in zip(at.tolist(), (at + size).tolist(), strict=True)]
                columns = [part.column("doc_id").take(pa.array(doc)), start, size, [zlib.crc32(x) for x in slices], total[doc]]
                if keep_ids:
                    columns.append(pa.array([x.tobytes() for x in slices], pa.binary()))
                yield pa.RecordBatch.from_arrays(
                    [x if isinstance(x, pa.Array) else pa.array(x, pa.int64()) for x in columns],
                    ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "ids"][: len(columns)],
                )

    source = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string"))
    return source.mapInArrow(made, PIECES + ", ids binary" * keep_ids)


def pack(docs: DataFrame, path: str | None = None, length: int = LENGTH, end: int = END, group: int = GROUP, keep_ids: bool = False) -> DataFrame:
    """One row for each piece of each row of docs(doc_id, text), with its sequence and its offset there.

    A null or empty text has one id, the end's. Repeated rows are packed as rows of their own, and null ids come out as
    null; an empty table gives no row. Groups are dealt by a hash of the piece's place, so that no id, however frequent,
    makes a group large. Pieces are written once to the shared folder, with their places: their number is known before
    they are dealt, and a lost executor costs no second encoding. A group meets in one task without its ids, which are
    joined to the places found.
    """
    own = written(pieces(docs, path or vocabulary_path(), length, end, keep_ids).withColumn("_row", F.monotonically_increasing_id()))
    full = own.where(F.col("length") == length).withColumns({"sequence_id": 2 * F.col("_row") + 1, "offset": F.lit(0).cast("bigint")}).drop("_row")
    rest = own.where(F.col("length") < length)
    groups = max(1, -(-rest.count() // group))
    dealt = rest.drop("ids").withColumn("_group", F.pmod(F.xxhash64("_row", F.lit(SEED)), F.lit(groups)))

    def fill(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        order = [("length", "descending"), ("doc_id", "ascending"), ("start", "ascending"), ("ids_crc32", "ascending"), ("_row", "ascending")]
        table = table.sort_by(order).drop_columns(["_group"])
        bins, offsets = first_fit(table.column("length").to_pylist(), length)
        ids = 2 * (np.array(bins, np.int64) + (key[0].as_py() << 32))
        return table.append_column("sequence_id", pa.array(ids)).append_column("offset", pa.array(offsets, pa.int64()))

    packed = dealt.groupBy("_group").applyInArrow(fill, f"{PIECES}, _row bigint, sequence_id bigint, offset bigint")
    if keep_ids:
        packed = packed.join(rest.select("_row", "ids"), "_row")
    return packed.select(full.columns).unionByName(full)


def padding(packed: DataFrame, length: int = LENGTH) -> DataFrame:
    """(sequences, ids, padding) of packed pieces: a sequence is padded to the length, unless its ids are a power of two."""
    fill = packed.groupBy("sequence_id").agg(F.sum("length").alias("n"))
    gap = F.when(F.bit_count("n") == 1, 0).otherwise(length - F.col("n"))
    return fill.agg(F.count("*").alias("sequences"), F.sum("n").alias("ids"), F.sum(gap).alias("padding"))
