"""Ranked lexical search over an index clustered by recursive graph bisection, with exact stopping.

Index. Each task of the scan gathers blocks of documents and reorders each block by recursive graph bisection: a part of
the order is cut in the middle, and documents change sides in pairs as long as that brings the terms of either side
closer together; then each half is cut again. What is left in the end are shards of a few similar documents. A shard is
a row: its terms, the postings of each, and for each term the largest frequency and the document with the least length
for a frequency, from which follows a bound for what the term adds to any score in the shard. The table is written to
the shared folder, so texts are read once and not shuffled.

Search. Items are looked up in blocks of bounded size, each broadcast to the tasks. A first pass over the shards' terms
counts documents by term; a second one bounds what each shard can score for each item, and names the best few shards of
each. Those are scored, and the k-th best score is where the search stops: the last pass enters, for each item, only the
shards whose bound reaches it, the most promising first, while what a task finds raises it further. No document that
belongs among the first k can be missed: a shard is left out only if its bound is below k scores already found, or equal
to them with larger ids alone. Places in the clustered order are mapped back to doc_id, which decides between equal scores.
"""

from __future__ import annotations

import math
import uuid
from array import array
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast, TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fluxgrid.session import cut, remove, shared_folder

#: Most documents of a shard, documents and bytes of a block that is reordered at once, and rounds of moves for each cut.
SHARD_DOCS, BLOCK_DOCS, BLOCK_BYTES, ROUNDS = 64, 2048, 8 << 20, 8
#: Tasks of the scan whose shards make a chunk; the seeds' reading is pruned to the chunks that hold any.
CHUNK_TASKS = 8
#: Characters of items, about, that are looked up at once.
ITEM_CHARS = 1 << 20
#: How many documents each item gets, and how many of its best shards are scored first.
TOP, SEEDS = 50, 16
#: Products of postings and items that are made at once.
PIECE = 1 << 22
#: Stands for a document without an id, and sorts before all others.
NO_ID = -(1 << 63)

SCHEMA = (
    "chunk int, shard long, n_terms long, least_id long, doc_ids array<long>, lengths array<int>, terms array<string>, top_tf array<int>, "
    "ratio array<double>, ends array<int>, docs array<int>, tfs array<int>"
)
#: The columns that bounds are made of.
OUTLINE = ("shard", "least_id", "terms", "top_tf", "ratio", "ends")
# Runs of these bytes are terms, with A-Z in lower case: 0-9, A-Z, a-z and all outside ASCII.
_FOLD = bytes(x + 32 if 65 <= x <= 90 else x if 48 <= x <= 57 or 97 <= x <= 122 or x > 127 else 32 for x in range(256))


def terms_of(text: bytes) -> Counter:
    """The terms of a text in UTF-8, with their frequencies."""
    return Counter(text.translate(_FOLD).split())


def bisected(doc: np.ndarray, term: np.ndarray, n: int, most: int = SHARD_DOCS, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """(documents in their new order, starts of the shards in it) of n documents with postings (doc, term), each pair once.

    All parts of a level are worked on at once. The cost of a term with a of the x documents of one side and b of the y
    of the other is a log(x / (a + 1)) + b log(y / (b + 1)); a document's gain is what the cost of its terms falls by if it
    changes sides. In each round both sides are sorted by gain, and those of equal rank swap while their gains sum to more
    than nothing.
    """
    order, starts = np.arange(n), np.array([0, n])
    often = np.bincount(term, minlength=1)[term] > 1  # the others don't tell documents apart
    doc, term = doc[often], term[often].astype(np.int64)
    while (np.diff(starts) > most).any():
        size = np.diff(starts)
        middle = starts[:-1] + np.where(size > most, (size + 1) // 2, size)
        node_at = np.repeat(np.arange(len(size)), size)
        place = np.empty(n, np.int64)
        place[order] = np.arange(n)
        node = node_at[place]
        here = size[node[doc]] > most
        d = doc[here]
        pair_key, pair = np.unique(node[d] * (int(term.max(initial=0)) + 1) + term[here], return_inverse=True)
        pair_node = pair_key // (int(term.max(initial=0)) + 1)
        left_n, right_n = (middle - starts[:-1])[pair_node].astype(float), (starts[1:] - middle)[pair_node].astype(float)
        cost = lambda a, b: a * np.log2(left_n / (a + 1)) + b * np.log2(right_n / (b + 1))  # noqa: E731, B023
        for _ in range(rounds):
            right = place >= middle[node]
            side = right[d]
            a = np.bincount(pair[~side], minlength=len(pair_key)).astype(float)
            b = np.bincount(pair[side], minlength=len(pair_key)).astype(float)
            now = cost(a, b)
            to_right, to_left = now - cost(np.maximum(a - 1, 0), b + 1), now - cost(a + 1, np.maximum(b - 1, 0))
            gain = np.bincount(d, weights=np.where(side, to_left[pair], to_right[pair]), minlength=n)
            order = np.lexsort((-gain, right, node))
            rank = np.arange(n) - starts[node_at]
            other = middle[node_at] + rank
            ok = (np.arange(n) < middle[node_at]) & (other < starts[1:][node_at])
            at = np.flatnonzero(ok)
            at = at[gain[order[at]] + gain[order[other[at]]] > 1e-9]
            order[at], order[other[at]] = order[other[at]], order[at]
            place[order] = np.arange(n)
            if not len(at):
                break
        starts = np.unique(np.concatenate((starts, middle)))
    return order, starts


def _lists(ends: np.ndarray, values: pa.Array) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.append(0, ends), pa.int32()), values)


class _Block:
    """Documents that are reordered together, each with a term at least, as numbers of terms and frequencies."""

    def __init__(self) -> None:
        self.ids, self.sizes, self.vocabulary = array("q"), array("q"), {}
        self.terms, self.tfs = array("i"), array("i")
        self.bytes = 0

    def add(self, i: int, text: Counter, size: int) -> None:
        number = self.vocabulary.setdefault
        self.ids.append(i)
        self.sizes.append(len(text))
        self.terms.extend(number(t, len(self.vocabulary)) for t in text)
        self.tfs.extend(text.values())
        self.bytes += size


def _shards(block: _Block, first: int, chunk: int, most: int = SHARD_DOCS) -> pa.RecordBatch:
    """The shards, of at most so many documents, of a block; numbered from first on."""
    n, ids = len(block.ids), block.ids
    term, tf = (np.frombuffer(x, np.int32).astype(np.int64) for x in (block.terms, block.tfs))
    doc = np.repeat(np.arange(n), block.sizes)
    order, starts = bisected(doc, term, n, most)
    place = np.empty(n, np.int64)
    place[order] = np.arange(n)
    shard = np.searchsorted(starts, place, "right") - 1
    lengths, ids = np.bincount(doc, weights=tf, minlength=n).astype(np.int64)[order], np.array(ids)[order]
    by = np.lexsort((place[doc], term, shard[doc]))
    own, term, tf, at = shard[doc[by]], term[by], tf[by], place[doc[by]]
    rows = np.flatnonzero(np.append(True, (np.diff(own) != 0) | (np.diff(term) != 0)))  # the first posting of each term of a shard
    per_shard = np.cumsum(np.bincount(own[rows], minlength=len(starts) - 1))
    postings = np.cumsum(np.bincount(own, minlength=len(starts) - 1))
    ends = np.append(rows[1:], len(own)) - np.append(0, postings)[own[rows]]
    sums = np.add.reduceat(lengths, starts[:-1])
    return pa.RecordBatch.from_arrays([
        pa.array(np.full(len(sums), chunk), pa.int32()), pa.array(first + np.arange(len(sums))), pa.array(sums), pa.array(np.minimum.reduceat(ids, starts[:-1])),
        _lists(starts[1:], pa.array(ids)), _lists(starts[1:], pa.array(lengths, pa.int32())),
        _lists(per_shard, pa.array(list(block.vocabulary), pa.binary()).cast(pa.string()).take(pa.array(term[rows]))),
        _lists(per_shard, pa.array(np.maximum.reduceat(tf, rows), pa.int32())), _lists(per_shard, pa.array(np.minimum.reduceat(lengths[at] / tf, rows))),
        _lists(per_shard, pa.array(ends, pa.int32())), _lists(postings, pa.array(at - starts[own], pa.int32())), _lists(postings, pa.array(tf, pa.int32())),
    ], [c.split()[0] for c in SCHEMA.split(", ")])


def _built(shard_docs: int, block_docs: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The shards of a task's documents, block by block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        block, first = _Block(), task << 32
        for batch in batches:
            for i, text in zip(batch.column(0), batch.column(1).cast(pa.binary()), strict=True):
                data = text.as_py() or b""
                if not (own := terms_of(data)):
                    continue
                if block.ids and (len(block.ids) == block_docs or block.bytes + len(data) > BLOCK_BYTES):
                    yield (out := _shards(block, first, task // CHUNK_TASKS, shard_docs))
                    block, first = _Block(), first + out.num_rows
                block.add(NO_ID if i.as_py() is None else i.as_py(), own, len(data))
        if block.ids:
            yield _shards(block, first, task // CHUNK_TASKS, shard_docs)

    return run


def indexed(docs: DataFrame, path: str, shard_docs: int = SHARD_DOCS, block_docs: int = BLOCK_DOCS) -> DataFrame:
    """The index of docs(doc_id, text), a row for each shard, written to path as Parquet. Documents without a term aren't in it."""
    own = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).mapInArrow(_built(shard_docs, block_docs), SCHEMA)
    own.write.option("compression", "zstd").option("parquet.block.size", 8 << 20).parquet(path)
    return docs.sparkSession.read.schema(SCHEMA).parquet(path)


@dataclass
class Items:
    """Items as arrays: their ids, all terms, and for each term the items that have it."""

    ids: list[int | None]
    terms: pa.Array
    first: np.ndarray
    items: np.ndarray
    #: Of each term, and of the index.
    weights: np.ndarray | None = None
    n: int = 0
    total: int = 0
    #: Of each item: a score and id that the k-th best document has or betters.
    score: np.ndarray | None = None
    last_id: np.ndarray | None = None


def items_of(ids: list[int | None], texts: list[str | None]) -> Items:
    """Rows of one id are one item with the terms of all of them; items without a term are left out."""
    own: dict[int | None, set[bytes]] = {}
    for i, text in zip(ids, texts, strict=True):
        if found := terms_of((text or "").encode()):
            own.setdefault(i, set()).update(found)
    pairs = sorted((t, q) for q, terms in enumerate(own.values()) for t in terms)
    names = sorted({t for t, _ in pairs})
    at = {t: k for k, t in enumerate(names)}
    first = np.append(0, np.cumsum(np.bincount([at[t] for t, _ in pairs], minlength=len(names)))) if pairs else np.zeros(1, int)
    return Items(list(own), pa.array(names, pa.binary()).cast(pa.string()), first, np.array([q for _, q in pairs], np.int64))


def weight(n: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n + 2) / (2 * df + 1)))


def _hits(batch: pa.RecordBatch, items: Items) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each row of the index: (row, places among its terms that items have, numbers of those terms)."""
    column = batch.column("terms")
    number = pc.index_in(column.flatten(), value_set=items.terms).fill_null(-1).to_numpy(zero_copy_only=False)
    ends = np.cumsum(pc.list_value_length(column).to_numpy(zero_copy_only=False))
    for r, (a, b) in enumerate(zip(np.append(0, ends[:-1]), ends, strict=True)):
        own = number[a:b]
        at = np.flatnonzero(own >= 0)
        yield r, at, own[at]


def _row(batch: pa.RecordBatch, name: str, r: int) -> np.ndarray:
    return batch.column(name)[r].values.to_numpy(zero_copy_only=False)


def _expanded(items: Items, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place in number, item) for each item of each of the terms."""
    count = items.first[number + 1] - items.first[number]
    at = np.repeat(np.arange(len(number)), count)
    return at, items.items[np.arange(len(at)) + np.repeat(items.first[number] - np.cumsum(count) + count, count)]


def _bounds(batch: pa.RecordBatch, items: Items) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """For each row: (row, what its documents can score for each item at most, and the hits as above)."""
    share = 50.0 * items.n / max(items.total, 1)
    for r, at, number in _hits(batch, items):
        # The norm of n terms is more than 49 + share * n, so no document's part is above this; 1 more than floored.
        part = np.floor(1e9 / (1000.0 + 20.0 * (49.0 / _row(batch, "top_tf", r)[at] + share * _row(batch, "ratio", r)[at]))) + 1
        place, item = _expanded(items, number)
        yield r, np.bincount(item, weights=(items.weights[number] * part)[place], minlength=len(items.ids)), at, number


def _counted(shared: Broadcast) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(term, df) of a task's shards."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = shared.value
        df = np.zeros(len(items.terms), np.int64)
        for batch in batches:
            for r, at, number in _hits(batch, items):
                df[number] += np.diff(_row(batch, "ends", r), prepend=0)[at]
        found = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(df[found])], ["term", "df"])

    return run


def _promising(shared: Broadcast, most: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(item, bound, chunk, shard) of the best few shards of a task for each item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = shared.value
        bound = np.zeros((most + 1, len(items.ids)))
        shard, chunk = np.zeros(bound.shape, np.int64), np.zeros(bound.shape, np.int32)
        for batch in batches:
            for r, own, _, _ in _bounds(batch, items):
                bound[most], shard[most], chunk[most] = own, batch.column("shard")[r].as_py(), batch.column("chunk")[r].as_py()
                order = np.argsort(-bound, axis=0, kind="stable")
                bound, shard, chunk = (np.take_along_axis(x, order, 0) for x in (bound, shard, chunk))
        rank, item = np.nonzero(bound[:most] > 0)
        columns = [pa.array(item), *(pa.array(x[rank, item]) for x in (bound, chunk, shard))]
        yield pa.RecordBatch.from_arrays(columns, ["item", "bound", "chunk", "shard"])

    return run


class _Best:
    """A task's best documents of each item, and the score and id that a further one has to reach."""

    def __init__(self, items: Items, k: int) -> None:
        self.k, self.score, self.last_id = k, items.score.copy(), items.last_id.copy()
        self.found: list[list[tuple[int, int]]] = [[] for _ in items.ids]

    def may(self, bound: np.ndarray, least_id: int) -> np.ndarray:
        """The items for which a shard can hold a document that counts."""
        return np.flatnonzero((bound > self.score) | ((bound == self.score) & (least_id <= self.last_id)) & (bound > 0))

    def add(self, item: int, scores: np.ndarray, ids: np.ndarray) -> None:
        ok = (scores > 0) & ((scores > self.score[item]) | ((scores == self.score[item]) & (ids <= self.last_id[item])))
        if ok.any():
            self.found[item] += zip((-scores[ok]).tolist(), ids[ok].tolist(), strict=True)
            if len(self.found[item]) >= 2 * self.k:
                self.shorten(item)

    def shorten(self, item: int) -> None:
        self.found[item] = sorted(self.found[item])[: self.k]
        if len(self.found[item]) == self.k:
            minus, self.last_id[item] = self.found[item][-1]
            self.score[item] = -minus

    def rows(self) -> pa.RecordBatch:
        for item in range(len(self.found)):
            self.shorten(item)
        flat = [(item, i, -minus) for item, own in enumerate(self.found) for minus, i in own]
        columns = zip(*flat, strict=True) if flat else ((), (), ())
        return pa.RecordBatch.from_arrays([pa.array(list(x), pa.int64()) for x in columns], ["item", "doc_id", "score"])


def _scored(batch: pa.RecordBatch, r: int, at: np.ndarray, number: np.ndarray, items: Items, wanted: np.ndarray, exact: bool) -> np.ndarray:
    """Scores of a shard's documents, a row for each wanted item."""
    lengths, tfs, docs = (_row(batch, c, r).astype(np.int64) for c in ("lengths", "tfs", "docs"))
    ends = _row(batch, "ends", r).astype(np.int64)
    norm = 50 + (50 * lengths * items.n) // items.total
    begin, count = np.append(0, ends)[at], np.diff(ends, prepend=0)[at]
    slot = np.full(len(items.ids), -1)
    slot[wanted] = np.arange(len(wanted))
    out = np.zeros(len(wanted) * len(norm), np.int64 if exact else float)
    place, item = _expanded(items, number)
    keep = slot[item] >= 0
    place, item = place[keep], slot[item[keep]]
    cuts = np.searchsorted(np.cumsum(count[place]), np.arange(PIECE, int(count[place].sum()), PIECE))
    for p, q in zip(np.split(place, cuts), np.split(item, cuts), strict=True):
        c = count[p]
        k = np.arange(int(c.sum())) + np.repeat(begin[p] - np.cumsum(c) + c, c)
        tf, own = tfs[k], docs[k]
        value = np.repeat(items.weights[number[p]], c) * ((1_000_000_000 * tf) // (1000 * tf + 20 * norm[own]))
        to = np.repeat(q, c) * len(norm) + own
        if exact:
            np.add.at(out, to, value)
        else:
            out += np.bincount(to, weights=value, minlength=len(out))
    return out.astype(np.int64).reshape(len(wanted), len(norm))


def _visited(shared: Broadcast, k: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(item, doc_id, score) of a task's best k documents for each item, from the shards that may hold any."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = shared.value
        best = _Best(items, k)
        for batch in batches:
            rows = sorted(_bounds(batch, items), key=lambda x: -x[1].max(initial=0))
            for r, bound, at, number in rows:
                wanted = best.may(bound, batch.column("least_id")[r].as_py())
                if len(wanted):
                    # Sums of integers in doubles are exact up to 2^53.
                    scores = _scored(batch, r, at, number, items, wanted, bool(bound.max() >= 2**53))
                    ids = _row(batch, "doc_ids", r)
                    for own, item in zip(scores, wanted.tolist(), strict=True):
                        best.add(item, own, ids)
        yield best.rows()

    return run


def _any(conditions: list[Column]) -> Column:
    """Whether one of the conditions holds, as a balanced tree; unlike a long IN, each of them reaches the scan."""
    while len(conditions) > 1:
        conditions = [reduce(Column.__or__, conditions[i : i + 2]) for i in range(0, len(conditions), 2)]
    return conditions[0]


_FOUND = "item long, doc_id long, score long"


def _block(index: DataFrame, items: Items, n: int, total: int, k: int) -> DataFrame:
    """(item_id, rank, doc_id, score) of a block of items."""
    spark = index.sparkSession
    put = spark.sparkContext.broadcast
    df = dict(index.select("terms", "ends").mapInArrow(_counted(put(items)), "term long, df long").groupBy("term").agg(F.sum("df")).collect())
    items.n, items.total = n, total
    items.weights = np.array([weight(n, df.get(t, 0)) for t in range(len(items.terms))], np.int64)
    items.score, items.last_id = np.zeros(len(items.ids), np.int64), np.full(len(items.ids), (1 << 63) - 1)

    best_first = Window.partitionBy("item").orderBy(F.desc("bound"), "shard")
    near = index.select("chunk", *OUTLINE).mapInArrow(_promising(put(items), SEEDS), "item long, bound double, chunk int, shard long")
    seeds = near.withColumn("r", F.row_number().over(best_first)).where(F.col("r") <= SEEDS).select("chunk", "shard").distinct().collect()
    order = Window.partitionBy("item").orderBy(F.desc("score"), "doc_id")
    top = lambda found: found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    if seeds:
        first = index.where(_any([F.col("chunk") == c for c in sorted({s.chunk for s in seeds})]) & F.col("shard").isin([s.shard for s in seeds]))
        for row in top(first.mapInArrow(_visited(put(items), k), _FOUND)).where(F.col("rank") == k).collect():
            items.score[row["item"]], items.last_id[row["item"]] = row.score, row.doc_id

    names = spark.createDataFrame(list(enumerate(items.ids)), "item long, item_id long")
    found = top(index.mapInArrow(_visited(put(items), k), _FOUND)).join(F.broadcast(names), "item")  # a block's ids
    return found.select("item_id", "rank", F.when(F.col("doc_id") != NO_ID, F.col("doc_id")).alias("doc_id"), "score")


def search(index: DataFrame, items: DataFrame, k: int = TOP, item_chars: int = ITEM_CHARS) -> DataFrame:
    """(item_id, rank, doc_id, score) of the k best documents with a score above 0 for each item of items(item_id, text).

    Equal scores come by ascending doc_id, documents without an id first; a document's repeated rows are ranked each for
    itself. Rows of one item_id are one item, a null item_id like any other. Items without a term, and an empty index,
    give no row; other columns of the items aren't read. The work of a block of items is bounded by item_chars, except
    that a single item is never split.
    """
    listed = items.select(F.col("item_id").cast("bigint").alias("item_id"), F.col("text").cast("string").alias("text"))
    sizes = index.agg(F.sum(F.size("doc_ids")).alias("n"), F.sum("n_terms").alias("total")).first()
    chars = listed.agg(F.sum(F.length("text"))).first()[0] or 0
    passes, parts = max(1, math.ceil(chars / item_chars)), []
    for p in range(passes):
        own = listed.where(F.pmod(F.xxhash64("item_id"), F.lit(passes)) == p).collect()
        block = items_of([r.item_id for r in own], [r.text for r in own])
        if sizes.n and block.ids:
            parts.append(cut(_block(index, block, sizes.n, sizes.total, k)))
    parts = parts or [items.sparkSession.createDataFrame([], "item_id long, rank int, doc_id long, score long")]
    return reduce(DataFrame.unionByName, parts)


def ranked(docs: DataFrame, items: DataFrame, k: int = TOP) -> DataFrame:
    """search() over an index of docs(doc_id, text) that is made for it and removed afterwards.

    Null and empty documents, and those of separators alone, are counted nowhere and found by nothing.
    """
    path = f"{shared_folder(docs.sparkSession)}/index-{uuid.uuid4().hex}"
    try:
        return search(indexed(docs, path), items, k)
    finally:
        remove(docs.sparkSession, path)


ORACLE = r"""
with terms as (select doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') w, row_number() over () r from documents where text is not null),
asked as (select distinct item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) term from benchmark where text is not null),
sizes as (select count(*) n, cast(sum(len(w)) as bigint) total from terms where len(w) > 0),
lengths as (select r, doc_id, 50 + (50 * cast(len(w) as bigint) * n) // total m from terms, sizes where len(w) > 0),
flat as (select r, unnest(w) term from terms),
tfs as (select r, term, count(*) tf from flat where term in (select term from asked) group by r, term),
weights as (select term, cast(floor(1000 * ln((2 * any_value(n) + 2) / (2 * count(*) + 1))) as bigint) w from tfs, sizes group by term),
parts as (select r, doc_id, term, w * ((1000000000 * tf) // (1000 * tf + 20 * m)) part from tfs join weights using (term) join lengths using (r)),
scores as (select item_id, r, any_value(doc_id) doc_id, cast(sum(part) as bigint) score from asked join parts using (term) group by item_id, r),
placed as (select *, cast(row_number() over (partition by item_id order by score desc, doc_id) as integer) rank from scores where score > 0)
select item_id, rank, doc_id, score from placed where rank <= 50
"""
