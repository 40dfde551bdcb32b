"""Flat token files without an index, and the separator scan that counts their documents' tokens.

A token file is a run of ids in blocks, each document's followed by the separator, and nothing else: blocks break
anywhere and say nothing of documents. Separators are searched for by one vectorised comparison for each block. What lies
before a block (its number of ids and of documents, and the end of the last one) comes from a prefix scan of two levels,
which also stitches the documents that blocks cut. Which document is which stands in a table of labels beside the files,
by the file and the document's number there; the scan doesn't read it.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fluxgrid.llm.encoder import encoder, vocabulary_path
from fluxgrid.session import cut, shared_folder

#: The end-of-document id in token files: <|endoftext|> of that vocabulary. No text has it, as files are written with special tokens' strings as ordinary text.
END = 49407
#: Ids in a block of a token file.
BLOCK_IDS = 1 << 16


def encoded(batch: pa.RecordBatch, column: str, path: str, rows: int = 500, literal: bool = False) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """(some rows, their ids, number of ids of each), so many rows at a time; literal: as in Encoder.encode."""
    for at in range(0, batch.num_rows, rows):
        part = batch.slice(at, rows)
        yield part, *encoder(path).encode(part.column(column), literal)


FILES = "file_id bigint, block bigint, ids binary"
LABELS = "file_id bigint, first bigint, doc_ids array<bigint>"
_WRITTEN = "kind string, file_id bigint, block bigint, ids binary, first bigint, doc_ids array<bigint>"
_ARROW = pa.schema([("kind", pa.string()), ("file_id", pa.int64()), ("block", pa.int64()), ("ids", pa.binary()), ("first", pa.int64()), ("doc_ids", pa.list_(pa.int64()))])


def _written(path: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A partition's rows (doc_id, text) as one token file: rows of kind 'ids', its blocks, and of kind 'labels'."""

    def row(**values: object) -> pa.RecordBatch:
        return pa.RecordBatch.from_pylist([values], _ARROW)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file, block, first = TaskContext.get().partitionId(), 0, 0
        held = np.zeros(0, np.uint16)
        for batch in batches:
            for part, ids, sizes in encoded(batch, "text", path, literal=True):
                yield row(kind="labels", file_id=file, first=first, doc_ids=part.column("doc_id").to_pylist())
                first += part.num_rows
                flat = np.concatenate((held, np.insert(ids, np.cumsum(sizes), END))).astype("<u2")
                whole = len(flat) // BLOCK_IDS * BLOCK_IDS
                for at in range(0, whole, BLOCK_IDS):
                    yield row(kind="ids", file_id=file, block=block, ids=flat[at : at + BLOCK_IDS].tobytes())
                    block += 1
                held = flat[whole:]
        if len(held):
            yield row(kind="ids", file_id=file, block=block, ids=held.tobytes())

    return write


def write_token_files(docs: DataFrame, folder: str, path: str) -> tuple[DataFrame, DataFrame]:
    """Writes docs(doc_id, text) as flat token files, one of each partition, and gives (files, labels) as written.

    files(file_id, block, ids): little-endian unsigned 16-bit ids in blocks of BLOCK_IDS. labels(file_id, first,
    doc_ids): the ids of the documents from number first of a file on. Null texts count as empty.
    """
    source = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string"))
    source.mapInArrow(_written(path), _WRITTEN).write.option("compression", "zstd").partitionBy("kind").parquet(folder)
    read = docs.sparkSession.read
    try:
        return read.schema(FILES).parquet(f"{folder}/kind=ids"), read.schema(LABELS).parquet(f"{folder}/kind=labels")
    except AnalysisException:  # no document, no file
        none = docs.sparkSession.createDataFrame
        return none([], FILES), none([], LABELS)


def _positions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sizes, ends = [], []
        for ids in batch.column("ids"):
            flat = np.frombuffer(ids.as_buffer(), "<u2") if ids.is_valid else np.zeros(0, np.uint16)
            sizes.append(len(flat))
            ends.append(np.flatnonzero(flat == END).astype(np.int32))
        yield pa.RecordBatch.from_arrays(
            [batch.column("file_id"), batch.column("block"), pa.array(sizes, pa.int64()), pa.array(ends, pa.list_(pa.int32()))],
            ["file_id", "block", "n", "ends"],
        )


#: Blocks whose sums make one row of the upper level of the prefix scan.
FAN = 1024


def separator_scan(files: DataFrame) -> DataFrame:
    """(file_id, number, start, n_tokens) of each document of flat token files(file_id, block, ids).

    number: the document's place in its file, from 0. start: its first id there. n_tokens: its ids without the
    separator. The prefix scan has two levels: over the blocks of a group of FAN, and over the groups. Ids after a
    file's last separator make no document. A null block counts as empty; no file gives no row.
    """
    found = cut(files.select("file_id", "block", "ids").mapInArrow(_positions, "file_id bigint, block bigint, n bigint, ends array<int>"))
    sums = found.select(
        "file_id", "block", F.floor(F.col("block") / FAN).alias("part"), "n", F.size("ends").cast("bigint").alias("docs"), F.try_element_at("ends", F.lit(-1)).alias("last")
    )
    inner = Window.partitionBy("file_id", "part").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    outer = Window.partitionBy("file_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = lambda name, over: F.coalesce(F.sum(name).over(over), F.lit(0))
    local = sums.withColumns({"before": before("n", inner), "docs_before": before("docs", inner)})
    local = local.withColumn("open", F.max(F.col("before") + F.col("last") + 1).over(inner))
    groups = local.groupBy("file_id", "part").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"), F.max(F.col("before") + F.col("last") + 1).alias("open"))
    groups = groups.withColumns({"base": before("n", outer), "docs_base": before("docs", outer)})
    groups = groups.select("file_id", "part", "base", "docs_base", F.max(F.col("base") + F.col("open")).over(outer).alias("carried"))
    known = local.join(groups, ["file_id", "part"]).select(
        "file_id", "block", (F.col("base") + F.col("before")).alias("at"), (F.col("docs_base") + F.col("docs_before")).alias("number"),
        F.coalesce(F.col("base") + F.col("open"), "carried", F.lit(0)).alias("begin"),
    )
    each = found.where(F.size("ends") > 0).join(known, ["file_id", "block"])
    first = F.when(F.col("i") == 0, F.col("begin")).otherwise(F.col("at") + F.element_at("ends", F.col("i")) + 1)
    return each.select("file_id", "at", "number", "begin", "ends", F.posexplode("ends").alias("i", "end")).select(
        "file_id", (F.col("number") + F.col("i")).alias("number"), first.cast("bigint").alias("start"), (F.col("at") + F.col("end") - first).cast("bigint").alias("n_tokens"),
    )


def token_counts(docs: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, n_tokens, file_id, start) of each row of docs(doc_id, text), by way of flat token files in the shared folder.

    A null or empty text has no tokens. Repeated rows and null ids come out as they are. The files stay in the folder
    of the checkpoints, as the result is read from them.
    """
    folder = f"{shared_folder(docs.sparkSession)}/token-files-{uuid.uuid4().hex}"
    files, labels = write_token_files(docs, folder, path or vocabulary_path())
    named = labels.select("file_id", "first", F.posexplode("doc_ids").alias("i", "doc_id")).select("file_id", (F.col("first") + F.col("i")).alias("number"), "doc_id")
    return separator_scan(files).join(named, ["file_id", "number"]).select("doc_id", "n_tokens", "file_id", "start")
