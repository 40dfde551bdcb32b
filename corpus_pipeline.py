"""A corpus pipeline: quality rules, near-duplicates, benchmark decontamination, personal data, packing.

Each stage takes (spark, docs, sf_dir) and gives what it keeps of docs, with the columns of documents; the last gives
packed pieces with their ids. Between stages the rows are written as Parquet to the shared folder and read again; what a
stage was given is removed once its own rows are written, and only the last stage's stay.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from fluxgrid.llm import decontaminate, packing, pii, quality, simhash
from fluxgrid.session import remove, shared_folder


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no quality rule rejects."""
    return quality.kept(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one with the smallest id, of each component of texts that share 0.8 of their five-word shingles."""
    return simhash.deduplicated(docs)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no benchmark item."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def replace_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with placeholders for personal data and for terms that reveal it."""
    return pii.sanitised(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents, with their ids, in sequences of at most 4096."""
    return packing.pack(docs, keep_ids=True)


STAGES = [
    ("quality rules", keep_quality),
    ("near-dedup", drop_near_duplicates),
    ("benchmark decontamination", drop_benchmark),
    ("PII", replace_personal_data),
    ("packing", pack),
]

#: SQL has no tokenizer, so the last stage can't be expressed; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage, over all documents."""
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        out.write.parquet(f"{folder}/{k}")
        if k:
            remove(spark, f"{folder}/{k - 1}")
        docs = spark.read.schema(out.schema).parquet(f"{folder}/{k}")
    return docs
