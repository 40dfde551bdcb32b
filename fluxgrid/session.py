"""Session helpers: a local session for tests and the bench, and the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Largest estimated size of a relation that is broadcast by hint. Larger sides are joined by a shuffle.
BROADCAST_BYTES = 32 << 20


def local_session(cpus: int | str = 8, app: str = "fluxgrid", **conf: str) -> SparkSession:
    """A local session, as the tests and the bench use it; a cluster brings its own."""
    settings = {
        "spark.sql.shuffle.partitions": "8",
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "8g",
        "spark.driver.host": "127.0.0.1",
        "spark.sql.adaptive.enabled": "true",
    } | conf
    builder = SparkSession.builder.master(f"local[{cpus}]").appName(app)
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which the driver and all executors see.

    Only a local session gets a folder of its own where none is set: there driver and executor are one process.
    """
    context = spark.sparkContext
    folder = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not folder:
        if not context.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="fluxgrid-checkpoint-")
    if not context.getCheckpointDir():
        context.setCheckpointDir(folder)
    return folder


def cut(df: DataFrame) -> DataFrame:
    """Writes df once to the shared folder and goes on from there, so that a lost executor costs no recomputation."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def written(df: DataFrame) -> DataFrame:
    """Like cut(), for wide tables of which each reader wants a few columns or rows: Parquet, so that scans prune both."""
    path = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """A function that writes a table to the shared folder and reads it again; all its tables go at the end.

    For steps whose result is small, or cut() by itself, before the end: what is lazy must not read these tables later.
    As Parquet they take less room than checkpoints, and only the columns in use are read.
    """
    folder, n = f"{shared_folder(spark)}/scratch-{uuid.uuid4().hex}", 0

    def write(df: DataFrame) -> DataFrame:
        nonlocal n
        n += 1
        df.write.option("compression", "zstd").parquet(f"{folder}/{n}")
        return spark.read.schema(df.schema).parquet(f"{folder}/{n}")

    try:
        yield write
    finally:
        remove(spark, folder)


def remove(spark: SparkSession, folder: str) -> None:
    """Deletes a folder of the shared store, with all it holds."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def estimated_bytes(df: DataFrame) -> int:
    """What the optimizer takes for df's size; runs no job."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def small(df: DataFrame, most: int = BROADCAST_BYTES) -> DataFrame:
    """df with a broadcast hint if the optimizer's estimate of its size allows it, otherwise df as it is."""
    return F.broadcast(df) if estimated_bytes(df) <= most else df


def input_bytes(df: DataFrame) -> int:
    """The size of the relations that df is made of, without what joins may make of them; runs no job."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    return sum(int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size()))
