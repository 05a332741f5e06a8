"""Session settings and the shared folder for written intermediates."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager, nullcontext
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # Size partitions by bytes, not by core count, so a large job does not
    # end up with many tiny tasks after a strong reduction.
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "128m",
}


def build_session(app: str = "reachgrid", master: str | None = None, **extra: str) -> SparkSession:
    """A session with the settings the library is tuned for.

    Shuffle width is left to the cluster (AQE coalesces it); pass
    ``**{"spark.sql.shuffle.partitions": "8"}`` for a small local run.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **extra}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, as named by the cluster.

    A private temporary folder is used only in local mode without a setting.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    made = os.path.join(tempfile.gettempdir(), f"reachgrid-{os.getpid()}")
    os.makedirs(made, exist_ok=True)
    return made


#: Folder of the current run, where there is one.
_RUN: ContextVar[str | None] = ContextVar("run", default=None)


def _run_dir(spark: SparkSession) -> str:
    return _RUN.get() or f"{shared_dir(spark)}/reachgrid/{spark.sparkContext.applicationId}"


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """A run whose intermediates are deleted at its end.

    Frames built inside must be used up (written, published, counted) before.
    """
    path = f"{_run_dir(spark)}/run-{uuid.uuid4().hex}"
    token = _RUN.set(path)
    try:
        yield
    finally:
        _RUN.reset(token)
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def laid_out(df: DataFrame, partition_by: list[str] | None, sort_by: list[str] | None = None) -> DataFrame:
    """Rows arranged for a partitioned write: files of a good size, each with few partition values.

    Without this every task would write a small file per partition value; AQE
    splits a value that dominates. Sorting lets readers skip row groups.
    """
    if not partition_by:
        return df
    return df.hint("rebalance", *partition_by).sortWithinPartitions(*partition_by, *(sort_by or []))


#: Files that a task holds open at once; there are 48 half-hour slots. Rows of further values are sorted.
OPEN_FILES = 64


@contextmanager
def files_open(spark: SparkSession) -> Iterator[None]:
    """Partitioned writes in which a task keeps a file open for each value, instead of a sort of its rows."""
    key = "spark.sql.maxConcurrentOutputFileWriters"
    before = spark.conf.get(key, None)
    spark.conf.set(key, str(OPEN_FILES))
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def written(df: DataFrame, label: str, partition_by: list[str] | None = None, move: bool = True) -> DataFrame:
    """Write *df* to the shared folder once and continue from the files.

    Without *move* each task writes its rows where they are: for few partition
    values and long tasks, as behind a scan, whose files are of a good size.

    This cuts lineage in a way that survives lost executors, and the result is
    a plain Parquet scan: filters, columns and partitions are pruned as usual
    and Catalyst knows its true size when it chooses a join.
    """
    spark = df.sparkSession
    path = f"{_run_dir(spark)}/{label}-{uuid.uuid4().hex}"
    writer = (laid_out(df, partition_by) if move else df).write.mode("errorifexists")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    with nullcontext() if move else files_open(spark):
        writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
