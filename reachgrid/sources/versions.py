"""Versions of published tables.

A table is a set of directories of Parquet files that never change. A manifest
lists them: one for each partition value, or one for a table without
partitions. Manifests are numbered, and a new one is put in place only if no
other writer has taken its number; else the change is made again on top of the
other's. Readers take the newest manifest and see the old version or the new
one, never a part. What a change does not touch keeps its directories and files.

Below ``<root>/<name>.table``: ``manifests/<number>.json`` and
``data/[<column>=<value>/]written=<id>``.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable
from dataclasses import asdict, dataclass
from urllib.parse import unquote

from pyspark.errors.exceptions.base import PySparkException
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from reachgrid.session import laid_out

#: Name that Spark gives to the partition of null values.
NULL_PARTITION = "__HIVE_DEFAULT_PARTITION__"
#: How often a change is made again because other writers were first.
TRIES = 50


def filesystem(spark: SparkSession, path: str):
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), target


@dataclass(frozen=True)
class Manifest:
    """The directories of one version by partition name (``column=value``; "" without partitions), and the columns of its rows."""

    number: int
    column: str | None
    schema: str
    parts: dict[str, str]


Change = Callable[[Manifest | None], Manifest]


def value_of(part: str) -> str | None:
    """The value in a partition name, as text."""
    text = part.split("=", 1)[1]
    return None if text == NULL_PARTITION else unquote(text)


def _home(root: str, name: str) -> str:
    return f"{root}/{name}.table"


def numbers(spark: SparkSession, root: str, name: str) -> list[int]:
    """Numbers of the manifests of a table, the newest last."""
    fs, folder = filesystem(spark, f"{_home(root, name)}/manifests")
    names = [s.getPath().getName() for s in fs.listStatus(folder)] if fs.exists(folder) else []
    return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())


def manifest(spark: SparkSession, root: str, name: str, number: int | None = None) -> Manifest | None:
    """The manifest of a number, or the newest; None for a table without versions."""
    if number is None:
        known = numbers(spark, root, name)
        if not known:
            return None
        number = known[-1]
    fs, path = filesystem(spark, _manifest_path(root, name, number))
    stream = fs.open(path)
    try:
        text = spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()
    return Manifest(**json.loads(text))


def _manifest_path(root: str, name: str, number: int) -> str:
    return f"{_home(root, name)}/manifests/{number:012d}.json"


def place(spark: SparkSession, path: str, text: str) -> bool:
    """Put a file in place as a whole unless there is one; whether this writer did.

    On a local disk a hard link decides, elsewhere a rename without overwriting,
    which the store must do at once, as HDFS does.
    """
    jvm = spark._jvm
    folder, _, last = path.rpartition("/")
    fs, draft = filesystem(spark, f"{folder}/.{last}-{uuid.uuid4().hex}")
    stream = fs.create(draft, False)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()
    final = jvm.org.apache.hadoop.fs.Path(path)
    try:
        if fs.getUri().getScheme() == "file":
            at = [jvm.java.nio.file.Path.of(p.toUri().getPath(), spark.sparkContext._gateway.new_array(jvm.java.lang.String, 0)) for p in (final, draft)]
            jvm.java.nio.file.Files.createLink(*at)
        else:
            none = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(draft.toUri(), spark._jsc.hadoopConfiguration()).rename(draft, final, none)
        return True
    except Exception as error:  # noqa: BLE001 - py4j has one class for all errors of the JVM
        if "FileAlreadyExists" in str(error) and not isinstance(error, PySparkException):
            return False
        raise
    finally:
        fs.delete(draft, False)


def commit(spark: SparkSession, root: str, name: str, change: Change) -> Manifest:
    """Put the manifest that *change* makes of the newest one in place, again on top of others' if they were first."""
    for _ in range(TRIES):
        now = manifest(spark, root, name)
        new = change(now)
        new = Manifest(**{**asdict(new), "number": now.number + 1 if now else 1})
        if place(spark, _manifest_path(root, name, new.number), json.dumps(asdict(new))):
            return new
    raise RuntimeError(f"table {name!r} is written by too many others at once")


def write_parts(df: DataFrame, root: str, name: str, column: str | None) -> dict[str, str]:
    """Write rows into new directories of a table; {partition name: directory}. No reader sees them yet."""
    spark = df.sparkSession
    version = f"written=v{uuid.uuid4().hex}"
    home = _home(root, name)
    staging = f"{home}/staging-{version}"
    by = [column] if column else None
    writer = laid_out(df, by, _sorted_by(df)).write.mode("errorifexists")
    (writer.partitionBy(column) if column else writer).parquet(staging)
    fs, source = filesystem(spark, staging)
    made = {}
    names = [s.getPath().getName() for s in fs.listStatus(source)] if column else [""]
    for part in names:
        if column and not part.startswith(f"{column}="):
            continue
        made[part] = f"{part}/{version}" if part else version
        target = spark._jvm.org.apache.hadoop.fs.Path(f"{home}/data/{made[part]}")
        fs.mkdirs(target.getParent())
        if not fs.rename(spark._jvm.org.apache.hadoop.fs.Path(f"{staging}/{part}" if part else staging), target):
            raise OSError(f"cannot move {staging}/{part} to {target}")
    fs.delete(source, True)
    return made


def _sorted_by(df: DataFrame) -> list[str]:
    """Cells are what single reports look up."""
    return [c for c in ("cell_id", "origin_cell_id") if c in df.columns]


def publish(df: DataFrame, root: str, name: str, partition_by: list[str] | None = None) -> Manifest:
    """Write *df* as the whole of the table, by one column at most."""
    if partition_by and len(partition_by) > 1:
        raise ValueError("a table is partitioned by one column")
    column = partition_by[0] if partition_by else None
    parts = write_parts(df, root, name, column)
    return commit(df.sparkSession, root, name, lambda now: Manifest(0, column, df.schema.json(), parts))


def replace_partitions(df: DataFrame, root: str, name: str, column: str, values: list | None = None) -> Manifest:
    """Let *df* stand for the rows of some values of *column*; the directories of all others stay as they are.

    *values* are the ones replaced, with or without rows in *df*; by default those
    that occur in it. Writers of different values do not undo each other; of two
    that write one value, the later stands.
    """
    spark = df.sparkSession
    if manifest(spark, root, name) is None:
        return publish(df if values is None else df.where(F.col(column).isin(values)), root, name, [column])
    rows = df if values is None else df.where(F.col(column).isin(values) if values else F.lit(False))
    parts = write_parts(rows, root, name, column)
    gone = {value_of(p) for p in parts} if values is None else {str(v) for v in values}

    def change(now: Manifest | None) -> Manifest:
        if now is None or now.column != column:
            raise ValueError(f"table {name!r} is not partitioned by {column!r}")
        stays = {p: d for p, d in now.parts.items() if value_of(p) not in gone}
        return Manifest(0, column, now.schema, {**stays, **parts})

    return commit(spark, root, name, change)


def read_version(spark: SparkSession, root: str, name: str, version: Manifest, schema: StructType | None = None) -> DataFrame:
    """The rows of a version. A filter on the partition column prunes directories."""
    schema = schema or StructType.fromJson(json.loads(version.schema))
    if not version.parts:
        return spark.createDataFrame([], schema)
    data = f"{_home(root, name)}/data"
    found = spark.read.schema(schema).option("basePath", data).parquet(*[f"{data}/{d}" for d in sorted(version.parts.values())])
    return found.select(*schema.names)


def expire(spark: SparkSession, root: str, name: str, keep: int = 2, older_than: float = 86_400.0) -> int:
    """Delete manifests but the newest *keep*, and directories in none of those; how many directories went.

    Directories younger than *older_than* seconds stay: a writer may have made
    them for a version that it has not put in place yet.
    """
    known = numbers(spark, root, name)
    if not known:
        return 0
    used = {d for n in known[-keep:] for d in manifest(spark, root, name, n).parts.values()}
    for n in known[:-keep]:
        fs, path = filesystem(spark, _manifest_path(root, name, n))
        fs.delete(path, False)
    fs, data = filesystem(spark, f"{_home(root, name)}/data")
    gone = 0
    for status in fs.globStatus(spark._jvm.org.apache.hadoop.fs.Path(f"{data}/written=*")) or []:
        gone += _expired(fs, status, status.getPath().getName(), used, older_than)
    for status in fs.globStatus(spark._jvm.org.apache.hadoop.fs.Path(f"{data}/*=*/written=*")) or []:
        path = status.getPath()
        gone += _expired(fs, status, f"{path.getParent().getName()}/{path.getName()}", used, older_than)
    return gone


def _expired(fs, status, directory: str, used: set[str], older_than: float) -> bool:
    if directory in used or time.time() - status.getModificationTime() / 1000 < older_than:
        return False
    return bool(fs.delete(status.getPath(), True))
