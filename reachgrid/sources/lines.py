"""Text files as ordered rows of cells."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from reachgrid.functions.text import unquote

FILES = 10_000
BOM = "﻿"


def read_lines(spark: SparkSession, path: str | list[str], glob: str | None = None) -> DataFrame:
    """Lines in file order: value, _file, _block, _pos. Large files are read in splits."""
    reader = spark.read
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    lines = reader.text(path).select(
        F.regexp_replace("value", "\r$", "").alias("value"),
        F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_pos"),
    )
    return lines.withColumn("value", F.when(F.col("_block") == 0, F.ltrim("value", F.lit(BOM))).otherwise(F.col("value")))


def join_by_file(rows: DataFrame, per_file: DataFrame, keys: list[str] | str = "_file") -> DataFrame:
    """Join a few rows per file to the rows of the files.

    A file may hold most of all rows, so it must not become one join partition.
    The number of files is known from their listing; up to a limit the small
    side is broadcast.
    """
    files = len(per_file.inputFiles())
    return rows.join(F.broadcast(per_file) if files <= FILES else per_file, keys)


def skip_first(lines: DataFrame, n: int) -> DataFrame:
    """Drop the first *n* lines of every file; they lie in its first split.

    Line positions are consecutive inside a split, so the cut needs only the
    first position of each file.
    """
    first = lines.where("_block = 0").groupBy("_file").agg(F.min("_pos").alias("_first"))
    return join_by_file(lines, first).where((F.col("_block") > 0) | (F.col("_pos") >= F.col("_first") + n)).drop("_first")


def cell(parts: Column, i: int) -> Column:
    return unquote(F.get(parts, F.lit(i)))


def last_per_key(rows: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """The last row of every key in file order."""
    order = F.struct("_file", "_block", "_pos")
    picked = rows.groupBy(*keys).agg(F.max(F.struct(order.alias("o"), *values)).alias("r"))
    return picked.select(*keys, *[F.col(f"r.{v}").alias(v) for v in values])


def first_matching(lines: DataFrame, condition: Column) -> DataFrame:
    """Per file: the first line that fulfils *condition*, else the file's first line."""
    place = F.struct("_block", "_pos", "value")
    return (
        lines.groupBy("_file")
        .agg(F.min(F.when(condition, place)).alias("hit"), F.min(place).alias("top"))
        .select("_file", F.coalesce("hit", "top").alias("h"))
        .select("_file", F.col("h.value").alias("header"), F.col("h._block").alias("_hblock"), F.col("h._pos").alias("_hpos"))
    )


def by_line(*partition: str) -> Window:
    return Window.partitionBy(*partition).orderBy("_block", "_pos")
