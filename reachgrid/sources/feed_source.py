"""A Spark data source for timetable feeds: one partition for each member of each zip file.

A member is inflated and split into columns as a stream, in Arrow batches, so a
task holds a block of it and never the feed. Members that a query does not ask
for are not opened. Files are reached through ``pyarrow.fs``: local and mounted
paths, HDFS and object stores.
"""

from __future__ import annotations

import csv
import io
import json
import zipfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.csv as arrow_csv
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition

SUFFIX = ".gtfs.zip"
#: Member name of the line that says whether a member could be read.
STATUS = "status"
SCHEMA = "operator string, member string, row_no bigint, cells array<string>"
#: Bytes of a member that are split into columns at once.
BLOCK = 1 << 20
NAMES = ["operator", "member", "row_no", "cells"]


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    if path.startswith("file:"):
        path = "/" + path[5:].lstrip("/")
    return (fs.LocalFileSystem(), path) if path.startswith("/") else fs.FileSystem.from_uri(path)


class MemberPartition(InputPartition):
    def __init__(self, path: str, operator: str, member: str):
        self.path, self.operator, self.member = path, operator, member


class FeedReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"]
        self.wanted: dict[str, list[str]] = json.loads(options["members"])
        self.block = int(options.get("block", BLOCK))

    def pushFilters(self, filters: list[Filter]):
        """Members that a filter leaves out are not opened; Spark still applies the filter to the rows."""
        for f in filters:
            if isinstance(f, (EqualTo, In)) and f.attribute == ("member",):
                asked = {f.value} if isinstance(f, EqualTo) else set(f.value)
                # Any member may have a fault.
                if STATUS not in asked:
                    self.wanted = {m: c for m, c in self.wanted.items() if m in asked}
            yield f

    def partitions(self) -> list[MemberPartition]:
        system, folder = opened(self.path)
        found = system.get_file_info(fs.FileSelector(folder, allow_not_found=True))
        names = sorted(i.base_name for i in found if i.type == fs.FileType.File and i.base_name.endswith(SUFFIX))
        return [MemberPartition(f"{self.path}/{n}", n[: -len(SUFFIX)], m) for n in names for m in self.wanted]

    def read(self, partition: MemberPartition) -> Iterator[pa.RecordBatch]:
        """Rows of one member in order, then a status row: its only cell is null, or says what is wrong."""
        fault = None
        try:
            system, path = opened(partition.path)
            with system.open_input_file(path) as file, zipfile.ZipFile(file) as archive:
                if partition.member in archive.namelist():
                    with archive.open(partition.member) as member:
                        for first, cells in self._rows(member, self.wanted[partition.member]):
                            n = len(cells)
                            yield pa.RecordBatch.from_arrays([_same(partition.operator, n), _same(partition.member, n), first, cells], names=NAMES)
        except Exception as error:  # noqa: BLE001 - whatever is wrong with a feed, the others go on
            fault = f"{type(error).__name__}: {error}"
        told = pa.array([[partition.member, fault]], pa.list_(pa.string()))
        yield pa.RecordBatch.from_arrays([_same(partition.operator, 1), _same(STATUS, 1), pa.array([0], pa.int64()), told], names=NAMES)

    def _rows(self, member, columns: list[str]) -> Iterator[tuple[pa.Array, pa.ListArray]]:
        """(row numbers, cells) in batches. Rows with too few or too many fields are filled up or cut, and come behind the batch."""
        buffered = io.BufferedReader(member, self.block)
        head = buffered.readline().decode("utf-8-sig")
        header = next(csv.reader([head]), [])
        if not header or not buffered.peek(1):
            # Reading to the end checks the sum.
            buffered.read()
            return
        # Where all rows have one field more or less than the header, the first shows it.
        first = buffered.peek(self.block).split(b"\n", 1)[0].decode("utf-8", "replace")
        width = len(next(csv.reader([first]), [])) if first.strip() and first.count('"') % 2 == 0 else len(header)
        places_of = {c: i for i, c in reversed(list(enumerate(header))) if i < width}
        at = [places_of.get(c) for c in columns]
        # Uneven rows that are not sent yet, and the numbers of those that the next batches may have left out.
        odd: list[tuple[int, str]] = []
        skipped: list[int] = []

        def uneven(row) -> str:
            odd.append((row.number, row.text))
            skipped.append(row.number)
            return "skip"

        def filled() -> Iterator[tuple[pa.Array, pa.ListArray]]:
            lines = [next(csv.reader([text]), []) for _, text in odd]
            own = [pa.array([x[i] if i is not None and i < len(x) else None for x in lines], pa.string()) for i in at]
            if odd:
                yield pa.array([k for k, _ in odd], pa.int64()), _cells(own)
            odd.clear()

        needed = sorted({i for i in at if i is not None}) or [0]
        reader = arrow_csv.open_csv(
            buffered,
            arrow_csv.ReadOptions(use_threads=False, block_size=self.block, column_names=[f"c{i}" for i in range(width)]),
            arrow_csv.ParseOptions(newlines_in_values=True, invalid_row_handler=uneven),
            arrow_csv.ConvertOptions(strings_can_be_null=False, include_columns=[f"c{i}" for i in needed], column_types={f"c{i}": pa.string() for i in needed}),
        )
        number = 1
        for batch in reader:
            n = batch.num_rows
            places = np.arange(number, number + n + len(skipped), dtype=np.int64)
            places = places[~np.isin(places, skipped)][:n]
            own = [batch.column(needed.index(i)) if i is not None else pa.nulls(n, pa.string()) for i in at]
            if n:
                number = int(places[-1]) + 1
                yield pa.array(places), _cells(own)
            skipped[:] = [k for k in skipped if k >= number]
            yield from filled()
        yield from filled()


def _same(value: str, n: int) -> pa.Array:
    return pa.repeat(pa.scalar(value, pa.string()), n)


def _cells(columns: list[pa.Array]) -> pa.ListArray:
    """One list of cells for each row, from columns."""
    n, k = len(columns[0]), len(columns)
    turn = (np.arange(n)[:, None] + n * np.arange(k)[None, :]).ravel()
    flat = pa.concat_arrays(columns).take(pa.array(turn))
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * k), flat)


class FeedSource(DataSource):
    """``spark.read.format("timetable_feeds").option("members", ...).load(folder)``; *members* is a JSON object of members and their columns."""

    @classmethod
    def name(cls) -> str:
        return "timetable_feeds"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> FeedReader:
        return FeedReader(self.options)


def read_feeds(spark: SparkSession, path: str, members: dict[str, list[str]], block: int = BLOCK):
    """(operator, member, row_no, cells) of the wanted members of all feeds in a folder, with a status row for each."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(FeedSource)
    return spark.read.format(FeedSource.name()).option("members", json.dumps(members)).option("block", block).load(path)
