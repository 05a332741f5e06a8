"""Small helpers that several operators share."""

from __future__ import annotations

import ctypes
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from reachgrid.llm.words import bytes_of, slices

from reachgrid.operators.sizes import if_small
from reachgrid.session import written

__all__ = ["free", "ordered_sums", "portions", "read", "text_key", "without", "written"]

#: Bytes of text that a task takes at once.
PORTION = 1 << 22


def read(spark: SparkSession, folder: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{table}.parquet")


def portions(batches: Iterable[pa.RecordBatch], text: int = 0, size: int = PORTION) -> Iterator[pa.RecordBatch]:
    """The rows of *batches* in parts of about *size* bytes of the column at *text*; a longer row stands alone.

    What a task makes of a part stays small that way. Workers serve many tasks,
    so at the end freed memory goes back to the system.
    """
    for batch in batches:
        _, bounds = bytes_of(batch.column(text))
        for i, j in slices(bounds, size):
            yield batch.slice(i, j - i)
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def text_key(text: Column) -> list[Column]:
    """Two 64-bit hashes that stand for a whole text; null counts as empty."""
    whole = F.coalesce(text, F.lit(""))
    return [F.xxhash64(whole).alias("_k1"), F.xxhash64(F.lit("second"), whole).alias("_k2")]


def free(df: DataFrame, name: str) -> str:
    """*name*, with signs behind it until no column of *df* is called so."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """Rows of *docs* whose text, and doc_id where *gone* has one, is not in *gone* (k1, k2[, doc]); all columns stay."""
    keys = [free(docs, n) for n in ("_own_k1", "_own_k2")]
    theirs = {c: free(docs, f"_gone_{c}") for c in gone.columns}
    keyed = docs.withColumns(dict(zip(keys, text_key(F.col("text")))))
    same = (F.col(keys[0]) == F.col(theirs["k1"])) & (F.col(keys[1]) == F.col(theirs["k2"]))
    if "doc" in theirs:
        same = same & F.col("doc_id").cast("long").eqNullSafe(F.col(theirs["doc"]))
    return keyed.join(if_small(gone.withColumnsRenamed(theirs)), same, "left_anti").drop(*keys)


def ordered_sums(df: DataFrame, order: list[str], amounts: dict[str, str], label: str, by: str | None = None) -> DataFrame:
    """Sum of each amount over all earlier rows, as new columns; *amounts* maps them to (non-null) columns.

    Rows are range-sorted by *order* and written once with sums inside their
    part; one row per part (and value of *by*, whose values must be few) then
    gives what the parts before it hold. No task meets more than one part.
    With *by*, sums start anew for each of its values.
    """
    from pyspark.sql import Window, types as T

    names = list(amounts)
    fields = [T.StructField(f"_in_{n}", T.LongType()) for n in names] + [T.StructField("_part", T.IntegerType())]
    schema = T.StructType(list(df.schema.fields) + fields)
    by_at = df.columns.index(by) if by else None
    at = {n: df.columns.index(c) for n, c in amounts.items()}

    def running(batches):
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        so_far: dict = {}
        for batch in batches:
            keys = batch.column(by_at).to_numpy(zero_copy_only=False) if by else np.zeros(batch.num_rows, dtype=np.int8)
            turn = np.argsort(keys, kind="stable")
            kinds, begins = np.unique(keys[turn], return_index=True)
            made = []
            for n in names:
                values = batch.column(at[n]).to_numpy(zero_copy_only=False).astype(np.int64)
                out = np.empty(len(values), dtype=np.int64)
                for kind, rows in zip(kinds.tolist(), np.split(turn, begins[1:])):
                    sums = np.cumsum(values[rows])
                    out[rows] = sums - values[rows] + so_far.get((n, kind), 0)
                    so_far[n, kind] = so_far.get((n, kind), 0) + int(sums[-1])
                made.append(pa.array(out))
            made.append(pa.array(np.full(batch.num_rows, part, dtype=np.int32)))
            yield pa.RecordBatch.from_arrays(batch.columns + made, names=schema.names)

    sorted_parts = df.repartitionByRange(*[F.col(c).asc_nulls_last() for c in order]).sortWithinPartitions(
        *[F.col(c).asc_nulls_last() for c in order]
    )
    stored = written(sorted_parts.mapInArrow(running, schema), label)
    group = ["_part", *([by] if by else [])]
    ends = stored.groupBy(*group).agg(*[F.max(F.col(f"_in_{n}") + F.col(c)).alias(f"_end_{n}") for n, c in amounts.items()])
    before = Window.partitionBy(*([by] if by else [])).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    bases = ends.select(*group, *[F.coalesce(F.sum(f"_end_{n}").over(before), F.lit(0)).alias(f"_base_{n}") for n in names])
    # One row per part: bounded by the number of tasks of a stage.
    joined = stored.join(F.broadcast(bases), group)
    return joined.select(*df.columns, *[(F.col(f"_in_{n}") + F.col(f"_base_{n}")).alias(n) for n in names])
