"""A global order of tokens from rare to frequent, of fixed size.

Occurrences are counted over all texts in ``2 ** bits`` hashed counters: a
counter is never less than the count of any token that falls on it. A token's
key is (code of its counter, hash), so numeric order is order by rarity, the
same in every task. Counters that frequent tokens share only change the order,
which changes how fast a prefix join is, never its result.

The counters are the only thing that reaches the driver and that is broadcast:
``2 ** bits`` bytes, whatever the size of the corpus.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from reachgrid.llm.words import U

SEGMENT = 1 << 16
#: Bits of a key below the code.
KEY_BITS = 56
#: What one task reports of a counter at most; sums over tasks go on rising.
TASK_MOST = 255
#: Where sums stop.
MOST = (1 << 32) - 1
#: Tasks whose counters are added in one step.
JOINED = 32


def code_of(counts: np.ndarray) -> np.ndarray:
    """0 for none, 1 for a token that occurs once, then by fourths of a doubling, to 126."""
    with np.errstate(divide="ignore"):
        steep = np.floor(4 * np.log2(np.maximum(counts, 1))) + 1
    return np.where(counts == 0, 0, np.minimum(steep, 126)).astype(np.uint8)


def keys_of(hashes: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """63-bit keys whose numeric order is the order by rarity."""
    shift = U(64 - (len(codes).bit_length() - 1))
    return (codes[(hashes >> shift).astype(np.int64)].astype(U) << U(KEY_BITS)) | (hashes >> U(64 - KEY_BITS))


def frequencies(texts: DataFrame, tokens: Callable[[pa.Array], Iterator[np.ndarray]], bits: int, once: bool = False) -> np.ndarray:
    """Codes of all counters over the only column of *texts*.

    *tokens* yields hash arrays of a batch. Each task adds up its counters and
    sends them in segments, a byte each; segments of 32 tasks are added, then
    those of 32 such sums, then the rest. With *once* a task only marks the
    counters that it meets, in a fourth of the memory.
    """
    size = 1 << bits

    def count(batches):
        from pyspark import TaskContext

        total = np.zeros(size, dtype=np.uint8 if once else np.uint32)
        for batch in batches:
            for hashes in tokens(batch.column(0)):
                at = (hashes >> U(64 - bits)).astype(np.int64)
                if once:
                    total[at] = 1
                elif len(at) > size // 8:
                    total += np.bincount(at, minlength=size).astype(np.uint32)
                else:
                    # A number of the same type, or it goes the slow way.
                    np.add.at(total, at, total.dtype.type(1))
        part = TaskContext.get().partitionId()
        if total.any():
            for i, values in enumerate(total.reshape(-1, min(SEGMENT, size))):
                if values.any():
                    yield row(i, part, np.minimum(values, TASK_MOST).astype(np.uint8))

    def row(segment: int, part: int, values: np.ndarray) -> pa.RecordBatch:
        columns = [pa.array([segment], pa.int32()), pa.array([part], pa.int32()), pa.array([values.tobytes()], pa.binary()), pa.array([values.itemsize], pa.int32())]
        return pa.RecordBatch.from_arrays(columns, names=["segment", "part", "counts", "width"])

    def total_of(table) -> np.ndarray:
        total = np.zeros(min(SEGMENT, size), dtype=np.uint64)
        for blob, width in zip(table.column("counts"), table.column("width").to_pylist()):
            total += np.frombuffer(blob.as_py(), dtype=np.uint8 if width == 1 else np.uint32)
        return np.minimum(total, MOST)

    def added(key, table):
        return pa.Table.from_batches([row(key[0].as_py(), key[1].as_py(), total_of(table).astype(np.uint32))])

    def coded(key, table):
        return pa.Table.from_batches([row(key[0].as_py(), 0, code_of(total_of(table)))])

    schema = "segment int, part int, counts binary, width int"
    sums = texts.mapInArrow(count, schema)
    for _ in range(2):
        sums = sums.groupBy("segment", F.floor(F.col("part") / JOINED).cast("int").alias("_group")).applyInArrow(added, schema)
    codes = np.zeros(size, dtype=np.uint8)
    width = min(SEGMENT, size)
    for found in sums.groupBy("segment").applyInArrow(coded, schema).select("segment", "counts").toLocalIterator():
        codes[found["segment"] * width : (found["segment"] + 1) * width] = np.frombuffer(found["counts"], dtype=np.uint8)
    return codes


def flags_of(table: DataFrame, column: str, bits: int) -> np.ndarray:
    """Which of ``2 ** bits`` places the hashes in a long column of *table* fall on: a filter of fixed size."""

    def tokens(values):
        yield values.to_numpy(zero_copy_only=False).astype(np.int64).view(U)

    return frequencies(table.select(column), tokens, bits, once=True) > 0
