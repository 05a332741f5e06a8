"""Filters and the exact check of set joins over keys ordered by rarity.

A threshold is a fraction num / den; all tests are on whole numbers.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, functions as F

from reachgrid.llm.rarity import flags_of
from reachgrid.llm.words import U, mix

#: Bits of the filter in front of the join of index entries.
FILTER_BITS = 24


def prefix_length(n: int | np.ndarray, num: int, den: int):
    """So many of the rarest keys of a set of *n* that any match shares one of them."""
    return n - -(-num * n // den) + 1


def enough(overlap: Column, n_a: Column, n_b: Column, num: int, den: int) -> Column:
    """Whether sets of these sizes with this intersection have Jaccard >= num / den."""
    return (den + num) * overlap >= num * (n_a + n_b)


def may_match(n_a: Column, pos_a: Column, n_b: Column, pos_b: Column, num: int, den: int) -> Column:
    """Length and positional bounds for two sets whose first common key stands at these places (from 0).

    A common key that is not the first only bounds more tightly, so a true pair
    passes at its first one.
    """
    sizes = den * F.least(n_a, n_b) >= num * F.greatest(n_a, n_b)
    return sizes & enough(1 + F.least(n_a - pos_a - 1, n_b - pos_b - 1), n_a, n_b, num, den)


def verified(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs (a, b) whose sets (id, keys) have Jaccard >= num / den.

    The left set is joined last: pairs of one common left side then travel with
    their right sets, and AQE splits them.
    """
    right = sets.select(F.col("id").alias("b"), F.col("keys").alias("_right"))
    left = sets.select(F.col("id").alias("a"), F.col("keys").alias("_left"))
    both = pairs.join(right, "b").join(left, "a")
    overlap = F.size(F.array_intersect("_left", "_right")).cast("long")
    return both.where(enough(overlap, F.size("_left"), F.size("_right"), num, den)).select("a", "b")


def _short(keys: np.ndarray) -> np.ndarray:
    """32-bit hashes of keys, as signed numbers."""
    return (mix(keys) >> U(32)).astype(np.uint32).view(np.int32)


def shared_entries(index: DataFrame) -> tuple[DataFrame, Broadcast]:
    """(id, n, rank, pos, key): the index entries whose key some other row may have too; and the filter, to be destroyed once they are written.

    *index* has (id, n, rank, skipped, keys): keys in order, of which the first
    stands at place *skipped*. Most keys occur once. A count of their 32-bit
    hashes tells them apart without moving whole entries; the hashes that occur
    again pass a filter of fixed size. What passes is every key that occurs in
    two rows, and some that do not.
    """
    spark = index.sparkSession

    def hashes(batches):
        for batch in batches:
            keys = batch.column(0)
            values = keys.values.to_numpy(zero_copy_only=False)[keys.offsets[0].as_py() : keys.offsets[-1].as_py()]
            yield pa.RecordBatch.from_arrays([pa.array(_short(values.view(U)))], names=["short"])

    counts = index.select("keys").mapInArrow(hashes, "short int").groupBy("short").agg(F.count("*").alias("size"))
    # The hash fills the upper bits, which place it in the filter.
    again = counts.where("size > 1").select(F.shiftleft(F.col("short").cast("long"), 32).alias("place"))
    flags = spark.sparkContext.broadcast(flags_of(again, "place", FILTER_BITS))

    def passing(batches):
        for batch in batches:
            keys = batch.column(4)
            ends = keys.offsets.to_numpy().astype(np.int64)
            values = keys.values.to_numpy(zero_copy_only=False)[ends[0] : ends[-1]]
            place = _short(values.view(U)).view(np.uint32) >> np.uint32(32 - FILTER_BITS)
            at = np.flatnonzero(flags.value[place])
            row = np.searchsorted(ends - ends[0], at, side="right") - 1
            skipped = batch.column(3).to_numpy(zero_copy_only=False)
            pos = skipped[row] + at - (ends[row] - ends[0])
            taken = [batch.column(i).take(pa.array(row)) for i in range(3)]
            yield pa.RecordBatch.from_arrays([*taken, pa.array(pos.astype(np.int64)), pa.array(values[at])], names=["id", "n", "rank", "pos", "key"])

    return index.select("id", "n", "rank", "skipped", "keys").mapInArrow(passing, "id long, n long, rank long, pos long, key long"), flags
