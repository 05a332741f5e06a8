"""Importance resampling of documents towards a target distribution.

Runs of one to three words fall into hashed buckets, and each bucket has a gain:
how much more frequent it is in the target than in the corpus. The gains are one
array; a document's weight is the sum over its runs. With a Gumbel variate added,
the highest scores are a draw without replacement.

The cutoff score is found by weighted median-of-medians selection: each part of
the remaining keys gives its median and size, the median of these medians,
weighted by size, splits all keys, and at least a fourth of them goes in each
round, until the one key is left. Only the winners are sorted.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from reachgrid.llm.crc_grams import run_checksums, spans
from reachgrid.llm.texts import ordered_sums, written
from reachgrid.llm.words import LOWER, NOT_ALNUM, bytes_of, slices

BUCKETS = 10_000
MOST_WORDS = 3
SEED = 42
#: Bytes of text that are taken together.
SLICE = 1 << 18
#: Rows that give one median; a part with more gives several.
CHUNK = 1 << 20
#: Remaining keys are written anew when they are this share of what was written last.
SHRUNK = 1 / 8


def _buckets(column: pa.Array, buckets: int, most: int):
    """(words by row, [(bucket, row) of the runs of 1, 2, ... words]) by slices of a column of texts."""
    raw, bounds = bytes_of(column)
    for i, j in slices(bounds, SLICE):
        own = LOWER[raw[bounds[i] : bounds[j]]]
        start, end, first = spans(own, bounds[i : j + 1] - bounds[i], NOT_ALNUM)
        count = np.diff(first)
        row = np.repeat(np.arange(j - i), count)
        runs = []
        for k, crc in enumerate(run_checksums(own, start, end, most)):
            whole = row[: len(crc)] == row[k : k + len(crc)]
            runs.append(((crc[whole] % np.uint32(buckets)).astype(np.int64), row[: len(crc)][whole]))
        yield count, runs


def bucket_counts(texts: DataFrame, buckets: int = BUCKETS, most: int = MOST_WORDS) -> np.ndarray:
    """Runs in each bucket, over all whole texts of the only column; null and empty texts have none."""

    def count(batches):
        total = np.zeros(buckets, dtype=np.int64)
        for batch in batches:
            for _, runs in _buckets(batch.column(0), buckets, most):
                for bucket, _ in runs:
                    total += np.bincount(bucket, minlength=buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["bucket", "n"])

    summed = texts.mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(buckets, dtype=np.int64)
    # At most one row a bucket.
    for r in summed.collect():
        out[r["bucket"]] = r["n"]
    return out


def gains_of(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln((t + 1)(S + buckets) / ((s + 1)(T + buckets)))) of each bucket."""
    n, total_s, total_t = len(source), int(source.sum()), int(target.sum())
    pairs = zip(source.tolist(), target.tolist())
    return np.array([math.floor(1000 * math.log((t + 1) * (total_s + n) / ((s + 1) * (total_t + n)))) for s, t in pairs], dtype=np.int64)


def gumbel(doc_id: Column, seed: int = SEED) -> Column:
    """floor(-1000 ln(-ln(u))) with u in (0, 1) fixed by seed and id; a null id is spelt as nothing."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(name, 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0)))).cast("long")


def scored(docs: DataFrame, gains: np.ndarray, most: int = MOST_WORDS, seed: int = SEED) -> DataFrame:
    """(doc_id, n_words, n_features, weight, score) of every row of *docs* (doc_id, text)."""
    buckets = len(gains)

    def weigh(batches):
        for batch in batches:
            parts = []
            for count, runs in _buckets(batch.column(1), buckets, most):
                weight, features = np.zeros(len(count), dtype=np.int64), np.zeros(len(count), dtype=np.int64)
                for bucket, row in runs:
                    sums = np.concatenate([[0], np.cumsum(gains[bucket])])
                    ends = np.searchsorted(row, np.arange(len(count) + 1))
                    weight += sums[ends[1:]] - sums[ends[:-1]]
                    features += np.diff(ends)
                parts.append((count, features, weight))
            made = [np.concatenate(p) for p in zip(*parts)] if parts else [np.zeros(0, np.int64)] * 3
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(m.astype(np.int64)) for m in made]], names=["doc_id", "n_words", "n_features", "weight"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    out = rows.mapInArrow(weigh, "doc_id long, n_words long, n_features long, weight long")
    return out.withColumn("score", F.col("weight") + gumbel(F.col("doc_id"), seed))


#: The key by which rows are taken, least first: highest score, then least doc_id (nulls last), then row.
KEY = ["down", "no_id", "id", "rid"]
Key = tuple[int, int, int, int]


def _keys(table: DataFrame) -> DataFrame:
    return table.select(
        (-F.col("score")).alias("down"), F.col("doc_id").isNull().cast("long").alias("no_id"), F.coalesce("doc_id", F.lit(0)).cast("long").alias("id"), "rid"
    )


def _upto(columns: list[np.ndarray], key: Key) -> np.ndarray:
    """Which keys are at most *key*."""
    out = np.ones(len(columns[0]), dtype=bool)
    for values, k in zip(reversed(columns), reversed(key)):
        out = (values < k) | ((values == k) & out)
    return out


@dataclass
class _Half:
    """The parts of some keys: their medians and sizes."""

    medians: list[tuple[Key, int]]

    @property
    def size(self) -> int:
        return sum(n for _, n in self.medians)

    def pivot(self) -> Key:
        """The median of the medians, weighted by the sizes of their parts."""
        total, so_far = self.size, 0
        for key, n in sorted(self.medians):
            so_far += n
            if 2 * so_far >= total:
                return key
        raise ValueError("no keys")


def _halves(keys: DataFrame, low: Key | None, high: Key | None, pivot: Key | None, chunk: int) -> tuple[_Half, _Half]:
    """Parts of the keys in (low, high] that are at most *pivot*, and of those above it."""
    if low is not None:
        keys = keys.where(F.col("down") >= low[0])
    if high is not None:
        keys = keys.where(F.col("down") <= high[0])

    def split(batches):
        waiting: list[list[np.ndarray]] = []
        held = 0

        def medians():
            columns = [np.concatenate(c) for c in zip(*waiting)]
            upto = np.ones(len(columns[0]), dtype=bool) if pivot is None else _upto(columns, pivot)
            for side, rows in ((0, upto), (1, ~upto)):
                part = [c[rows] for c in columns]
                n = len(part[0])
                if n:
                    at = np.lexsort(part[::-1])[(n - 1) // 2]
                    yield pa.RecordBatch.from_arrays([pa.array([int(v)], pa.int64()) for v in (side, n, *(c[at] for c in part))], names=["side", "n", *KEY])

        for batch in batches:
            columns = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            inside = np.ones(len(columns[0]), dtype=bool)
            if low is not None:
                inside &= ~_upto(columns, low)
            if high is not None:
                inside &= _upto(columns, high)
            if inside.any():
                waiting.append([c[inside] for c in columns])
                held += int(inside.sum())
            if held >= chunk:
                yield from medians()
                waiting, held = [], 0
        if held:
            yield from medians()

    out = _Half([]), _Half([])
    # Two rows for each part.
    for r in keys.mapInArrow(split, "side long, n long, " + ", ".join(f"{c} long" for c in KEY)).toLocalIterator():
        out[r["side"]].medians.append((tuple(r[c] for c in KEY), r["n"]))
    return out


def cutoff(keys: DataFrame, share: tuple[int, int], chunk: int = CHUNK) -> Key | None:
    """The key of rank floor(num * N / den) among the N *keys*, all distinct; None when that is 0.

    Each round is one pass over what remains. It splits by a pivot with at least
    a fourth of the keys on either side and brings the medians for the next.
    """
    num, den = share
    low = high = None
    now, _ = _halves(keys, None, None, None, chunk)
    place = num * now.size // den
    if place == 0:
        return None
    stored = now.size
    while now.size > 1:
        pivot = now.pivot()
        upto, above = _halves(keys, low, high, pivot, chunk)
        if place <= upto.size:
            now, high = upto, pivot
        else:
            place -= upto.size
            now, low = above, pivot
        if 1 < now.size <= stored * SHRUNK:
            bounds = [F.struct(*KEY) <= _literal(high)] if high else []
            bounds += [F.struct(*KEY) > _literal(low)] if low else []
            for b in bounds:
                keys = keys.where(b)
            keys, stored = written(keys, "remaining-keys"), now.size
    return now.medians[0][0]


def _literal(key: Key) -> Column:
    return F.struct(*[F.lit(v).cast("long").alias(c) for c, v in zip(KEY, key)])


def resample(docs: DataFrame, target: DataFrame, share: tuple[int, int] = (5, 100), least_words: int = 20, buckets: int = BUCKETS, most: int = MOST_WORDS, seed: int = SEED, chunk: int = CHUNK) -> DataFrame:
    """(doc_id, n_words, n_features, weight, score, rank) of every row of *docs* (doc_id, text), drawn towards *target* (text).

    Words are runs of ASCII letters, digits and non-ASCII bytes, A-Z
    lower-cased; features are all runs of 1 to *most* words, repeats counted.
    Of the N rows with at least *least_words* words, floor(num * N / den) are
    drawn, by highest score; equal scores go by least doc_id (nulls last), and
    rows that repeat a doc_id by their place in the files. rank counts from 1;
    it is null for rows that are not drawn. Null and empty texts have no words,
    weight 0 and are never drawn. Repeated rows are drawn apart. Other columns
    are ignored; no rows give no rows, and an empty target is a flat one.
    """
    docs = docs.select("doc_id", "text")
    gains = gains_of(bucket_counts(docs.select("text"), buckets, most), bucket_counts(target.select("text"), buckets, most))
    table = written(scored(docs, gains, most, seed).withColumn("rid", F.monotonically_increasing_id()), "scores")
    entitled = table.where(F.col("n_words") >= least_words)
    edge = cutoff(_keys(entitled), share, chunk)
    columns = ["doc_id", "n_words", "n_features", "weight", "score"]
    none = F.lit(None).cast("long").alias("rank")
    if edge is None:
        return table.select(*columns, none)
    key = F.struct(
        (-F.col("score")).alias("down"), F.col("doc_id").isNull().cast("long").alias("no_id"), F.coalesce("doc_id", F.lit(0)).cast("long").alias("id"), F.col("rid").alias("rid")
    )
    drawn = (F.col("n_words") >= least_words) & (key <= _literal(edge))
    winners = table.where(drawn).withColumns({"down": -F.col("score"), "one": F.lit(1)})
    ranked = ordered_sums(winners, ["down", "doc_id", "rid"], {"before": "one"}, "winners")
    return ranked.select(*columns, (F.col("before") + 1).cast("long").alias("rank")).unionByName(table.where(~drawn).select(*columns, none))
