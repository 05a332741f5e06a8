"""Conflict-constrained best-fit packing of documents into training sequences.

Documents are cut into pieces of at most a sequence; whole sequences stand
alone and the rest is packed by decreasing length. Open bins are ordered by
residual; each carries a bitmap of duplicate clusters and one of sources. For
a piece the search starts at the least residual that holds it and goes on to
the next larger ones until a bin without conflict is found, which is the
tightest compatible one; else a bin is opened.

Packing is done in blocks of rows of a task, so its memory is bounded by the
block. The narrow rows (id, length, source, cluster) are first spread over tasks
by a hash, so that a block holds a cross-section of the corpus and not what one
file has of one source or of copies.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

BLOCK = 4096
#: Blocks of a task, about.
BLOCKS_A_TASK = 8
SCHEMA = "doc_id long, piece long, start long, n long, bin_id long, bin_pos long"


def best_fit(lengths: np.ndarray, sources: list, clusters: list, capacity: int, per_source: int) -> tuple[np.ndarray, np.ndarray]:
    """(bin, place in it) of each piece; lengths are 1 to *capacity*.

    No bin has two pieces of one cluster or more than *per_source* of one
    source. None is a cluster or source without conflicts. Pieces of equal
    length are taken in order; of equally tight bins the oldest is taken.
    """
    n = len(lengths)
    own, at = np.empty(n, dtype=np.int64), np.empty(n, dtype=np.int64)
    often = Counter(s for s in sources if s is not None)
    code = {s: i for i, s in enumerate(s for s, c in often.items() if c > per_source)}
    held = np.zeros((n, max(len(code), 1)), dtype=np.uint8 if per_source < 255 else np.uint32)
    copies = Counter(c for c in clusters if c is not None)
    marks = {c: np.zeros(n, dtype=bool) for c, m in copies.items() if m > 1}
    free = np.empty(n, dtype=np.int64)
    order, ids, open_bins, made = np.empty(n, dtype=np.int64), np.empty(n, dtype=np.int64), 0, 0
    # order holds residual * n + bin, rising: by residual, then by age of the bin.
    for i in np.argsort(-lengths, kind="stable"):
        need, source, cluster = int(lengths[i]), code.get(sources[i]), clusters[i]
        low = int(np.searchsorted(order[:open_bins], need * n))
        bins = ids[low:open_bins]
        fits = np.ones(len(bins), dtype=bool)
        if source is not None:
            fits &= held[bins, source] < per_source
        if cluster in marks:
            fits &= ~marks[cluster][bins]
        hit = int(fits.argmax()) if len(bins) else 0
        if len(bins) and fits[hit]:
            b, place = int(bins[hit]), low + hit
            order[place : open_bins - 1] = order[place + 1 : open_bins]
            ids[place : open_bins - 1] = ids[place + 1 : open_bins]
            open_bins -= 1
        else:
            b, made = made, made + 1
            free[b] = capacity
        own[i], at[i] = b, capacity - free[b]
        free[b] -= need
        if source is not None:
            held[b, source] += 1
        if cluster in marks:
            marks[cluster][b] = True
        if free[b] > 0:
            key = free[b] * n + b
            place = int(np.searchsorted(order[:open_bins], key))
            order[place + 1 : open_bins + 1] = order[place:open_bins].copy()
            ids[place + 1 : open_bins + 1] = ids[place:open_bins].copy()
            order[place], ids[place] = key, b
            open_bins += 1
    return own, at


def _pieces(doc_ids, lengths, sources, clusters, capacity) -> Iterator[tuple]:
    for d, length, s, c in zip(doc_ids, lengths, sources, clusters):
        for k, start in enumerate(range(0, length, capacity)):
            yield d, k, start, min(capacity, length - start), s, c


def pack(docs: DataFrame, length: Column, cluster: Column, capacity: int = 16384, per_source: int = 4, block: int = BLOCK) -> DataFrame:
    """A row for each piece of *docs* (doc_id, source): its bin and its place there.

    Columns: doc_id, piece (from 0), start (in the document), n, bin_id, bin_pos.
    *length* is a positive number of tokens of a row, *cluster* the long that its
    duplicates share. Every token is in exactly one piece, pieces of a bin do
    not overlap and end within *capacity*. No bin holds two pieces of a cluster
    (nor two of one document) or more than *per_source* of a source. A null
    source or cluster has no conflicts; a null or non-positive length has no
    piece. A null doc_id is kept. Repeated rows are packed apart. Columns with
    other names are ignored; no rows give no rows.
    """
    narrow = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), length.cast("long").alias("length"), F.col("source").cast("string").alias("source"), cluster.cast("long").alias("cluster")
    ).where("length > 0")
    tasks = docs.count() // (block * BLOCKS_A_TASK) + 1
    spread = narrow.repartition(tasks, F.xxhash64("doc_id", "cluster", "length"))

    def packed(batches):
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        bins = 0
        wait: list[tuple] = []

        def flush():
            nonlocal bins, wait
            whole = np.array([p[3] == capacity for p in wait], dtype=bool)
            sizes = np.array([p[3] for p in wait], dtype=np.int64)
            own, at = np.zeros(len(wait), dtype=np.int64), np.zeros(len(wait), dtype=np.int64)
            rest = np.flatnonzero(~whole)
            if len(rest):
                own[rest], at[rest] = best_fit(sizes[rest], [wait[i][4] for i in rest], [wait[i][5] for i in rest], capacity, per_source)
            first = int(own[rest].max()) + 1 if len(rest) else 0
            own[whole] = first + np.arange(whole.sum())
            ids = (part << 40) + bins + own
            bins += first + int(whole.sum())
            cols = list(zip(*wait))
            out = pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (*cols[:4], ids, at)], names=["doc_id", "piece", "start", "n", "bin_id", "bin_pos"])
            wait = []
            return out

        for batch in batches:
            columns = [batch.column(i).to_pylist() for i in range(4)]
            for piece in _pieces(*columns, capacity):
                wait.append(piece)
                if len(wait) >= block:
                    yield flush()
        if wait:
            yield flush()

    # Rows come in an order of their own, so bins do not depend on when they arrive.
    return spread.sortWithinPartitions(F.xxhash64("cluster", "doc_id"), "doc_id", "length").mapInArrow(packed, SCHEMA)


def byte_length(text: Column) -> Column:
    """Tokens of a byte-level model: the UTF-8 bytes of a text and an end mark; null is empty."""
    return F.octet_length(F.coalesce(text, F.lit(""))) + 1


def exact_cluster(text: Column) -> Column:
    """One long for each text; empty ones, and null, are no cluster."""
    return F.when(F.length(text) > 0, F.xxhash64(text))
