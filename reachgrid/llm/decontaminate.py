"""Benchmark decontamination by a prefix-filtered set join with exact windows.

A window is *width* consecutive words of an item, or all words of a shorter
item. All of a window must be in a document for it to occur, so one shingle
of it is prefix enough: the rarest by its count over all documents. Documents
are looked up by that shingle alone; length and position bound where the
window can start, and its words are then compared one by one.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, functions as F

from reachgrid.llm.rarity import flags_of
from reachgrid.llm.texts import portions, text_key, without, written
from reachgrid.llm.words import LOWER, NOT_ALNUM, U, Words, grams, longs, read_words, text_grams

#: Words of a shingle; a shorter window is one shingle.
SHINGLE = 5
#: Bits of the filters in front of the joins: 16 places for each shingle, 16 MB in a task at most.
LEAST_BITS, MOST_BITS = 12, 24


def _joined(words: Words, a: int, b: int) -> str:
    """Words a to b of a slice, lower-cased, with one space between."""
    return b" ".join(LOWER[words.raw[s:e]].tobytes() for s, e in zip(words.start[a:b], words.end[a:b])).decode()


def _windows(benchmark: DataFrame, width: int) -> DataFrame:
    """(window, m, items, shingles): every distinct window, its words, its items, and its shingles in order."""

    def cut(batches):
        for batch in batches:
            for i, j, words in read_words(batch.column(0), NOT_ALNUM, LOWER):
                item, text, size, shingles = [], [], [], []
                for r in range(i, j):
                    a, b = int(words.first[r - i]), int(words.first[r - i + 1])
                    m = min(width, b - a)
                    for at in range(a, b - m + 1) if m else ():
                        item.append(batch.column(1)[r])
                        text.append(_joined(words, at, at + m))
                        size.append(m)
                        shingles.append(grams(words.hash[at : at + m], SHINGLE))
                bounds = np.concatenate([[0], np.cumsum([len(s) for s in shingles])])
                flat = np.concatenate(shingles) if shingles else np.zeros(0, U)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([x.as_py() for x in item], pa.string()), pa.array(text, pa.string()), pa.array(size, pa.int64()), longs(flat, bounds)],
                    names=["item", "window", "m", "shingles"],
                )

    items = benchmark.select(F.coalesce("text", F.lit("")).alias("text"), F.col("item_id").cast("string").alias("item"))
    rows = items.mapInArrow(cut, "item string, window string, m long, shingles array<long>")
    return written(
        rows.groupBy("window", "m").agg(F.collect_set("item").alias("items"), F.first("shingles").alias("shingles")), "windows"
    )


def _filter(table: DataFrame) -> Broadcast:
    """The places of the shingles of *table*; a full filter lets more pass, and the join behind it is exact."""
    bits = min(max((16 * table.count()).bit_length(), LEAST_BITS), MOST_BITS)
    return table.sparkSession.sparkContext.broadcast(flags_of(table, "shingle", bits))


def _hits(hashes: np.ndarray, present: np.ndarray) -> np.ndarray:
    return np.flatnonzero(present[(hashes >> U(65 - len(present).bit_length())).astype(np.int64)])


def _runs(words: Words, sizes: list[int]):
    """For each shingle size: (hashes of the texts long enough, first word of each)."""
    count = np.diff(words.first)
    for s in sizes:
        hashes, bounds = text_grams(words, s)
        runs = np.diff(bounds)
        place = np.arange(len(hashes)) - np.repeat(bounds[:-1] - words.first[:-1], runs)
        long_enough = np.repeat(count >= s, runs)
        yield hashes[long_enough], place[long_enough]


def _counts(docs: DataFrame, present, sizes: list[int]) -> DataFrame:
    """(shingle, seen): occurrences in all documents of whatever passes the filter."""

    def count(batches):
        for batch in portions(batches):
            for _, _, words in read_words(batch.column(0), NOT_ALNUM, LOWER):
                for hashes, _ in _runs(words, sizes):
                    values, seen = np.unique(hashes[_hits(hashes, present.value)], return_counts=True)
                    if len(values):
                        yield pa.RecordBatch.from_arrays([pa.array(values.astype(np.int64)), pa.array(seen)], names=["shingle", "seen"])

    return docs.select("text").mapInArrow(count, "shingle long, seen long").groupBy("shingle").agg(F.sum("seen").alias("seen"))


def _candidates(docs: DataFrame, present, sizes: list[int], width: int) -> DataFrame:
    """A row for each document, with the places whose shingle passes the filter and the words around them."""
    found = pa.list_(pa.struct([("key", pa.int64()), ("pos", pa.int64()), ("base", pa.int64()), ("around", pa.string())]))

    def look(batches):
        for batch in portions(batches):
            for i, j, words in read_words(batch.column(0), NOT_ALNUM, LOWER):
                rows: list[list] = [[] for _ in range(j - i)]
                for hashes, place in _runs(words, sizes):
                    for at in _hits(hashes, present.value):
                        p = int(place[at])
                        r = int(np.searchsorted(words.first, p, side="right")) - 1
                        first, last = int(words.first[r]), int(words.first[r + 1])
                        a, b = max(first, p - width + 1), min(last, p + width)
                        rows[r].append({"key": int(hashes[at].astype(np.int64)), "pos": p - first, "base": a - first, "around": _joined(words, a, b)})
                part = batch.slice(i, j - i)
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[1:], pa.array(np.diff(words.first).astype(np.int64)), pa.array(rows, found)],
                    names=["doc_id", "k1", "k2", "n_words", "found"],
                )

    texts = docs.select(F.coalesce("text", F.lit("")).alias("text"), F.col("doc_id").cast("long").alias("doc_id"), *text_key(F.col("text")))
    schema = "doc_id long, k1 long, k2 long, n_words long, found array<struct<key: long, pos: long, base: long, around: string>>"
    return written(texts.mapInArrow(look, schema).withColumn("rid", F.monotonically_increasing_id()), "candidates")


def contamination(docs: DataFrame, benchmark: DataFrame, width: int = 10) -> DataFrame:
    """What of the benchmark (item_id, text) occurs in each row of *docs* (doc_id, text).

    Columns: doc_id, n_words, n_hit (words inside any occurrence of a window),
    spans (their sorted (start, length) in words, windows may overlap), items
    (sorted ids as strings of items with an occurring window), n_items,
    items_sha256, contaminated, and the text's hashes k1, k2.

    Words are runs of ASCII letters, digits and non-ASCII bytes, A-Z
    lower-cased. Null and empty texts have no words and no hit; an item without
    words has no window. Items with a null item_id mark words but are not
    counted; rows of one item_id are one item. Each row of *docs* gives one row,
    repeated or not. Without items no document has hits; without documents
    there are no rows.
    """
    docs = docs.select("doc_id", "text")
    windows = _windows(benchmark.select("item_id", "text"), width)
    shingles = windows.select("window", "m", F.posexplode("shingles").alias("offset", "shingle"))
    # At most SHINGLE values.
    sizes = sorted(int(r["s"]) for r in windows.select(F.least("m", F.lit(SHINGLE)).alias("s")).distinct().collect())
    present = _filter(shingles)
    counts = written(_counts(docs, present, sizes), "shingle-counts")
    present.destroy()
    # A window with a shingle that no document has cannot occur.
    best = F.min(F.struct(F.coalesce("seen", F.lit(0)).alias("seen"), "shingle", "offset")).alias("rarest")
    prefixes = shingles.join(counts, "shingle", "left").groupBy("window", "m").agg(best).where("rarest.seen > 0")
    prefixes = written(
        prefixes.join(windows.select("window", "items"), "window").select("window", "m", "items", "rarest.shingle", "rarest.offset"), "prefixes"
    )
    wanted = _filter(prefixes)
    table = _candidates(docs, wanted, sizes, width)
    wanted.destroy()

    places = table.where(F.size("found") > 0).select("rid", "n_words", F.explode("found").alias("f"))
    start = F.col("f.pos") - F.col("offset")
    met = places.join(prefixes, F.col("f.key") == F.col("shingle")).where((start >= 0) & (start + F.col("m") <= F.col("n_words")))
    here = F.array_join(F.slice(F.split("f.around", " "), (start - F.col("f.base") + 1).cast("int"), F.col("m").cast("int")), " ")
    real = written(met.where(here == F.col("window")).select("rid", start.alias("start"), "m", "window"), "occurrences")

    spans = real.groupBy("rid").agg(F.array_sort(F.collect_set(F.struct("start", "m"))).alias("spans"))
    merged = F.aggregate(
        "spans",
        F.struct(F.lit(0).cast("long").alias("end"), F.lit(0).cast("long").alias("hit")),
        lambda acc, s: F.struct(
            F.greatest(acc["end"], s["start"] + s["m"]).alias("end"),
            (acc["hit"] + F.greatest(F.lit(0), s["start"] + s["m"] - F.greatest(acc["end"], s["start"]))).alias("hit"),
        ),
    )["hit"]
    items = (
        real.select("rid", "window").distinct()
        .join(prefixes.select("window", F.explode("items").alias("item")), "window")
        .groupBy("rid").agg(F.array_sort(F.collect_set("item")).alias("items"))
    )
    # The ids of rows with hits are joined as they are; all other rows get none.
    none = F.array().cast("array<string>")
    out = table.drop("found").join(spans.select("rid", "spans", merged.alias("n_hit")), "rid", "left").join(items, "rid", "left")
    out = out.withColumns({"n_hit": F.coalesce("n_hit", F.lit(0)).cast("long"), "items": F.coalesce("items", none)})
    return out.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
        "spans", "items", "k1", "k2",
    )


def clean_of(docs: DataFrame, benchmark: DataFrame, width: int = 10) -> DataFrame:
    """Rows of *docs* whose text holds no window of the benchmark; all columns are kept."""
    bad = contamination(docs, benchmark, width).where("contaminated").select("k1", "k2").distinct()
    return without(docs, written(bad, "contaminated"))
