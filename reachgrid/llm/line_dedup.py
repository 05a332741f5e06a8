"""Line dedup by an exact set-similarity join.

A line is the set of its tokens, which are runs of five words. Tokens are
ordered by rarity over the whole corpus; a line is indexed under its prefix,
the rarest tokens of which any match shares one. Length and positional filters leave few candidates, whose whole
sets are compared. Of lines that match, all but the earliest go.

Only whether an earlier match exists matters, so large buckets cost no square:
each line set is compared with the earliest one of each of its buckets, and
only those that this leaves open meet the others.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from reachgrid.llm.rarity import frequencies, keys_of
from reachgrid.llm.setjoin import may_match, prefix_length, shared_entries, verified
from reachgrid.llm.texts import free, ordered_sums, portions, text_key, written
from reachgrid.llm.words import LOWER, U, WHITE, bytes_of, longs, mix, read_words, slices, text_grams, words_of
from reachgrid.operators.sizes import if_small

RARITY_BITS = 22
#: Numbers in lists of lines that are broadcast, some 20 MB; longer lists are joined by shuffle.
BROADCAST_LINES = 2_500_000

def _line_bounds(raw: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(byte bounds of all lines, row of each line, number of each line in its row)."""
    breaks = np.flatnonzero(raw == 10) + 1
    starts = np.concatenate([bounds[:-1], breaks])
    rows = np.concatenate([np.arange(len(bounds) - 1), np.searchsorted(bounds, breaks - 1, side="right") - 1])
    turn = np.lexsort((starts, rows))
    starts, rows = starts[turn], rows[turn]
    first = np.searchsorted(rows, np.arange(len(bounds) - 1))
    return np.append(starts, bounds[-1]), rows, np.arange(len(rows)) - first[rows]


def _sorted_sets(hashes: np.ndarray, bounds: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys of each row, rising, and their bounds."""
    keys = keys_of(hashes, codes)
    row = np.repeat(np.arange(len(bounds) - 1, dtype=U), np.diff(bounds))
    if len(bounds) <= 1 << 12:
        near = (row << U(52)) | (keys >> U(11))
        turn = np.argsort(near)
        near, moved = near[turn], keys[turn]
        if ((near[1:] == near[:-1]) & (moved[1:] != moved[:-1])).any():
            turn = np.lexsort((keys, row))
    else:
        turn = np.lexsort((keys, row))
    keys, row = keys[turn], row[turn]
    new = np.ones(len(keys), dtype=bool)
    new[1:] = (keys[1:] != keys[:-1]) | (row[1:] != row[:-1])
    return keys[new], np.searchsorted(row[new], np.arange(len(bounds), dtype=U))


def _line_sets(raw: np.ndarray, lines: np.ndarray, k: int, codes: np.ndarray):
    """(first line, line after the last, distinct keys, bounds by line) by slices of lines."""
    for a, b in slices(lines, 1 << 17):
        tokens, at = text_grams(words_of(raw, lines[a : b + 1], WHITE, LOWER), k)
        yield a, b, *_sorted_sets(tokens, at, codes)


def _segment_sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    total = np.concatenate([np.zeros(1, U), np.cumsum(values, dtype=U)])
    return total[bounds[1:]] - total[bounds[:-1]]


def _index(docs: DataFrame, firsts: DataFrame, codes, k: int, num: int, den: int, least: int) -> DataFrame:
    """A row for each line with tokens: its document's first place, its number and place, size, fingerprint (id) and prefix keys."""

    def lines_of(batches):
        for batch in portions(batches):
            raw, bounds = bytes_of(batch.column(0))
            ends, rows, numbers = _line_bounds(raw, bounds)
            for a, b, keys, at in _line_sets(raw, ends, k, codes.value):
                n = np.diff(at)
                some = np.flatnonzero(n >= max(least, 1))
                size = prefix_length(n[some], num, den)
                cuts = np.concatenate([[0], np.cumsum(size)])
                flat = keys[np.repeat(at[some] - cuts[:-1], size) + np.arange(cuts[-1])]
                prints = mix(_segment_sums(mix(keys), at) ^ mix(n.astype(U)))[some]
                yield pa.RecordBatch.from_arrays(
                    [*[c.take(pa.array(rows[a:b][some])) for c in batch.columns[1:]], pa.array(numbers[a:b][some]), pa.array(n[some]), pa.array(prints.astype(np.int64)), longs(flat, cuts)],
                    names=["doc", "k1", "k2", "line", "n", "id", "keys"],
                )

    texts = docs.select(F.coalesce("text", F.lit("")).alias("text"), F.col("doc_id").cast("long").alias("doc"), *text_key(F.col("text")))
    lines = texts.mapInArrow(lines_of, "doc long, k1 long, k2 long, line long, n long, id long, keys array<long>").alias("l")
    r = if_small(firsts).alias("r")
    same = F.col("l.doc").eqNullSafe(F.col("r.doc")) & (F.col("l.k1") == F.col("r.k1")) & (F.col("l.k2") == F.col("r.k2"))
    place = F.col("r.first") + F.col("l.line")
    return written(lines.join(r, same).select("r.first", "l.line", place.alias("place"), "l.id", "l.n", "l.keys"), "lines")


def _sets_of(docs: DataFrame, wanted: DataFrame, codes, k: int) -> DataFrame:
    """(id, keys) of the wanted lines (id, doc, k1, k2, line)."""

    def sets(batches):
        for batch in portions(batches):
            ids, lines = [], []
            for text, picks in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                own = text.split("\n")
                ids += [p["id"] for p in picks]
                lines += [own[p["line"]] for p in picks]
            raw, bounds = bytes_of(pa.array(lines, pa.large_string()))
            for a, b, keys, at in _line_sets(raw, bounds, k, codes.value):
                yield pa.RecordBatch.from_arrays([pa.array(ids[a:b], pa.int64()), longs(keys, at)], names=["id", "keys"])

    texts = docs.select("text", F.col("doc_id").cast("long").alias("_doc"), *text_key(F.col("text")))
    w = if_small(wanted.groupBy("doc", "k1", "k2").agg(F.collect_set(F.struct("id", "line")).alias("lines"))).alias("w")
    same = (F.col("_k1") == F.col("w.k1")) & (F.col("_k2") == F.col("w.k2")) & F.col("_doc").eqNullSafe(F.col("w.doc"))
    found = texts.join(w, same).select("text", "lines").mapInArrow(sets, "id long, keys array<long>")
    # Rows that repeat a document give its sets again.
    return written(found.groupBy("id").agg(F.first("keys").alias("keys")), "line-sets")


def repeated_lines(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100, least: int = 1, rarity_bits: int = RARITY_BITS) -> DataFrame:
    """(doc, k1, k2, lines): numbers of the lines, from 0, that an earlier line of any document matches.

    Lines are parts of a text between line feeds; their words are runs of
    non-white bytes, A-Z lower-cased, and their tokens the distinct runs of *k*
    words, or all words of a shorter line. Lines match when the Jaccard
    similarity of their sets of tokens is at least num / den. Tokens and sets
    are known by 64-bit hashes. Lines without words, or with fewer than *least*
    tokens, neither match nor go. Order is by doc_id (nulls last), then by
    hashes of the text (k1, k2), then by line. An earlier line counts whether or
    not it goes itself. Rows that repeat doc_id and text are one document.
    Documents without such lines have no row.
    """
    docs = docs.select("doc_id", "text")
    spark = docs.sparkSession

    def occurrences(column):
        for _, _, words in read_words(column, WHITE, LOWER):
            yield text_grams(words, k)[0]

    codes = spark.sparkContext.broadcast(frequencies(docs.select("text"), occurrences, rarity_bits))
    # Every document takes as many places as it has lines.
    text = F.coalesce("text", F.lit(""))
    n_lines = F.octet_length(text) - F.octet_length(F.replace(text, F.lit("\n"), F.lit(""))) + 1
    known = docs.select(F.col("doc_id").cast("long").alias("doc"), *text_key(F.col("text")), n_lines.cast("long").alias("n")).toDF("doc", "k1", "k2", "n")
    known = known.groupBy("doc", "k1", "k2").agg(F.max("n").alias("n"))
    firsts = written(ordered_sums(known, ["doc", "k1", "k2"], {"first": "n"}, "doc-order").drop("n"), "doc-places")
    index = _index(docs, firsts, codes, k, num, den, least)
    classes = written(index.groupBy("id").agg(F.min(F.struct("place", "first", "line")).alias("at")).select("id", "at.*"), "line-classes")

    entries, flags = shared_entries(index.select("id", "n", F.col("place").alias("rank"), F.lit(0).cast("long").alias("skipped"), "keys"))
    # Equal lines are one entry.
    entries = written(entries.groupBy("key", "id", "n", "pos").agg(F.min("rank").alias("place")), "line-entries")
    flags.destroy()
    leads = entries.groupBy("key").agg(F.count("*").alias("size"), F.min("place").alias("lead")).where("size > 1").select("key", "lead")
    hits = written(entries.join(leads, "key"), "line-hits")
    h, v = hits.alias("h"), hits.where("place = lead").alias("v")
    near = may_match(F.col("h.n"), F.col("h.pos"), F.col("v.n"), F.col("v.pos"), num, den)
    star = h.join(v, (F.col("h.key") == F.col("v.key")) & (F.col("h.place") != F.col("v.place")) & near)
    first = written(star.select(F.col("v.id").alias("a"), F.col("h.id").alias("b")).distinct(), "line-pairs")

    def matching(pairs: DataFrame) -> DataFrame:
        ends = pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).distinct()
        wanted = ends.join(classes, "id").join(firsts, "first").select("id", "doc", "k1", "k2", "line")
        return verified(pairs, _sets_of(docs, wanted, codes, k), num, den).select("b").distinct()

    gone = written(matching(first), "line-matches")
    x, y = hits.alias("x"), hits.join(gone, F.col("id") == F.col("b"), "left_anti").alias("y")
    bound = may_match(F.col("x.n"), F.col("x.pos"), F.col("y.n"), F.col("y.pos"), num, den)
    rest = x.join(y, (F.col("x.key") == F.col("y.key")) & (F.col("x.place") < F.col("y.place")) & bound).select(
        F.col("x.id").alias("a"), F.col("y.id").alias("b")
    )
    rest = written(rest.distinct().join(first, ["a", "b"], "left_anti"), "line-rest")
    if not rest.isEmpty():
        gone = written(gone.unionByName(matching(rest)).distinct(), "line-matches")

    # All that needs them is written.
    codes.destroy()
    judged = classes.join(gone, F.col("id") == F.col("b"), "left").select("id", F.col("place").alias("earliest"), F.col("b").isNotNull().alias("gone"))
    later = index.select("id", "place", "first", "line").join(judged, "id").where(F.col("gone") | (F.col("place") != F.col("earliest")))
    lines = later.groupBy("first").agg(F.collect_set("line").alias("lines"))
    return lines.join(firsts, "first").select("doc", "k1", "k2", "lines")


def cut_lines(docs: DataFrame, found: DataFrame, removed: str, lines: str | None = None) -> DataFrame:
    """*docs* without the lines of *found* (:func:`repeated_lines`), with how many went as *removed* and, if named, how many there were as *lines*."""
    k1, k2, mark = (free(docs, n) for n in ("_own_k1", "_own_k2", "_lines"))
    found = found.withColumnsRenamed({c: free(docs, f"_cut_{c}") for c in ("doc", "k1", "k2")} | {"lines": mark})
    doc, c1, c2 = found.columns[:3]
    # The lists count as what they hold.
    small = not found.isEmpty() and found.agg(F.sum(F.size(mark) + 4)).first()[0] <= BROADCAST_LINES
    keyed = docs.withColumns(dict(zip((k1, k2), text_key(F.col("text")))))
    same = (F.col(k1) == F.col(c1)) & (F.col(k2) == F.col(c2)) & F.col("doc_id").cast("long").eqNullSafe(F.col(doc))
    joined = keyed.join(F.broadcast(found) if small else found, same, "left").drop(k1, k2, doc, c1, c2)
    counted = joined.withColumns({name: F.lit(0).cast("long") for name in (lines, removed) if name})
    schema = counted.drop(mark).schema
    at = {c: i for i, c in enumerate(counted.columns)}

    def cut(batches):
        for batch in portions(batches, at["text"]):
            texts, gone = batch.column(at["text"]), batch.column(at[mark]).to_pylist()
            raw, bounds = bytes_of(texts)
            breaks = np.searchsorted(np.flatnonzero(raw == 10), bounds)
            n_lines = np.where(texts.is_null().to_numpy(zero_copy_only=False), 0, np.diff(breaks) + 1)
            if any(gone):
                out = texts.to_pylist()
                for i, g in enumerate(gone):
                    if g:
                        g = set(g)
                        out[i] = "\n".join(line for k, line in enumerate(out[i].split("\n")) if k not in g)
                texts = pa.array(out, texts.type)
            made = {"text": texts, lines: pa.array(n_lines, pa.int64()), removed: pa.array([len(g or ()) for g in gone], pa.int64())}
            yield pa.RecordBatch.from_arrays([made.get(c, batch.column(i)) for c, i in at.items() if c != mark], names=schema.names)

    return counted.mapInArrow(cut, schema)


def dedup_lines(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100, least: int = 1, rarity_bits: int = RARITY_BITS) -> DataFrame:
    """*docs* without its repeated lines (see :func:`repeated_lines`), with n_lines and n_removed.

    Other lines keep their order and bytes. A null text stays null and has no
    lines; an empty one has one line and stays. All columns and rows are kept;
    columns named n_lines or n_removed are replaced.
    """
    found = written(repeated_lines(docs, k, num, den, least, rarity_bits), "repeated-lines")
    return cut_lines(docs.drop("n_lines", "n_removed"), found, "n_removed", "n_lines")
