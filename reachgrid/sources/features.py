"""Features of GeoJSON collections, read in byte ranges.

A collection is one JSON document, often on one line. Spark's text reader cuts it
behind closing braces, which it can do in any byte range of a file. A first pass
notes of each range how far it changes the nesting, once as if it began inside a
quoted text and once as if not; from the first range on it is then known at which
depth each one begins. A second pass cuts out the objects of the array
``features``; those that go over the end of a range are put together from their
pieces.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from reachgrid.session import written

#: Bytes of a range that are looked at together.
PORTION = 1 << 22
#: Depth inside the array of features: the document, then the array.
INSIDE = 2
SUMMARY = "file string, block long, quoted boolean, quoted_after boolean, escaped_after boolean, delta int, arrays map<int, boolean>"
PIECES = "file string, block long, turn int, kind string, text string"


def _portions(batches) -> Iterator[tuple[str, int, bytes]]:
    """(file, block, bytes) of consecutive pieces of one range, with the braces that the reader took."""
    held: list[bytes] = []
    size, at = 0, None
    for batch in batches:
        for value, file, block in zip(*(c.to_pylist() for c in batch.columns)):
            if held and ((file, block) != at or size > PORTION):
                yield *at, b"".join(held)
                held, size = [], 0
            at = (file, block)
            piece = value.encode() + b"}"
            held.append(piece)
            size += len(piece)
    if held:
        yield *at, b"".join(held)


class _Scan:
    """Nesting of a text that comes in parts, from a known or assumed state."""

    def __init__(self, quoted: bool, depth: int = 0, escaped: bool = False):
        self.quoted, self.depth, self.escaped = quoted, depth, escaped
        #: Depth of each array that is open, or was the last one there, and whether it is called features.
        self.arrays: dict[int, bool] = {}

    def marks(self, raw: bytes):
        """(places, steps, depths after them) of all brackets outside of quoted texts."""
        import numpy as np

        data = np.frombuffer(raw, dtype=np.uint8)
        slash = data == 0x5C
        # A character is escaped behind an odd run of backslashes.
        number = np.arange(len(data))
        last_other = np.maximum.accumulate(np.where(slash, -1, number))
        run = np.where(slash, number - last_other, 0)
        before = np.concatenate([[0], run[:-1]])
        if self.escaped and len(data):
            # The first run goes on from the part before.
            first = int(np.argmin(slash)) if not slash.all() else len(data)
            before[: first + 1] = np.arange(min(first + 1, len(data))) + 1
            ending = first + 1 if slash.all() else int(run[-1])
        else:
            ending = int(run[-1]) if len(data) else 0
        quote = (data == 0x22) & (before % 2 == 0)
        inside = (np.cumsum(quote) - quote + self.quoted) % 2 == 1
        step = np.where(inside, 0, ((data == 0x7B) | (data == 0x5B)).astype(np.int64) - ((data == 0x7D) | (data == 0x5D)))
        places = np.flatnonzero(step)
        steps = step[places]
        depths = self.depth + np.cumsum(steps)
        for p in places[(steps > 0) & (data[places] == 0x5B)].tolist() if len(places) else ():
            at = int(depths[np.searchsorted(places, p)])
            if at <= self.depth + 1 or at <= INSIDE:
                self.arrays[at] = raw[max(0, p - 64) : p].rstrip(b" \t\r\n:").endswith(b'"features"')
        self.quoted = bool((int(quote.sum()) + self.quoted) % 2)
        self.escaped = ending % 2 == 1
        self.depth = int(depths[-1]) if len(depths) else self.depth
        return places, steps, depths


def _summaries(pieces: DataFrame) -> DataFrame:
    def look(batches):
        import pyarrow as pa

        scans, at, out = (), None, []

        def closed():
            for quoted, scan in zip((False, True), scans):
                out.append((*at, quoted, scan.quoted, scan.escaped, scan.depth, list(scan.arrays.items())))

        for file, block, raw in _portions(batches):
            if (file, block) != at:
                closed()
                at, scans = (file, block), (_Scan(False), _Scan(True))
            for scan in scans:
                scan.marks(raw)
        closed()
        kinds = [pa.string(), pa.int64(), pa.bool_(), pa.bool_(), pa.bool_(), pa.int32(), pa.map_(pa.int32(), pa.bool_())]
        names = ["file", "block", "quoted", "quoted_after", "escaped_after", "delta", "arrays"]
        columns = list(zip(*out)) or [[]] * 7
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=names)

    return pieces.mapInArrow(look, SUMMARY)


def _starts(summaries: DataFrame) -> DataFrame:
    """(file, block, quoted, escaped, depth, inside): the state in which each range begins. A file has a row for each range."""

    def chain(key, table):
        import pyarrow as pa

        rows = {}
        for r in table.to_pylist():
            rows.setdefault(r["block"], {})[r["quoted"]] = r
        quoted, escaped, depth, inside, out = False, False, 0, False, []
        for block in sorted(rows):
            out.append((key[0].as_py(), block, quoted, escaped, depth, inside))
            r = rows[block][quoted]
            arrays = dict(r["arrays"])
            if INSIDE - depth in arrays:
                inside = arrays[INSIDE - depth]
            quoted, escaped, depth = r["quoted_after"], r["escaped_after"], depth + r["delta"]
        names = ["file", "block", "quoted", "escaped", "depth", "inside"]
        kinds = [pa.string(), pa.int64(), pa.bool_(), pa.bool_(), pa.int32(), pa.bool_()]
        return pa.table([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names=names)

    return summaries.groupBy("file").applyInArrow(chain, "file string, block long, quoted boolean, escaped boolean, depth int, inside boolean")


def _cut(pieces: DataFrame) -> DataFrame:
    """PIECES of all features: whole ones, and parts of those that go over the end of a range, numbered by turn."""

    def cut(batches):
        import numpy as np
        import pyarrow as pa

        def rows_of(found):
            kinds = [pa.string(), pa.int64(), pa.int32(), pa.string(), pa.string()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found), kinds)], names=["file", "block", "turn", "kind", "text"])

        at, scan, turn, open_, carried, inside = None, None, 0, False, [], False

        def rest():
            # What is open at the end of a range goes on in the next one.
            return [(*at, turn, carried[0], b"".join(carried[1:]).decode())] if open_ and at else []

        out = []
        for batch in batches:
            state = {(r["file"], r["block"]): r for r in batch.select(["file", "block", "quoted", "escaped", "depth", "inside"]).slice(0).to_pylist()}
            for file, block, raw in _portions([batch.select(["value", "file", "block"])]):
                if (file, block) != at:
                    out += rest()
                    s = state[file, block]
                    at, scan, turn, inside = (file, block), _Scan(s["quoted"], s["depth"], s["escaped"]), 0, s["inside"]
                    open_ = s["depth"] > INSIDE and inside
                    carried = ["middle"] if open_ else []
                places, steps, depths = scan.marks(raw)
                kinds = np.frombuffer(raw, dtype=np.uint8)[places]
                start = 0
                # Brackets that open or close the array of features, or one in it.
                edge = np.flatnonzero(((steps > 0) & (depths <= INSIDE + 1)) | ((steps < 0) & (depths <= INSIDE)))
                for k in edge.tolist():
                    p, d = int(places[k]), int(depths[k])
                    if steps[k] > 0 and d == INSIDE:
                        inside = kinds[k] == 0x5B and raw[max(0, p - 64) : p].rstrip(b" \t\r\n:").endswith(b'"features"')
                    elif steps[k] > 0 and d == INSIDE + 1 and inside and kinds[k] == 0x7B:
                        open_, carried, start = True, ["head"], p
                    elif steps[k] < 0 and d == INSIDE and open_:
                        text = b"".join([*carried[1:], raw[start : p + 1]]).decode()
                        out.append((*at, turn, "whole" if carried[0] == "head" else "tail", text))
                        turn, open_, carried = turn + 1, False, []
                    elif steps[k] < 0 and d < INSIDE:
                        inside = False
                if open_:
                    carried.append(raw[start:])
                if out:
                    yield rows_of(out)
                    out = []
        out += rest()
        if out:
            yield rows_of(out)

    return pieces.mapInArrow(cut, PIECES)


def feature_texts(spark: SparkSession, path: str) -> DataFrame:
    """(text) of every feature of the collections at *path*, in order inside a range; splits as Spark makes them."""
    pieces = spark.read.option("lineSep", "}").text(path).select(
        "value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block")
    )
    starts = written(_starts(_summaries(pieces)), "feature-ranges")
    # One row for each range of a file.
    found = written(_cut(pieces.join(F.broadcast(starts), ["file", "block"]).select("value", "file", "block", "quoted", "escaped", "depth", "inside")), "feature-pieces")
    parts = found.where("kind <> 'whole'")
    order = Window.partitionBy("file").orderBy("block", "turn")
    # A piece without a beginning belongs to the last one that began.
    joined = (
        parts.withColumn("begun", F.sum((F.col("kind") == "head").cast("int")).over(order))
        .groupBy("file", "begun")
        .agg(F.array_sort(F.collect_list(F.struct("block", "turn", "text"))).alias("parts"))
        .select(F.concat_ws("", F.transform("parts", lambda p: p["text"])).alias("text"))
    )
    return found.where("kind = 'whole'").select("text").unionByName(joined)
