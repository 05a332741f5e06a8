"""Merkle fixity audit of WARC archives.

Records are numbered and laid into files of bounded size. The leaves of a
file's tree are its records: the SHA-256 of their bytes at their offset range.
An inner node is the SHA-256 of up to FANOUT nodes below it, each with its
offset range, and a file's root is the only node of its top level. Two replicas
are compared root by root; only below roots that differ are the nodes of the
next level looked at, down to the records.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from reachgrid.llm.texts import ordered_sums, written
from reachgrid.operators.sizes import if_small

FANOUT = 16
#: A record starts in a file before this many bytes.
FILE_BYTES = 8 << 20
END = "\r\n\r\n"


def record(page_id: Column, url: Column, html: Column) -> Column:
    """A WARC resource record as text, without the two line ends behind it; nulls are empty."""
    body = F.coalesce(html, F.lit(""))
    return F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:page:"),
        F.coalesce(page_id.cast("string"), F.lit("none")),
        F.lit(">\r\nWARC-Target-URI: "),
        F.coalesce(url, F.lit("")),
        F.lit("\r\nContent-Type: text/html\r\nContent-Length: "),
        F.octet_length(body).cast("string"),
        F.lit("\r\n\r\n"),
        body,
    )


def _key() -> list[Column]:
    whole = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("page_id", "url", "html")]
    return [F.xxhash64(*whole).alias("_k1"), F.xxhash64(F.lit("second"), *whole).alias("_k2")]


def layout(pages: DataFrame, file_bytes: int = FILE_BYTES) -> DataFrame:
    """(page_id, k1, k2, file, record, offset, length) of all records, in the order of page_id (nulls last).

    Rows that repeat page_id, url and html are one record. Only these narrow
    columns are sorted.
    """
    size = F.octet_length(record(F.col("page_id"), F.col("url"), F.col("html"))) + len(END)
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), *_key(), size.cast("long").alias("length"))
    rows = rows.groupBy("page_id", "_k1", "_k2").agg(F.max("length").alias("length")).withColumn("_one", F.lit(1))
    placed = ordered_sums(rows, ["page_id", "_k1", "_k2"], {"at": "length", "number": "_one"}, "layout")
    placed = placed.withColumn("file", F.floor(F.col("at") / file_bytes))
    first = placed.groupBy("file").agg(F.min("at").alias("_at"), F.min("number").alias("_number"))
    out = placed.join(first, "file").select(
        "page_id", F.col("_k1").alias("k1"), F.col("_k2").alias("k2"), "file",
        (F.col("number") - F.col("_number")).alias("record"), (F.col("at") - F.col("_at")).alias("offset"), "length",
    )
    return written(out, "warc-layout")


def records(pages: DataFrame, places: DataFrame, also: tuple[str, ...] = ()) -> DataFrame:
    """(file, record, offset, length, value): each record's text and place, and columns of the page."""
    keyed = pages.select("page_id", "url", "html", *_key())
    p = if_small(places.select("k1", "k2", "file", "record", "offset", "length"))
    met = keyed.join(p, (F.col("_k1") == F.col("k1")) & (F.col("_k2") == F.col("k2")))
    return met.select(*also, "file", "record", "offset", "length", record(F.col("page_id"), F.col("url"), F.col("html")).alias("value"))


def write_archive(rows: DataFrame, path: str) -> None:
    """Write records as WARC files, one folder for each file; Spark compresses the blocks of a file.

    A record that several pages repeat is written once.
    """
    if not rows.groupBy("file", "record").count().where("count > 1").isEmpty():
        rows = rows.groupBy("file", "record").agg(F.first("value").alias("value"))
    laid = rows.select("file", "record", "value").repartition("file").sortWithinPartitions("file", "record")
    laid.select("file", "value").write.mode("errorifexists").partitionBy("file").options(lineSep=END, compression="lz4").text(path)


def _levels(leaves: Column, fanout: int) -> Column:
    """Levels of a tree as arrays of (offset, end, hash), leaves first, until one node is left.

    The number of levels is bounded by a constant, enough for 16 ** 8 records.
    """

    def parents(nodes: Column) -> Column:
        count = F.ceil(F.size(nodes) / F.lit(fanout)).cast("int")

        def node(i: Column) -> Column:
            below = F.slice(nodes, (i * fanout + 1).cast("int"), fanout)
            spelt = F.array_join(F.transform(below, lambda c: F.concat_ws(":", c["offset"].cast("string"), c["end"].cast("string"), c["hash"])), ",")
            return F.struct(below[0]["offset"].alias("offset"), F.element_at(below, -1)["end"].alias("end"), F.sha2(spelt, 256).alias("hash"))

        return F.transform(F.sequence(F.lit(0), count - 1), node)

    def step(acc: Column, _: Column) -> Column:
        top = F.element_at(acc, -1)
        return F.when(F.size(top) > 1, F.concat(acc, F.array(parents(top)))).otherwise(acc)

    return F.aggregate(F.sequence(F.lit(1), F.lit(8)), F.array(leaves), step)


def _nodes(files: DataFrame, label: str, fanout: int) -> DataFrame:
    """(file, level, number, offset, end, hash, top) of all nodes, from (file, leaves); written by level.

    The level folders let a reader take only the level that it looks at.
    """
    levels = files.where(F.size("leaves") > 0).select("file", _levels(F.col("leaves"), fanout).alias("levels"))
    rows = levels.select("file", F.size("levels").alias("top"), F.posexplode("levels").alias("level", "nodes")).select(
        "file", "level", (F.col("level") == F.col("top") - 1).alias("top"), F.posexplode("nodes").alias("number", "node")
    )
    return written(rows.select("file", "level", "top", "number", "node.offset", "node.end", "node.hash"), label, ["level"])


def tree_of_records(rows: DataFrame, fanout: int = FANOUT, label: str = "tree") -> DataFrame:
    """Nodes over the records as they are in a table. All records of a file, as hashes, are in one row."""
    leaf = F.struct("record", "offset", (F.col("offset") + F.col("length")).alias("end"), F.sha2(F.concat("value", F.lit(END)), 256).alias("hash"))
    files = rows.select("file", leaf.alias("leaf")).groupBy("file").agg(F.sort_array(F.collect_set("leaf")).alias("leaves"))
    bare = F.transform("leaves", lambda x: F.struct(x["offset"].alias("offset"), x["end"].alias("end"), x["hash"].alias("hash")))
    return _nodes(files.select("file", bare.alias("leaves")), label, fanout)


def tree_of_archive(spark: SparkSession, path: str, places: DataFrame, fanout: int = FANOUT, label: str = "tree") -> DataFrame:
    """Nodes over the bytes of an archive at the offset ranges where the records were laid.

    A file is read as a whole, which its bounded size allows. A range beyond the
    end of a file hashes what is there of it; a missing file hashes nothing.
    """
    content = spark.read.schema("value string, file long").text(path, wholetext=True).select("file", F.col("value").cast("binary").alias("content"))
    ranges = places.groupBy("file").agg(F.sort_array(F.collect_set(F.struct("record", "offset", "length"))).alias("ranges"))
    node = pa.list_(pa.struct([("offset", pa.int64()), ("end", pa.int64()), ("hash", pa.string())]))

    def hashed(batches):
        for batch in batches:
            files = []
            for content, laid in zip(batch.column(1), batch.column(2).to_pylist()):
                whole = memoryview(content.as_buffer() if content.is_valid else b"")
                ends = [(r["offset"], r["offset"] + r["length"]) for r in laid]
                files.append([{"offset": a, "end": b, "hash": hashlib.sha256(whole[a:b]).hexdigest()} for a, b in ends])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(files, node)], names=["file", "leaves"])

    # A column expression would copy the whole file for each of its ranges.
    met = ranges.join(content, "file", "left").select("file", "content", "ranges")
    leaves = met.mapInArrow(hashed, "file long, leaves array<struct<offset: long, end: long, hash: string>>")
    return _nodes(leaves, label, fanout)


def audit(one: DataFrame, other: DataFrame, fanout: int = FANOUT) -> tuple[DataFrame, list[int]]:
    """((file, record) where the replicas differ, number of nodes compared at each level from the top).

    Levels are taken from the top of the highest tree. At each, the nodes
    compared are the roots of files whose tree ends there and the children of
    nodes that differed one level above. A node that one replica lacks differs.
    """
    spark = one.sparkSession
    deepest = one.agg(F.max("level")).first()[0]
    other_deepest = other.agg(F.max("level")).first()[0]
    compared: list[int] = []
    found = spark.createDataFrame([], "file long, number long")
    for level in range(max(x for x in (deepest, other_deepest, -1) if x is not None), -1, -1):
        a = one.where(F.col("level") == level).select("file", "number", "top", F.col("hash").alias("hash_a"))
        b = other.where(F.col("level") == level).select("file", "number", F.col("top").alias("top_b"), F.col("hash").alias("hash_b"))
        both = a.join(b, ["file", "number"], "full").withColumn("top", F.coalesce("top", F.lit(False)) | F.coalesce("top_b", F.lit(False)))
        open_nodes = found.select(F.col("file").alias("_file"), F.col("number").alias("_parent"))
        below = both.join(open_nodes, (F.col("file") == F.col("_file")) & (F.floor(F.col("number") / fanout) == F.col("_parent")), "left_semi")
        roots = both.where("top")
        met = written(below.unionByName(roots).dropDuplicates(["file", "number"]), "compared")
        compared.append(met.count())
        found = met.where(~F.col("hash_a").eqNullSafe(F.col("hash_b"))).select("file", "number")
    return found.select("file", F.col("number").cast("long").alias("record")), compared


def verdicts(places: DataFrame, one: DataFrame, damaged: DataFrame) -> DataFrame:
    """(page_id, file, record, offset, length, digest, intact) of every record laid out."""
    leaves = one.where("level = 0").select("file", F.col("number").cast("long").alias("record"), F.col("hash").alias("digest"))
    bad = damaged.withColumn("_bad", F.lit(True))
    rows = places.join(leaves, ["file", "record"], "left").join(bad, ["file", "record"], "left")
    return rows.select("page_id", "file", "record", "offset", "length", "digest", F.col("_bad").isNull().alias("intact"))
