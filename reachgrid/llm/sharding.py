"""Rendezvous hashing of records over weighted shards.

Every shard draws a number for a record from their common hash, scaled by the
shard's weight, and the least number wins. A shard more or less moves only the
records that it takes or held; all others keep their order of preference.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from reachgrid.llm.texts import ordered_sums, text_key


def draw(key: Column, shard: Column, weight: Column) -> Column:
    """An exponential variate of rate *weight*, fixed by key and shard."""
    bits = F.shiftrightunsigned(F.xxhash64(key, shard.cast("int")), 11)
    return -F.log((bits + F.lit(0.5)) / F.lit(float(1 << 53))) / weight


def shard_of(key: Column, weights: list[float]) -> Column:
    """Shard, from 0, for a long key; shard i has share weights[i] / sum(weights) of the keys."""
    if not weights or min(weights) < 0 or max(weights) == 0:
        raise ValueError("weights must not be negative, and one must be positive")
    shards = F.array(*[F.struct(F.lit(i).alias("id"), F.lit(float(w)).alias("w")) for i, w in enumerate(weights) if w > 0])
    drawn = F.transform(shards, lambda s: F.struct(draw(key, s["id"], s["w"]).alias("d"), s["id"].alias("id")))
    return F.array_min(drawn)["id"]


def record_key(doc_id: Column, text: Column) -> Column:
    """The stable key: the id, or the text where it is null."""
    return F.coalesce(F.xxhash64(F.lit("id"), doc_id.cast("long")) + F.when(doc_id.isNull(), F.lit(None).cast("long")).otherwise(0), F.xxhash64(F.lit("text"), F.coalesce(text, F.lit(""))))


def assign(docs: DataFrame, weights: list[float]) -> DataFrame:
    """*docs* with its shard, by doc_id; see :func:`shard_of`. A column named shard is replaced.

    A null doc_id is keyed by its text. Rows of one doc_id share a shard,
    whatever their text, and so do repeated rows.
    """
    return docs.withColumn("shard", shard_of(record_key(F.col("doc_id"), F.col("text")), weights))


def slots(docs: DataFrame, weights: list[float], grown: float = 1.0) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) of every row of *docs* (doc_id, text).

    size is the UTF-8 bytes of the text plus 8, slot counts the rows of a shard
    from 0 in the order of doc_id (nulls last) and text hash without gaps, and
    grown_shard is the shard with one more shard of weight *grown*. A null text
    counts as empty. Repeated rows have slots of their own. Only these narrow
    columns are shuffled; no shard is ever one task's work.
    """
    text = F.coalesce("text", F.lit(""))
    key = record_key(F.col("doc_id"), F.col("text"))
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(text) + 8).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.lit("key").alias("law"),
        shard_of(key, weights).alias("shard"),
        shard_of(key, [*weights, grown]).alias("grown_shard"),
        text_key(F.col("text"))[0],
        F.lit(1).alias("_one"),
    )
    placed = ordered_sums(rows, ["shard", "doc_id", "_k1"], {"slot": "_one"}, "shards", by="shard")
    return placed.select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


def write_shards(docs: DataFrame, weights: list[float], path: str) -> None:
    """Write *docs* as Parquet with a folder for each shard; a shard is split over as many tasks as its size needs."""
    assign(docs, weights).hint("rebalance", "shard").write.mode("errorifexists").partitionBy("shard").parquet(path)
