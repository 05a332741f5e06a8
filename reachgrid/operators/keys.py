"""Surrogate ids, get-or-create and delete-then-insert on small reference tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from reachgrid.operators.ordering import number_rows
from reachgrid.operators.sizes import if_small


def top_id(df: DataFrame) -> DataFrame:
    """One row with the largest id, 0 when the table is empty."""
    return df.agg(F.coalesce(F.max("id"), F.lit(0)).cast("bigint").alias("_top")).withColumn("_one", F.lit(1))


def with_new_ids(new: DataFrame, existing: DataFrame, order: list[Column]) -> DataFrame:
    """Ids for *new* that go on after the largest id of *existing*, in *order*."""
    numbered = number_rows(new, order, "_n").withColumn("_one", F.lit(1))
    return (
        numbered.join(F.broadcast(top_id(existing)), "_one")
        .withColumn("id", (F.col("_top") + F.col("_n")).cast("bigint"))
        .drop("_one", "_top", "_n")
    )


def append_with_ids(existing: DataFrame, new: DataFrame, order: list[Column]) -> DataFrame:
    """Union that leaves the ids of *existing* as they are."""
    added = with_new_ids(new, existing, order)
    return existing.unionByName(added.select(*[F.col(c).cast(existing.schema[c].dataType) for c in existing.columns]))


def get_or_create(types: DataFrame, wanted: DataFrame, key: str = "code") -> DataFrame:
    """*types* plus one new row for every *wanted* key it lacks.

    *wanted* has the key, optionally an order column ``_first`` (order of first
    appearance) and the other columns of *types* but the id.
    """
    missing = wanted.join(types.select(key), key, "left_anti")
    order = [F.col("_first")] if "_first" in wanted.columns else []
    return append_with_ids(types, missing, [*order, F.col(key)])


def replace_types(existing: DataFrame, incoming: DataFrame, key: str = "type_id") -> DataFrame:
    """Rows of *existing* whose key does not come in again."""
    return existing.join(incoming.select(key).distinct(), key, "left_anti")


def remap(df: DataFrame, column: str, mapping: DataFrame) -> DataFrame:
    """Replace *column* through (old_id, new_id); rows without a new id are dropped."""
    return (
        df.join(if_small(mapping.select(F.col("old_id").alias(column), "new_id")), column)
        .withColumn(column, F.col("new_id"))
        .drop("new_id")
        .select(*df.columns)
    )
