"""Broadcast behind a check of the size."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

# Rows of a few narrow columns: some tens of megabytes on each executor.
BROADCAST_ROWS = 500_000


def is_small(df: DataFrame, rows: int | None = None) -> bool:
    """Whether *df* has at most *rows* rows, by a count that stops early."""
    rows = BROADCAST_ROWS if rows is None else rows
    return df.select(F.lit(1)).limit(rows + 1).count() <= rows


def if_small(df: DataFrame, rows: int | None = None) -> DataFrame:
    """Mark *df* for broadcast when it has at most *rows* rows, else leave it alone.

    Catalyst multiplies sizes across joins, so it shuffles a large table to meet
    a small one that is itself joined. A count that stops early settles it. A
    side that is too large is joined by shuffle, where AQE splits hot keys.
    """
    return F.broadcast(df) if is_small(df, rows) else df
