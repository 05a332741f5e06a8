"""Row numbers, order statistics and carry-forward without a single hot task."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

from reachgrid.session import written

SCAN = ["_file", "_block", "_pos"]


def scan_order(df: DataFrame) -> DataFrame:
    """Attach the place of each row in the files it was read from.

    (_file, _block, _pos) sorts rows in file order: a block is one file split
    and _pos rises within it. Apply directly to a file scan.
    """
    return df.select(
        "*",
        F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_pos"),
    )


def number_scan(df: DataFrame, out: str, start: int | Column = 0, file_order: Column | None = None) -> DataFrame:
    """1-based row numbers in file order, after *start*.

    Rows are numbered inside their file split (bounded by the split size); the
    offsets come from one count per split.
    """
    start = start if isinstance(start, Column) else F.lit(start)
    rank_file = file_order if file_order is not None else F.col("_file")
    df = df.withColumn("_rank", rank_file)
    sizes = df.groupBy("_rank", "_file", "_block").agg(F.count("*").alias("_size"))
    earlier = Window.orderBy("_rank", "_file", "_block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_file", "_block", F.coalesce(F.sum("_size").over(earlier), F.lit(0)).alias("_offset"))
    inside = Window.partitionBy("_file", "_block").orderBy("_pos")
    return (
        df.withColumn("_within", F.row_number().over(inside))
        .join(offsets, ["_file", "_block"])
        .withColumn(out, (start + F.col("_offset") + F.col("_within")).cast("bigint"))
        .drop("_rank", "_offset", "_within", *SCAN)
    )


def number_rows(df: DataFrame, order: list[Column], out: str, start: int | Column = 0) -> DataFrame:
    """Global row numbers in *order* (make it unique for a stable result).

    The rows are range-sorted and written once; reading the sorted files back
    gives the numbers, so no task ever holds more than one file split.
    """
    stored = written(df.orderBy(*order), "sorted")
    part = F.regexp_extract("_file", r"part-(\d+)", 1).cast("int")
    return number_scan(scan_order(stored), out, start, part).select(*df.columns, out)


def latest(df: DataFrame, key: str, by: str) -> DataFrame:
    """Row with the largest *by* per key; aggregates before the shuffle."""
    rest = [c for c in df.columns if c != key]
    ordered = F.struct(by, *[c for c in rest if c != by])
    return df.groupBy(key).agg(F.max(ordered).alias("_row")).select(key, *[F.col(f"_row.{c}").alias(c) for c in rest])


def fill_forward(df: DataFrame, columns: list[str]) -> DataFrame:
    """Carry the last value of each column forward in file order.

    Inside a split a running window does it; between splits only the last value
    of each split travels.
    """
    inside = Window.partitionBy("_file", "_block").orderBy("_pos").rowsBetween(Window.unboundedPreceding, 0)
    ends = df.groupBy("_file", "_block").agg(
        *[F.max(F.when(F.col(c).isNotNull(), F.struct("_pos", c)))[c].alias(f"_last_{c}") for c in columns]
    )
    before = Window.partitionBy("_file").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select(
        "_file", "_block", *[F.last(f"_last_{c}", ignorenulls=True).over(before).alias(f"_carry_{c}") for c in columns]
    )
    filled = df.select(
        *[c for c in df.columns if c not in columns],
        *[F.last(c, ignorenulls=True).over(inside).alias(c) for c in columns],
    ).join(carried, ["_file", "_block"], "left")
    for c in columns:
        filled = filled.withColumn(c, F.coalesce(F.col(c), F.col(f"_carry_{c}")))
    return filled.select(*df.columns)


def at_ranks(
    df: DataFrame,
    keys: list[str],
    value: str,
    ranks: dict[str, Callable[[Column], Column]],
    quantile: float = 0.5,
    accuracy: int = 10_000,
    few: bool = False,
) -> DataFrame:
    """Exact values at given 0-based ranks near *quantile*.

    Say *few* when the number of groups is bounded (modes, purposes): their
    bounds are then broadcast. Without keys there is one row.

    A sketch brackets the wanted ranks; one pass counts what lies below the
    bracket and one counts the distinct values inside it (about 4/accuracy of
    the rows). Only that remainder is ordered, so a group may be of any size.
    Ranks outside the bracket raise an error instead of giving a wrong value.
    """
    keyed = df.where(F.col(value).isNotNull()).select(
        *(keys or [F.lit(1).alias("_all")]), F.col(value).cast("double").alias("_v")
    )
    by = keys or ["_all"]
    margin = 2.0 / accuracy
    cut = F.percentile_approx("_v", [max(quantile - margin, 0.0), min(quantile + margin, 1.0)], accuracy)
    bounds = keyed.groupBy(*by).agg(F.count("*").alias("_n"), cut.alias("_cut"))
    bounds = bounds.select(*by, "_n", F.col("_cut")[0].alias("_from"), F.col("_cut")[1].alias("_to"))
    near = F.broadcast if few or not keys else lambda df: df
    placed = keyed.join(near(bounds), by)
    below = placed.groupBy(*by, "_n").agg(F.count(F.when(F.col("_v") < F.col("_from"), 1)).alias("_below"))
    inside = (
        placed.where((F.col("_v") >= F.col("_from")) & (F.col("_v") <= F.col("_to")))
        .groupBy(*by, "_v")
        .agg(F.count("*").alias("_c"))
    )
    running = Window.partitionBy(*by).orderBy("_v")
    spans = inside.join(near(below), by).withColumn("_end", F.col("_below") + F.sum("_c").over(running))
    picks, checks = [], []
    for name, rank in ranks.items():
        wanted = rank(F.col("_n")).cast("bigint")
        hit = (wanted >= F.col("_end") - F.col("_c")) & (wanted < F.col("_end"))
        picks.append(F.max(F.when(hit, F.col("_v"))).alias(name))
    found = spans.groupBy(*by, "_n").agg(*picks)
    for name in ranks:
        miss = F.raise_error(F.lit(f"rank {name} lies outside the bracket")).cast("double")
        checks.append(F.coalesce(F.col(name), miss).alias(name))
    return found.select(*keys, F.col("_n").alias("group_size"), *checks)


def median(df: DataFrame, keys: list[str], value: str, out: str, few: bool = False) -> DataFrame:
    """Exact interpolated median per group; *few* as in :func:`at_ranks`."""
    ranks = {"_lo": lambda n: F.floor((n - 1) / 2), "_hi": lambda n: F.ceil((n - 1) / 2)}
    return at_ranks(df, keys, value, ranks, few=few).select(
        *keys, (F.col("_lo") + (F.col("_hi") - F.col("_lo")) * 0.5).alias(out)
    )
