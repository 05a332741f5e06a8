"""Gravity accessibility, normalisation, combination and nearest destination.

Every step groups by the departure slot, so one job scores all slots: there is
no loop over slots or over batches of cells.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from reachgrid.functions.scoring import concave, impedance, scaled
from reachgrid.operators.sizes import if_small
from reachgrid.params import ScoreParams

GROUP = ["departure_time", "cell_id", "mode", "purpose"]
STRATUM = ["departure_time", "mode", "purpose"]


def typed_destinations(destinations: DataFrame, types: DataFrame, params: ScoreParams) -> DataFrame:
    """(destination_id, purpose, weight) of every destination whose type has a purpose."""
    purposes = types.select(F.col("id").alias("type_id"), params.purpose_of(F.col("code")).alias("purpose"))
    return destinations.join(purposes.where("purpose is not null"), "type_id").select(
        F.col("id").alias("destination_id"), "purpose", F.col("weight").cast("double")
    )


def unmapped_types(od: DataFrame, destinations: DataFrame, types: DataFrame, params: ScoreParams) -> DataFrame:
    """Destination types without a purpose and the OD rows they drop."""
    loose = types.where(params.purpose_of(F.col("code")).isNull())
    ids = destinations.join(loose.select(F.col("id").alias("type_id"), "code"), "type_id")
    # Rows per destination first: the join then sees one row per destination.
    per_dest = within(od, params).groupBy("destination_id").agg(F.count("*").alias("n"))
    return (
        per_dest.join(ids.select(F.col("id").alias("destination_id"), "code"), "destination_id")
        .groupBy("code")
        .agg(F.sum("n").alias("rows_dropped"))
    )


def within(
    od: DataFrame, params: ScoreParams, slots: list[str] | None = None, cells: DataFrame | None = None
) -> DataFrame:
    """OD rows inside the cut-off; slots prune partitions, *cells* is a semi join."""
    od = od.where(F.col("travel_time_minutes") <= params.max_minutes)
    if slots is not None:
        od = od.where(F.col("departure_time").isin(slots))
    if cells is not None:
        wanted = cells.select(F.col("id").alias("origin_cell_id"))
        od = od.join(if_small(wanted), "origin_cell_id", "left_semi")
    return od


def reached(
    od: DataFrame,
    destinations: DataFrame,
    types: DataFrame,
    params: ScoreParams,
    slots: list[str] | None = None,
    cells: DataFrame | None = None,
) -> DataFrame:
    """OD rows with purpose and contribution.

    The destinations are broadcast when they are few enough, so the travel
    times are not shuffled before they are summed; otherwise AQE splits a
    destination that dominates.
    """
    dest = if_small(typed_destinations(destinations, types, params))
    minutes, mode, purpose = F.col("travel_time_minutes"), F.col("mode"), F.col("purpose")
    return (
        within(od, params, slots, cells)
        .join(dest, "destination_id")
        .select(
            "departure_time",
            F.col("origin_cell_id").alias("cell_id"),
            "mode",
            "purpose",
            "destination_id",
            "travel_time_minutes",
            (F.col("weight") * impedance(minutes, params.alpha_of(mode, purpose))).alias("contribution"),
        )
    )


def gravity(rows: DataFrame, params: ScoreParams) -> DataFrame:
    """Raw sum and concave score per (slot, cell, mode, purpose)."""
    raw = rows.groupBy(*GROUP).agg(F.sum("contribution").alias("raw_score"))
    return raw.withColumn("score", concave(F.col("raw_score"), params.beta))


def nearest(rows: DataFrame, max_minutes: float) -> DataFrame:
    """Fewest minutes and the destination that gives them; ties go to the smallest id."""
    out = rows.groupBy(*GROUP).agg(*_closest(max_minutes))
    return out.select(*GROUP, *_unpacked())


def gravity_and_nearest(rows: DataFrame, params: ScoreParams) -> DataFrame:
    """Both measures in one pass and one shuffle."""
    out = rows.groupBy(*GROUP).agg(F.sum("contribution").alias("raw_score"), *_closest(params.max_minutes))
    return out.select(*GROUP, "raw_score", concave(F.col("raw_score"), params.beta).alias("score"), *_unpacked())


ID_SPAN = "100000000000000000000"
ID_SHIFT = "9223372036854775808"


def _closest(max_minutes: float) -> list[Column]:
    """Aggregates for the minimum and its smallest id, as plain numbers.

    A minimum over a struct would make Spark sort all rows. One decimal that
    holds minutes in front and the id behind keeps the hash aggregation; minutes
    closer than 1e-15 (for a cut-off below 1000) count as a tie.
    """
    digits = 18 - len(str(int(max_minutes)))
    front = (F.col("travel_time_minutes") * F.lit(float(10**digits))).cast("decimal(18,0)")
    span, shift = (F.lit(v).cast(f"decimal({n},0)") for v, n in ((ID_SPAN, 21), (ID_SHIFT, 19)))
    packed = front * span + (F.col("destination_id").cast("decimal(19,0)") + shift)
    return [F.min("travel_time_minutes").alias("min_travel_time_minutes"), F.min(packed).alias("packed")]


def _unpacked() -> list:
    span, shift = (F.lit(v).cast(f"decimal({n},0)") for v, n in ((ID_SPAN, 21), (ID_SHIFT, 19)))
    nearest_id = (F.col("packed") % span - shift).cast("bigint")
    return ["min_travel_time_minutes", nearest_id.alias("nearest_destination_id")]


def extremes(df: DataFrame, value: str, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.min(value).alias("low"), F.max(value).alias("high"))


def minmax(df: DataFrame, value: str, keys: list[str], out: str) -> DataFrame:
    """Min-max within *keys*.

    The extremes have one row per stratum - half-hour slots times configured
    modes and purposes, so at most a few thousand - and are broadcast; a window
    would put every cell of a purpose into one task.
    """
    low_high = F.broadcast(extremes(df, value, keys))
    return (
        df.join(low_high, keys)
        .withColumn(out, scaled(F.col(value), F.col("low"), F.col("high")))
        .drop("low", "high")
    )


def rescaled_weights(strata: DataFrame, params: ScoreParams) -> DataFrame:
    """Weights ``w`` rescaled to sum to 1 per (slot, mode) over the purposes present.

    *strata* has one row per (slot, mode, purpose); the window is over those few
    rows. Strata without a weight, or in a mode whose weights sum to nothing, get null.
    """
    weighted = strata.withColumn("w", params.weight_of(F.col("mode"), F.col("purpose")))
    total = F.sum("w").over(Window.partitionBy("departure_time", "mode"))
    return weighted.withColumn("_total", total).withColumn("w", F.when(F.col("_total") > 0, F.col("w") / F.col("_total"))).drop("_total")


def normalised(scores: DataFrame, strata: DataFrame) -> DataFrame:
    """Scores with ``score_normalized`` and weight ``w`` from one small broadcast.

    *strata* comes from :func:`extremes` and :func:`rescaled_weights`.
    """
    return scores.join(F.broadcast(strata), STRATUM).withColumn(
        "score_normalized", scaled(F.col("score"), F.col("low"), F.col("high"))
    )


def combine(weighted: DataFrame) -> DataFrame:
    """Weighted sum per (slot, cell) of normalised rows, then min-max within the slot."""
    summed = (
        weighted.where("w is not null")
        .groupBy("departure_time", "cell_id")
        .agg(F.sum(F.col("w") * F.col("score_normalized")).alias("combined_score"))
    )
    return minmax(summed, "combined_score", ["departure_time"], "combined_score_normalized")


def weights_json(params: ScoreParams) -> Column:
    literal = F.create_map(
        *[
            part
            for mode, inner in params.weights.items()
            for part in (
                F.lit(mode),
                F.create_map(*[x for p, w in inner.items() for x in (F.lit(p), F.lit(float(w)))]),
            )
        ]
    )
    return F.to_json(literal)
