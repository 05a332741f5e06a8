"""Region-wide indicators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from reachgrid.functions.bands import histogram_bucket
from reachgrid.functions.numbers import pct
from reachgrid.functions.scoring import weighted_mean
from reachgrid.operators.ordering import median
from reachgrid.params import check_slot
from reachgrid.workspace import Workspace

LIMITS = (15, 30, 45, 60)


def scored_cells(ws: Workspace, slot: str, how: str = "left") -> DataFrame:
    """Cells with population and combined score at one slot."""
    check_slot(slot)
    combined = ws.at("combined_scores", slot).select("cell_id", F.col("combined_score_normalized").alias("score"))
    cells = ws.table("grid_cells").select("id", "population")
    return cells.join(combined, cells.id == combined.cell_id, how).select("id", "population", "score", "cell_id")


def summary(ws: Workspace, slot: str) -> DataFrame:
    """One row of key figures; optional tables that are missing count as 0."""
    cells = scored_cells(ws, slot)
    main = cells.agg(
        F.count("*").alias("total_cells"),
        F.count_if(F.col("population") > 0).alias("populated_cells"),
        F.coalesce(F.sum("population"), F.lit(0.0)).alias("total_population"),
        F.count("cell_id").alias("cells_with_scores"),
        F.avg("score").alias("avg_score"),
        weighted_mean(F.col("score"), F.col("population")).alias("weighted_avg_score"),
    )
    middle = median(cells, [], "score", "median_score")
    out = _beside(main, middle)
    for name, label in (
        ("destinations", "destination_count"),
        ("gtfs_stops", "transit_stop_count"),
        ("gtfs_routes", "transit_route_count"),
        ("municipalities", "municipality_count"),
        ("comarcas", "comarca_count"),
    ):
        out = _beside(out, ws.table(name, required=False).agg(F.count("*").alias(label)))
    return out


def _beside(left: DataFrame, right: DataFrame) -> DataFrame:
    """Put the single row of *right* next to the rows of *left*."""
    one = F.lit(1).alias("_one")
    return left.select("*", one).join(F.broadcast(right.select("*", one)), "_one", "left").drop("_one")


def histogram(ws: Workspace, slot: str) -> DataFrame:
    """Ten buckets of the combined score with cells and population; empty ones are 0."""
    counted = (
        scored_cells(ws, slot, "inner")
        .where("score is not null")
        .groupBy(histogram_bucket(F.col("score")).alias("bucket"))
        .agg(F.count("*").alias("cell_count"), F.sum("population").alias("population"))
    )
    frame = ws.spark.range(1, 11).select(F.col("id").cast("int").alias("bucket"))
    high, low = F.col("bucket") * 10, (F.col("bucket") - 1) * 10
    return frame.join(F.broadcast(counted), "bucket", "left").select(
        "bucket",
        F.concat_ws("-", low.cast("string"), high.cast("string")).alias("range_label"),
        low.cast("double").alias("range_min"),
        high.cast("double").alias("range_max"),
        F.coalesce("cell_count", F.lit(0)).alias("cell_count"),
        F.coalesce("population", F.lit(0.0)).alias("population"),
    )


def low_share(hist: DataFrame, total_population: DataFrame | None = None, upto: float = 30) -> DataFrame:
    """Population in the low buckets and its share of *total_population* (one row)."""
    low = hist.agg(
        F.coalesce(F.sum(F.when(F.col("range_max") <= upto, F.col("population"))), F.lit(0.0)).alias("low_population"),
        F.sum("population").alias("scored_population"),
    )
    if total_population is None:
        low = low.withColumn("total_population", F.col("scored_population"))
    else:
        low = _beside(low, total_population.select("total_population"))
    return low.select(
        "low_population", "total_population", pct(F.col("low_population"), F.col("total_population"), None).alias("low_pct")
    )


def labelled(df: DataFrame, ws: Workspace) -> DataFrame:
    """Purpose label from the destination types; the code where none is known."""
    labels = ws.table("destination_types").select(F.col("code").alias("purpose"), "label")
    return df.join(labels, "purpose", "left").withColumn("purpose_label", F.coalesce("label", "purpose")).drop("label")


def by_purpose(facts: DataFrame, keys: list[str]) -> DataFrame:
    return facts.groupBy(*keys).agg(
        F.avg("score_normalized").alias("avg_score"),
        weighted_mean(F.col("score_normalized"), F.col("population")).alias("weighted_avg_score"),
        F.count("*").alias("cell_count"),
    )


def purpose_breakdown(ws: Workspace, slot: str) -> DataFrame:
    """Scores and mean minutes per mode and purpose."""
    check_slot(slot)
    cells = ws.table("grid_cells").select(F.col("id").alias("cell_id"), "population")
    scores = by_purpose(ws.at("connectivity_scores", slot).join(cells, "cell_id"), ["mode", "purpose"])
    minutes = (
        ws.at("min_travel_times", slot)
        .groupBy("mode", "purpose")
        .agg(F.avg("min_travel_time_minutes").alias("avg_travel_time"))
    )
    return labelled(scores.join(minutes, ["mode", "purpose"], "left"), ws)


def reached_population(limits: tuple[int, ...] = LIMITS) -> list[Column]:
    near = [
        F.coalesce(F.sum(F.when(F.col("min_travel_time_minutes") <= m, F.col("population"))), F.lit(0.0)).alias(f"pop_{m}min")
        for m in limits
    ]
    return [
        F.count("*").alias("total_cells"),
        F.coalesce(F.sum("population"), F.lit(0.0)).alias("total_population"),
        *near,
        F.avg("min_travel_time_minutes").alias("avg_travel_time"),
    ]


def coverage_of(facts: DataFrame, keys: list[str], ws: Workspace, limits: tuple[int, ...] = LIMITS) -> DataFrame:
    # Modes and purposes are configured and few; areas may be many.
    middle = median(facts, keys, "min_travel_time_minutes", "median_travel_time", few="code" not in keys)
    out = facts.groupBy(*keys).agg(*reached_population(limits)).join(middle, keys, "left")
    shares = {f"pct_pop_{m}min": pct(F.col(f"pop_{m}min"), F.col("total_population"), None) for m in limits}
    return labelled(out.withColumns(shares), ws)


def coverage(ws: Workspace, slot: str, limits: tuple[int, ...] = LIMITS) -> DataFrame:
    """Population within the time limits, per purpose and mode.

    The denominator holds only cells that reach a destination of the purpose.
    """
    check_slot(slot)
    cells = ws.table("grid_cells").select(F.col("id").alias("cell_id"), "population")
    return coverage_of(ws.at("min_travel_times", slot).join(cells, "cell_id"), ["purpose", "mode"], ws, limits)


def coverage_bands(cov: DataFrame) -> DataFrame:
    """Exclusive bands from the cumulative shares; never negative."""
    edges = [f"pct_pop_{m}min" for m in LIMITS]
    bands = {"band_lt15": F.col(edges[0])}
    for low, high, name in zip(edges, edges[1:], ("band_15_30", "band_30_45", "band_45_60")):
        bands[name] = F.greatest(F.col(high) - F.col(low), F.lit(0.0))
    bands["band_gt60"] = F.greatest(100.0 - F.col(edges[-1]), F.lit(0.0))
    return cov.select("purpose", "mode", *[c.alias(n) for n, c in bands.items()])


def deserts(cov: DataFrame) -> DataFrame:
    """Services by 30-minute coverage, worst first, with the people not reached."""
    return cov.select(
        "purpose",
        "mode",
        "pct_pop_30min",
        (F.col("total_population") - F.col("pop_30min")).alias("unreached_30"),
        (F.col("total_population") - F.col("pop_60min")).alias("unreached_60"),
    ).orderBy("pct_pop_30min", "purpose", "mode")


def compare(area: DataFrame, region: DataFrame) -> DataFrame:
    """Area scores against region scores by purpose; the smallest difference first."""
    base = region.groupBy("purpose").agg(F.max_by("weighted_avg_score", "mode").alias("r"))
    zero = F.lit(0.0)
    keep = [c for c in ("code", "mode") if c in area.columns]
    out = area.join(base, "purpose", "left").select(
        *keep,
        "purpose",
        F.coalesce("weighted_avg_score", zero).alias("area"),
        F.coalesce("r", zero).alias("region"),
    )
    return out.withColumn("delta", F.col("area") - F.col("region")).orderBy("delta", "purpose")
