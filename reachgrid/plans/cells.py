"""Per-cell metrics, coarser grids and single-cell detail."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from reachgrid.functions.geo import cell_xy, code_of
from reachgrid.functions.scoring import weighted_mean
from reachgrid.params import METRICS, RESOLUTIONS, check_choice, check_slot
from reachgrid.sources.sinks import square_geometry, to_features
from reachgrid.workspace import Workspace

BASE = ["id", "cell_code", "x0", "y0", "size", "population"]


def cell_metric(
    ws: Workspace, slot: str, mode: str | None = None, purpose: str | None = None, metric: str = "score"
) -> DataFrame:
    """Every cell with one number, null where nothing was scored.

    Travel time keeps the minimum over modes when only the purpose is given and
    the mean otherwise; scores are averaged, and the combined score is used when
    neither is given. The right side is filtered before the outer join.
    """
    check_slot(slot)
    check_choice(metric, METRICS, "metric")
    if metric == "score" and mode is None and purpose is None:
        facts = ws.at("combined_scores", slot).select("cell_id", F.col("combined_score_normalized").alias("score"))
    else:
        name, value = (
            ("min_travel_times", "min_travel_time_minutes")
            if metric == "travel_time"
            else ("connectivity_scores", "score_normalized")
        )
        facts = ws.at(name, slot)
        if mode is not None:
            facts = facts.where(F.col("mode") == mode)
        if purpose is not None:
            facts = facts.where(F.col("purpose") == purpose)
        if mode is not None and purpose is not None:
            facts = facts.select("cell_id", F.col(value).alias("score"))
        else:
            fold = F.min if metric == "travel_time" and purpose is not None else F.avg
            facts = facts.groupBy("cell_id").agg(fold(value).alias("score"))
    cells = ws.table("grid_cells").select(*BASE)
    return cells.join(facts, cells.id == facts.cell_id, "left").select(*BASE, "score")


def rollup(cells: DataFrame, resolution: int) -> DataFrame:
    """Group 250 m cells into 500 m or 1 km squares, by integer division of the code."""
    check_choice(resolution, RESOLUTIONS, "resolution")
    east, north = cell_xy(F.col("cell_code"))
    res = F.lit(resolution)
    return (
        cells.withColumns({"_e": F.floor(east / res) * res, "_n": F.floor(north / res) * res})
        .groupBy("_e", "_n")
        .agg(
            F.sum("population").alias("population"),
            weighted_mean(F.col("score"), F.col("population"), "scored").alias("score"),
            F.min("x0").alias("xmin"),
            F.min("y0").alias("ymin"),
            F.max(F.col("x0") + F.col("size")).alias("xmax"),
            F.max(F.col("y0") + F.col("size")).alias("ymax"),
        )
        .select(code_of(F.col("_e"), F.col("_n")).alias("cell_code"), "population", "score", "xmin", "ymin", "xmax", "ymax")
    )


def cell_features(
    ws: Workspace,
    slot: str,
    mode: str | None = None,
    purpose: str | None = None,
    metric: str = "score",
    resolution: int = 250,
) -> DataFrame:
    """The cell map as GeoJSON features, in projected coordinates."""
    check_choice(resolution, RESOLUTIONS, "resolution")
    cells = cell_metric(ws, slot, mode, purpose, metric)
    if resolution == 250:
        far = (F.col("x0") + F.col("size"), F.col("y0") + F.col("size"))
        return to_features(
            cells, square_geometry(F.col("x0"), F.col("y0"), *far), ["cell_code", "population", "score", "id"]
        )
    box = square_geometry(*(F.col(c) for c in ("xmin", "ymin", "xmax", "ymax")))
    return to_features(rollup(cells, resolution), box, ["cell_code", "population", "score"])


def cell_detail(ws: Workspace, slot: str, cell_id: int | None = None) -> DataFrame:
    """Combined score and the list of scores of one cell, or of every cell."""
    check_slot(slot)
    cells, scores, combined = (
        ws.table("grid_cells"),
        ws.at("connectivity_scores", slot),
        ws.at("combined_scores", slot),
    )
    if cell_id is not None:
        cells = cells.where(F.col("id") == cell_id)
        scores, combined = (t.where(F.col("cell_id") == cell_id) for t in (scores, combined))
    # A cell has one row per mode and purpose, so the list is short.
    listed = scores.groupBy("cell_id").agg(
        F.array_sort(F.collect_list(F.struct("mode", "purpose", "score", "score_normalized"))).alias("scores")
    )
    return (
        cells.select(F.col("id").alias("cell_id"), "cell_code", "population")
        .join(combined.select("cell_id", "combined_score", "combined_score_normalized"), "cell_id", "left")
        .join(listed, "cell_id", "left")
        .withColumnRenamed("cell_id", "id")
    )


def slots(ws: Workspace) -> DataFrame:
    """Departure slots that have scores, in order."""
    return ws.table("connectivity_scores").select("departure_time").distinct().orderBy("departure_time")
