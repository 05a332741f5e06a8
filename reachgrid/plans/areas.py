"""Rankings and details of municipalities, comarcas and drawn areas."""

from __future__ import annotations

import json
from typing import Any

from pyspark.sql import DataFrame, functions as F

from reachgrid.functions.scoring import weighted_mean
from reachgrid.operators.contain import contains, polygon_edges
from reachgrid.params import check_code, check_slot
from reachgrid.plans.region import by_purpose, coverage_of, labelled, scored_cells
from reachgrid.schemas import LAYERS, RINGS
from reachgrid.session import written
from reachgrid.workspace import Workspace


def area_scores(ws: Workspace, layer: str, slot: str, null_mode: str = "zero", code: str | None = None) -> DataFrame:
    """Cells, population and scores per area; cells on a border count in both areas.

    Grouping is by the short area code with partial sums, so one large area
    does not collect its cells in one task.
    """
    inside = ws.area_cells(layer, code)
    cells = scored_cells(ws, slot).join(inside, "id")
    found = cells.groupBy("code").agg(
        F.count("*").alias("cell_count"),
        F.coalesce(F.sum("population"), F.lit(0.0)).alias("population"),
        F.avg("score").alias("avg_score"),
        weighted_mean(F.col("score"), F.col("population"), null_mode).alias("weighted_avg_score"),
    )
    names = ws.table(layer).select(F.col(LAYERS[layer]).cast("string").alias("code"), "name")
    return names.join(found, "code").select("name", "code", "cell_count", "population", "avg_score", "weighted_avg_score")


def area_ranking(ws: Workspace, layer: str, slot: str) -> DataFrame:
    return area_scores(ws, layer, slot).orderBy(F.desc_nulls_last("weighted_avg_score"), "code")


def area_purposes(ws: Workspace, layer: str, slot: str, code: str | None = None, inside: DataFrame | None = None) -> DataFrame:
    """Purpose breakdown per area."""
    members = _members(ws, layer, code, inside)
    scores = by_purpose(ws.at("connectivity_scores", slot).join(members, "cell_id"), ["code", "mode", "purpose"])
    minutes = (
        ws.at("min_travel_times", slot)
        .join(members, "cell_id")
        .groupBy("code", "mode", "purpose")
        .agg(F.avg("min_travel_time_minutes").alias("avg_travel_time"))
    )
    return labelled(scores.join(minutes, ["code", "mode", "purpose"], "left"), ws)


def area_coverage(ws: Workspace, layer: str, slot: str, code: str | None = None, inside: DataFrame | None = None) -> DataFrame:
    """Service coverage per area."""
    members = _members(ws, layer, code, inside)
    return coverage_of(ws.at("min_travel_times", slot).join(members, "cell_id"), ["code", "purpose", "mode"], ws)


def _members(ws: Workspace, layer: str, code: str | None, inside: DataFrame | None) -> DataFrame:
    pairs = inside if inside is not None else ws.area_cells(layer, code)
    return ws.table("grid_cells").select("id", "population").join(pairs, "id").withColumnRenamed("id", "cell_id")


def area_detail(ws: Workspace, layer: str, code: str, slot: str) -> dict[str, DataFrame]:
    """Summary, purposes and coverage of one area.

    The cells of the area are found once and written; the reports reuse them.
    """
    check_code(code)
    check_slot(slot)
    inside = written(ws.area_cells(layer, code), f"inside-{layer}")
    if inside.isEmpty():
        raise LookupError(f"area {code!r} not found in {layer}")
    local = Workspace(ws.spark, ws.root, ws.tenant, {**ws.frames, f"{layer}_cells": inside})
    return {
        "summary": area_scores(local, layer, slot, code=code),
        "purposes": area_purposes(local, layer, slot, code, inside),
        "coverage": area_coverage(local, layer, slot, code, inside),
    }


def geojson_edges(ws: Workspace, geometry: str | dict[str, Any]) -> DataFrame:
    """Edges of one drawn polygon, keyed by ``code`` = 'drawn'; raises on bad geometry."""
    try:
        shape = json.loads(geometry) if isinstance(geometry, str) else geometry
        parts = {"Polygon": lambda c: [c], "MultiPolygon": lambda c: c}[shape["type"]](shape["coordinates"])
        rings = [
            (i, j, [(float(x), float(y)) for x, y, *_ in ring])
            for i, part in enumerate(parts)
            for j, ring in enumerate(part)
        ]
    except (KeyError, TypeError, ValueError) as exc:
        raise ValueError("the geometry is not a GeoJSON polygon") from exc
    row = ws.spark.createDataFrame([("drawn", rings)], f"code string, rings {RINGS}")
    return polygon_edges(row, "code")


def area_stats(ws: Workspace, geometry: str | dict[str, Any], slot: str | None = None, crs: str = "degrees") -> DataFrame:
    """Figures for cells whose centroid lies in a drawn polygon of lon/lat, or of projected metres.

    Without a slot every scored slot of a cell counts as its own row.
    """
    if crs not in ("degrees", "metres"):
        raise ValueError("crs must be degrees or metres")
    if crs == "degrees":
        points = ws.table("grid_cells").select("id", F.col("lon").alias("x"), F.col("lat").alias("y"))
        inside = contains(points, geojson_edges(ws, geometry), "code", tile=0.05)
    else:
        inside = contains(ws.centroids(), geojson_edges(ws, geometry), "code")
    return stats_of(ws, inside, slot)


def stats_of(ws: Workspace, inside: DataFrame, slot: str | None = None) -> DataFrame:
    combined = ws.table("combined_scores")
    if slot is not None:
        combined = combined.where(F.col("departure_time") == check_slot(slot))
    cells = ws.table("grid_cells").select("id", "population").join(inside.select("id"), "id", "left_semi")
    rows = cells.join(
        combined.select(F.col("cell_id").alias("id"), F.col("combined_score_normalized").alias("score")), "id", "left"
    )
    return rows.agg(
        F.count("*").alias("cell_count"),
        F.coalesce(F.sum("population"), F.lit(0.0)).alias("population"),
        F.avg("score").alias("avg_combined_score"),
        weighted_mean(F.col("score"), F.col("population"), "strict").alias("weighted_avg_combined_score"),
    )


def score_gap(ranking: DataFrame) -> DataFrame:
    """Score of the first area less that of the last; unscored areas stand at the end with 0.

    One aggregate over (rank key, score): no sort is needed.
    """
    score = F.col("weighted_avg_score")
    key = F.struct(score.isNotNull().alias("k"), score.alias("s"))
    ends = ranking.agg(F.max(key)["s"].alias("top"), F.min(key)["s"].alias("bottom"))
    zero = F.lit(0.0)
    return ends.select((F.coalesce("top", zero) - F.coalesce("bottom", zero)).alias("score_gap"))


def findings(
    ranking: DataFrame,
    purposes: DataFrame,
    cover: DataFrame,
    region_purposes: DataFrame,
    region_cover: DataFrame,
) -> DataFrame:
    """What stands out in each area of *purposes*.

    Ranks come from a range sort of the ranking; everything else is grouped by area.
    """
    zero = F.lit(0.0)
    score = F.coalesce("weighted_avg_score", zero)
    base = region_purposes.groupBy("purpose").agg(F.max_by("weighted_avg_score", "mode").alias("r"))
    judged = purposes.join(base, "purpose", "left").withColumn("above", score > F.coalesce("r", zero))
    best = F.struct((-score).alias("s"), "purpose", "mode")
    extremes = judged.groupBy("code").agg(
        F.min(best).alias("best"),
        F.max(best).alias("worst"),
        F.count_if("above").alias("above_region"),
        F.count_if(~F.col("above")).alias("below_region"),
    )
    cov = region_cover.groupBy("purpose").agg(F.max_by("pct_pop_30min", "mode").alias("region_pct"))
    gap = F.coalesce("region_pct", zero) - F.col("pct_pop_30min")
    gaps = (
        cover.join(cov, "purpose", "left")
        .groupBy("code")
        .agg(
            F.min(F.struct("pct_pop_30min", "purpose")).alias("low"),
            F.min(F.struct((-gap).alias("g"), "purpose")).alias("gap"),
        )
    )
    placed = ranks(ranking)
    third = F.ceil(F.col("total") / 3)
    two_thirds = F.ceil(F.col("total") * 2 / 3)
    return (
        extremes.join(gaps, "code", "left")
        .join(placed, "code", "left")
        .select(
            "code",
            "rank",
            "total",
            F.when(F.col("rank") <= third, "top").when(F.col("rank") > two_thirds, "bottom").otherwise("middle").alias("tercile"),
            F.col("best.purpose").alias("best_purpose"),
            (-F.col("best.s")).alias("best_score"),
            F.col("worst.purpose").alias("worst_purpose"),
            (-F.col("worst.s")).alias("worst_score"),
            "above_region",
            "below_region",
            F.col("low.purpose").alias("lowest_coverage_purpose"),
            F.col("low.pct_pop_30min").alias("lowest_coverage_pct"),
            F.col("gap.purpose").alias("biggest_gap_purpose"),
            (-F.col("gap.g")).alias("biggest_gap"),
        )
    )


def ranks(ranking: DataFrame) -> DataFrame:
    """(code, rank, total) of a ranking, by a range sort that no single task holds."""
    from reachgrid.operators.ordering import number_rows

    rows = ranking.select("code", "weighted_avg_score")
    numbered = number_rows(rows, [F.desc_nulls_last("weighted_avg_score"), F.col("code").asc()], "rank")
    total = numbered.agg(F.count("*").alias("total")).withColumn("_one", F.lit(1))
    return numbered.withColumn("_one", F.lit(1)).join(F.broadcast(total), "_one").select("code", "rank", "total")


def terciles(ranking: DataFrame) -> DataFrame:
    third, two_thirds = F.ceil(F.col("total") / 3), F.ceil(F.col("total") * 2 / 3)
    return ranks(ranking).withColumn(
        "tercile", F.when(F.col("rank") <= third, 1).when(F.col("rank") > two_thirds, 3).otherwise(2)
    )
