"""Transit stops, routes, operators and service frequency."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, functions as F

from reachgrid.functions.bands import frequency_band
from reachgrid.workspace import Workspace

# Colour per GTFS route type, and the default.
ROUTE_COLOURS = {
    0: "#e11d48",
    1: "#dc2626",
    2: "#7c3aed",
    3: "#2563eb",
    4: "#0891b2",
    5: "#6b7280",
    6: "#6b7280",
    7: "#a855f7",
}
DEFAULT_COLOUR = "#2563eb"


def route_colour(own: Column, route_type: Column) -> Column:
    by_type = F.create_map(*[F.lit(v) for pair in ROUTE_COLOURS.items() for v in pair])
    return F.when(F.length(own) > 0, F.concat(F.lit("#"), own)).otherwise(
        F.coalesce(F.try_element_at(by_type, route_type), F.lit(DEFAULT_COLOUR))
    )


def transit_stops(ws: Workspace, operator: str | None = None, n: int | None = None) -> DataFrame:
    """All stops by id, or the first *n*, optionally of one operator."""
    stops = ws.table("gtfs_stops", required=False)
    if operator:
        stops = stops.where(F.col("operator") == operator)
    return _first(stops.select("id", "operator", "stop_id", "stop_name", "lon", "lat").orderBy("id"), n)


def transit_routes(ws: Workspace, operator: str | None = None, n: int | None = None) -> DataFrame:
    """All routes with geometry by id, or the first *n*, with their display colour."""
    routes = ws.table("gtfs_routes", required=False).where(F.col("lines").isNotNull())
    if operator:
        routes = routes.where(F.col("operator") == operator)
    shown = routes.select(
        "id",
        "operator",
        "route_id",
        "route_name",
        "route_type",
        route_colour(F.col("route_color"), F.col("route_type")).alias("color"),
        "lines",
    )
    return _first(shown.orderBy("id"), n)


def _first(rows: DataFrame, n: int | None) -> DataFrame:
    if n is None:
        return rows
    if n < 1:
        raise ValueError("a limit must be positive")
    return rows.limit(n)


def operators(ws: Workspace) -> DataFrame:
    """Operators with their numbers of routes and stops."""
    routes = ws.table("gtfs_routes", required=False).groupBy("operator").agg(F.count_distinct("id").alias("routes"))
    stops = ws.table("gtfs_stops", required=False).groupBy("operator").agg(F.count("*").alias("stops"))
    return (
        routes.join(stops, "operator", "left")
        .select("operator", "routes", F.coalesce("stops", F.lit(0)).alias("stops"))
        .orderBy("operator")
    )


def frequency(ws: Workspace, window: str = "07:00-09:00", min_dph: float = 0) -> DataFrame:
    """Stops of one time window with at least *min_dph* departures per hour."""
    if not re.fullmatch(r"\d{2}:\d{2}-\d{2}:\d{2}", window):
        raise ValueError("window must look like HH:MM-HH:MM")
    if not 0 <= min_dph <= 1000:
        raise ValueError("min_dph must be between 0 and 1000")
    return (
        ws.table("stop_frequency", required=False)
        .where((F.col("time_window") == window) & (F.col("departures_per_hour") >= min_dph))
        .where("lon is not null and lat is not null")
        .select("operator", "stop_id", "stop_name", "departures", "departures_per_hour", "lon", "lat")
        .orderBy(F.desc("departures_per_hour"), "operator", "stop_id")
    )


def frequency_bands(ws: Workspace, window: str = "07:00-09:00") -> DataFrame:
    """Stops per service level with their share of all stops and the overall mean."""
    stops = frequency(ws, window)
    banded = (
        stops.groupBy(frequency_band(F.col("departures_per_hour")).alias("band"))
        .agg(F.count("*").alias("stops"), F.sum("departures_per_hour").alias("dph"))
    )
    total = banded.agg(F.sum("stops").alias("n"), F.sum("dph").alias("d")).withColumn("_one", F.lit(1))
    return (
        banded.where("band is not null")
        .withColumn("_one", F.lit(1))
        .join(F.broadcast(total), "_one")
        .select(
            "band", "stops", (F.col("stops") / F.col("n") * 100).alias("pct"), (F.col("d") / F.col("n")).alias("avg_per_hour")
        )
    )


def top_stops(ws: Workspace, window: str = "07:00-09:00", k: int = 20) -> DataFrame:
    return frequency(ws, window).limit(k)
