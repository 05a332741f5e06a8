"""Timetable feeds: zip files to tables.

:mod:`reachgrid.sources.feed_source` reads the members of the feeds side by
side, each once. A feed counts as a whole: what is wrong with a member is known
at its end, where its sum is checked, and then no row of the feed counts. The
others go on.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from reachgrid.functions.text import clock_minutes
from reachgrid.operators.ordering import number_rows
from reachgrid.operators.sizes import if_small
from reachgrid.operators.transit import WINDOWS, active_services, route_lines, running_stop_times, stop_frequency
from reachgrid.schemas import columns
from reachgrid.session import written
from reachgrid.sources.feed_source import STATUS, SUFFIX, read_feeds
from reachgrid.sources.versions import filesystem

#: Members that are read, and their columns.
WANTED = {
    "stops.txt": ["stop_id", "stop_name", "stop_lon", "stop_lat"],
    "trips.txt": ["trip_id", "route_id", "service_id", "shape_id"],
    "routes.txt": ["route_id", "route_long_name", "route_short_name", "route_type", "route_color"],
    "shapes.txt": ["shape_id", "shape_pt_lon", "shape_pt_lat", "shape_pt_sequence"],
    "stop_times.txt": ["trip_id", "stop_id", "departure_time"],
    "calendar.txt": ["service_id", "monday"],
    "calendar_dates.txt": ["service_id", "exception_type"],
}
def unpack(spark: SparkSession, path: str, wanted: dict[str, list[str]] | None = None) -> DataFrame:
    """Rows of the wanted members of every sound feed: operator, member, row_no, cells.

    Each member is read once, by a task of its own, and written. Columns a feed
    lacks are null. The operator is the file name without its suffix. Each feed
    also has a row of member ``status`` whose only cell is null, or says what is
    wrong; a feed with a fault in a wanted member has no other rows.
    """
    fs, folder = filesystem(spark, path)
    names = [s.getPath().getName() for s in fs.listStatus(folder)] if fs.exists(folder) else []
    if not any(n.endswith(SUFFIX) for n in names):
        raise FileNotFoundError(f"no {SUFFIX} files in {path}")
    read = written(read_feeds(spark, path, wanted or WANTED), "feed-members", ["member"])
    told = read.where(F.col("member") == STATUS)
    first = F.min(F.when(F.col("cells")[1].isNotNull(), F.col("cells")))
    feeds = written(told.groupBy("operator").agg(first.alias("fault")).select("operator", F.col("fault")[1].alias("fault")), "feeds")
    faulty = if_small(feeds.where("fault is not null").select("operator"))
    rows = read.where(F.col("member") != STATUS).join(faulty, "operator", "left_anti").select("operator", "row_no", "cells", "member")
    lines = feeds.select("operator", F.lit(1).cast("bigint").alias("row_no"), F.array("fault").alias("cells"), F.lit(STATUS).alias("member"))
    return rows.unionByName(lines)


def rows_of(unpacked: DataFrame, member: str, columns_of_member: list[str] | None = None) -> DataFrame:
    """operator, row_no and the columns of one member as text."""
    names = columns_of_member or WANTED[member]
    rows = unpacked.where(F.col("member") == member)
    return rows.select("operator", "row_no", *[F.col("cells")[i].alias(c) for i, c in enumerate(names)])


def read_gtfs(spark: SparkSession, path: str, member: str, wanted: list[str]) -> DataFrame:
    """Rows of one member of every sound feed; see :func:`unpack`."""
    return rows_of(unpack(spark, path, {member: wanted}), member, wanted)


def stops(unpacked: DataFrame) -> DataFrame:
    """Stops with readable coordinates; of repeated ids all rows are kept."""
    raw = rows_of(unpacked, "stops.txt")
    return raw.select(
        "operator",
        "row_no",
        F.coalesce("stop_id", F.lit("")).alias("stop_id"),
        F.coalesce("stop_name", F.lit("")).alias("stop_name"),
        F.col("stop_lon").try_cast("double").alias("lon"),
        F.col("stop_lat").try_cast("double").alias("lat"),
    ).where("lon is not null and lat is not null")


def trips(unpacked: DataFrame) -> DataFrame:
    return rows_of(unpacked, "trips.txt")


def routes(unpacked: DataFrame) -> DataFrame:
    raw = rows_of(unpacked, "routes.txt")
    long_name = F.when(F.length("route_long_name") > 0, F.col("route_long_name"))
    return raw.select(
        "operator", "row_no", "route_id",
        F.coalesce(long_name, "route_short_name", F.lit("")).alias("route_name"), "route_type", "route_color",
    )


def shapes(unpacked: DataFrame) -> DataFrame:
    raw = rows_of(unpacked, "shapes.txt")
    return raw.select(
        "operator", "row_no", "shape_id",
        F.coalesce("shape_pt_sequence", F.lit("0")).try_cast("double").alias("seq"),
        F.col("shape_pt_lon").try_cast("double").alias("lon"),
        F.col("shape_pt_lat").try_cast("double").alias("lat"),
    )


def stop_times(unpacked: DataFrame) -> DataFrame:
    raw = rows_of(unpacked, "stop_times.txt")
    return raw.select(
        "operator", "row_no", F.coalesce("trip_id", F.lit("")).alias("trip_id"),
        F.coalesce("stop_id", F.lit("")).alias("stop_id"), clock_minutes(F.col("departure_time")).alias("dep_min"),
    )


def import_routes(spark: SparkSession, path: str, unpacked: DataFrame | None = None) -> DataFrame:
    """The gtfs_routes table of all feeds in a folder, or of feeds unpacked already."""
    unpacked = unpacked or unpack(spark, path)
    lines = route_lines(shapes(unpacked), trips(unpacked), routes(unpacked))
    return number_rows(lines, [F.col("operator"), F.col("route_id")], "id").select(*columns("gtfs_routes"))


def import_stops(spark: SparkSession, path: str, unpacked: DataFrame | None = None) -> DataFrame:
    """The gtfs_stops table of all feeds in a folder, or of feeds unpacked already."""
    unpacked = unpacked or unpack(spark, path)
    order = [F.col("operator"), F.col("row_no")]
    return number_rows(stops(unpacked), order, "id").select(*columns("gtfs_stops"))


def import_frequency(spark: SparkSession, path: str, windows=WINDOWS, unpacked: DataFrame | None = None) -> DataFrame:
    """The stop_frequency table of all feeds in a folder, or of feeds unpacked already."""
    unpacked = unpacked or unpack(spark, path)
    calendar, dates = rows_of(unpacked, "calendar.txt"), rows_of(unpacked, "calendar_dates.txt")
    running = running_stop_times(stop_times(unpacked), trips(unpacked), active_services(calendar, dates))
    # A feed without trips cannot be counted.
    with_trips = trips(unpacked).select("operator").distinct()
    place = F.max_by(F.struct("stop_name", "lon", "lat"), "row_no").alias("p")
    located = stops(unpacked).groupBy("operator", "stop_id").agg(place).select("operator", "stop_id", "p.*")
    counted = stop_frequency(running.join(with_trips, "operator", "left_semi"), located, windows)
    order = [F.col("operator"), F.col("stop_id"), F.col("time_window")]
    return number_rows(counted, order, "id").select(*columns("stop_frequency"))


def import_report(stops_table: DataFrame, routes_table: DataFrame, feeds: DataFrame) -> DataFrame:
    """Stops and routes per operator, and the fault of a feed that could not be read, which shows zeros."""
    counts = [
        t.groupBy("operator").agg(F.count("*").alias(n)) for t, n in ((stops_table, "stops"), (routes_table, "routes"))
    ]
    fault = F.max("fault") if "fault" in feeds.columns else F.lit(None).cast("string")
    out = feeds.groupBy("operator").agg(fault.alias("fault"))
    for c in counts:
        out = out.join(c, "operator", "left")
    return out.select("operator", F.coalesce("routes", F.lit(0)).alias("routes"), F.coalesce("stops", F.lit(0)).alias("stops"), "fault")


def feeds(spark: SparkSession, path: str, unpacked: DataFrame | None = None) -> DataFrame:
    """(operator, fault) of the feed files in a folder; the fault of a readable one is null."""
    return rows_of(unpacked or unpack(spark, path), STATUS, ["fault"]).select("operator", "fault")
