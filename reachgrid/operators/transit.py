"""Service frequency at stops and line geometry of routes, from timetable tables.

All inputs carry the operator, so feeds are never looped over.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from reachgrid.operators.sizes import if_small

# Time windows as (label, first minute, end minute, hours).
WINDOWS = (
    ("07:00-09:00", 420, 540, 2.0),
    ("09:00-12:00", 540, 720, 3.0),
    ("12:00-15:00", 720, 900, 3.0),
    ("15:00-18:00", 900, 1080, 3.0),
    ("18:00-21:00", 1080, 1260, 3.0),
    ("06:00-22:00", 360, 1320, 16.0),
)


def window_array(windows=WINDOWS) -> Column:
    fields = ("label", "start", "end", "hours")
    return F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip(fields, w)]) for w in windows])


def active_services(calendar: DataFrame, dates: DataFrame) -> DataFrame:
    """(operator, service_id) of Monday services; where an operator has none, its added dates."""
    monday = calendar.where("monday = '1'").select("operator", "service_id").distinct()
    added = dates.where(F.coalesce("exception_type", F.lit("1")) == "1").select("operator", "service_id").distinct()
    return monday.unionByName(added.join(monday.select("operator").distinct(), "operator", "left_anti"))


def running_stop_times(stop_times: DataFrame, trips: DataFrame, services: DataFrame) -> DataFrame:
    """Stop times on active services; all of an operator's when it has no known service.

    An operator may hold most of the rows, so services and operators are
    broadcast when they are few; only trips need a shuffle.
    """
    trip = trips.groupBy("operator", "trip_id").agg(F.max_by("service_id", "row_no").alias("service_id"))
    known = services.select("operator").distinct().withColumn("restricted", F.lit(True))
    active = services.withColumn("active", F.lit(True))
    return (
        stop_times.join(trip, ["operator", "trip_id"], "left")
        .withColumn("service_id", F.coalesce("service_id", F.lit("")))
        .join(if_small(active), ["operator", "service_id"], "left")
        .join(if_small(known), "operator", "left")
        .where("active or restricted is null")
        .select("operator", "stop_id", "trip_id", "dep_min")
    )


def in_windows(rows: DataFrame, windows=WINDOWS) -> DataFrame:
    """One row per time window a departure falls in; windows may overlap."""
    hit = F.filter(
        window_array(windows), lambda w: (F.col("dep_min") >= w["start"]) & (F.col("dep_min") < w["end"])
    )
    return rows.where("dep_min is not null").select("*", F.explode(F.transform(hit, lambda w: w["label"])).alias("time_window"))


def stop_frequency(running: DataFrame, stops: DataFrame, windows=WINDOWS) -> DataFrame:
    """Distinct trips per stop and window, with zero rows for the other windows of a seen stop.

    One flag per window says whether a trip serves the stop in it; summing the
    flags counts distinct trips without a distinct per window.
    """
    flags = [
        F.max(((F.col("dep_min") >= start) & (F.col("dep_min") < end)).cast("int")).alias(f"w{i}")
        for i, (_, start, end, _) in enumerate(windows)
    ]
    per_trip = running.where("dep_min is not null").groupBy("operator", "stop_id", "trip_id").agg(*flags)
    counts = F.array(*[F.sum(f"w{i}") for i in range(len(windows))])
    per_stop = per_trip.groupBy("operator", "stop_id").agg(counts.alias("counts"))
    seen = per_stop.where(F.array_max("counts") > 0)
    located = stops.where("lon is not null and lat is not null")
    rows = seen.join(located, ["operator", "stop_id"]).select("*", F.posexplode(window_array(windows)).alias("i", "w"))
    departures = F.get("counts", F.col("i"))
    rate = F.when(F.col("w.hours") > 0, departures / F.col("w.hours")).otherwise(F.lit(0.0))
    return rows.select(
        "operator",
        "stop_id",
        "stop_name",
        F.col("w.label").alias("time_window"),
        departures.alias("departures"),
        # Halves go to the even digit, as the stored rates do.
        F.bround(rate, 2).alias("departures_per_hour"),
        "lon",
        "lat",
    )


def route_lines(shapes: DataFrame, trips: DataFrame, routes: DataFrame) -> DataFrame:
    """Lines per route: points in sequence, two or more, one line per pair of end points.

    *shapes* has operator, shape_id, seq, lon, lat, row_no. The last trip row
    names a shape's route; a shape without one stands for itself.
    """
    owner = (
        trips.where("length(shape_id) > 0 and length(route_id) > 0")
        .groupBy("operator", "shape_id")
        .agg(F.max_by("route_id", "row_no").alias("owner"))
    )
    # The collected list is the geometry itself.
    lines = (
        shapes.where("seq is not null and lon is not null and lat is not null")
        .groupBy("operator", "shape_id")
        .agg(
            F.array_sort(F.collect_list(F.struct("seq", "row_no", "lon", "lat"))).alias("pts"),
            F.min("row_no").alias("first_row"),
        )
        .where(F.size("pts") >= 2)
        .join(owner, ["operator", "shape_id"], "left")
        .select(
            "operator",
            F.coalesce("owner", "shape_id").alias("route_id"),
            "first_row",
            F.transform("pts", lambda p: F.struct(p["lon"].alias("x"), p["lat"].alias("y"))).alias("line"),
        )
    )
    ends = [F.element_at("line", i)[c] for i in (1, -1) for c in ("x", "y")]
    first = Window.partitionBy("operator", "route_id", *ends).orderBy("first_row")
    unique = lines.withColumn("_n", F.row_number().over(first)).where("_n = 1")
    grouped = unique.groupBy("operator", "route_id").agg(
        F.array_sort(F.collect_list(F.struct("first_row", "line"))).alias("ls")
    )
    info = routes.groupBy("operator", "route_id").agg(
        F.max_by(F.struct("route_name", "route_type", "route_color"), "row_no").alias("i")
    )
    return grouped.join(info, ["operator", "route_id"], "left").select(
        "operator",
        "route_id",
        F.coalesce("i.route_name", F.lit("")).alias("route_name"),
        F.coalesce(F.col("i.route_type").try_cast("int"), F.lit(3)).alias("route_type"),
        F.coalesce("i.route_color", F.lit("")).alias("route_color"),
        F.transform("ls", lambda s: s["line"]).alias("lines"),
    )
