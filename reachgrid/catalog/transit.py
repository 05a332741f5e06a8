"""Stops, routes, operators and service frequency from the events table.

Event types stand for operators, users for stops, ``event_id % 4000`` for trips.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from reachgrid.catalog.registry import PARTS, query
from reachgrid.functions.text import clock_minutes
from reachgrid.operators import transit as op
from reachgrid.plans import transit as plan
from reachgrid.workspace import Workspace

# Portable statements, used by Spark and by the oracle.
FEED = {
    "feed_stop_times": """
        select event_type as operator, cast(event_id % 4000 as string) as trip_id, cast(user_id as string) as stop_id,
               cast(hour(ts) as int) * 60 + cast(minute(ts) as int) as dep_min from events""",
    "feed_trips": """
        select event_type as operator, cast(event_id % 4000 as string) as trip_id,
               concat('s', cast(event_id % 4000 % 3 as string)) as service_id, max(event_id) as row_no
        from events group by event_type, event_id % 4000""",
    "feed_calendar": """
        select event_type as operator, concat('s', cast(event_id % 3 as string)) as service_id,
               case when event_type in ('view', 'error') and event_id % 3 < 2 then '1' else '0' end as monday
        from events group by event_type, event_id % 3""",
    "feed_dates": """
        select event_type as operator, concat('s', cast(event_id % 3 as string)) as service_id,
               case when event_type in ('view', 'purchase') and event_id % 3 = 2 then '1' else '2' end as exception_type
        from events group by event_type, event_id % 3""",
    "feed_stops": """
        select event_type as operator, cast(user_id as string) as stop_id, concat('stop ', cast(user_id as string)) as stop_name,
               min(value) as lon, case when min(event_id) % 9 = 0 then null else max(value) end as lat, min(event_id) as id
        from events group by event_type, user_id""",
    "feed_routes": """
        select event_type as operator, concat('r', cast(user_id % 50 as string)) as route_id, min(event_id) as id,
               concat('line ', cast(user_id % 50 as string)) as route_name, cast(min(event_id) % 9 as int) as route_type,
               case when min(event_id) % 2 = 0 then 'ff00aa' else '' end as route_color,
               min(event_id) % 5 > 0 as has_line
        from events where event_type <> 'click' group by event_type, user_id % 50""",
    "feed_shapes": """
        select event_type as operator, cast(user_id as string) as shape_id, cast(event_id % 1000 as double) as seq,
               floor(value / cast(100 as double)) as lon, cast(floor(event_id / 3000) as double) as lat, event_id as row_no
        from events""",
    "feed_shape_trips": """
        select event_type as operator, cast(user_id as string) as shape_id, concat('r', cast(event_id % 7 as string)) as route_id,
               event_id as row_no
        from events where value > 2""",
}
PARTS.update(FEED)
PARTS["feed_services"] = """
    select distinct operator, service_id from feed_calendar where monday = '1'
    union
    select distinct operator, service_id from feed_dates where exception_type = '1'
      and operator not in (select operator from feed_calendar where monday = '1')"""
PARTS["feed_running"] = """
    select s.operator, s.stop_id, s.trip_id, s.dep_min
    from feed_stop_times s left join feed_trips t on t.operator = s.operator and t.trip_id = s.trip_id
    where s.operator not in (select operator from feed_services)
       or (s.operator, coalesce(t.service_id, '')) in (select (operator, service_id) from feed_services)"""
PARTS["feed_frequency"] = """
    with hits as (select r.operator, r.stop_id, w.time_window, count(distinct r.trip_id) as n
                  from feed_running r join windows w on r.dep_min >= w.start_min and r.dep_min < w.end_min
                  group by r.operator, r.stop_id, w.time_window),
    seen as (select distinct operator, stop_id from hits)
    select s.operator, s.stop_id, p.stop_name, w.time_window, coalesce(h.n, 0) as departures,
           round_even(cast(coalesce(h.n, 0) / w.hours as double), 2) as departures_per_hour, p.lon, p.lat
    from seen s cross join windows w
    join feed_stops p on p.operator = s.operator and p.stop_id = s.stop_id and p.lon is not null and p.lat is not null
    left join hits h on h.operator = s.operator and h.stop_id = s.stop_id and h.time_window = w.time_window"""


def feed(b, name: str):
    return b.spark.sql(FEED[name].replace("from events", "from {events}"), events=b.raw("events"))


def running(b):
    services = op.active_services(feed(b, "feed_calendar"), feed(b, "feed_dates"))
    return op.running_stop_times(feed(b, "feed_stop_times"), feed(b, "feed_trips"), services)


def workspace(b) -> Workspace:
    frequency = op.stop_frequency(running(b), feed(b, "feed_stops").drop("id"))
    line = F.array(F.array(*[F.struct(F.lit(float(v)).alias("x"), F.lit(0.0).alias("y")) for v in (0, 1)]))
    routes = feed(b, "feed_routes").withColumn("lines", F.when(F.col("has_line"), line))
    return Workspace(
        b.spark, frames={"stop_frequency": frequency, "gtfs_stops": feed(b, "feed_stops"), "gtfs_routes": routes}
    )


@query("j17_running_stop_times", "select operator, count(*) as n, count(distinct trip_id) as trips from feed_running group by operator")
def _(b):
    return running(b).groupBy("operator").agg(F.count("*").alias("n"), F.count_distinct("trip_id").alias("trips"))


@query(
    "j23_departures_in_windows",
    """select r.operator, w.time_window, count(*) as n from feed_running r
       join windows w on r.dep_min >= w.start_min and r.dep_min < w.end_min group by r.operator, w.time_window""",
)
def _(b):
    return op.in_windows(running(b)).groupBy("operator", "time_window").agg(F.count("*").alias("n"))


@query("a19_stop_frequency", "select * from feed_frequency", "departures_per_hour lon lat")
def _(b):
    return op.stop_frequency(running(b), feed(b, "feed_stops").drop("id"))


@query(
    "p10_l12_frequency_listing",
    """select operator, stop_id, stop_name, departures, departures_per_hour, lon, lat from feed_frequency
       where time_window = '06:00-22:00' and departures_per_hour >= 0.2 and lon is not null and lat is not null""",
    "departures_per_hour lon lat",
)
def _(b):
    return plan.frequency(workspace(b), "06:00-22:00", 0.2)


@query(
    "a33_frequency_bands",
    """with f as (select * from feed_frequency where time_window = '07:00-09:00'),
       t as (select case when departures_per_hour >= 6 then 'high' when departures_per_hour >= 3 then 'medium'
                         when departures_per_hour >= 1 then 'low' when departures_per_hour > 0 then 'very_low' end as band
             from f)
       select band, count(*) as stops, count(*) / (select count(*) from f) * 100 as pct,
              (select avg(departures_per_hour) from f) as avg_per_hour
       from t where band is not null group by band""",
    "pct avg_per_hour",
)
def _(b):
    return plan.frequency_bands(workspace(b), "07:00-09:00")


@query(
    "a33_top_stops",
    """select operator, stop_id, stop_name, departures, departures_per_hour, lon, lat from feed_frequency
       where time_window = '07:00-09:00' order by departures_per_hour desc, operator, stop_id limit 20""",
    "departures_per_hour lon lat",
)
def _(b):
    return plan.top_stops(workspace(b))


@query(
    "l07_p11_o03_transit_stops",
    "select id, operator, stop_id, stop_name, lon, lat from feed_stops where operator = 'view' order by id limit 50",
    "lon lat",
)
def _(b):
    return plan.transit_stops(workspace(b), "view", 50)


@query(
    "l08_p12_transit_routes",
    """select id, operator, route_id, route_name, route_type,
              case when route_color <> '' then '#' || route_color
                   else coalesce(case route_type when 0 then '#e11d48' when 1 then '#dc2626' when 2 then '#7c3aed'
                        when 3 then '#2563eb' when 4 then '#0891b2' when 5 then '#6b7280' when 6 then '#6b7280'
                        when 7 then '#a855f7' end, '#2563eb') end as color
       from feed_routes where has_line""",
)
def _(b):
    return plan.transit_routes(workspace(b)).drop("lines")


@query(
    "a24_j16_operators",
    """select r.operator, count(distinct r.id) as routes, coalesce(max(s.n), 0) as stops
       from feed_routes r left join (select operator, count(*) as n from feed_stops group by operator) s using (operator)
       group by r.operator""",
)
def _(b):
    return plan.operators(workspace(b))


@query(
    "a37_j18_w07_route_lines",
    """with o as (select operator, shape_id, arg_max(route_id, row_no) as owner from feed_shape_trips group by operator, shape_id),
       p as (select *, row_number() over (partition by operator, shape_id order by seq, row_no) as rn,
                    count(*) over (partition by operator, shape_id) as n from feed_shapes),
       l as (select p.operator, p.shape_id, coalesce(any_value(o.owner), p.shape_id) as route_id, min(p.row_no) as first_row,
                    max(n) as points,
                    max(lon) filter (where rn = 1) as x1, max(lat) filter (where rn = 1) as y1,
                    max(lon) filter (where rn = n) as x2, max(lat) filter (where rn = n) as y2
             from p left join o on o.operator = p.operator and o.shape_id = p.shape_id
             group by p.operator, p.shape_id having max(n) >= 2),
       u as (select *, row_number() over (partition by operator, route_id, x1, y1, x2, y2 order by first_row) as k from l)
       select operator, route_id, count(*) as lines, cast(sum(points) as bigint) as points from u where k = 1
       group by operator, route_id""",
)
def _(b):
    routes = feed(b, "feed_routes").withColumn("row_no", F.col("id"))
    built = op.route_lines(feed(b, "feed_shapes"), feed(b, "feed_shape_trips"), routes)
    points = F.aggregate("lines", F.lit(0).cast("bigint"), lambda acc, line: acc + F.size(line))
    return built.select("operator", "route_id", F.size("lines").cast("bigint").alias("lines"), points.alias("points"))


@query(
    "f10_clock_minutes",
    """select event_id, case when event_type = 'error' then null
                             else cast(event_id % 30 as int) * 60 + cast(minute(ts) as int) end as minutes from events""",
)
def _(b):
    text = F.when(F.col("event_type") == "error", F.lit("soon")).otherwise(
        F.concat_ws(":", (F.col("event_id") % 30).cast("string"), F.date_format("ts", "mm"), F.lit("59"))
    )
    return b.raw("events").select("event_id", clock_minutes(text).alias("minutes"))
