"""Distances, areas, overlays, grid and distance-based travel times."""

from __future__ import annotations

from pyspark.sql import functions as F

from reachgrid.catalog.registry import query
from reachgrid.functions.geo import haversine_km
from reachgrid.operators import distance, overlay
from reachgrid.operators.contain import bounds_of
from reachgrid.operators.grid import covering_cells
from reachgrid.plans.jobs import cell_boxes, conservation

HAVERSINE = """2 * 6371.0 * atan2(sqrt(power(sin(radians({lat2} - {lat1}) / 2), 2)
      + cos(radians({lat1})) * cos(radians({lat2})) * power(sin(radians({lon2} - {lon1}) / 2), 2)),
    sqrt(1 - (power(sin(radians({lat2} - {lat1}) / 2), 2)
      + cos(radians({lat1})) * cos(radians({lat2})) * power(sin(radians({lon2} - {lon1}) / 2), 2))))"""


def box_edges(boxes, key: str):
    """Counter-clockwise edges of axis-parallel boxes."""
    corners = [("x0", "y0"), ("x1", "y0"), ("x1", "y1"), ("x0", "y1")]
    sides = [
        F.struct(*[F.col(c).alias(n) for c, n in zip((*a, *b), ("ax", "ay", "bx", "by"))])
        for a, b in zip(corners, corners[1:] + corners[:1])
    ]
    return boxes.select(key, F.explode(F.array(*sides)).alias("e")).select(key, "e.*")


def sources(b):
    boxes = b.fx("fx_population_boxes")
    return boxes.select("source_id", "population"), box_edges(boxes, "source_id")


OVERLAP = """greatest(least(c.x0 + 250, s.x1) - greatest(c.x0, s.x0), 0)
             * greatest(least(c.y0 + 250, s.y1) - greatest(c.y0, s.y0), 0)"""
AREAL = f"""
    select c.id, coalesce(sum(s.population * {OVERLAP} / ((s.x1 - s.x0) * (s.y1 - s.y0))), 0) as population
    from cells c left join fx_population_boxes s
      on c.x0 < s.x1 and c.x0 + 250 > s.x0 and c.y0 < s.y1 and c.y0 + 250 > s.y0
    group by c.id"""


@query(
    "f05_haversine",
    "select c.id, " + HAVERSINE.format(lon1="c.lon", lat1="c.lat", lon2="-2.93", lat2="43.26") + " as km from cells c",
    "km",
)
def _(b):
    km = haversine_km(F.col("lon"), F.col("lat"), F.lit(-2.93), F.lit(43.26))
    return b.workspace().table("grid_cells").select("id", km.alias("km"))


@query(
    "f20_envelope_and_centroid",
    """select cast(area_id as varchar) as code, min(least(ax, bx)) as xmin, min(least(ay, "by")) as ymin,
              max(greatest(ax, bx)) as xmax, max(greatest(ay, "by")) as ymax,
              sum((ax * "by" - bx * ay) * (ax + bx)) / (3 * sum(ax * "by" - bx * ay)) as cx
       from fx_area_edges group by area_id""",
    "xmin ymin xmax ymax cx",
)
def _(b):
    edges = b.workspace().edges("municipalities")
    cross = F.col("ax") * F.col("by") - F.col("bx") * F.col("ay")
    centre = edges.groupBy("code").agg((F.sum(cross * (F.col("ax") + F.col("bx"))) / (3 * F.sum(cross))).alias("cx"))
    return bounds_of(edges, "code").join(centre, "code")


@query(
    "f21_polygon_area",
    """select cast(area_id as varchar) as code, sum(ax * "by" - bx * ay) / 2 as area from fx_area_edges group by area_id""",
    "area",
)
def _(b):
    return overlay.polygon_area(b.workspace().edges("municipalities"), "code")


@query("j06_a21_areal_weighting", AREAL, "population")
def _(b):
    people, edges = sources(b)
    return overlay.areal_weight(people, edges, cell_boxes(b.workspace()))


@query(
    "f21_overlap_area",
    f"""select s.source_id, c.id, {OVERLAP} as overlap from cells c join fx_population_boxes s
        on c.x0 < s.x1 and c.x0 + 250 > s.x0 and c.y0 < s.y1 and c.y0 + 250 > s.y0""",
    "overlap",
)
def _(b):
    people, edges = sources(b)
    return overlay.shares(people, edges, cell_boxes(b.workspace()))


# Settlement boxes, one in each area; they overlap no other.
MASKS = """
    select cast(n_nationkey as bigint) as mask_id,
           cast(500000 + (n_nationkey % 5) * 2000 + 130 as double) as x0,
           cast(4790000 + cast(floor(n_nationkey / 5) as bigint) * 1900 + 170 as double) as y0,
           cast(500000 + (n_nationkey % 5) * 2000 + 1530 as double) as x1,
           cast(4790000 + cast(floor(n_nationkey / 5) as bigint) * 1900 + 1490 as double) as y1
    from {nation}"""


@query(
    "j07_masked_weighting",
    f"""with mk as ({MASKS.replace("{nation}", "nation")}),
        p as (select s.source_id, s.population, greatest(s.x0, m.x0) as x0, greatest(s.y0, m.y0) as y0,
                     least(s.x1, m.x1) as x1, least(s.y1, m.y1) as y1
              from fx_population_boxes s join mk m on s.x0 < m.x1 and s.x1 > m.x0 and s.y0 < m.y1 and s.y1 > m.y0),
        a as (select source_id, sum((x1 - x0) * (y1 - y0)) as area from p group by source_id)
        select c.id, coalesce(sum(s.population * {OVERLAP} / a.area), 0) as population
        from cells c
        left join p s on c.x0 < s.x1 and c.x0 + 250 > s.x0 and c.y0 < s.y1 and c.y0 + 250 > s.y0
        left join a on a.source_id = s.source_id group by c.id""",
    "population",
)
def _(b):
    people, edges = sources(b)
    masks = box_edges(b.spark.sql(MASKS, nation=b.raw("nation")), "mask_id")
    return overlay.masked_weight(people, edges, cell_boxes(b.workspace()), masks)


@query(
    "a22_conservation",
    f"""with p as ({AREAL}), g as (select sum(population) as source_population from fx_population_boxes),
        q as (select sum(population) as allocated_population, count(*) filter (where population > 0) as cells_with_population,
                     count(*) as total_cells from p)
        select source_population, allocated_population, cells_with_population, total_cells, false as masked,
               abs(source_population - allocated_population) / source_population * 100 as loss_pct from g, q""",
    "source_population allocated_population loss_pct",
)
def _(b):
    people, edges = sources(b)
    return conservation(people, overlay.areal_weight(people, edges, cell_boxes(b.workspace())))


@query(
    "j08_grid_over_boundary",
    """with f as (select floor(min(x0) / 250) as c0, ceil(max(x1) / 250) - 1 as c1, floor(min(y0) / 250) as r0,
                         ceil(max(y1) / 250) - 1 as r1 from fx_population_boxes),
       k as (select cast(cx as bigint) as cx, cast(cy as bigint) as cy
             from (select unnest(range(cast(c0 as bigint), cast(c1 as bigint) + 1)) as cx from f),
                  (select unnest(range(cast(r0 as bigint), cast(r1 as bigint) + 1)) as cy from f))
       select distinct cx, cy from k join fx_population_boxes s
         on cx * 250 <= s.x1 and cx * 250 + 250 >= s.x0 and cy * 250 <= s.y1 and cy * 250 + 250 >= s.y0""",
)
def _(b):
    return covering_cells(sources(b)[1], "source_id")


PLACES = ["id", "x", "y"]


def places(b):
    ws = b.workspace()
    return ws.centroids(), ws.table("destinations").select(*PLACES)


@query(
    "j09_distance_od",
    """select c.id as origin_cell_id, count(*) as n, sum(sqrt(power(c.x - d.x, 2) + power(c.y - d.y, 2)) / 1000 / 15 * 60 + 5) as minutes,
              min(d.id) as first_destination, max(d.id) as last_destination
       from cells c join dests d on sqrt(power(c.x - d.x, 2) + power(c.y - d.y, 2)) <= 13750
       where sqrt(power(c.x - d.x, 2) + power(c.y - d.y, 2)) / 1000 / 15 * 60 + 5 <= 60 group by c.id""",
    "minutes",
)
def _(b):
    cells, dests = places(b)
    return distance.distance_od(cells, dests).groupBy("origin_cell_id").agg(
        F.count("*").alias("n"), F.sum("travel_time_minutes").alias("minutes"), F.min("destination_id").alias("first_destination"), F.max("destination_id").alias("last_destination")
    )


@query(
    "j10_slot_od",
    """with s as (select h, case when m = 0 then '00' else '30' end as mm, h as hour from range(0, 24) t(h), (values (0), (30)) u(m)),
       f as (select lpad(cast(h as varchar), 2, '0') || ':' || mm as departure_time,
                    case when h between 7 and 9 or h between 17 and 19 then 1.0 when h between 10 and 16 then 1.15
                         when h between 20 and 22 then 1.3 else 2.0 end as speed,
                    case when h between 7 and 9 or h between 17 and 19 then 1.0 when h between 10 and 16 then 1.5
                         when h between 20 and 22 then 2.5 else 4.0 end as wait from s),
       d as (select c.id, e.id as did, """
    + HAVERSINE.format(lon1="c.lon", lat1="c.lat", lon2="e.lon", lat2="e.lat")
    + """ as km from cells c, dests e),
       o as (select departure_time, id, did, km / 15 * 60 * speed + 5 * wait as minutes from d, f)
       select departure_time, count(*) as n, cast(sum(id) as bigint) as cells, cast(sum(did) as bigint) as dests,
              avg(round(greatest(minutes, 1), 1)) as minutes, max(round(greatest(minutes, 1), 1)) as slowest
       from o where minutes <= 60 group by departure_time""",
    "minutes slowest",
)
def _(b):
    ws = b.workspace()
    cells = ws.table("grid_cells").select("id", "lon", "lat")
    dests = ws.table("destinations").select("id", "lon", "lat")
    od = distance.slot_od(cells, dests, jitter=False)
    return od.groupBy("departure_time").agg(
        F.count("*").alias("n"),
        F.sum("origin_cell_id").alias("cells"),
        F.sum("destination_id").alias("dests"),
        F.avg("travel_time_minutes").alias("minutes"),
        F.max("travel_time_minutes").alias("slowest"),
    )
