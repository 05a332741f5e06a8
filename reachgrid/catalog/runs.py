"""Publishing, runs over some slots and full runs, on a workspace of their own in the shared folder."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from reachgrid.catalog.bindings import TENANT
from reachgrid.catalog.files import fresh, named
from reachgrid.catalog.geo import OVERLAP
from reachgrid.catalog.registry import query
from reachgrid.params import ScoreParams
from reachgrid.plans import jobs
from reachgrid.sources import versions
from reachgrid.sources.seed import seed_reference
from reachgrid.workspace import Workspace

#: Cells of a grid that was numbered otherwise.
OLD_IDS = 10_000_000


@query(
    "s17_slot_overwrite",
    """select departure_time, origin_cell_id, count(*) as n, sum(case when departure_time = '08:00' then travel_time_minutes + 1 else travel_time_minutes end) as minutes
       from fx_travel_times where departure_time <> '09:30' group by departure_time, origin_cell_id""",
    "minutes",
)
def _(b):
    """All slots are published, one is written again, and one that is named has no rows any more."""
    root, name = fresh(b, "serving"), "travel_times"
    times = b.travel_times()
    versions.publish(times, root, name, ["departure_time"])
    later = times.where("departure_time = '08:00'").withColumn("travel_time_minutes", F.col("travel_time_minutes") + 1)
    versions.replace_partitions(later, root, name, "departure_time", ["08:00", "09:30"])
    now = versions.read_version(b.spark, root, name, versions.manifest(b.spark, root, name))
    return now.groupBy("departure_time", "origin_cell_id").agg(F.count("*").alias("n"), F.sum("travel_time_minutes").alias("minutes"))


@query(
    "x03_slot_scores",
    """select departure_time, cell_id, purpose, case when departure_time = '08:00' then power(raw_score, 0.5) else power(raw_score, 0.7) end as score
       from grav""",
    "score",
)
def _(b):
    """All slots are scored, then one again with other parameters; the files of the others stay."""
    ws = Workspace(b.spark, fresh(b, "serving"), TENANT, b.inputs())
    jobs.score(ws)
    jobs.score(ws, ScoreParams().with_changes(beta=0.5), slots=["08:00"])
    return ws.table("connectivity_scores").select("departure_time", "cell_id", "purpose", "score")


GRID_SQL = """
    box as (select min(x0) as xa, min(y0) as ya, max(x0) + 250 as xb, max(y0) + 250 as yb from cells),
    g as (select xa + 250 * cx as x0, ya + 250 * cy as y0
          from (select *, unnest(range(0, cast((xb - xa) / 250 as bigint))) as cx from box),
               (select unnest(range(0, cast((yb - ya) / 250 as bigint))) as cy from box)),
    placed as (select s.*, (least(s.x1, xb) - greatest(s.x0, xa)) * (least(s.y1, yb) - greatest(s.y0, ya)) as reached from fx_population_boxes s, box
               where s.x0 < xb and s.x1 > xa and s.y0 < yb and s.y1 > ya)"""


@query(
    "x01_full_run",
    f"""with {GRID_SQL},
        p as (select c.x0, c.y0, coalesce(sum(s.population * {OVERLAP} / ((s.x1 - s.x0) * (s.y1 - s.y0))), 0) as population
              from g c left join placed s on c.x0 < s.x1 and c.x0 + 250 > s.x0 and c.y0 < s.y1 and c.y0 + 250 > s.y0 group by c.x0, c.y0)
        select c.cell_code, p.population, k.departure_time, k.combined_score
        from comb k join cells c on c.id = k.cell_id join p on p.x0 = c.x0 and p.y0 = c.y0""",
    "population combined_score",
)
def _(b):
    """From a boundary, population boxes, destinations and OD files that were routed on a grid with other ids."""
    cells = b.grid_cells()
    ring = lambda x0, y0, x1, y1: F.array(*[F.struct(x.cast("double").alias("x"), y.cast("double").alias("y")) for x, y in ((x0, y0), (x1, y0), (x1, y1), (x0, y1))])
    rings = lambda *box: F.array(F.struct(F.lit(0).alias("part"), F.lit(0).alias("ring"), ring(*box).alias("pts")))
    bounds = cells.agg(F.min("x0").alias("xa"), F.min("y0").alias("ya"), (F.max("x0") + 250).alias("xb"), (F.max("y0") + 250).alias("yb"))
    frame = rings(*[F.col(c) for c in ("xa", "ya", "xb", "yb")])
    boundary = bounds.select(
        F.lit(1).cast("bigint").alias("id"), F.lit(TENANT).alias("tenant_id"), F.lit("Region").alias("name"), F.lit("region").alias("boundary_type"),
        frame.alias("rings"), frame.alias("rings_m"),
    )
    shape = rings(*[F.col(c) for c in ("x0", "y0", "x1", "y1")])
    people = b.fx("fx_population_boxes").select(
        F.col("source_id").alias("id"), F.lit(TENANT).alias("tenant_id"), F.lit("").alias("name"), "population",
        F.col("source_id").cast("string").alias("source_code"), shape.alias("rings"), shape.alias("rings_m"),
    )
    folder = fresh(b, "matrices")
    digits = F.concat(F.substring("departure_time", 1, 2), F.substring("departure_time", 4, 2))
    rows = b.fx("fx_travel_times").select(
        "departure_time", (F.col("origin_cell_id") + OLD_IDS).alias("from_id"), F.col("destination_id").alias("to_id"), F.col("travel_time_minutes").alias("travel_time_p50"),
        F.concat(F.lit("ttm_transit_"), digits).alias("name"),
    )
    named(b, rows, folder)
    frames = {n: f for n, f in b.inputs().items() if n in ("destinations", "destination_types")}
    ws = Workspace(b.spark, fresh(b, "serving"), TENANT, {**frames, "boundaries": boundary, "population_sources": people})
    origins = cells.select((F.col("id") + OLD_IDS).alias("id"), (F.col("x0") + 125).alias("x"), (F.col("y0") + 125).alias("y"))
    out = jobs.run(ws, folder, origins=origins)
    grid = ws.table("grid_cells").select(F.col("id").alias("cell_id"), "cell_code", "population")
    return out["combined_scores"].join(grid, "cell_id").select("cell_code", "population", "departure_time", "combined_score")


@query(
    "s03_missing_tables",
    """select 'destinations' as name, count(*) as n from supplier union all select 'municipalities', count(*) from nation
       union all select 'travel_times', count(*) from fx_travel_times
       union all select unnest(['gtfs_stops', 'gtfs_routes', 'nucleos', 'stop_frequency']), 0""",
)
def _(b):
    """Tables that were never written are empty, and counted as such beside those that were."""
    ws = b.workspace()
    names = ("destinations", "municipalities", "travel_times", "gtfs_stops", "gtfs_routes", "nucleos", "stop_frequency")
    counts = [ws.table(n, required=False).agg(F.lit(n).alias("name"), F.count("*").alias("n")) for n in names]
    return reduce(DataFrame.unionByName, counts)


@query(
    "s20_seeded_types",
    """select t.id, t.code, array_to_string(list_transform(string_split(t.code, '_'), lambda w: upper(w[1]) || lower(w[2:])), ' ') as label,
              count(d.id) as places, coalesce(sum(d.weight), 0) as weight
       from types t left join fx_destinations d on d.type_id = t.id group by t.id, t.code""",
    "weight",
)
def _(b):
    """Destinations by the types that a new tenant starts with."""
    ws = b.workspace()
    places = ws.table("destinations").groupBy(F.col("type_id").alias("id")).agg(F.count("*").alias("places"), F.sum("weight").alias("weight"))
    types = seed_reference(ws)["destination_types"].select("id", "code", "label")
    return types.join(places, "id", "left").na.fill(0, ["places", "weight"])
