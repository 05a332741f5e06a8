"""Containment, rankings, area detail and findings."""

from __future__ import annotations

from pyspark.sql import functions as F

from reachgrid.catalog.bindings import SLOT
from reachgrid.catalog.registry import query
from reachgrid.catalog.region import COVERAGE
from reachgrid.operators.contain import contains
from reachgrid.plans import areas, region

RANK = "population avg_score weighted_avg_score"
# A drawn L-shaped polygon over the demo region.
DRAWN = {
    "type": "Polygon",
    "coordinates": [
        [
            [501010.0, 4790510.0],
            [507910.0, 4790910.0],
            [507510.0, 4793010.0],
            [504010.0, 4793110.0],
            [503810.0, 4798010.0],
            [501210.0, 4797510.0],
            [501010.0, 4790510.0],
        ]
    ],
}
POINTS = DRAWN["coordinates"][0]
# The same polygon by the linear degrees of the bound grid.
DRAWN_DEGREES = {"type": "Polygon", "coordinates": [[[(x - 500000) / 80000 - 3, (y - 4790000) / 110000 + 43] for x, y in POINTS]]}
DRAWN_EDGES = 'select * from (values {}) t(ax, ay, bx, "by")'.format(
    ", ".join(f"({a[0]}, {a[1]}, {b[0]}, {b[1]})" for a, b in zip(POINTS, POINTS[1:]))
)
DRAWN_IDS = f"""
    select c.id from cells c join ({DRAWN_EDGES}) e on c.y between least(e.ay, e.by) and greatest(e.ay, e.by)
    group by c.id
    having sum(case when (e.ay > c.y) <> (e.by > c.y)
                     and c.x < (e.bx - e.ax) * (c.y - e.ay) / nullif(e.by - e.ay, 0) + e.ax then 1 else 0 end) % 2 = 1"""


@query("j04_cells_in_municipalities", "select id, code from inside")
def _(b):
    ws = b.workspace()
    return contains(ws.centroids(), ws.edges("municipalities"), "code")


@query("j04_cells_in_comarcas", "select distinct id, code from inside_comarca")
def _(b):
    ws = b.workspace()
    return contains(ws.centroids(), ws.edges("comarcas"), "code")


@query("j05_cells_in_drawn_area", DRAWN_IDS)
def _(b):
    ws = b.workspace()
    return contains(ws.centroids(), areas.geojson_edges(ws, DRAWN), "code").select("id")


@query("a10_o01_municipality_ranking", "select * from muni_rank", RANK)
def _(b):
    return areas.area_ranking(b.scored(), "municipalities", SLOT)


@query("a11_comarca_ranking", "select * from comarca_rank", RANK)
def _(b):
    return areas.area_ranking(b.scored(), "comarcas", SLOT)


@query("a13_area_summary", "select * from comarca_rank where code = '2'", RANK)
def _(b):
    return areas.area_detail(b.scored(), "comarcas", "2", SLOT)["summary"]


@query(
    "a13_area_purposes",
    """select s.*, t.avg_travel_time, coalesce(p.label, s.purpose) as purpose_label
       from area_breakdown s
       left join (select i.code, n.mode, n.purpose, avg(n.min_travel_time_minutes) as avg_travel_time
                  from near8 n join inside_comarca i on i.id = n.cell_id group by i.code, n.mode, n.purpose) t
         using (code, mode, purpose)
       left join types p on p.code = s.purpose""",
    "avg_score weighted_avg_score avg_travel_time",
)
def _(b):
    return areas.area_purposes(b.scored(), "comarcas", SLOT)


@query(
    "a13_area_coverage",
    "select v.*, coalesce(p.label, v.purpose) as purpose_label from area_cov v left join types p on p.code = v.purpose",
    COVERAGE,
)
def _(b):
    return areas.area_coverage(b.scored(), "comarcas", SLOT)


def _stats(extra: str) -> str:
    return f"""
        select count(*) as cell_count, coalesce(sum(c.population), 0) as population,
               avg(s.combined_score_normalized) as avg_combined_score,
               case when sum(c.population) > 0
                    then sum(c.population * coalesce(s.combined_score_normalized, 0)) / sum(c.population) end
                 as weighted_avg_combined_score
        from cells c join ({DRAWN_IDS}) d on d.id = c.id left join comb s on s.cell_id = c.id {extra}"""


STATS = "population avg_combined_score weighted_avg_combined_score"


@query("a14_area_stats", _stats("and s.departure_time = '08:00'"), STATS)
def _(b):
    return areas.area_stats(b.scored(), DRAWN, SLOT, crs="metres")


@query("a14_area_stats_degrees", _stats("and s.departure_time = '08:00'"), STATS)
def _(b):
    return areas.area_stats(b.scored(), DRAWN_DEGREES, SLOT)


@query("a14_area_stats_all_slots", _stats(""), STATS)
def _(b):
    return areas.area_stats(b.scored(), DRAWN, crs="metres")


@query(
    "j21_area_against_region",
    """select a.code, a.mode, a.purpose, coalesce(a.weighted_avg_score, 0) as area, coalesce(r.weighted_avg_score, 0) as region,
              coalesce(a.weighted_avg_score, 0) - coalesce(r.weighted_avg_score, 0) as delta
       from area_breakdown a left join breakdown r on r.purpose = a.purpose""",
    "area region delta",
)
def _(b):
    ws = b.scored()
    return region.compare(areas.area_purposes(ws, "comarcas", SLOT), region.purpose_breakdown(ws, SLOT))


@query(
    "a29_area_findings",
    """with r as (select code, row_number() over (order by weighted_avg_score desc nulls last, code) as rank,
                         count(*) over () as total from comarca_rank),
       j as (select a.code, a.purpose, coalesce(a.weighted_avg_score, 0) as s,
                    coalesce(a.weighted_avg_score, 0) > coalesce(b.weighted_avg_score, 0) as above
             from area_breakdown a left join breakdown b on b.purpose = a.purpose),
       e as (select code, arg_max(purpose, s) as best_purpose, max(s) as best_score, arg_min(purpose, s) as worst_purpose,
                    min(s) as worst_score, count(*) filter (where above) as above_region,
                    count(*) filter (where not above) as below_region from j group by code),
       g as (select a.code, a.purpose, a.pct_pop_30min as p, coalesce(v.pct_pop_30min, 0) - a.pct_pop_30min as gap
             from area_cov a left join cov v on v.purpose = a.purpose),
       k as (select code, first(purpose order by p, purpose) as lowest_coverage_purpose, min(p) as lowest_coverage_pct,
                    first(purpose order by gap desc, purpose) as biggest_gap_purpose, max(gap) as biggest_gap
             from g group by code)
       select code, rank, total,
              case when rank <= ceil(total / 3) then 'top' when rank > ceil(total * 2 / 3) then 'bottom' else 'middle' end as tercile,
              best_purpose, best_score, worst_purpose, worst_score, above_region, below_region,
              lowest_coverage_purpose, lowest_coverage_pct, biggest_gap_purpose, biggest_gap
       from e join k using (code) join r using (code)""",
    "best_score worst_score lowest_coverage_pct biggest_gap",
)
def _(b):
    ws = b.scored()
    return areas.findings(
        areas.area_ranking(ws, "comarcas", SLOT),
        areas.area_purposes(ws, "comarcas", SLOT),
        areas.area_coverage(ws, "comarcas", SLOT),
        region.purpose_breakdown(ws, SLOT),
        region.coverage(ws, SLOT),
    )


@query(
    "w05_ranks_and_terciles",
    """select code, row_number() over (order by weighted_avg_score desc nulls last, code) as rank, count(*) over () as total,
              case when row_number() over (order by weighted_avg_score desc nulls last, code) <= ceil(count(*) over () / 3) then 1
                   when row_number() over (order by weighted_avg_score desc nulls last, code) > ceil(count(*) over () * 2 / 3) then 3
                   else 2 end as tercile
       from muni_rank""",
)
def _(b):
    return areas.terciles(areas.area_ranking(b.scored(), "municipalities", SLOT))


@query(
    "o04_top_and_bottom_areas",
    """select * from (select 'top' as side, code, population from muni_rank order by weighted_avg_score desc nulls last, code limit 15)
       union all
       select * from (select 'bottom' as side, code, population from muni_rank
                      order by weighted_avg_score asc nulls first, code desc limit 15)""",
    "population",
)
def _(b):
    rows = areas.area_scores(b.scored(), "municipalities", SLOT)
    best = rows.orderBy(F.desc_nulls_last("weighted_avg_score"), "code").limit(15)
    worst = rows.orderBy(F.asc_nulls_first("weighted_avg_score"), F.desc("code")).limit(15)
    return best.select(F.lit("top").alias("side"), "code", "population").unionByName(
        worst.select(F.lit("bottom").alias("side"), "code", "population")
    )
