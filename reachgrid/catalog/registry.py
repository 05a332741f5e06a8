"""Registration of queries and composition of their oracle SQL."""

from __future__ import annotations

from collections.abc import Callable
from functools import cache

from pyspark.sql import DataFrame, SparkSession, functions as F

from reachgrid.catalog.bindings import FX, Bound
from reachgrid.params import PURPOSES

Build = Callable[[Bound], DataFrame]
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
DIGITS = 4
# Moves exact decimal halves, which the two engines round differently, off the edge.
NUDGE = 0.00000123


def query(name: str, sql: str | None = None, doubles: str = "") -> Callable[[Build], Build]:
    """Register a query; *doubles* are rounded to four decimals on both sides.

    Sums of doubles depend on their order, so the last bits differ by engine.
    """
    wanted = doubles.split()

    def register(build: Build) -> Build:
        def run(spark: SparkSession, folder: str) -> DataFrame:
            df = build(Bound(spark, folder))
            shown = {c: F.round(F.col(c) + NUDGE, DIGITS) + F.lit(0.0) for c in wanted}
            return df.withColumns(shown) if wanted else df

        QUERIES[name] = run
        if sql is not None:
            ORACLE[name] = compose(sql, wanted)
        return build

    return register


# Named parts of the oracle; each is one CTE that may use the ones before it.
PARTS: dict[str, str] = {
    **FX,
    "types": "select * from (values "
    + ", ".join(
        f"({i + 1}, '{p}', {repr(p.upper()) if i < 8 else 'null'})" for i, p in enumerate(PURPOSES)
    )
    + ") t(id, code, label)",
    "cells": """
        select id, cell_code, x0, y0, population, x0 + 125 as x, y0 + 125 as y,
               (x0 + 125 - 500000) / 80000 - 3 as lon, (y0 + 125 - 4790000) / 110000 + 43 as lat,
               cast(muni_key as varchar) as muni_code
        from fx_grid_cells""",
    "dests": """
        select *, (x - 500000) / 80000 - 3 as lon, (y - 4790000) / 110000 + 43 as lat from fx_destinations""",
    "reach": """
        select t.departure_time, t.origin_cell_id as cell_id, t.mode, p.code as purpose, t.destination_id,
               t.travel_time_minutes as m, d.weight * exp(-0.03 * t.travel_time_minutes) as c
        from fx_travel_times t join fx_destinations d on d.id = t.destination_id join types p on p.id = d.type_id
        where t.travel_time_minutes <= 120""",
    "grav": """
        select departure_time, cell_id, mode, purpose, sum(c) as raw_score, power(sum(c), 0.7) as score
        from reach group by departure_time, cell_id, mode, purpose""",
    "near": """
        select departure_time, cell_id, mode, purpose, m as min_travel_time_minutes,
               destination_id as nearest_destination_id
        from (select *, row_number() over (partition by departure_time, cell_id, mode, purpose
                                           order by m, destination_id) as rn from reach) where rn = 1""",
    "ext": """
        select departure_time, mode, purpose, min(score) as lo, max(score) as hi
        from grav group by departure_time, mode, purpose""",
    "conn": """
        select g.*, case when e.hi = e.lo then 50.0 else (g.score - e.lo) / (e.hi - e.lo) * 100 end as score_normalized
        from grav g join ext e using (departure_time, mode, purpose)""",
    "wts": """
        select departure_time, mode, purpose, 0.1 / sum(0.1) over (partition by departure_time, mode) as w from ext""",
    "comb0": """
        select departure_time, cell_id, sum(w * score_normalized) as combined_score
        from conn join wts using (departure_time, mode, purpose) group by departure_time, cell_id""",
    "comb": """
        select c.*, case when hi = lo then 50.0 else (combined_score - lo) / (hi - lo) * 100 end
                    as combined_score_normalized
        from comb0 c join (select departure_time, min(combined_score) as lo, max(combined_score) as hi
                           from comb0 group by departure_time) e using (departure_time)""",
    "conn8": "select * from conn where departure_time = '08:00'",
    "comb8": "select * from comb where departure_time = '08:00'",
    "near8": "select * from near where departure_time = '08:00'",
    "inside": """
        select id, code from (
          select c.id, cast(a.area_id as varchar) as code,
                 sum(case when (a.ay > c.y) <> (a.by > c.y)
                           and c.x < (a.bx - a.ax) * (c.y - a.ay) / nullif(a.by - a.ay, 0) + a.ax
                     then 1 else 0 end) as crossings
          from cells c join fx_area_edges a
            on c.y between least(a.ay, a.by) and greatest(a.ay, a.by)
          group by c.id, a.area_id) where crossings % 2 = 1""",
    "inside_comarca": """
        select i.id, cast(m.comarca_key as varchar) as code
        from inside i join fx_municipalities m on cast(m.muni_key as varchar) = i.code""",
    "munis": "select cast(muni_key as varchar) as muni_code, name, muni_key, comarca_key from fx_municipalities",
    "muni_rank": """
        select m.name, i.code, count(*) as cell_count, coalesce(sum(c.population), 0) as population,
               avg(s.combined_score_normalized) as avg_score,
               case when sum(c.population) > 0
                    then sum(c.population * coalesce(s.combined_score_normalized, 0)) / sum(c.population)
                    else avg(s.combined_score_normalized) end as weighted_avg_score
        from inside i join cells c on c.id = i.id join munis m on m.muni_code = i.code
        left join comb8 s on s.cell_id = c.id group by m.name, i.code""",
    "comarca_rank": """
        select r.r_name as name, i.code, count(*) as cell_count, coalesce(sum(c.population), 0) as population,
               avg(s.combined_score_normalized) as avg_score,
               case when sum(c.population) > 0
                    then sum(c.population * coalesce(s.combined_score_normalized, 0)) / sum(c.population)
                    else avg(s.combined_score_normalized) end as weighted_avg_score
        from inside_comarca i join cells c on c.id = i.id join region r on cast(r.r_regionkey as varchar) = i.code
        left join comb8 s on s.cell_id = c.id group by r.r_name, i.code""",
    "breakdown": """
        select s.mode, s.purpose, avg(s.score_normalized) as avg_score,
               case when sum(c.population) > 0
                    then sum(c.population * coalesce(s.score_normalized, 0)) / sum(c.population)
                    else avg(s.score_normalized) end as weighted_avg_score,
               count(*) as cell_count
        from conn8 s join cells c on c.id = s.cell_id group by s.mode, s.purpose""",
    "area_breakdown": """
        select i.code, s.mode, s.purpose, avg(s.score_normalized) as avg_score,
               case when sum(c.population) > 0
                    then sum(c.population * coalesce(s.score_normalized, 0)) / sum(c.population)
                    else avg(s.score_normalized) end as weighted_avg_score,
               count(*) as cell_count
        from conn8 s join cells c on c.id = s.cell_id join inside_comarca i on i.id = c.id
        group by i.code, s.mode, s.purpose""",
    "cov0": """
        select n.purpose, n.mode, count(*) as total_cells, coalesce(sum(c.population), 0) as total_population,
               coalesce(sum(c.population) filter (where min_travel_time_minutes <= 15), 0) as pop_15min,
               coalesce(sum(c.population) filter (where min_travel_time_minutes <= 30), 0) as pop_30min,
               coalesce(sum(c.population) filter (where min_travel_time_minutes <= 45), 0) as pop_45min,
               coalesce(sum(c.population) filter (where min_travel_time_minutes <= 60), 0) as pop_60min,
               avg(min_travel_time_minutes) as avg_travel_time,
               quantile_cont(min_travel_time_minutes, 0.5) as median_travel_time
        from near8 n join cells c on c.id = n.cell_id group by n.purpose, n.mode""",
    "area_cov0": """
        select i.code, n.purpose, n.mode, count(*) as total_cells, coalesce(sum(c.population), 0) as total_population,
               coalesce(sum(c.population) filter (where min_travel_time_minutes <= 15), 0) as pop_15min,
               coalesce(sum(c.population) filter (where min_travel_time_minutes <= 30), 0) as pop_30min,
               coalesce(sum(c.population) filter (where min_travel_time_minutes <= 45), 0) as pop_45min,
               coalesce(sum(c.population) filter (where min_travel_time_minutes <= 60), 0) as pop_60min,
               avg(min_travel_time_minutes) as avg_travel_time,
               quantile_cont(min_travel_time_minutes, 0.5) as median_travel_time
        from near8 n join cells c on c.id = n.cell_id join inside_comarca i on i.id = c.id
        group by i.code, n.purpose, n.mode""",
    **{
        name: f"""
        select *, {", ".join(f"case when total_population > 0 then pop_{m}min / total_population * 100 else 0 end as pct_pop_{m}min" for m in (15, 30, 45, 60))}
        from {name}0"""
        for name in ("cov", "area_cov")
    },
    "demo": """
        select cast(muni_key as varchar) as muni_code, year, pop_total, pop_0_17, pop_18_25,
               pop_total - pop_0_17 - pop_18_25 - pop_65_plus as pop_26_64, pop_65_plus,
               pop_0_17 / pop_total * 100.0 as pct_0_17, pop_18_25 / pop_total * 100.0 as pct_18_25,
               pop_65_plus / pop_total * 100.0 as pct_65_plus
        from fx_demographics""",
    "income": """
        select cast(muni_key as varchar) as muni_code, year,
               cast(renta_total as double) / n as renta_personal_media,
               cast(renta_total as double) / n * 0.5 as renta_disponible_media,
               cast(renta_total as double) / n / 1000 as renta_index
        from fx_income""",
    "cars": """
        select cast(muni_key as varchar) as muni_code, year, vehicles_per_inhab from fx_cars""",
    "last_demo": "select distinct on (muni_code) * from demo order by muni_code, year desc",
    "last_income": "select distinct on (muni_code) * from income order by muni_code, year desc",
    "last_cars": "select distinct on (muni_code) * from cars order by muni_code, year desc",
    "prof": """
        select r.code as muni_code, r.name, r.population, r.weighted_avg_score,
               d.pop_total, d.pop_0_17, d.pop_18_25, d.pop_65_plus, d.pct_0_17, d.pct_18_25, d.pct_65_plus,
               i.renta_personal_media, i.renta_disponible_media, i.renta_index, c.vehicles_per_inhab
        from muni_rank r left join last_demo d on d.muni_code = r.code
        left join last_income i on i.muni_code = r.code left join last_cars c on c.muni_code = r.code""",
    "vuln": """
        with e as (select min(weighted_avg_score) as s0, max(weighted_avg_score) as s1,
                          min(pct_65_plus) as p0, max(pct_65_plus) as p1, min(renta_index) as r0,
                          max(renta_index) as r1, min(vehicles_per_inhab) as v0, max(vehicles_per_inhab) as v1
                   from prof where weighted_avg_score is not null and pct_65_plus is not null
                     and renta_index is not null and vehicles_per_inhab is not null)
        select prof.*, 0.4 * (1 - case when s1 > s0 then (weighted_avg_score - s0) / (s1 - s0) else 0 end)
             + 0.2 * case when p1 > p0 then (pct_65_plus - p0) / (p1 - p0) else 0 end
             + 0.2 * (1 - case when r1 > r0 then (renta_index - r0) / (r1 - r0) else 0 end)
             + 0.2 * (1 - case when v1 > v0 then (vehicles_per_inhab - v0) / (v1 - v0) else 0 end) as vuln_score
        from prof, e""",
    "windows": """
        select * from (values ('07:00-09:00', 420, 540, 2.0), ('09:00-12:00', 540, 720, 3.0),
          ('12:00-15:00', 720, 900, 3.0), ('15:00-18:00', 900, 1080, 3.0), ('18:00-21:00', 1080, 1260, 3.0),
          ('06:00-22:00', 360, 1320, 16.0)) t(time_window, start_min, end_min, hours)""",
}


@cache
def _needs(name: str) -> tuple[str, ...]:
    return _used(PARTS[name], name)


def _used(text: str, own: str = "") -> tuple[str, ...]:
    import re

    words = set(re.findall(r"\b[a-z_0-9]+\b", text))
    return tuple(p for p in PARTS if p in words and p != own)


def compose(sql: str, doubles: list[str]) -> str:
    """Put the parts a statement uses in front of it and round its doubles."""
    order: list[str] = []

    def add(name: str) -> None:
        for part in _needs(name):
            if part not in order:
                add(part)
        if name not in order:
            order.append(name)

    for part in _used(sql):
        add(part)
    ctes = ",\n".join(f"{p} as ({PARTS[p]})" for p in order)
    head = f"with {ctes}\n" if order else ""
    if not doubles:
        return f"{head}select * from ({sql}) result"
    replaced = ", ".join(f"round(cast({c} as double) + {NUDGE}, {DIGITS}) + 0.0 as {c}" for c in doubles)
    return f"{head}select * replace ({replaced}) from ({sql}) result"
