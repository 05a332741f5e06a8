"""Social facts, profiles, vulnerability and equity."""

from __future__ import annotations

from pyspark.sql import functions as F

from reachgrid.catalog.bindings import SLOT
from reachgrid.catalog.registry import query
from reachgrid.operators.ordering import latest
from reachgrid.plans import areas, social

FACTS = "pct_0_17 pct_18_25 pct_65_plus renta_personal_media renta_disponible_media renta_index vehicles_per_inhab"
YEAR = 1995


@query(
    "w02_latest_rows",
    """select muni_code, d.year as demo_year, d.pop_total, i.year as income_year, i.renta_index, c.year as cars_year
       from last_demo d left join last_income i using (muni_code) left join last_cars c using (muni_code)""",
    "renta_index",
)
def _(b):
    ws = b.workspace()
    tables = [latest(ws.table(t), "muni_code", "year") for t in (
        "municipality_demographics", "municipality_income", "municipality_car_ownership")]
    demo = tables[0].select("muni_code", F.col("year").alias("demo_year"), "pop_total")
    income = tables[1].select("muni_code", F.col("year").alias("income_year"), "renta_index")
    cars = tables[2].select("muni_code", F.col("year").alias("cars_year"))
    return demo.join(income, "muni_code", "left").join(cars, "muni_code", "left")


@query("w03_latest_year", "select coalesce(max(year), 2023) as year from income")
def _(b):
    return social.latest_year(b.workspace().table("municipality_income"))


NAMED = "select {t}.muni_code, coalesce(m.name, {t}.muni_code) as name, {cols} from {t} left join munis m on m.muni_code = {t}.muni_code where {t}.year = {year}"


@query(
    "l09_j12_demographics",
    NAMED.format(
        t="demo", year=YEAR,
        cols="year, pop_total, pop_0_17, pop_18_25, pop_26_64, pop_65_plus, pct_0_17, pct_18_25, pct_65_plus",
    ),
    "pct_0_17 pct_18_25 pct_65_plus",
)
def _(b):
    return social.facts(b.workspace(), "demographics", YEAR)


@query(
    "l10_income",
    NAMED.format(
        t="income", year="(select max(year) from income)",
        cols="year, renta_personal_media, renta_disponible_media, renta_index",
    ),
    "renta_personal_media renta_disponible_media renta_index",
)
def _(b):
    return social.facts(b.workspace(), "income")


@query(
    "l11_car_ownership",
    NAMED.format(t="cars", year="(select max(year) from cars)", cols="year, vehicles_per_inhab"),
    "vehicles_per_inhab",
)
def _(b):
    return social.facts(b.workspace(), "cars")


@query("j11_l13_profiles", "select * from prof", "population weighted_avg_score " + FACTS)
def _(b):
    return social.profiles(b.scored(), SLOT)


@query(
    "a25_vulnerability",
    """select *, case when vuln_score >= 0.6 then 'high' when vuln_score >= 0.35 then 'medium'
                     when vuln_score is not null then 'low' end as vuln_level from vuln""",
    "vuln_score population weighted_avg_score " + FACTS,
)
def _(b):
    return social.vulnerability(social.profiles(b.scored(), SLOT))


@query(
    "a26_tier_means",
    """with t as (select *, vuln_score >= 0.6 as h from vuln where vuln_score is not null)
       select count(*) filter (where h) as high_count, coalesce(sum(population) filter (where h), 0) as high_population,
              coalesce(avg(pct_65_plus) filter (where h), 0) as avg_elderly_high, coalesce(avg(pct_65_plus), 0) as avg_elderly_all,
              coalesce(avg(renta_index) filter (where h), 0) as avg_income_high, coalesce(avg(renta_index), 0) as avg_income_all,
              coalesce(avg(vehicles_per_inhab) filter (where h), 0) as avg_cars_high,
              coalesce(avg(vehicles_per_inhab), 0) as avg_cars_all from t""",
    "high_population avg_elderly_high avg_elderly_all avg_income_high avg_income_all avg_cars_high avg_cars_all",
)
def _(b):
    return social.tier_means(social.vulnerability(social.profiles(b.scored(), SLOT)))


@query(
    "a38_socio_map",
    """select m.muni_code, m.name, v.weighted_avg_score, d.pop_total, d.pct_0_17, d.pct_18_25, d.pct_65_plus, i.renta_index,
              c.vehicles_per_inhab, v.vuln_score as vulnerability
       from munis m left join vuln v on v.muni_code = m.muni_code left join last_demo d on d.muni_code = m.muni_code
       left join last_income i on i.muni_code = m.muni_code left join last_cars c on c.muni_code = m.muni_code""",
    "weighted_avg_score pct_0_17 pct_18_25 pct_65_plus renta_index vehicles_per_inhab vulnerability",
)
def _(b):
    return social.socio_map(b.scored(), SLOT)


@query(
    "a27_j22_equity_hotspots",
    """with o as (select code, name, population, weighted_avg_score, coalesce(weighted_avg_score, 0) as score,
                         row_number() over (order by coalesce(weighted_avg_score, 0)) - 1 as rn, count(*) over () as n
                  from muni_rank),
       m as (select max(score) as med from o where rn = n // 2)
       select o.code, o.name, o.population, o.weighted_avg_score, med - o.score as gap,
              o.population * (100 - o.score) as burden, p.renta_index, p.vehicles_per_inhab, p.pct_65_plus
       from o cross join m left join prof p on p.muni_code = o.code
       where o.population > 5000 and o.score < med order by burden desc, o.code limit 12""",
    "population weighted_avg_score gap burden renta_index vehicles_per_inhab pct_65_plus",
)
def _(b):
    ws = b.scored()
    return social.hotspots(areas.area_ranking(ws, "municipalities", SLOT), social.profiles(ws, SLOT))


@query(
    "a30_social_overlaps",
    """with f as (select * from prof where weighted_avg_score is not null and renta_index is not null
                    and vehicles_per_inhab is not null and pct_65_plus is not null),
       fm as (select avg(weighted_avg_score) as ms, avg(renta_index) as mi, avg(vehicles_per_inhab) as mc from f),
       b as (select * from prof where pop_total is not null and weighted_avg_score is not null),
       bm as (select avg(weighted_avg_score) as ms, coalesce(avg(renta_index), 0) as mi, coalesce(avg(vehicles_per_inhab), 0) as mc from b),
       x as (select count(*) as full_count,
                    count(*) filter (where weighted_avg_score < ms and renta_index < mi) as full_low_income_low_score,
                    count(*) filter (where weighted_avg_score < ms) as full_low_score,
                    cast(coalesce(sum(pop_65_plus) filter (where weighted_avg_score < ms), 0) as bigint) as full_elderly_low_score,
                    count(*) filter (where weighted_avg_score < ms and vehicles_per_inhab > mc) as full_car_dependent,
                    max(mc) as full_avg_cars from f, fm),
       nm as (select coalesce(string_agg(name, ', ' order by population desc, name), '') as full_names
              from (select name, population from f, fm where weighted_avg_score < ms and renta_index < mi
                    order by population desc, name limit 4)),
       y as (select count(*) filter (where weighted_avg_score < ms) as low_score,
                    cast(coalesce(sum(pop_65_plus) filter (where weighted_avg_score < ms), 0) as bigint) as elderly_low_score,
                    cast(coalesce(sum(pop_0_17) filter (where weighted_avg_score < ms), 0) as bigint) as children_low_score,
                    cast(coalesce(sum(pop_18_25) filter (where weighted_avg_score < ms), 0) as bigint) as youth_low_score,
                    count(*) filter (where weighted_avg_score < ms and renta_index < mi) as low_income_low_score,
                    coalesce(sum(population) filter (where weighted_avg_score < ms and renta_index < mi), 0) as low_income_population,
                    count(*) filter (where weighted_avg_score < ms and vehicles_per_inhab < mc) as carless_low_score,
                    coalesce(sum(population) filter (where weighted_avg_score < ms and vehicles_per_inhab < mc), 0) as carless_population
             from b, bm)
       select * from x, nm, y""",
    "full_avg_cars low_income_population carless_population",
)
def _(b):
    return social.overlaps(social.profiles(b.scored(), SLOT))


@query(
    "a34_composition",
    """select muni_code, name, coalesce(pct_0_17, 0) as children, coalesce(pct_18_25, 0) as youth, coalesce(pct_65_plus, 0) as elderly,
              100 - coalesce(pct_0_17, 0) - coalesce(pct_18_25, 0) - coalesce(pct_65_plus, 0) as adults
       from prof where pop_total > 0 order by coalesce(pct_65_plus, 0) desc, muni_code limit 25""",
    "children youth elderly adults",
)
def _(b):
    return social.composition(social.profiles(b.scored(), SLOT))


def _scatter(x: str) -> str:
    return f"""
        with p as (select muni_code, name, {x} as x, weighted_avg_score as y, population as z from prof
                   where {x} is not null and weighted_avg_score is not null and population is not null)
        select p.*, avg_x, avg_y, correlation from p, (select avg(x) as avg_x, avg(y) as avg_y, corr(x, y) as correlation from p)"""


for _x in ("renta_index", "vehicles_per_inhab"):

    @query(f"a35_scatter_{_x}", _scatter(_x), "x y z avg_x avg_y correlation")
    def _(b, x=_x):
        return social.scatter(social.profiles(b.scored(), SLOT), x)
