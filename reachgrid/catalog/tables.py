"""Scans, listings, keys, text functions and set operations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from reachgrid.catalog.bindings import SLOT
from reachgrid.catalog.registry import query
from reachgrid.functions import text
from reachgrid.functions.numbers import age_split
from reachgrid.operators import keys
from reachgrid.operators.ordering import fill_forward, number_rows, number_scan, scan_order
from reachgrid.plans import listings
from reachgrid.sources.census import by_municipality, match_sections
from reachgrid.sources.indicators import merge_indicators
from reachgrid.sources.pois import judged
from reachgrid.sources.sinks import endpoint_rows
from reachgrid.workspace import Workspace


@query("s01_scan_table", "select count(*) as n, sum(population) as population, max(cell_code) as last_code from cells", "population")
def _(b):
    cells = b.workspace().table("grid_cells")
    return cells.agg(F.count("*").alias("n"), F.sum("population").alias("population"), F.max("cell_code").alias("last_code"))


@query("s02_scan_directory", "select departure_time, count(*) as n from conn group by departure_time")
def _(b):
    return b.scored().table("connectivity_scores").groupBy("departure_time").agg(F.count("*").alias("n"))


@query("p01_tenant_filter", "select c_custkey as id, c_name as name from customer where c_mktsegment = 'BUILDING'")
def _(b):
    rows = b.raw("customer").select(
        F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("tenant_id"), F.col("c_name").alias("name")
    )
    return Workspace(b.spark, tenant="BUILDING", frames={"municipalities": rows}).table("municipalities").drop("tenant_id")


# Settlements from suppliers; every fifth nation's are dispersed.
NUCLEOS = """
    select s_suppkey as id, 'demo' as tenant_id, concat('n', cast(s_suppkey as string)) as code,
           case when s_nationkey % 5 = 0 then '99' else concat('0', cast(s_nationkey % 5 as string)) end as nucleo_num,
           s_name as name, '' as entity_name, cast(s_nationkey as string) as muni_code, n_name as muni_name
    from {supplier} join {nation} on n_nationkey = s_nationkey"""
NUCLEOS_SQL = NUCLEOS.replace("{", "").replace("}", "")


def settlements(b) -> Workspace:
    rows = b.spark.sql(NUCLEOS, supplier=b.raw("supplier"), nation=b.raw("nation"))
    return Workspace(b.spark, tenant="demo", frames={**b.inputs(), "nucleos": rows})


@query(
    "p09_l04_settlements",
    f"select id, code, nucleo_num, name, entity_name, muni_code, muni_name from ({NUCLEOS_SQL}) where nucleo_num <> '99'",
)
def _(b):
    return listings.layer(settlements(b), "nucleos")


@query(
    "l04_settlements_with_dispersed",
    f"select id, code, nucleo_num, name, entity_name, muni_code, muni_name from ({NUCLEOS_SQL})",
)
def _(b):
    return listings.layer(settlements(b), "nucleos", include_dispersed=True)


@query("p13_name_search", f"select id, name from ({NUCLEOS_SQL}) where lower(name) like '%1%' and nucleo_num <> '99'")
def _(b):
    return listings.layer(settlements(b), "nucleos", name_like="1").select("id", "name")


@query("l01_boundary", "select r_regionkey::bigint as id, r_name as name, 'region' as boundary_type from region")
def _(b):
    rows = b.raw("region").select(
        F.col("r_regionkey").cast("bigint").alias("id"), F.lit("demo").alias("tenant_id"),
        F.col("r_name").alias("name"), F.lit("region").alias("boundary_type"),
    )
    return listings.layer(Workspace(b.spark, tenant="demo", frames={"boundaries": rows}), "boundaries")


@query("l02_o02_municipalities", "select muni_key as id, muni_code, name from munis")
def _(b):
    return listings.layer(b.workspace(), "municipalities")


@query("l03_comarcas", "select r_regionkey::bigint as id, cast(r_regionkey as varchar) as comarca_code, r_name as name from region")
def _(b):
    return listings.layer(b.workspace(), "comarcas")


@query("l05_destination_types", "select code, label from types")
def _(b):
    return listings.destination_types(b.workspace())


@query(
    "l06_j20_destinations",
    """select d.id, d.name, p.code as type, p.label as type_label, d.weight, d.lon, d.lat
       from dests d join types p on p.id = d.type_id""",
    "weight lon lat",
)
def _(b):
    return listings.destinations(b.workspace())


@query(
    "w01_row_ids",
    """select row_number() over (order by cell_id, mode, purpose) as id, cell_id, mode, purpose from conn8""",
)
def _(b):
    rows = b.scored().at("connectivity_scores", SLOT).select("cell_id", "mode", "purpose")
    return number_rows(rows, [F.col("cell_id"), F.col("mode"), F.col("purpose")], "id")


@query(
    "w04_forward_fill",
    """select c_custkey as id, last_value(case when c_acctbal > 5000 then c_mktsegment end ignore nulls)
              over (order by c_custkey rows between unbounded preceding and current row) as segment,
              last_value(case when c_acctbal < 0 then c_nationkey end ignore nulls)
              over (order by c_custkey rows between unbounded preceding and current row) as nation
       from customer""",
)
def _(b):
    rows = scan_order(b.raw("customer")).select(
        F.col("c_custkey").alias("id"),
        F.when(F.col("c_acctbal") > 5000, F.col("c_mktsegment")).alias("segment"),
        F.when(F.col("c_acctbal") < 0, F.col("c_nationkey")).alias("nation"),
        "_file", "_block", "_pos",
    )
    return fill_forward(rows, ["segment", "nation"]).select("id", "segment", "nation")


@query(
    "u02_w06_append_with_new_ids",
    """with e as (select s_suppkey as id, s_name as name from supplier)
       select * from e union all
       select (select max(id) from e) + row_number() over (order by c_name), c_name from customer""",
)
def _(b):
    existing = b.raw("supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"))
    new = b.raw("customer").select(F.col("c_name").alias("name"))
    return keys.append_with_ids(existing, new, [F.col("name")])


@query(
    "u03_replace_by_type",
    """select s_suppkey as id, s_nationkey as type_id from supplier where s_nationkey not in (select c_nationkey * 2 from customer)
       union all
       select c_custkey, c_nationkey * 2 from customer""",
)
def _(b):
    existing = b.raw("supplier").select(F.col("s_suppkey").alias("id"), F.col("s_nationkey").alias("type_id"))
    # Customers come in under twice their type, so suppliers of odd types stay.
    incoming = b.raw("customer").select(F.col("c_custkey").alias("id"), (F.col("c_nationkey") * 2).alias("type_id"))
    return keys.replace_types(existing, incoming).unionByName(incoming)


@query(
    "u04_get_or_create_type",
    """with k as (select id, code from types),
       w as (select distinct trim(regexp_replace(lower(p_type), '[^a-z0-9]+', '_', 'g'), '_') as code from part
             union select 'hospital'),
       m as (select code from w where code not in (select code from k))
       select id, code from k
       union all select 10 + cast(row_number() over (order by code) as int), code from m""",
)
def _(b):
    types = b.workspace().table("destination_types").select("id", "code")
    wanted = b.raw("part").select(text.slug(F.col("p_type")).alias("code")).unionByName(
        types.where("code = 'hospital'").select("code")
    ).distinct()
    return keys.get_or_create(types, wanted)


@query("u01_concatenate_slots", "select departure_time, cell_id, combined_score from comb", "combined_score")
def _(b):
    ws = b.scored()
    shown = ["departure_time", "cell_id", "combined_score"]
    slots = ("07:00", "07:30", "08:00", "08:30", "09:00", "09:30", "10:00")
    return reduce(DataFrame.unionByName, [ws.at("combined_scores", s).select(*shown) for s in slots])


@query(
    "f08_f09_slug_and_label",
    """with s as (select p_partkey as id, trim(regexp_replace(lower(trim('  ' || p_name || ' (' || p_brand || ')')),
                                                              '[^a-z0-9]+', '_', 'g'), '_') as code from part)
       select id, code, array_to_string(list_transform(string_split(code, '_'),
              lambda w: upper(w[1]) || lower(w[2:])), ' ') as label from s""",
)
def _(b):
    raw = F.concat(F.lit("  "), "p_name", F.lit(" ("), "p_brand", F.lit(")"))
    return b.raw("part").select(F.col("p_partkey").alias("id"), text.slug(raw).alias("code")).withColumn(
        "label", text.label_from_code(F.col("code"))
    )


@query(
    "f11_european_numbers",
    """select s_suppkey as id, cast(s_suppkey * 1000 + 250 as int) as people, s_acctbal as amount, 0.0 as broken from supplier""",
    "amount broken",
)
def _(b):
    return b.raw("supplier").select(
        F.col("s_suppkey").alias("id"),
        text.dotted_int(F.concat(F.lit('"'), F.col("s_suppkey").cast("string"), F.lit('.250"'))).alias("people"),
        text.comma_float(F.replace(F.col("s_acctbal").cast("string"), F.lit("."), F.lit(","))).alias("amount"),
        text.comma_percent(F.lit("..")).alias("broken"),
    )


@query(
    "f12_f13_section_and_municipality_codes",
    """select c_custkey as id, '48' || cast(c_custkey as varchar) || '01' || '001' as section,
              case when length(cast(c_custkey as varchar)) = 3 then '48' || cast(c_custkey as varchar)
                   else cast(c_custkey as varchar) end as muni from customer""",
)
def _(b):
    code = F.col("c_custkey").cast("string")
    return b.raw("customer").select(
        F.col("c_custkey").alias("id"),
        text.section_key(F.lit("48"), code, F.lit("01"), F.lit("001")).alias("section"),
        text.full_municipality(code, "48").alias("muni"),
    )


# Census-like sections: one per customer, shares from the balance.
SECTIONS = """
    select cast(c_nationkey as string) as muni, cast(c_custkey % 900 as int) as population,
           abs(c_acctbal) / cast(300 as double) as pct_0_19, cast(60 as double) as pct_20_64,
           cast(40 as double) - abs(c_acctbal) / cast(300 as double) as pct_65
    from {customer}"""


@query(
    "a20_f14_age_groups",
    f"""with s as ({SECTIONS.replace("{customer}", "customer")}),
        b as (select muni, sum(population) as p, sum(population * pct_0_19 / 100) as a, sum(population * pct_20_64 / 100) as m,
                     sum(population * pct_65 / 100) as o from s group by muni),
        y as (select *, trunc(a * 0.9) as y0, trunc(m * 6 / 45) as e0 from b where p > 0)
        select case when length(muni) = 3 then '48' || muni else muni end as muni_code, cast(2025 as int) as year,
               cast(p as bigint) as pop_total, cast(y0 as bigint) as pop_0_17, cast(trunc(a - y0 + e0) as bigint) as pop_18_25,
               cast(trunc(m - e0) as bigint) as pop_26_64, cast(trunc(o) as bigint) as pop_65_plus,
               y0 / p * 100 as pct_0_17, trunc(a - y0 + e0) / p * 100 as pct_18_25, trunc(o) / p * 100 as pct_65_plus
        from y""",
)
def _(b):
    rows = b.spark.sql(SECTIONS, customer=b.raw("customer"))
    return by_municipality(rows, 2025, "48", digits=None)


@query(
    "f14_age_split",
    """select muni_code, year, trunc(pop_0_17 * 0.9)::int as pop_0_17, trunc(pop_26_64 * 1.0 * 6 / 45)::int as early,
              trunc(pop_0_17 - trunc(pop_0_17 * 0.9) + trunc(pop_26_64 * 1.0 * 6 / 45))::int as pop_18_25,
              trunc(pop_26_64 - trunc(pop_26_64 * 1.0 * 6 / 45))::int as pop_26_64, pop_65_plus::int as pop_65_plus from demo""",
)
def _(b):
    rows = b.workspace().table("municipality_demographics")
    split = age_split(*[F.col(c).cast("double") for c in ("pop_0_17", "pop_26_64", "pop_65_plus")])
    early = (F.col("pop_26_64").cast("double") * 6 / 45).cast("int").alias("early")
    return rows.select("muni_code", "year", early, *[c.alias(n) for n, c in split.items()])


@query(
    "j13_merged_indicators",
    """with i as (select muni_code, year, renta_index from income),
       c as (select muni_code, year, vehicles_per_inhab as cars from cars)
       select coalesce(i.muni_code, c.muni_code) as muni_code, coalesce(i.year, c.year) as year, renta_index, cars
       from i full join c on c.muni_code = i.muni_code and c.year = i.year
       where renta_index is not null or cars is not null""",
    "renta_index cars",
)
def _(b):
    ws = b.workspace()
    income = ws.table("municipality_income").select("muni_code", "year", F.col("renta_index").alias("value"))
    cars = ws.table("municipality_car_ownership").select(
        "muni_code", "year", F.col("vehicles_per_inhab").alias("value")
    )
    return merge_indicators({"renta_index": income, "cars": cars})


@query(
    "j14_sections_matched",
    """with p as (select s_nationkey, min(s_suppkey) as id from supplier group by s_nationkey)
       select c_custkey as population, cast(c_nationkey as varchar) as source_code, p.id as polygon
       from customer join p on p.s_nationkey = c_nationkey""",
)
def _(b):
    polygons = b.raw("supplier").select(
        F.col("s_nationkey").cast("string").alias("join_key"), F.col("s_suppkey").alias("polygon")
    )
    census = b.raw("customer").select(F.col("c_nationkey").cast("string").alias("source_code"), F.col("c_custkey").alias("population"))
    return match_sections(census, polygons, "polygon")[0]


@query(
    "j14_sections_unmatched",
    """select cast(c_nationkey as varchar) as source_code, count(*) as n from customer
       where c_nationkey not in (select s_nationkey + 5 from supplier) group by c_nationkey""",
)
def _(b):
    # Polygons of all suppliers, under keys that the first sections do not have.
    polygons = b.raw("supplier").select(
        (F.col("s_nationkey") + 5).cast("string").alias("join_key"), F.col("s_suppkey").alias("polygon")
    )
    census = b.raw("customer").select(F.col("c_nationkey").cast("string").alias("source_code"), F.col("c_custkey").alias("population"))
    return match_sections(census, polygons, "polygon")[1].groupBy("source_code").agg(F.count("*").alias("n"))


@query(
    "s05_ids_in_file_order",
    "select row_number() over (order by c_custkey) as id, c_custkey, c_name from customer",
)
def _(b):
    return number_scan(scan_order(b.raw("customer")).select("c_custkey", "c_name", "_file", "_block", "_pos"), "id")


@query(
    "s18_endpoint_rows",
    """select 'cell' as kind, id, printf('%.8f', lon) as lon, printf('%.8f', lat) as lat from cells
       union all select 'destination', id, printf('%.8f', lon), printf('%.8f', lat) from dests""",
)
def _(b):
    ws = b.workspace()
    cells, places = (endpoint_rows(ws.table(t)) for t in ("grid_cells", "destinations"))
    return cells.select(F.lit("cell").alias("kind"), "*").unionByName(places.select(F.lit("destination").alias("kind"), "*"))


# Places with every kind of fault, from customers.
PLACES = """
    select c_custkey as id, c_nationkey > 2 as unified, concat('type ', cast(c_nationkey as string)) as code,
           case when c_nationkey = 7 then '' else concat('type ', cast(c_nationkey as string)) end as label,
           case when c_mktsegment = 'MACHINERY' and c_acctbal < 500 then '' else c_name end as name,
           case when c_acctbal > 9500 then 'west' else cast(c_acctbal / cast(2000 as double) - cast(5 as double) as string) end as lon_text,
           cast(cast(43 as double) + cast(c_nationkey as double) / cast(40 as double) as string) as lat_text,
           case when c_nationkey % 4 = 0 then '' when c_nationkey % 4 = 1 then '0' when c_nationkey % 4 = 2 then '2.5' else 'heavy' end
             as weight_text
    from {customer}"""


@query(
    "p08_place_checks",
    f"""with p as ({PLACES.replace("{customer}", "customer")}),
        t as (select *, try_cast(lon_text as double) as lon, try_cast(lat_text as double) as lat,
                     case when weight_text = '' then 1.0::double else try_cast(weight_text as double) end as weight from p)
        select id, case when unified and label = '' then 'missing_type' when name = '' then 'missing_name'
                        when lon is null or lat is null then 'invalid_coordinates'
                        when not (lon between -3.5 and -2.3 and lat between 42.9 and 43.5) then 'outside_box'
                        when weight is null or weight <= 0 then 'invalid_weight' end as reason, weight from t""",
    "weight",
)
def _(b):
    return judged(b.spark.sql(PLACES, customer=b.raw("customer"))).select("id", "reason", "weight")
