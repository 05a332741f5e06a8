"""The driver tables in the shape of the serving tables.

The ``fx_`` statements run unchanged in Spark SQL and in the SQL oracle. The
oracle builds everything else by itself; Spark uses the library.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import cache

from pyspark.sql import DataFrame, SparkSession, functions as F

from reachgrid.params import PURPOSES
from reachgrid.plans.jobs import score_frames
from reachgrid.session import written
from reachgrid.workspace import Workspace

TENANT = "demo"
SLOT = "08:00"
#: Rows of travel times in a part; rows are narrow, so that parts by bytes would be long.
PART = 500_000
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()

FX: dict[str, str] = {
    "fx_grid_cells": """
        select c_custkey as id,
               concat('E', cast(500000 + (c_custkey % 40) * 250 as string),
                      '_N', cast(4790000 + cast(floor(c_custkey / 40) as bigint) * 250 as string)) as cell_code,
               cast(500000 + (c_custkey % 40) * 250 as double) as x0,
               cast(4790000 + cast(floor(c_custkey / 40) as bigint) * 250 as double) as y0,
               case when c_acctbal > 0 then cast(c_acctbal as double) else cast(0 as double) end as population,
               cast(c_nationkey as bigint) as muni_key
        from customer""",
    "fx_destinations": """
        select s_suppkey as id, cast(s_nationkey % 10 + 1 as int) as type_id, s_name as name,
               cast(1 + s_suppkey % 4 as double) / cast(2 as double) as weight,
               cast(500000 + (s_suppkey * 97 % 400) * 25 + 7 as double) as x,
               cast(4790000 + (s_suppkey * 61 % 380) * 25 + 11 as double) as y
        from supplier""",
    "fx_travel_times": """
        select o_custkey as origin_cell_id, l_suppkey as destination_id, 'TRANSIT' as mode,
               case l_linenumber when 1 then '07:00' when 2 then '07:30' when 3 then '08:00'
                    when 4 then '08:30' when 5 then '09:00' when 6 then '09:30' else '10:00' end as departure_time,
               min(l_quantity * cast(2.5 as double)) as travel_time_minutes
        from lineitem join orders on l_orderkey = o_orderkey
        group by o_custkey, l_suppkey, l_linenumber""",
    "fx_municipalities": """
        select cast(n_nationkey as bigint) as muni_key, n_name as name, cast(n_regionkey as bigint) as comarca_key
        from nation""",
    "fx_area_edges": """
        with a as (
          select cast(n_nationkey as bigint) as area_id,
                 cast(500000 + (n_nationkey % 5) * 2000 as double) as xa,
                 cast(4790000 + cast(floor(n_nationkey / 5) as bigint) * 1900 as double) as ya
          from nation)
        select area_id, 1 as edge, xa as ax, ya as ay, xa + 2000 as bx, ya + 125 as by from a
        union all select area_id, 2, xa + 2000, ya + 125, xa + 2000, ya + 2025 from a
        union all select area_id, 3, xa + 2000, ya + 2025, xa, ya + 1900 from a
        union all select area_id, 4, xa, ya + 1900, xa, ya from a""",
    "fx_population_boxes": """
        select s_suppkey as source_id,
               cast(500000 + (s_suppkey * 97 % 380) * 25 as double) as x0,
               cast(4790000 + (s_suppkey * 61 % 360) * 25 as double) as y0,
               cast(500000 + (s_suppkey * 97 % 380) * 25 + 100 + (s_suppkey % 7) * 150 as double) as x1,
               cast(4790000 + (s_suppkey * 61 % 360) * 25 + 100 + (s_suppkey % 5) * 200 as double) as y1,
               abs(cast(s_acctbal as double)) as population
        from supplier""",
    "fx_demographics": """
        select cast(c_nationkey as bigint) as muni_key, cast(year(o_orderdate) as int) as year,
               count(*) as pop_total,
               count(*) filter (where o_orderpriority = '1-URGENT') as pop_0_17,
               count(*) filter (where o_orderpriority = '2-HIGH') as pop_18_25,
               count(*) filter (where o_orderpriority = '5-LOW') as pop_65_plus
        from orders join customer on o_custkey = c_custkey
        group by c_nationkey, year(o_orderdate)""",
    "fx_income": """
        select cast(c_nationkey as bigint) as muni_key, cast(year(o_orderdate) as int) as year,
               sum(cast(o_totalprice as decimal(18,2))) as renta_total, count(*) as n
        from orders join customer on o_custkey = c_custkey
        where o_orderstatus = 'F'
        group by c_nationkey, year(o_orderdate)""",
    "fx_cars": """
        select cast(c_nationkey as bigint) as muni_key, cast(year(o_orderdate) as int) as year,
               cast(count(distinct o_custkey) as double) / cast(count(*) as double) as vehicles_per_inhab
        from orders join customer on o_custkey = c_custkey
        where o_orderstatus <> 'F'
        group by c_nationkey, year(o_orderdate)""",
    "fx_stop_times": """
        select user_id as stop_id, event_id % 4000 as trip_id, event_type as service_id,
               cast(hour(ts) as int) * 60 + cast(minute(ts) as int) as dep_min,
               cast(day(ts) as int) % 7 as dow
        from events""",
}

# Slots of the lines of an order, as in ``fx_travel_times``; all later lines have the last.
LINE_SLOTS = ("07:00", "07:30", "08:00", "08:30", "09:00", "09:30")
LAST_SLOT = "10:00"


@cache
def _read(spark: SparkSession, app: str, path: str) -> DataFrame:
    """A table's scan; the schema is looked up once per application."""
    return spark.read.parquet(path)


class Bound:
    """The bindings over one folder of driver tables."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder

    def raw(self, name: str) -> DataFrame:
        return _read(self.spark, self.spark.sparkContext.applicationId, f"{self.folder}/{name}.parquet")

    def fx(self, name: str) -> DataFrame:
        """One binding; the statement's tables are passed in, no view is left behind."""
        text = FX[name]
        used = {t: self.raw(t) for t in TABLES if f" {t}" in text}
        for t in used:
            text = text.replace(f"from {t}", f"from {{{t}}}").replace(f"join {t}", f"join {{{t}}}")
        return self.spark.sql(text, **used)

    def inputs(self) -> dict[str, Callable[[], DataFrame]]:
        """Everything but the scores, made from the driver tables when asked for."""
        made = (
            self.grid_cells, self.destinations, self.destination_types, self.travel_times, self.municipalities, self.comarcas,
            self.municipalities_edges, self.comarcas_edges, self.municipality_demographics, self.municipality_income,
            self.municipality_car_ownership,
        )
        return {m.__name__: m for m in made}

    def grid_cells(self) -> DataFrame:
        cells = self.fx("fx_grid_cells").withColumns({"x": F.col("x0") + 125, "y": F.col("y0") + 125})
        return cells.select(
            "id", tenant(), "cell_code", "x0", "y0", F.lit(250.0).alias("size"), *pseudo_degrees(), "population",
            F.col("muni_key").cast("string").alias("muni_code"),
        )

    def destinations(self) -> DataFrame:
        return self.fx("fx_destinations").select(
            "id", tenant(), "type_id", "name", "weight", F.lit("{}").alias("metadata"), *pseudo_degrees(), "x", "y"
        )

    def destination_types(self) -> DataFrame:
        kinds = self.raw("nation").select((F.col("n_nationkey") % 10).alias("k")).distinct()
        return kinds.select(
            (F.col("k") + 1).cast("int").alias("id"), purpose_code().alias("code"),
            F.when(F.col("k") < 8, F.upper(purpose_code())).alias("label"), F.lit("").alias("description"),
        )

    def travel_times(self) -> DataFrame:
        """The rows of ``fx_travel_times``, dealt by cell in parts of bounded size.

        They are moved once for their own grouping and for any by cell behind
        it; no task's groups outgrow its memory.
        """
        lines = self.raw("lineitem")
        parts = -(-lines.count() // PART)
        met = lines.join(self.raw("orders"), F.col("l_orderkey") == F.col("o_orderkey")).select(
            "o_custkey", "l_suppkey", "l_linenumber", (F.col("l_quantity") * 2.5).alias("minutes")
        )
        # Few rows are left to AQE.
        dealt = met.repartition(max(parts, self.spark.sparkContext.defaultParallelism), "o_custkey") if parts > 1 else met.repartition("o_custkey")
        least = dealt.groupBy("o_custkey", "l_suppkey", "l_linenumber").agg(F.min("minutes").alias("travel_time_minutes"))
        slot = F.get(F.array(*map(F.lit, LINE_SLOTS)), F.col("l_linenumber") - 1)
        return least.select(
            tenant(), F.col("o_custkey").alias("origin_cell_id"), F.col("l_suppkey").alias("destination_id"),
            F.lit("TRANSIT").alias("mode"), "travel_time_minutes",
            F.coalesce(slot, F.lit(LAST_SLOT)).alias("departure_time"),
        )

    def municipalities(self) -> DataFrame:
        return self.fx("fx_municipalities").select(F.col("muni_key").alias("id"), tenant(), muni_code(), "name")

    def comarcas(self) -> DataFrame:
        return self.raw("region").select(
            F.col("r_regionkey").cast("bigint").alias("id"), tenant(),
            F.col("r_regionkey").cast("string").alias("comarca_code"), F.col("r_name").alias("name"),
        )

    def municipalities_edges(self) -> DataFrame:
        return self.fx("fx_area_edges").select(F.col("area_id").cast("string").alias("code"), "ax", "ay", "bx", "by")

    def comarcas_edges(self) -> DataFrame:
        owner = self.fx("fx_municipalities").select(F.col("muni_key").alias("area_id"), "comarca_key")
        joined = self.fx("fx_area_edges").join(owner, "area_id")
        return joined.select(F.col("comarca_key").cast("string").alias("code"), "ax", "ay", "bx", "by")

    def municipality_demographics(self) -> DataFrame:
        share = {c: (F.col(c) / F.col("pop_total") * 100.0).alias(c.replace("pop", "pct")) for c in ("pop_0_17", "pop_18_25", "pop_65_plus")}
        rest = F.col("pop_total") - F.col("pop_0_17") - F.col("pop_18_25") - F.col("pop_65_plus")
        return self.fx("fx_demographics").select(
            muni_code(), "year", "pop_total", "pop_0_17", "pop_18_25", rest.alias("pop_26_64"), "pop_65_plus", *share.values()
        )

    def municipality_income(self) -> DataFrame:
        mean = F.col("renta_total").cast("double") / F.col("n")
        return self.fx("fx_income").select(
            muni_code(), "year", mean.alias("renta_personal_media"), (mean * 0.5).alias("renta_disponible_media"),
            (mean / 1000.0).alias("renta_index"),
        )

    def municipality_car_ownership(self) -> DataFrame:
        return self.fx("fx_cars").select(muni_code(), "year", "vehicles_per_inhab")

    def workspace(self) -> Workspace:
        """Inputs only: scores are not stored, nothing is read before the query runs."""
        return Workspace(self.spark, None, TENANT, self.inputs())

    def scored(self) -> Workspace:
        """Inputs and written scores, as after a scoring job; reports start here."""
        return _scored(self.spark, self.spark.sparkContext.applicationId, self.folder)


@cache
def _scored(spark: SparkSession, app: str, folder: str) -> Workspace:
    bound = Bound(spark, folder)
    frames = bound.inputs()
    ws = Workspace(spark, None, TENANT, frames)
    for name, df in score_frames(ws, store=True).items():
        frames[name] = written(df, name, ["departure_time"], move=False)
    ws = Workspace(spark, None, TENANT, frames)
    for layer in ("municipalities", "comarcas"):
        frames[f"{layer}_cells"] = written(ws.area_cells(layer), f"{layer}_cells")
    return Workspace(spark, None, TENANT, frames)


def tenant():
    return F.lit(TENANT).alias("tenant_id")


def muni_code():
    return F.col("muni_key").cast("string").alias("muni_code")


def purpose_code():
    """Purpose code of type number k (0-9)."""
    names = F.array(*[F.lit(p) for p in PURPOSES])
    return F.element_at(names, (F.col("k") + 1).cast("int"))


def pseudo_degrees():
    """Degrees near the demo region, linear in x and y so the oracle can repeat them."""
    return ((F.col("x") - 500000.0) / 80000.0 - 3.0).alias("lon"), ((F.col("y") - 4790000.0) / 110000.0 + 43.0).alias("lat")
