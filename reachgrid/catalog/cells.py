"""Cell map, coarser grids, slots and single-cell detail."""

from __future__ import annotations

from pyspark.sql import functions as F

from reachgrid.catalog.bindings import SLOT
from reachgrid.catalog.registry import query
from reachgrid.functions import bands
from reachgrid.functions.geo import cell_code, cell_xy, code_of, snapped
from reachgrid.plans import cells as plan

SHOWN = ["id", "cell_code", "population", "score"]
BY_CELL = """select c.id, c.cell_code, c.population, {value} as score
             from cells c left join {table} s on s.cell_id = c.id {extra} group by c.id, c.cell_code, c.population"""
VARIANTS = {
    "score": ({}, "comb8", "max(s.combined_score_normalized)", ""),
    "score_mode": ({"mode": "TRANSIT"}, "conn8", "avg(s.score_normalized)", "and s.mode = 'TRANSIT'"),
    "score_purpose": ({"purpose": "hospital"}, "conn8", "avg(s.score_normalized)", "and s.purpose = 'hospital'"),
    "score_mode_purpose": (
        {"mode": "TRANSIT", "purpose": "hospital"},
        "conn8",
        "max(s.score_normalized)",
        "and s.mode = 'TRANSIT' and s.purpose = 'hospital'",
    ),
    "time": ({"metric": "travel_time"}, "near8", "avg(s.min_travel_time_minutes)", ""),
    "time_mode": (
        {"metric": "travel_time", "mode": "TRANSIT"},
        "near8",
        "avg(s.min_travel_time_minutes)",
        "and s.mode = 'TRANSIT'",
    ),
    "time_purpose": (
        {"metric": "travel_time", "purpose": "hospital"},
        "near8",
        "min(s.min_travel_time_minutes)",
        "and s.purpose = 'hospital'",
    ),
    "time_mode_purpose": (
        {"metric": "travel_time", "mode": "TRANSIT", "purpose": "hospital"},
        "near8",
        "max(s.min_travel_time_minutes)",
        "and s.mode = 'TRANSIT' and s.purpose = 'hospital'",
    ),
}


def _register_variants() -> None:
    for name, (args, table, value, extra) in VARIANTS.items():
        sql = BY_CELL.format(table=table, value=value, extra=extra)

        @query(f"a15_cell_metric_{name}", sql, "population score")
        def _(b, args=args):
            return plan.cell_metric(b.scored(), SLOT, **args).select(*SHOWN)

        for size in (500, 1000):
            rolled = f"""
                select 'E' || cast(floor(x0 / {size}) * {size} as bigint) || '_N' ||
                       cast(floor(y0 / {size}) * {size} as bigint) as cell_code,
                       sum(b.population) as population,
                       coalesce(sum(b.population * score) / nullif(sum(case when score is not null then b.population end), 0),
                                avg(score)) as score,
                       min(x0) as xmin, min(y0) as ymin, max(x0 + 250) as xmax, max(y0 + 250) as ymax
                from ({sql}) b join cells using (id) group by floor(x0 / {size}), floor(y0 / {size})"""
            if name in ("score", "time_purpose"):

                @query(f"a16_rollup_{size}_{name}", rolled, "population score")
                def _(b, args=args, size=size):
                    return plan.rollup(plan.cell_metric(b.scored(), SLOT, **args), size)


_register_variants()


@query(
    "j02_cells_left_scores",
    """select c.id, s.purpose, s.score_normalized from cells c
       left join conn8 s on s.cell_id = c.id and s.mode = 'TRANSIT'""",
    "score_normalized",
)
def _(b):
    ws = b.scored()
    scores = ws.at("connectivity_scores", SLOT).where("mode = 'TRANSIT'").select("cell_id", "purpose", "score_normalized")
    cells = ws.table("grid_cells").select("id")
    return cells.join(scores, cells.id == scores.cell_id, "left").drop("cell_id")


@query(
    "a17_cell_detail",
    """select c.id, c.cell_code, c.population, s.combined_score, s.combined_score_normalized,
              coalesce(k.n, 0) as score_count, k.first_purpose, k.last_purpose, k.total
       from cells c left join comb8 s on s.cell_id = c.id
       left join (select cell_id, count(*) as n, min(purpose) as first_purpose, max(purpose) as last_purpose,
                         sum(score_normalized) as total from conn8 group by cell_id) k on k.cell_id = c.id""",
    "population combined_score combined_score_normalized total",
)
def _(b):
    scores = F.col("scores")
    return plan.cell_detail(b.scored(), SLOT).select(
        "id",
        "cell_code",
        "population",
        "combined_score",
        "combined_score_normalized",
        F.coalesce(F.when(scores.isNotNull(), F.size(scores)), F.lit(0)).cast("bigint").alias("score_count"),
        F.element_at(scores, 1)["purpose"].alias("first_purpose"),
        F.element_at(scores, -1)["purpose"].alias("last_purpose"),
        F.aggregate(scores, F.lit(0.0), lambda acc, s: acc + s["score_normalized"]).alias("total"),
    )


@query("a18_u05_slots", "select distinct departure_time from conn")
def _(b):
    return plan.slots(b.scored())


@query(
    "a36_map_classes",
    """select c.id, case when t.m < 30 then '< 30 min' when t.m < 45 then '30-45 min' when t.m < 60 then '45-60 min'
                         when t.m < 75 then '60-75 min' when t.m < 90 then '75-90 min' else '> 90 min' end as time_band,
              cast(case when s.v is null then null else
                1 + (s.v >= 9)::int + (s.v >= 18)::int + (s.v >= 27)::int + (s.v >= 36)::int + (s.v >= 45)::int
                  + (s.v >= 54)::int + (s.v >= 63)::int + (s.v >= 72)::int + (s.v >= 81)::int + (s.v >= 90)::int
                  + (s.v >= 100)::int end as integer) as score_class
       from cells c
       left join (select cell_id, min(min_travel_time_minutes) as m from near8 where purpose = 'hospital' group by cell_id) t
         on t.cell_id = c.id
       left join (select cell_id, combined_score_normalized as v from comb8) s on s.cell_id = c.id""",
)
def _(b):
    ws = b.scored()
    minutes = plan.cell_metric(ws, SLOT, purpose="hospital", metric="travel_time")
    scores = plan.cell_metric(ws, SLOT).select("id", F.col("score").alias("combined"))
    return minutes.join(scores, "id").select(
        "id", bands.time_band(F.col("score")).alias("time_band"), bands.score_class(F.col("combined")).alias("score_class")
    )


@query(
    "f06_snap_to_grid",
    """select s_suppkey as id, 'E' || cast(floor(x / 250) * 250 as bigint) || '_N' || cast(floor(y / 250) * 250 as bigint) as code
       from (select s_suppkey, s_acctbal * 100 + 500000 as x, s_acctbal * 50 + 4790000 as y from supplier)""",
)
def _(b):
    points = b.raw("supplier").select(
        F.col("s_suppkey").alias("id"), (F.col("s_acctbal") * 100 + 500000).alias("x"), (F.col("s_acctbal") * 50 + 4790000).alias("y")
    )
    return points.select("id", cell_code(F.col("x"), F.col("y")).alias("code"))


@query(
    "f07_coarser_code",
    """select id, 'E' || cast(floor(e / 1000) * 1000 as bigint) || '_N' || cast(floor(n / 1000) * 1000 as bigint) as code_1km, e, n
       from (select id, cast(regexp_extract(cell_code, 'E(\\d+)_N', 1) as bigint) as e,
                    cast(regexp_extract(cell_code, '_N(\\d+)', 1) as bigint) as n from cells)""",
)
def _(b):
    east, north = cell_xy(F.col("cell_code"))
    return b.workspace().table("grid_cells").select("id", east.alias("e"), north.alias("n")).select(
        "id", code_of(snapped(F.col("e"), 1000), snapped(F.col("n"), 1000)).alias("code_1km"), "e", "n"
    )


@query(
    "f17_null_safe_ratio",
    """select purpose, coalesce(sum(population * score_normalized) / nullif(sum(population), 0), avg(score_normalized)) as ratio,
              least(greatest(max(score_normalized), 10), 90) as bounded
       from conn8 join cells on cells.id = conn8.cell_id group by purpose""",
    "ratio bounded",
)
def _(b):
    ws = b.scored()
    facts = ws.at("connectivity_scores", SLOT).join(
        ws.table("grid_cells").select(F.col("id").alias("cell_id"), "population"), "cell_id"
    )
    people = F.sum("population")
    return facts.groupBy("purpose").agg(
        F.coalesce(
            F.sum(F.col("population") * F.col("score_normalized")) / F.nullif(people, F.lit(0.0)), F.avg("score_normalized")
        ).alias("ratio"),
        F.least(F.greatest(F.max("score_normalized"), F.lit(10.0)), F.lit(90.0)).alias("bounded"),
    )


@query(
    "s19_cell_features",
    """select count(*) as features, count(*) filter (where s.cell_id is not null) as scored from cells c
       left join comb8 s on s.cell_id = c.id""",
)
def _(b):
    features = plan.cell_features(b.scored(), SLOT)
    score = F.get_json_object("feature", "$.properties.score")
    valid = F.get_json_object("feature", "$.geometry.type") == "Polygon"
    return features.agg(F.count_if(valid).alias("features"), F.count_if(valid & score.isNotNull()).alias("scored"))
