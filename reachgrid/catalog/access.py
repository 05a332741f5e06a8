"""Scoring: decay, sums, normalisation, combination, nearest destination, OD import."""

from __future__ import annotations

from pyspark.sql import functions as F

from reachgrid.catalog.registry import query
from reachgrid.functions.scoring import concave, impedance
from reachgrid.operators import scoring as op
from reachgrid.params import ScoreParams
from reachgrid.plans.jobs import score_frames
from reachgrid.sources import od as od_source

PARAMS = ScoreParams()


def rows_of(b, **limits):
    ws = b.workspace()
    return op.reached(
        ws.table("travel_times"), ws.table("destinations"), ws.table("destination_types"), PARAMS, **limits
    )


@query(
    "f01_impedance",
    """select departure_time, count(*) as n, sum(exp(-0.03 * travel_time_minutes)) as total,
              min(exp(-0.03 * travel_time_minutes)) as lowest
       from fx_travel_times group by departure_time""",
    "total lowest",
)
def _(b):
    value = impedance(F.col("travel_time_minutes"), 0.03)
    return b.workspace().table("travel_times").groupBy("departure_time").agg(
        F.count("*").alias("n"), F.sum(value).alias("total"), F.min(value).alias("lowest")
    )


@query(
    "f02_concave",
    "select s_suppkey as id, power(abs(s_acctbal), 0.7) as score, power(0.0, 0.7) as of_zero from supplier",
    "score of_zero",
)
def _(b):
    return b.raw("supplier").select(
        F.col("s_suppkey").alias("id"),
        concave(F.abs("s_acctbal"), 0.7).alias("score"),
        concave(F.col("s_acctbal") * 0.0, 0.7).alias("of_zero"),
    )


@query(
    "f03_alpha_lookup",
    """select c as case_mode, purpose, case when c = 'TRANSIT' then 0.03 else 0.05 end as alpha
       from (select code as purpose from types) p
       cross join (select distinct case when l_returnflag = 'R' then 'TRANSIT' else 'OTHER' end as c from lineitem) m""",
    "alpha",
)
def _(b):
    modes = b.raw("lineitem").select(F.when(F.col("l_returnflag") == "R", "TRANSIT").otherwise("OTHER").alias("mode")).distinct()
    purposes = b.workspace().table("destination_types").select(F.col("code").alias("purpose"))
    pairs = modes.select("mode", F.lit(1).alias("k")).join(purposes.select("purpose", F.lit(1).alias("k")), "k")
    alpha = PARAMS.alpha_of(F.col("mode"), F.col("purpose"))
    return pairs.select(F.col("mode").alias("case_mode"), "purpose", alpha.alias("alpha"))


@query(
    "f04_unmapped_types",
    """select p.code, count(*) as rows_dropped from fx_travel_times t join fx_destinations d on d.id = t.destination_id
       join types p on p.id = d.type_id where t.travel_time_minutes <= 120 and p.code in ('hospital', 'hacienda')
       group by p.code""",
)
def _(b):
    ws = b.workspace()
    partial = PARAMS.with_changes(
        purpose_map={k: v for k, v in PARAMS.purpose_map.items() if k not in ("hospital", "hacienda")}
    )
    return op.unmapped_types(ws.table("travel_times"), ws.table("destinations"), ws.table("destination_types"), partial)


@query(
    "f18_weights_json",
    """select departure_time, count(*) as cells,
              '{"TRANSIT":{' || (select string_agg('"' || code || '":0.1', ',' order by code) from types) || '}}' as weights
       from comb group by departure_time""",
)
def _(b):
    combined = b.scored().table("combined_scores")
    return combined.groupBy("departure_time", "weights").agg(F.count("*").alias("cells"))


@query(
    "j01_od_with_destinations",
    """select departure_time, purpose, count(*) as n, sum(m) as minutes, sum(c) as contribution
       from reach group by departure_time, purpose""",
    "minutes contribution",
)
def _(b):
    return rows_of(b).groupBy("departure_time", "purpose").agg(
        F.count("*").alias("n"), F.sum("travel_time_minutes").alias("minutes"), F.sum("contribution").alias("contribution")
    )


@query(
    "j03_restricted_to_cells",
    """select departure_time, cell_id, mode, purpose, raw_score from grav
       where cell_id in (select c_custkey from customer where c_mktsegment = 'BUILDING')""",
    "raw_score",
)
def _(b):
    cells = b.raw("customer").where(F.col("c_mktsegment") == "BUILDING").select(F.col("c_custkey").alias("id"))
    return op.gravity(rows_of(b, cells=cells), PARAMS).select(*op.GROUP, "raw_score")


@query(
    "j19_rescaled_weights",
    """select departure_time, mode, purpose, cell_id, w, w * score_normalized as weighted
       from conn join wts using (departure_time, mode, purpose)""",
    "w weighted",
)
def _(b):
    scores = b.scored().table("connectivity_scores")
    weights = op.rescaled_weights(scores.select(*op.STRATUM).distinct(), PARAMS)
    return scores.join(F.broadcast(weights), op.STRATUM).select(
        *op.STRATUM, "cell_id", "w", (F.col("w") * F.col("score_normalized")).alias("weighted")
    )


@query(
    "p07_cut_off",
    """select departure_time, count(*) as n, max(travel_time_minutes) as slowest from fx_travel_times
       where travel_time_minutes <= 120 group by departure_time""",
    "slowest",
)
def _(b):
    kept = op.within(b.workspace().table("travel_times"), PARAMS)
    return kept.groupBy("departure_time").agg(F.count("*").alias("n"), F.max("travel_time_minutes").alias("slowest"))


@query("a01_gravity", "select * from grav", "raw_score score")
def _(b):
    return op.gravity(rows_of(b), PARAMS)


@query(
    "a02_minmax",
    "select departure_time, cell_id, mode, purpose, score, score_normalized from conn",
    "score score_normalized",
)
def _(b):
    scores = op.gravity(rows_of(b), PARAMS)
    return op.minmax(scores, "score", op.STRATUM, "score_normalized").drop("raw_score")


@query(
    "a03_combined",
    "select departure_time, cell_id, combined_score, combined_score_normalized from comb",
    "combined_score combined_score_normalized",
)
def _(b):
    scores = op.gravity(rows_of(b), PARAMS)
    strata = op.rescaled_weights(op.extremes(scores, "score", op.STRATUM), PARAMS)
    return op.combine(op.normalised(scores, strata))


@query("a04_nearest", "select * from near", "min_travel_time_minutes")
def _(b):
    return op.nearest(rows_of(b), PARAMS.max_minutes)


@query(
    "a05_all_outputs",
    """select c.departure_time, c.cell_id, c.mode, c.purpose, c.score, c.score_normalized,
              n.min_travel_time_minutes, n.nearest_destination_id, s.combined_score, s.combined_score_normalized
       from conn c join near n using (departure_time, cell_id, mode, purpose)
       join comb s using (departure_time, cell_id)""",
    "score score_normalized min_travel_time_minutes combined_score combined_score_normalized",
)
def _(b):
    out = {k: v.drop("tenant_id", "weights") for k, v in score_frames(b.workspace(), PARAMS, store=True).items()}
    return (
        out["connectivity_scores"]
        .join(out["min_travel_times"], op.GROUP)
        .join(out["combined_scores"], ["departure_time", "cell_id"])
    )


@query(
    "a05_single_slot",
    """select departure_time, cell_id, combined_score, combined_score_normalized from comb8""",
    "combined_score combined_score_normalized",
)
def _(b):
    return score_frames(b.workspace(), PARAMS, slots=["08:00"])["combined_scores"].drop("tenant_id", "weights")


@query(
    "w08_group_extremes",
    "select departure_time, mode, purpose, lo as low, hi as high from ext",
    "low high",
)
def _(b):
    return op.extremes(b.scored().table("connectivity_scores"), "score", op.STRATUM)


# Matrix rows as text, with unreadable and out-of-range values, and a file name.
MATRIX = """
    select concat('ttm_transit_', case when l_linenumber < 4 then '0730' else '0800' end, '.parquet') as file,
           case when l_linestatus = 'O' and l_tax > 0.07 then 'x' else cast(o_custkey as string) end as from_id,
           cast(l_suppkey as string) as to_id,
           case when l_returnflag = 'R' and l_discount > 0.08 then 'n/a'
                else cast(l_quantity * cast(3 as double) - cast(10 as double) as string) end as minutes
    from {lineitem} join {orders} on l_orderkey = o_orderkey"""
MATRIX_SQL = f"""
    with m as ({MATRIX.replace("{", "").replace("}", "")}),
    t as (select concat(substring(file, 13, 2), ':', substring(file, 15, 2)) as departure_time,
                 try_cast(from_id as bigint) as o, try_cast(to_id as bigint) as d, try_cast(minutes as double) as v from m)
"""


def matrix(b):
    raw = b.spark.sql(MATRIX, lineitem=b.raw("lineitem"), orders=b.raw("orders"))
    mode, slot = od_source.mode_of(F.col("file")).alias("mode"), od_source.slot_of(F.col("file")).alias("departure_time")
    return od_source.typed(raw, "from_id", "to_id", "minutes", mode, slot)


@query(
    "s07_p06_od_import",
    MATRIX_SQL
    + """select departure_time, count(*) as n, sum(v) as minutes, count(distinct o) as origins from t
         where o is not null and d is not null and v between 0 and 120 group by departure_time""",
    "minutes",
)
def _(b):
    kept = od_source.judged(matrix(b)).where("fate = 'kept'")
    return kept.groupBy("departure_time").agg(
        F.count("*").alias("n"),
        F.sum("travel_time_minutes").alias("minutes"),
        F.count_distinct("origin_cell_id").alias("origins"),
    )


@query(
    "p05_numeric_coercion",
    MATRIX_SQL
    + """select count(*) as n, count(*) filter (where o is null) as origin_bad,
                count(*) filter (where v is null) as minutes_bad from t""",
)
def _(b):
    return od_source.judged(matrix(b)).agg(
        F.count("*").alias("n"),
        F.count_if(F.col("origin_cell_id").isNull()).alias("origin_bad"),
        F.count_if(F.col("travel_time_minutes").isNull()).alias("minutes_bad"),
    )


@query(
    "a23_import_report",
    MATRIX_SQL
    + """select 'TRANSIT' as mode, departure_time,
                count(*) filter (where o is not null and d is not null and v between 0 and 120) as rows_kept,
                count(*) filter (where o is null or d is null or v is null) as rows_not_numeric,
                count(*) filter (where o is not null and d is not null and (v < 0 or v > 120)) as rows_out_of_range,
                cast(sum((o is null)::int + (d is null)::int + (v is null)::int) as bigint) as values_not_numeric
         from t group by departure_time""",
)
def _(b):
    return od_source.report(od_source.judged(matrix(b)))


@query(
    "j15_origin_remap",
    """select t.departure_time, c.id as origin_cell_id, count(*) as n
       from fx_travel_times t join cells c on c.id = t.origin_cell_id
       join customer k on k.c_custkey = c.id and k.c_mktsegment <> 'MACHINERY'
       group by t.departure_time, c.id""",
)
def _(b):
    ws = b.workspace()
    kept = b.raw("customer").where("c_mktsegment <> 'MACHINERY'").select(F.col("c_custkey").alias("id"))
    current = ws.table("grid_cells").join(kept, "id", "left_semi")
    shift = 10_000_000_000
    origins = ws.table("grid_cells").select(
        (F.col("id") + shift).alias("id"), (F.col("x0") + 125).alias("x"), (F.col("y0") + 125).alias("y")
    )
    older = ws.table("travel_times").withColumn("origin_cell_id", F.col("origin_cell_id") + shift)
    return od_source.remap_origins(older, origins, current).groupBy("departure_time", "origin_cell_id").agg(
        F.count("*").alias("n")
    )
