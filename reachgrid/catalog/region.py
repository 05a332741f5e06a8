"""Region-wide reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from reachgrid.catalog.bindings import SLOT
from reachgrid.catalog.registry import query
from reachgrid.functions.numbers import display, pct
from reachgrid.functions.scoring import weighted_mean
from reachgrid.plans import areas, region

COVERAGE = (
    "total_population pop_15min pop_30min pop_45min pop_60min pct_pop_15min pct_pop_30min pct_pop_45min pct_pop_60min "
    "avg_travel_time median_travel_time"
)


@query(
    "a06_a07_summary",
    """select count(*) as total_cells, count(*) filter (where c.population > 0) as populated_cells,
              coalesce(sum(c.population), 0) as total_population, count(s.cell_id) as cells_with_scores,
              avg(s.combined_score_normalized) as avg_score,
              case when sum(c.population) > 0
                   then sum(c.population * coalesce(s.combined_score_normalized, 0)) / sum(c.population)
                   else avg(s.combined_score_normalized) end as weighted_avg_score,
              quantile_cont(s.combined_score_normalized, 0.5) as median_score,
              (select count(*) from supplier) as destination_count, 0::bigint as transit_stop_count,
              0::bigint as transit_route_count, (select count(*) from nation) as municipality_count,
              (select count(*) from region) as comarca_count
       from cells c left join comb8 s on s.cell_id = c.id""",
    "total_population avg_score weighted_avg_score median_score",
)
def _(b):
    return region.summary(b.scored(), SLOT)


@query(
    "a08_histogram",
    """with s as (select c.population, least(greatest(cast(floor(combined_score_normalized / 10) + 1 as int), 1), 10) as bucket
                  from cells c join comb8 s on s.cell_id = c.id where combined_score_normalized is not null)
       select cast(b.i as int) as bucket, ((b.i - 1) * 10) || '-' || (b.i * 10) as range_label,
              (b.i - 1) * 10.0 as range_min, b.i * 10.0 as range_max,
              count(s.bucket) as cell_count, coalesce(sum(s.population), 0) as population
       from range(1, 11) b(i) left join s on s.bucket = b.i group by b.i""",
    "range_min range_max population",
)
def _(b):
    return region.histogram(b.scored(), SLOT)


@query(
    "a09_purpose_breakdown",
    """select s.*, t.avg_travel_time, coalesce(p.label, s.purpose) as purpose_label
       from breakdown s left join (select mode, purpose, avg(min_travel_time_minutes) as avg_travel_time
                                   from near8 group by mode, purpose) t using (mode, purpose)
       left join types p on p.code = s.purpose""",
    "avg_score weighted_avg_score avg_travel_time",
)
def _(b):
    return region.purpose_breakdown(b.scored(), SLOT)


@query(
    "f19_label_or_code",
    "select distinct s.purpose, coalesce(p.label, s.purpose) as purpose_label from conn8 s left join types p on p.code = s.purpose",
)
def _(b):
    ws = b.scored()
    return region.labelled(ws.at("connectivity_scores", SLOT).select("purpose").distinct(), ws)


@query(
    "a12_service_coverage",
    "select v.*, coalesce(p.label, v.purpose) as purpose_label from cov v left join types p on p.code = v.purpose",
    COVERAGE,
)
def _(b):
    return region.coverage(b.scored(), SLOT)


@query(
    "f15_percentages",
    """select purpose, mode, case when total_population > 0 then pop_30min / total_population * 100 else 0 end as pct
       from cov""",
    "pct",
)
def _(b):
    cov = region.coverage(b.scored(), SLOT)
    return cov.select("purpose", "mode", pct(F.col("pop_30min"), F.col("total_population"), None).alias("pct"))


@query("f16_display_rounding", "select s_suppkey as id, round(cast(s_suppkey as double) / 3, 2) as shown from supplier")
def _(b):
    third = F.col("s_suppkey").cast("double") / 3
    return b.raw("supplier").select(F.col("s_suppkey").alias("id"), display(third).alias("shown"))


@query(
    "a31_coverage_bands",
    """select purpose, mode, pct_pop_15min as band_lt15, greatest(pct_pop_30min - pct_pop_15min, 0) as band_15_30,
              greatest(pct_pop_45min - pct_pop_30min, 0) as band_30_45, greatest(pct_pop_60min - pct_pop_45min, 0) as band_45_60,
              greatest(100 - pct_pop_60min, 0) as band_gt60 from cov""",
    "band_lt15 band_15_30 band_30_45 band_45_60 band_gt60",
)
def _(b):
    return region.coverage_bands(region.coverage(b.scored(), SLOT))


@query(
    "a32_service_deserts",
    """select purpose, mode, pct_pop_30min, total_population - pop_30min as unreached_30,
              total_population - pop_60min as unreached_60 from cov""",
    "pct_pop_30min unreached_30 unreached_60",
)
def _(b):
    return region.deserts(region.coverage(b.scored(), SLOT))


@query(
    "a28_low_score_share",
    """with h as (select c.population, least(greatest(cast(floor(combined_score_normalized / 10) + 1 as int), 1), 10) as bucket
                  from cells c join comb8 s on s.cell_id = c.id),
       l as (select coalesce(sum(population) filter (where bucket <= 3), 0) as low_population from h),
       t as (select sum(population) as total_population from cells)
       select low_population, total_population, low_population / total_population * 100 as low_pct from l, t""",
    "low_population total_population low_pct",
)
def _(b):
    ws = b.scored()
    return region.low_share(region.histogram(ws, SLOT), region.summary(ws, SLOT))


@query(
    "a28_score_gap",
    "select max(weighted_avg_score) - min(weighted_avg_score) as score_gap from comarca_rank",
    "score_gap",
)
def _(b):
    return areas.score_gap(areas.area_ranking(b.scored(), "comarcas", SLOT))


@query(
    "f17_weighted_means",
    """with j as (select t.departure_time, c.muni_code, c.population as w, s.combined_score_normalized as v
                  from cells c cross join (select distinct departure_time from comb) t
                  left join comb s on s.cell_id = c.id and s.departure_time = t.departure_time
                                  and s.combined_score_normalized > 40)
       select muni_code, case when sum(w) > 0 then sum(w * coalesce(v, 0)) / sum(w) else avg(v) end as zero,
              case when sum(w) > 0 then sum(w * v) / sum(w) else avg(v) end as skip,
              coalesce(sum(w * v) / nullif(sum(case when v is not null then w end), 0), avg(v)) as scored
       from j group by muni_code""",
    "zero skip scored",
)
def _(b):
    ws = b.scored()
    times = ws.table("combined_scores").select("departure_time").distinct()
    cells = ws.table("grid_cells").select("id", "muni_code", "population")
    # Every cell at every slot: the slots are a handful, carried as one array.
    every = times.agg(F.sort_array(F.collect_set("departure_time")).alias("ts")).withColumn("k", F.lit(1))
    grid = cells.withColumn("k", F.lit(1)).join(F.broadcast(every), "k").select(
        "id", "muni_code", "population", F.explode("ts").alias("departure_time")
    )
    high = ws.table("combined_scores").where("combined_score_normalized > 40").select(
        F.col("cell_id").alias("id"), "departure_time", F.col("combined_score_normalized").alias("v")
    )
    value, weight = F.col("v"), F.col("population")
    return grid.join(high, ["id", "departure_time"], "left").groupBy("muni_code").agg(
        *[weighted_mean(value, weight, mode).alias(mode) for mode in ("zero", "skip", "scored")]
    )
