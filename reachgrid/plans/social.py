"""Social facts, profiles, vulnerability and equity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from reachgrid.functions.bands import vulnerability_tier
from reachgrid.functions.scoring import unit
from reachgrid.operators.ordering import at_ranks, latest
from reachgrid.plans.areas import area_scores
from reachgrid.workspace import Workspace

# Weights of the vulnerability index, its inverted parts, the
# year used when a table is empty, and the default demographics year.
VULNERABILITY = {"weighted_avg_score": 0.4, "pct_65_plus": 0.2, "renta_index": 0.2, "vehicles_per_inhab": 0.2}
INVERTED = ("weighted_avg_score", "renta_index", "vehicles_per_inhab")
FALLBACK_YEAR = 2023
DEMOGRAPHICS_YEAR = 2025

KINDS = {
    "demographics": ("municipality_demographics", F.desc, "pop_total"),
    "income": ("municipality_income", F.desc_nulls_last, "renta_personal_media"),
    "cars": ("municipality_car_ownership", F.asc, "vehicles_per_inhab"),
}


def latest_year(df: DataFrame) -> DataFrame:
    return df.agg(F.coalesce(F.max("year"), F.lit(FALLBACK_YEAR)).alias("year"))


def facts(ws: Workspace, kind: str, year: int | None = None) -> DataFrame:
    """One year of a fact table with municipality names; the latest year by default.

    Demographics default to their reference year, as the other two follow the data.
    """
    table, direction, order = KINDS[kind]
    rows = ws.table(table, required=False)
    if year is None and kind == "demographics":
        year = DEMOGRAPHICS_YEAR
    rows = rows.where(F.col("year") == year) if year is not None else rows.join(F.broadcast(latest_year(rows)), "year")
    return with_names(ws, rows).orderBy(direction(order), "muni_code")


def with_names(ws: Workspace, rows: DataFrame) -> DataFrame:
    names = ws.table("municipalities", required=False).select("muni_code", "name")
    rest = [c for c in rows.columns if c != "muni_code"]
    return rows.join(names, "muni_code", "left").select(
        "muni_code", F.coalesce("name", "muni_code").alias("name"), *rest
    )


def profiles(ws: Workspace, slot: str) -> DataFrame:
    """Scores and latest facts per municipality that has cells."""
    scores = area_scores(ws, "municipalities", slot, "skip").select(
        F.col("code").alias("muni_code"), "name", "population", "weighted_avg_score"
    )
    return _with_latest(ws, scores).orderBy(F.desc_nulls_last("population"), "muni_code")


def _with_latest(ws: Workspace, base: DataFrame) -> DataFrame:
    for table, drop in (
        ("municipality_demographics", ("year", "pop_26_64")),
        ("municipality_income", ("year",)),
        ("municipality_car_ownership", ("year",)),
    ):
        base = base.join(latest(ws.table(table, required=False), "muni_code", "year").drop(*drop), "muni_code", "left")
    return base


def socio_map(ws: Workspace, slot: str) -> DataFrame:
    """Every municipality with its score, facts and vulnerability."""
    scores = area_scores(ws, "municipalities", slot, "skip").select(
        F.col("code").alias("muni_code"), "weighted_avg_score"
    )
    munis = ws.table("municipalities").select("muni_code", "name").join(scores, "muni_code", "left")
    full = vulnerability(_with_latest(ws, munis))
    return full.select(
        "muni_code",
        "name",
        "weighted_avg_score",
        "pop_total",
        "pct_0_17",
        "pct_18_25",
        "pct_65_plus",
        "renta_index",
        "vehicles_per_inhab",
        F.col("vuln_score").alias("vulnerability"),
    )


def vulnerability(rows: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """Index from four min-max parts over complete rows; incomplete rows get null."""
    weights = weights or VULNERABILITY
    complete = _all_present(list(weights))
    ends = rows.where(complete).agg(
        *[f(c).alias(f"_{n}_{c}") for c in weights for f, n in ((F.min, "lo"), (F.max, "hi"))]
    )
    parts = []
    for c, w in weights.items():
        part = unit(F.col(c), F.col(f"_lo_{c}"), F.col(f"_hi_{c}"))
        parts.append((1 - part if c in INVERTED else part) * w)
    index = F.when(complete, sum(parts[1:], parts[0]))
    return (
        _beside(rows, ends)
        .withColumn("vuln_score", index)
        .withColumn("vuln_level", vulnerability_tier(F.col("vuln_score")))
        .select(*rows.columns, "vuln_score", "vuln_level")
    )


def _beside(rows: DataFrame, one_row: DataFrame) -> DataFrame:
    key = F.lit(1).alias("_one")
    return rows.select("*", key).join(F.broadcast(one_row.select("*", key)), "_one").drop("_one")


def _all_present(names: list[str]) -> Column:
    out = F.lit(True)
    for n in names:
        out = out & F.col(n).isNotNull()
    return out


def tier_means(ranked: DataFrame) -> DataFrame:
    """The highly vulnerable against everyone, over rows with an index."""
    high = F.col("vuln_level") == "high"
    measures = []
    for c, label in (("pct_65_plus", "elderly"), ("renta_index", "income"), ("vehicles_per_inhab", "cars")):
        measures.append(F.coalesce(F.avg(F.when(high, F.col(c))), F.lit(0.0)).alias(f"avg_{label}_high"))
        measures.append(F.coalesce(F.avg(c), F.lit(0.0)).alias(f"avg_{label}_all"))
    return ranked.where("vuln_score is not null").agg(
        F.count_if(high).alias("high_count"),
        F.coalesce(F.sum(F.when(high, F.col("population"))), F.lit(0.0)).alias("high_population"),
        *measures,
    )


def hotspots(ranking: DataFrame, people: DataFrame, min_pop: float = 5000, k: int = 12) -> DataFrame:
    """Populous municipalities below the upper median score, by people times missing score.

    *people* are the profiles; they are found by code, else by name.
    """
    score = F.coalesce("weighted_avg_score", F.lit(0.0))
    scored = ranking.withColumn("score", score)
    middle = at_ranks(scored, [], "score", {"median_score": lambda n: F.floor(n / 2)}).select("median_score")
    top = (
        _beside(scored, middle)
        .where((F.col("population") > min_pop) & (F.col("score") < F.col("median_score")))
        .withColumn("burden", F.col("population") * (100.0 - F.col("score")))
        .orderBy(F.desc("burden"), "code")
        .limit(k)
    )
    wanted = ["renta_index", "vehicles_per_inhab", "pct_65_plus"]
    by_code = people.select(F.col("muni_code").alias("code"), F.struct(*wanted).alias("_by_code"))
    by_name = people.groupBy("name").agg(F.min_by(F.struct(*wanted), "muni_code").alias("_by_name"))
    found = F.coalesce("_by_code", "_by_name")
    return (
        top.join(by_code, "code", "left")
        .join(by_name, "name", "left")
        .select(
            "code", "name", "population", "weighted_avg_score", (F.col("median_score") - F.col("score")).alias("gap"), "burden",
            *[found[c].alias(c) for c in wanted],
        )
        .orderBy(F.desc("burden"), "code")
    )


def overlaps(rows: DataFrame, named: int = 4) -> DataFrame:
    """Where weak access meets low income, age or (missing) cars; one row.

    The ``full_`` figures use municipalities with all four measures and their
    means; the others use those with a population and a score.
    """
    four = ["weighted_avg_score", "renta_index", "vehicles_per_inhab", "pct_65_plus"]
    complete = rows.where(_all_present(four))
    means = complete.agg(
        F.avg("weighted_avg_score").alias("m_score"), F.avg("renta_index").alias("m_income"), F.avg("vehicles_per_inhab").alias("m_cars")
    )
    c = _beside(complete, means)
    weak = F.col("weighted_avg_score") < F.col("m_score")
    poor = weak & (F.col("renta_index") < F.col("m_income"))
    full = c.agg(
        F.count("*").alias("full_count"),
        F.count_if(poor).alias("full_low_income_low_score"),
        F.count_if(weak).alias("full_low_score"),
        _total(weak, "pop_65_plus").alias("full_elderly_low_score"),
        F.count_if(weak & (F.col("vehicles_per_inhab") > F.col("m_cars"))).alias("full_car_dependent"),
        F.max("m_cars").alias("full_avg_cars"),
    )
    # The list is cut before it is collected.
    first = c.where(poor).orderBy(F.desc_nulls_last(F.coalesce("population", F.lit(0.0))), "name").limit(named)
    names = first.agg(
        F.concat_ws(
            ", ",
            F.transform(
                F.array_sort(F.collect_list(F.struct((-F.coalesce("population", F.lit(0.0))).alias("p"), "name"))),
                lambda s: s["name"],
            ),
        ).alias("full_names")
    )
    basic = rows.where("pop_total is not null and weighted_avg_score is not null")
    basic_means = basic.agg(
        F.avg("weighted_avg_score").alias("m_score"),
        F.coalesce(F.avg("renta_index"), F.lit(0.0)).alias("m_income"),
        F.coalesce(F.avg("vehicles_per_inhab"), F.lit(0.0)).alias("m_cars"),
    )
    b = _beside(basic, basic_means)
    poor, carless = weak & (F.col("renta_index") < F.col("m_income")), weak & (F.col("vehicles_per_inhab") < F.col("m_cars"))
    rest = b.agg(
        F.count_if(weak).alias("low_score"),
        _total(weak, "pop_65_plus").alias("elderly_low_score"),
        _total(weak, "pop_0_17").alias("children_low_score"),
        _total(weak, "pop_18_25").alias("youth_low_score"),
        F.count_if(poor).alias("low_income_low_score"),
        _total(poor, "population").alias("low_income_population"),
        F.count_if(carless).alias("carless_low_score"),
        _total(carless, "population").alias("carless_population"),
    )
    return _beside(_beside(full, names), rest)


def _total(condition: Column, value: str) -> Column:
    return F.coalesce(F.sum(F.when(condition, F.col(value))), F.lit(0))


def composition(rows: DataFrame, key: str = "elderly", k: int = 25) -> DataFrame:
    """Age mix of the top *k* municipalities by population, elderly or youth share."""
    by = {"pop": "pop_total", "elderly": "pct_65_plus", "youth": "pct_18_25"}[key]
    share = {n: F.coalesce(c, F.lit(0.0)) for n, c in (("children", "pct_0_17"), ("youth", "pct_18_25"), ("elderly", "pct_65_plus"))}
    return (
        rows.where("pop_total > 0")
        .orderBy(F.desc(F.coalesce(F.col(by).cast("double"), F.lit(0.0))), "muni_code")
        .limit(k)
        .select(
            "muni_code",
            "name",
            *[c.alias(n) for n, c in share.items()],
            (100.0 - share["children"] - share["youth"] - share["elderly"]).alias("adults"),
        )
    )


def scatter(rows: DataFrame, x: str = "renta_index") -> DataFrame:
    """Points of *x* against the score, with the means of both and their correlation."""
    points = rows.where(_all_present([x, "weighted_avg_score", "population"])).select(
        "muni_code", "name", F.col(x).alias("x"), F.col("weighted_avg_score").alias("y"), F.col("population").alias("z")
    )
    means = points.agg(F.avg("x").alias("avg_x"), F.avg("y").alias("avg_y"), F.corr("x", "y").alias("correlation"))
    return _beside(points, means)
