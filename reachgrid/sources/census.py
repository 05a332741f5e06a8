"""Census-section files: population and broad age bands."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from reachgrid.functions.numbers import age_split
from reachgrid.functions.text import comma_percent, dotted_int, full_municipality, section_key
from reachgrid.operators.ordering import fill_forward
from reachgrid.sources.lines import cell, last_per_key, read_lines, skip_first

# Province, lines before the data, and the code of total rows.
PROVINCE = "48"
PREAMBLE = 6
TOTAL = "000"


def section_rows(ws, path: str, at_least: int) -> DataFrame:
    """Cells of the data lines, with municipality and district carried forward.

    A blank district keeps the last one, also across municipalities.
    """
    lines = skip_first(read_lines(ws.spark, path), PREAMBLE)
    text = F.trim(F.regexp_replace("value", r"^\s+|\s+$", ""))
    parts = lines.select(F.split(text, ";").alias("p"), "_file", "_block", "_pos").where(F.size("p") >= at_least)

    def blank_null(i: int):
        return F.when(F.length(cell(F.col("p"), i)) > 0, cell(F.col("p"), i))

    rows = parts.select(
        "p", "_file", "_block", "_pos",
        blank_null(0).alias("muni"),
        blank_null(2).alias("district"),
        cell(F.col("p"), 3).alias("section"),
        dotted_int(F.get("p", F.lit(4))).alias("population"),
    )
    filled = fill_forward(rows, ["muni", "district"])
    return filled.where((F.length("section") > 0) & (F.col("section") != TOTAL)).where(
        "muni is not null and population is not null"
    )


def read_census(ws, path: str, province: str = PROVINCE) -> DataFrame:
    """(source_code, population) per section; of a repeated key the last line counts."""
    rows = section_rows(ws, path, 5)
    keyed = rows.select(
        section_key(F.lit(province), F.col("muni"), F.coalesce("district", F.lit("None")), F.col("section")).alias("source_code"),
        "population", "_file", "_block", "_pos",
    )
    return last_per_key(keyed, ["source_code"], ["population"])


def match_sections(census: DataFrame, polygons: DataFrame, tie: str) -> tuple[DataFrame, DataFrame]:
    """(sections with their polygon, sections without one).

    *polygons* has join_key; of several polygons with one key the smallest
    *tie* is taken, before the join.
    """
    first = Window.partitionBy("join_key").orderBy(tie)
    unique = polygons.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")
    by_key = census.source_code == unique.join_key
    return census.join(unique, by_key).drop("join_key"), census.join(unique, by_key, "left_anti")


def match_report(census: DataFrame, matched: DataFrame, unmatched: DataFrame) -> DataFrame:
    """Sections and people matched and lost; one row."""
    one = F.lit(1).alias("_one")
    a = census.agg(F.count("*").alias("csv_sections"), F.coalesce(F.sum("population"), F.lit(0)).alias("csv_population"), one)
    m = matched.agg(F.count("*").alias("matched"), F.coalesce(F.sum("population"), F.lit(0)).alias("matched_population"), one)
    u = unmatched.agg(F.count("*").alias("unmatched"), one)
    lost = F.abs(F.col("csv_population") - F.col("matched_population")) / F.col("csv_population") * 100
    return (
        a.join(F.broadcast(m), "_one")
        .join(F.broadcast(u), "_one")
        .drop("_one")
        .withColumn("loss_pct", F.when(F.col("csv_population") > 0, lost).otherwise(F.lit(0.0)))
    )


def attach_population(ws, layer: DataFrame, census: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(population_sources, unmatched sections, report) from section polygons and census rows."""
    matched, unmatched = match_sections(census, layer.withColumnRenamed("code", "join_key"), "id")
    sources = matched.select(
        "id",
        F.lit(ws.tenant).alias("tenant_id"),
        "name",
        F.col("population").cast("double").alias("population"),
        "source_code",
        "rings",
        "rings_m",
    )
    return sources, unmatched, match_report(census, matched, unmatched)


def read_ages(ws, path: str) -> DataFrame:
    """(muni, population, three shares) per section."""
    share = {n: comma_percent(F.get("p", F.lit(i))) for n, i in (("pct_0_19", 8), ("pct_20_64", 9), ("pct_65", 10))}
    rows = section_rows(ws, path, 11)
    return rows.select("muni", "population", *[c.alias(n) for n, c in share.items()])


def by_municipality(rows: DataFrame, year: int, province: str = PROVINCE, digits: int | None = 2) -> DataFrame:
    """Demographics per municipality from section shares, weighted by population."""
    people = F.col("population")
    bands = rows.groupBy("muni").agg(
        F.sum(people).cast("bigint").alias("pop_total"),
        F.sum(people * F.col("pct_0_19") / 100).alias("a"),
        F.sum(people * F.col("pct_20_64") / 100).alias("m"),
        F.sum(people * F.col("pct_65") / 100).alias("o"),
    )
    split = age_split(F.col("a"), F.col("m"), F.col("o"))
    out = bands.where("pop_total > 0").select(
        full_municipality(F.col("muni"), province).alias("muni_code"),
        F.lit(year).cast("int").alias("year"),
        "pop_total",
        *[c.cast("bigint").alias(n) for n, c in split.items()],
    )

    def share(name: str):
        value = F.col(name) / F.col("pop_total") * 100
        return value if digits is None else F.round(value, digits)

    return out.withColumns({f"pct_{g}": share(f"pop_{g}") for g in ("0_17", "18_25", "65_plus")})


def import_demographics(ws, path: str, year: int = 2025, province: str = PROVINCE) -> DataFrame:
    return by_municipality(read_ages(ws, path), year, province)
