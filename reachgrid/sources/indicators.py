"""Indicator files with one column per year."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from reachgrid.functions.text import unquote
from reachgrid.sources.lines import first_matching, join_by_file, read_lines

# Province prefix, and the texts that stand for "no value".
PREFIX = "48"
CODE_LENGTH = 5
NO_VALUE = ("", "..", "-")
YEAR = r"^[0-9]{4}$"


def read_indicator(ws, path: str, prefix: str = PREFIX) -> DataFrame:
    """(muni_code, year, value) from files of one indicator.

    The header is the first line with a label and at least one year. Only
    municipality codes of the province are kept. When a code is repeated, the
    last of its lines that has any value replaces the others.
    """
    lines = read_lines(ws.spark, path)
    cells = F.transform(F.split("value", ";"), lambda c: unquote(F.trim(c)))
    has_year = F.exists(cells, lambda c: c.rlike(YEAR))
    has_label = F.col("value").rlike("Municipio|municipio|Codigo")
    header = first_matching(lines, has_label & has_year)
    head_cells = F.transform(F.split("header", ";"), lambda c: unquote(F.trim(c)))
    # A header has a few dozen columns.
    years = header.select("_file", F.posexplode(head_cells).alias("at", "label")).where(F.col("label").rlike(YEAR))
    after = (F.col("_block") > F.col("_hblock")) | ((F.col("_block") == F.col("_hblock")) & (F.col("_pos") > F.col("_hpos")))
    data = (
        join_by_file(lines, header)
        .where(after)
        .select("_file", "_block", "_pos", cells.alias("c"))
        .where((F.size("c") >= 3) & F.col("c")[0].startswith(prefix) & (F.length(F.col("c")[0]) == CODE_LENGTH))
    )
    text = F.replace("text", F.lit(","), F.lit("."))
    cells_of = data.select("_file", "_block", "_pos", F.col("c")[0].alias("muni_code"), F.posexplode("c").alias("at", "text"))
    values = (
        join_by_file(cells_of, years, ["_file", "at"])
        .where(~F.col("text").isin(*NO_VALUE))
        .select("_file", "_block", "_pos", "muni_code", F.col("label").cast("int").alias("year"), text.try_cast("double").alias("value"))
        .where("value is not null")
    )
    place = F.struct("_file", "_block", "_pos")
    # One list of yearly values per line, then the last line per municipality.
    per_line = values.groupBy("muni_code", place.alias("place")).agg(F.collect_list(F.struct("year", "value")).alias("v"))
    last = per_line.groupBy("muni_code").agg(F.max_by("v", "place").alias("v"))
    return last.select("muni_code", F.explode("v").alias("y")).select("muni_code", "y.year", "y.value")


def merge_indicators(parts: dict[str, DataFrame]) -> DataFrame:
    """One row per (municipality, year) with a column per indicator; rows without any are dropped.

    A union and one aggregation do the work of repeated full outer joins.
    """
    stacked = reduce(
        DataFrame.unionByName,
        [
            df.select("muni_code", "year", *[(F.col("value") if n == name else F.lit(None).cast("double")).alias(n) for n in parts])
            for name, df in parts.items()
        ],
    )
    merged = stacked.groupBy("muni_code", "year").agg(*[F.max(n).alias(n) for n in parts])
    return merged.where(F.coalesce(*parts).isNotNull())


def import_income(ws, paths: dict[str, str], prefix: str = PREFIX) -> DataFrame:
    """municipality_income from files by column name; indicators without a file stay null."""
    wanted = ("renta_personal_media", "renta_disponible_media", "renta_index")
    parts = {name: read_indicator(ws, path, prefix) for name, path in paths.items() if name in wanted}
    if not parts:
        raise ValueError(f"give a file for at least one of {wanted}")
    merged = merge_indicators(parts)
    return merged.select(
        "muni_code", "year", *[(F.col(n) if n in parts else F.lit(None).cast("double")).alias(n) for n in wanted]
    )


def import_car_ownership(ws, path: str, prefix: str = PREFIX) -> DataFrame:
    return read_indicator(ws, path, prefix).withColumnRenamed("value", "vehicles_per_inhab")
