"""Places of interest from CSV files in two layouts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from reachgrid.functions.text import label_from_code, slug
from reachgrid.operators.keys import append_with_ids, get_or_create, replace_types
from reachgrid.schemas import columns
from reachgrid.sources.lines import first_matching, join_by_file, read_lines

# The accepted box (west, east, south, north) and the columns
# that tell the layouts apart.
BOX = (-3.5, -2.3, 42.9, 43.5)
UNIFIED = ("poi", "nombre", "longitud", "latitud")
PER_TYPE = ("name", "lon", "lat")


def csv_cells(line: Column) -> Column:
    """Cells of one CSV line; commas inside quotes do not split, doubled quotes become one."""
    outside_quotes = ',(?=(?:[^"]*"[^"]*")*[^"]*$)'

    def plain(c: Column) -> Column:
        inner = F.regexp_extract(c, r'(?s)^\s*"(.*)"\s*$', 1)
        return F.when(c.rlike(r'(?s)^\s*".*"\s*$'), F.replace(inner, F.lit('""'), F.lit('"'))).otherwise(c)

    return F.transform(F.split(line, outside_quotes), plain)


def read_pois(ws, path: str, glob: str = "*.csv") -> DataFrame:
    """Rows of all CSV files with type code, label, raw texts and their place.

    The header decides a file's layout; a file with neither set of columns is
    left out. Without a type column the file name is the type.
    """
    lines = read_lines(ws.spark, path, glob)
    top = first_matching(lines, F.lit(False)).select("_file", "header", "_hpos", "_hblock")
    names = F.transform(csv_cells(F.col("header")), lambda c: F.lower(F.trim(c)))
    heads = top.select("_file", "_hpos", "_hblock", names.alias("names"))

    def has(wanted: tuple[str, ...]) -> Column:
        return F.size(F.array_intersect("names", F.array(*[F.lit(w) for w in wanted]))) == len(wanted)

    heads = heads.select("*", has(UNIFIED).alias("unified")).where(F.col("unified") | has(PER_TYPE))
    header_line = (F.col("_block") == F.col("_hblock")) & (F.col("_pos") == F.col("_hpos"))
    rows = (
        join_by_file(lines, heads)
        .where(~header_line & (F.length(F.trim("value")) > 0))
        .select("*", csv_cells(F.col("value")).alias("c"))
    )

    def field(unified: str, per_type: str) -> Column:
        name = F.when(F.col("unified"), F.lit(unified)).otherwise(F.lit(per_type))
        return F.trim(F.coalesce(F.get("c", (F.array_position("names", name) - 1).cast("int")), F.lit("")))

    stem = F.regexp_extract("_file", r"([^/]+)\.csv$", 1)
    raw_type = field("poi", "poi")
    return rows.select(
        "_file", "_block", "_pos", "unified",
        F.when(F.col("unified"), slug(raw_type)).otherwise(stem).alias("code"),
        F.when(F.col("unified"), raw_type).otherwise(label_from_code(stem)).alias("label"),
        field("nombre", "name").alias("name"),
        field("longitud", "lon").alias("lon_text"),
        field("latitud", "lat").alias("lat_text"),
        field("weight", "weight").alias("weight_text"),
    )


def judged(rows: DataFrame, box: tuple[float, float, float, float] = BOX) -> DataFrame:
    """Typed columns and the first reason to reject a row (null when it is good)."""
    west, east, south, north = box
    typed = rows.select(
        "*",
        F.col("lon_text").try_cast("double").alias("lon"),
        F.col("lat_text").try_cast("double").alias("lat"),
        F.when(F.col("weight_text") == "", F.lit(1.0)).otherwise(F.col("weight_text").try_cast("double")).alias("weight"),
    )
    inside = F.col("lon").between(west, east) & F.col("lat").between(south, north)
    reason = (
        F.when(F.col("unified") & (F.col("label") == ""), "missing_type")
        .when(F.col("name") == "", "missing_name")
        .when(F.col("lon").isNull() | F.col("lat").isNull(), "invalid_coordinates")
        .when(~inside, "outside_box")
        .when(F.col("weight").isNull() | (F.col("weight") <= 0), "invalid_weight")
    )
    return typed.withColumn("reason", reason)


def import_pois(
    ws, path: str, box: tuple[float, float, float, float] = BOX, clear_existing: bool = False
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(destinations, destination_types, rejected rows) after adding all files of a folder.

    Existing ids stay. With *clear_existing* the types that occur in the files
    are emptied first, file by file in name order, so of a type that occurs in
    several files only the last file remains.
    """
    rows = judged(read_pois(ws, path), box)
    good, rejected = rows.where("reason is null"), rows.where("reason is not null")
    place = F.struct("_file", "_block", "_pos")
    # A file without a type column creates its type even when no row is good.
    named = rows.where("reason is null or not unified")
    wanted = named.groupBy("code").agg(
        F.min(place).alias("_first"),
        F.min_by("label", place).alias("label"),
        F.lit("").alias("description"),
    )
    types = get_or_create(ws.table("destination_types", required=False), wanted)
    if clear_existing:
        last = rows.where("code <> ''").groupBy("code").agg(F.max("_file").alias("_file"))
        good = good.join(last, ["code", "_file"], "left_semi")
    new = good.join(types.select(F.col("id").alias("type_id"), "code"), "code").select(
        F.lit(ws.tenant).alias("tenant_id"), "type_id", "name", "weight", F.lit("{}").alias("metadata"), "lon", "lat",
        F.col("_file").alias("from_file"), F.col("_block").alias("from_block"), F.col("_pos").alias("from_pos"),
    )
    existing = ws.table("destinations", required=False).select(*columns("destinations"))
    if clear_existing:
        seen = rows.select("code").distinct().join(types.select(F.col("id").alias("type_id"), "code"), "code")
        existing = replace_types(existing, seen)
    order = [F.col("from_file"), F.col("from_block"), F.col("from_pos")]
    return append_with_ids(existing, new, order), types, rejected


def import_counts(rows: DataFrame) -> DataFrame:
    """Good and rejected rows per type code and reason."""
    return rows.groupBy("code", "reason").agg(F.count("*").alias("rows"))
