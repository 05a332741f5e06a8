"""Reading serving tables and smoothing over differences in how they were written."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from reachgrid.functions.geo import CELL_SIZE, cell_xy, project_rings, unproject
from reachgrid.operators.ordering import number_scan, scan_order
from reachgrid.schemas import SCHEMAS, columns
from reachgrid.sources.versions import filesystem, manifest, read_version
from reachgrid.sources.wkb import decode_lines, decode_points, decode_rings


def table_path(spark: SparkSession, root: str, name: str) -> str | None:
    """``name.parquet`` (a file or a directory), else ``name``: tables that others wrote."""
    for candidate in (f"{root}/{name}.parquet", f"{root}/{name}"):
        fs, path = filesystem(spark, candidate)
        if fs.exists(path):
            return candidate
    return None


def exists(spark: SparkSession, root: str, name: str) -> bool:
    return manifest(spark, root, name) is not None or table_path(spark, root, name) is not None


def read_table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """One serving table in the layout of :mod:`reachgrid.schemas`.

    Files written by this library are scanned with their fixed schema. Other
    files may call the geometry ``geometry``, hold it as WKB, and lack an id;
    they are brought into the same shape.
    """
    wanted = columns(name)
    version = manifest(spark, root, name)
    if version is not None:
        found = read_version(spark, root, name, version)
        if not set(wanted) <= set(found.columns):
            return conform(found, name)
        fixed = StructType.fromDDL(SCHEMAS[name])
        return read_version(spark, root, name, version, fixed).select(*wanted)
    path = table_path(spark, root, name)
    if path is None:
        raise FileNotFoundError(f"no table {name!r} under {root}")
    found = spark.read.parquet(path)
    if set(wanted) <= set(found.columns):
        return spark.read.schema(SCHEMAS[name]).parquet(path).select(*wanted)
    return conform(found, name)


def conform(found: DataFrame, name: str) -> DataFrame:
    wanted = columns(name)
    df = found
    if "id" in wanted and "id" not in df.columns:
        df = number_scan(scan_order(df), "id")
    if "geometry" in df.columns and "geom" not in df.columns:
        df = df.withColumnRenamed("geometry", "geom")
    if "geom" in df.columns and df.schema["geom"].dataType.typeName() == "binary":
        if "rings" in wanted:
            df = df.withColumn("rings", decode_rings("geom"))
        elif "lines" in wanted:
            df = df.withColumn("lines", decode_lines("geom"))
        elif "lon" in wanted and name != "grid_cells":
            df = df.withColumn("_p", decode_points("geom")).withColumns({"lon": F.col("_p.x"), "lat": F.col("_p.y")})
    if "rings_m" in wanted and "rings" in df.columns and "rings_m" not in df.columns:
        df = df.withColumn("rings_m", project_rings(F.col("rings")))
    if name == "grid_cells" and "x0" not in df.columns:
        df = with_cell_geometry(df)
    fields = spark_fields(df.sparkSession, name)
    missing = [c for c in wanted if c not in df.columns]
    df = df.select("*", *[F.lit(None).alias(c) for c in missing])
    return df.select(*[F.col(c).cast(fields[c]).alias(c) for c in wanted])


def spark_fields(spark: SparkSession, name: str) -> dict:
    return {f.name: f.dataType for f in spark.createDataFrame([], SCHEMAS[name]).schema.fields}


def with_cell_geometry(df: DataFrame, size: int = CELL_SIZE) -> DataFrame:
    """Corner, size and centroid of a cell from its code."""
    east, north = cell_xy(F.col("cell_code"))
    lon, lat = unproject(east + F.lit(size / 2), north + F.lit(size / 2))
    return df.withColumns(
        {
            "x0": east.cast("double"),
            "y0": north.cast("double"),
            "size": F.lit(float(size)),
            "lon": lon,
            "lat": lat,
        }
    )
