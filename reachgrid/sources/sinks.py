"""GeoJSON features and routing endpoints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def point_geometry(lon: Column, lat: Column) -> Column:
    return F.when(
        lon.isNotNull() & lat.isNotNull(),
        F.struct(F.lit("Point").alias("type"), F.array(lon, lat).alias("coordinates")),
    )


def square_geometry(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """A box as a closed ring, counter-clockwise from the south-west corner."""
    ring = F.array(F.array(x0, y0), F.array(x1, y0), F.array(x1, y1), F.array(x0, y1), F.array(x0, y0))
    return F.struct(F.lit("Polygon").alias("type"), F.array(ring).alias("coordinates"))


def polygon_geometry(rings: Column) -> Column:
    """MultiPolygon from a rings column: parts in order, each with its rings in order."""
    parts = F.array_sort(F.array_distinct(F.transform(rings, lambda r: r["part"])))

    def closed(r: Column) -> Column:
        pts = F.transform(r["pts"], lambda p: F.array(p["x"], p["y"]))
        first, last = F.element_at(pts, 1), F.element_at(pts, -1)
        return F.when(first == last, pts).otherwise(F.concat(pts, F.array(first)))

    coordinates = F.transform(
        parts, lambda part: F.transform(F.filter(rings, lambda r: r["part"] == part), closed)
    )
    return F.when(rings.isNotNull(), F.struct(F.lit("MultiPolygon").alias("type"), coordinates.alias("coordinates")))


def line_geometry(lines: Column) -> Column:
    coordinates = F.transform(lines, lambda line: F.transform(line, lambda p: F.array(p["x"], p["y"])))
    return F.when(
        lines.isNotNull(), F.struct(F.lit("MultiLineString").alias("type"), coordinates.alias("coordinates"))
    )


def valid_geometry(text: Column) -> Column:
    """GeoJSON text as it came, or null when it is not a JSON object with a type."""
    return F.when(F.get_json_object(text, "$.type").isNotNull(), text)


def to_features(df: DataFrame, geometry: Column, properties: list[str]) -> DataFrame:
    """One GeoJSON feature per row, as a ``feature`` text column.

    Text geometry is passed through (malformed text becomes null); structs are
    written by ``to_json``. Null properties stay visible.
    """
    props = F.to_json(F.struct(*properties), {"ignoreNullFields": "false"})
    is_text = df.select(geometry.alias("g")).schema["g"].dataType.typeName() == "string"
    geom = valid_geometry(geometry) if is_text else F.to_json(geometry)
    return df.select(
        F.concat(
            F.lit('{"type":"Feature","properties":'),
            props,
            F.lit(',"geometry":'),
            F.coalesce(geom, F.lit("null")),
            F.lit("}"),
        ).alias("feature")
    )


def write_features(features: DataFrame, path: str) -> None:
    """Line-delimited features; each task writes its own file."""
    features.select(F.col("feature").alias("value")).write.mode("errorifexists").text(path)


def endpoint_rows(df: DataFrame) -> DataFrame:
    """id, lon, lat as text with eight decimals, the routing job's input format."""
    return df.select(
        "id", F.format_string("%.8f", "lon").alias("lon"), F.format_string("%.8f", "lat").alias("lat")
    )


def export_endpoints(ws, out: str) -> dict[str, str]:
    """Write origins (cell centroids) and destinations for the routing job."""
    paths = {}
    for kind, table in (("origins", "grid_cells"), ("destinations", "destinations")):
        paths[kind] = f"{out}/{kind}"
        rows = ws.table(table)
        if rows.isEmpty():
            raise ValueError(f"no rows in {table}")
        endpoint_rows(rows).write.mode("errorifexists").option("header", True).csv(paths[kind])
    return paths
