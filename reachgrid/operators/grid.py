"""Square cells over a boundary."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from reachgrid.functions.geo import CELL_SIZE, code_of, unproject


def covering_cells(edges: DataFrame, key: str, size: int = CELL_SIZE) -> DataFrame:
    """Column and row numbers (cx, cy) of all cells that touch a polygon.

    Border cells come from walking each edge through its grid columns; inner
    cells from filling between the edge crossings of every row's centre line.
    Nothing is compared with a candidate list, so the work follows the result.
    Touching counts, within the grid snapped to the bounds of all polygons.
    """
    s = F.lit(size)
    # The bounds are one row by construction.
    frame = edges.agg(
        F.floor(F.min(F.least("ax", "bx")) / s).cast("bigint").alias("c0"),
        F.floor(F.min(F.least("ay", "by")) / s).cast("bigint").alias("r0"),
        (F.ceil(F.max(F.greatest("ax", "bx")) / s) - 1).cast("bigint").alias("c1"),
        (F.ceil(F.max(F.greatest("ay", "by")) / s) - 1).cast("bigint").alias("r1"),
    ).withColumn("one", F.lit(1))
    lo, hi = F.least("ax", "bx"), F.greatest("ax", "bx")
    columns = edges.select(
        "ax", "ay", "bx", "by",
        F.explode(F.sequence((F.ceil(lo / s) - 1).cast("bigint"), F.floor(hi / s).cast("bigint"))).alias("cx"),
    )
    left, right = F.greatest(lo, F.col("cx") * s), F.least(hi, (F.col("cx") + 1) * s)

    def height(x):
        sloped = F.col("ay") + (F.col("by") - F.col("ay")) * (x - F.col("ax")) / (F.col("bx") - F.col("ax"))
        return F.when(F.col("ax") == F.col("bx"), F.col("ay")).otherwise(sloped)

    # A vertical edge keeps its full height; others their height within the column.
    ends = [
        F.when(F.col("ax") == F.col("bx"), F.col("ay")).otherwise(height(left)),
        F.when(F.col("ax") == F.col("bx"), F.col("by")).otherwise(height(right)),
    ]
    border = columns.select(
        "cx",
        F.explode(
            F.sequence(
                (F.ceil(F.least(*ends) / s) - 1).cast("bigint"), F.floor(F.greatest(*ends) / s).cast("bigint")
            )
        ).alias("cy"),
    )
    low, high = F.least("ay", "by"), F.greatest("ay", "by")
    first, last = F.ceil(low / s - 0.5).cast("bigint"), (F.ceil(high / s - 0.5) - 1).cast("bigint")
    rows = edges.select(key, "ax", "ay", "bx", "by", first.alias("first"), last.alias("last")).where("first <= last")
    crossings = rows.select(
        key, "ax", "ay", "bx", "by", F.explode(F.sequence("first", "last")).alias("cy")
    ).select(
        key,
        "cy",
        (
            F.col("ax")
            + (F.col("bx") - F.col("ax")) * ((F.col("cy") + 0.5) * s - F.col("ay")) / (F.col("by") - F.col("ay"))
        ).alias("x"),
    )
    along = Window.partitionBy(key, "cy").orderBy("x")
    runs = crossings.select(
        "cy", "x", F.lead("x").over(along).alias("until"), F.row_number().over(along).alias("n")
    ).where("n % 2 = 1")
    span = runs.select(
        "cy",
        F.ceil(F.col("x") / s - 0.5).cast("bigint").alias("from"),
        F.floor(F.col("until") / s - 0.5).cast("bigint").alias("to"),
    ).where("from <= to")
    inner = span.select(F.explode(F.sequence("from", "to")).alias("cx"), "cy")
    touched = border.unionByName(inner).distinct().withColumn("one", F.lit(1))
    return (
        touched.join(F.broadcast(frame), "one")
        .where("cx between c0 and c1 and cy between r0 and r1")
        .select("cx", "cy")
    )


def grid_rows(covered: DataFrame, tenant: str, size: int = CELL_SIZE) -> DataFrame:
    """Grid table rows; the id is the row-major position in the snapped frame.

    Ids need only be unique and stable: they are computed from the position, so
    no global numbering is needed.
    """
    edge = covered.agg(
        F.min("cx").alias("c0"), F.min("cy").alias("r0"), (F.max("cy") - F.min("cy") + 1).alias("nr")
    ).withColumn("one", F.lit(1))
    x0, y0 = F.col("cx") * size, F.col("cy") * size
    lon, lat = unproject(x0 + F.lit(size / 2), y0 + F.lit(size / 2))
    return covered.withColumn("one", F.lit(1)).join(F.broadcast(edge), "one").select(
        ((F.col("cx") - F.col("c0")) * F.col("nr") + F.col("cy") - F.col("r0") + 1).alias("id"),
        F.lit(tenant).alias("tenant_id"),
        code_of(x0, y0).alias("cell_code"),
        x0.cast("double").alias("x0"),
        y0.cast("double").alias("y0"),
        F.lit(float(size)).alias("size"),
        lon.alias("lon"),
        lat.alias("lat"),
        F.lit(0.0).alias("population"),
        F.lit(None).cast("string").alias("muni_code"),
    )
