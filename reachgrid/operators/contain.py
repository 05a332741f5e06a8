"""Points in polygons by a cover of square tiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from reachgrid.operators.sizes import if_small

TILE_M = 2000.0


def tile_of(value: Column, tile: float) -> Column:
    return F.floor(value / F.lit(tile)).cast("bigint")


def tile_span(low: Column, high: Column, tile: float) -> Column:
    return F.explode(F.sequence(tile_of(low, tile), tile_of(high, tile)))


def polygon_edges(layer: DataFrame, key: str, rings: str = "rings") -> DataFrame:
    """Directed edges of every ring: shells counter-clockwise, holes clockwise."""
    from reachgrid.functions.geo import signed_area

    flat = layer.select(key, F.explode(rings).alias("r")).select(key, "r.part", "r.ring", F.col("r.pts").alias("pts"))
    flat = flat.where(F.size("pts") > 2)
    is_shell = F.col("ring") == 0
    wrong = is_shell != (signed_area(F.col("pts")) > 0)
    oriented = flat.withColumn("pts", F.when(wrong, F.reverse("pts")).otherwise(F.col("pts")))
    points = oriented.select(key, "part", "ring", F.posexplode("pts").alias("i", "p"), "pts")
    nxt = F.try_element_at("pts", (F.col("i") + 1) % F.size("pts") + 1)
    return points.select(
        key,
        F.concat_ws("/", "part", "ring", "i").alias("edge"),
        F.col("p.x").alias("ax"),
        F.col("p.y").alias("ay"),
        nxt["x"].alias("bx"),
        nxt["y"].alias("by"),
    ).where("ax <> bx or ay <> by")


def bounds_of(edges: DataFrame, key: str) -> DataFrame:
    return edges.groupBy(key).agg(
        F.min(F.least("ax", "bx")).alias("xmin"),
        F.min(F.least("ay", "by")).alias("ymin"),
        F.max(F.greatest("ax", "bx")).alias("xmax"),
        F.max(F.greatest("ay", "by")).alias("ymax"),
    )


#: Tile borders lie off the round coordinates of grids and layers, by this part of a tile.
SHIFT = 0.1369137
#: An edge is filed a little wider than it is, by this part of a tile.
SLACK = 1e-9


def _tile(value: Column, tile: float) -> Column:
    return tile_of(value - F.lit(SHIFT * tile), tile)


def _border(number: Column, tile: float) -> Column:
    """The lower border of a column or row of tiles."""
    return number * F.lit(tile) + F.lit(SHIFT * tile)


def _x_at(y: Column) -> Column:
    ax, ay, bx, by = (F.col(c) for c in ("ax", "ay", "bx", "by"))
    return (bx - ax) * (y - ay) / (by - ay) + ax


def filed_edges(edges: DataFrame, key: str, tile: float) -> DataFrame:
    """Edges with each tile (_tx, _ty) that they go through: one for a short edge, else as many as it is tiles long."""
    low, high = F.least("ay", "by"), F.greatest("ay", "by")
    rows = edges.select(key, "ax", "ay", "bx", "by", F.explode(F.sequence(_tile(low - SLACK * tile, tile), _tile(high + SLACK * tile, tile))).alias("_ty"))
    at = [F.least(F.greatest(_border(F.col("_ty") + k, tile), low), high) for k in (0, 1)]
    flat = F.col("ay") == F.col("by")
    x = [F.when(flat, F.col(c)).otherwise(_x_at(y)) for c, y in zip(("ax", "bx"), at)]
    left, right = F.least(*x) - F.lit(SLACK * tile), F.greatest(*x) + F.lit(SLACK * tile)
    return rows.select("*", F.explode(F.sequence(_tile(left, tile), _tile(right, tile))).alias("_tx"))


def tile_cover(edges: DataFrame, filed: DataFrame, key: str, tile: float) -> DataFrame:
    """(*key*, _tx, _ty, _odd, _inner): the tiles of each polygon.

    A tile that edges go through has _odd: whether its lower right corner is
    inside. All other tiles inside the polygon are inner ones. Rows of tiles are
    scanned from the right: an edge that crosses a row's lower border turns the
    corners to its left inside out.
    """
    low, high = F.least("ay", "by"), F.greatest("ay", "by")
    lines = F.when(_tile(high, tile) > _tile(low, tile), F.sequence(_tile(low, tile) + 1, _tile(high, tile)))
    cut = edges.select(key, "ax", "ay", "bx", "by", F.explode(lines).alias("_ty"))
    y = _border(F.col("_ty"), tile)
    cut = cut.where((F.col("ay") > y) != (F.col("by") > y))
    crossed = cut.select(key, "_ty", _tile(_x_at(y), tile).alias("_tx"), F.lit(1).alias("_n"))
    marks = filed.select(key, "_ty", "_tx", F.lit(0).alias("_n")).unionByName(crossed).groupBy(key, "_ty", "_tx").agg(F.sum("_n").alias("_n"))
    right = Window.partitionBy(key, "_ty").orderBy(F.col("_tx").desc())
    beyond = F.coalesce(F.sum("_n").over(right.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    scanned = marks.select(key, "_ty", "_tx", (beyond % 2 == 1).alias("_odd"), ((beyond + F.col("_n")) % 2 == 1).alias("_left_odd"), F.lead("_tx").over(right).alias("_next"))
    # Between two tiles with edges all is as the corner between them.
    gap = F.when(F.col("_left_odd") & (F.col("_next") < F.col("_tx") - 1), F.sequence(F.col("_next") + 1, F.col("_tx") - 1)).otherwise(F.array().cast("array<bigint>"))
    inner = scanned.select(key, "_ty", F.explode(gap).alias("_tx")).select(key, "_tx", "_ty", F.lit(True).alias("_odd"), F.lit(True).alias("_inner"))
    return scanned.select(key, "_tx", "_ty", "_odd", F.lit(False).alias("_inner")).unionByName(inner)


def contains(points: DataFrame, edges: DataFrame, key: str = "area_id", tile: float = TILE_M) -> DataFrame:
    """Pairs (id, *key*) of points inside or on the border of a polygon.

    *points* has id, x, y; *edges* has *key*, ax, ay, bx, by. Each polygon is
    covered by tiles. A point in an inner tile is inside without a look at an
    edge. In a tile with edges, the way from the point to the right and down to
    the tile's corner, of which it is known whether it is inside, stays in the
    tile, so only the tile's own edges can cross it. Holes and several parts
    need no care.
    """
    filed = filed_edges(edges, key, tile)
    cover = tile_cover(edges, filed, key, tile)
    placed = points.select("id", "x", "y", _tile(F.col("x"), tile).alias("_tx"), _tile(F.col("y"), tile).alias("_ty"))
    near = placed.join(if_small(cover), ["_tx", "_ty"])
    inside = near.where("_inner").select("id", key)
    met = near.where("not _inner").join(if_small(filed), [key, "_tx", "_ty"])
    tested = met.select("id", key, "_odd", crosses(tile).alias("cross"), on_edge().alias("on"))
    border = (
        tested.groupBy("id", key)
        .agg((F.sum("cross") + F.max(F.col("_odd").cast("int"))).alias("n"), F.max("on").alias("on"))
        .where("on or n % 2 = 1")
        .select("id", key)
    )
    return inside.unionByName(border)


def crosses(tile: float) -> Column:
    """How often an edge a-b crosses the way from (x, y) to the right border of its tile and down to the corner."""
    ax, ay, bx, by, x, y = (F.col(c) for c in ("ax", "ay", "bx", "by", "x", "y"))
    corner_x, corner_y = _border(F.col("_tx") + 1, tile), _border(F.col("_ty"), tile)
    across = F.when((ay > y) != (by > y), (x < _x_at(y)) & (_x_at(y) <= corner_x)).otherwise(F.lit(False))
    height = (by - ay) * (corner_x - ax) / (bx - ax) + ay
    down = F.when((ax > corner_x) != (bx > corner_x), (corner_y < height) & (height <= y)).otherwise(F.lit(False))
    return across.cast("int") + down.cast("int")


def on_edge() -> Column:
    ax, ay, bx, by, x, y = (F.col(c) for c in ("ax", "ay", "bx", "by", "x", "y"))
    collinear = (bx - ax) * (y - ay) - (by - ay) * (x - ax) == 0
    return collinear & x.between(F.least(ax, bx), F.greatest(ax, bx)) & y.between(F.least(ay, by), F.greatest(ay, by))
