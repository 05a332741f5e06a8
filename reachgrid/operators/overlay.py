"""Areal and masked (dasymetric) weighting of polygons onto grid cells.

Areas are additive in x, so every cell is cut at tile columns and each piece
meets only the edges filed under its column.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from reachgrid.operators.contain import bounds_of, tile_of, tile_span
from reachgrid.operators.sizes import if_small
from reachgrid.session import written

TILE_M = 1000.0
STRIP_EDGES = 32


def shares(sources: DataFrame, edges: DataFrame, cells: DataFrame, tile: float = TILE_M) -> DataFrame:
    """Overlap area of every (source, cell) pair.

    *sources* has source_id; *edges* source_id, ax..by (shells counter-clockwise);
    *cells* id, x0, y0, x1, y1.
    """
    pieces = _pieces(bounds_of(edges, "source_id"), cells, "source_id", tile)
    met = pieces.join(if_small(_columns(edges, "source_id", tile)), ["source_id", "_tx"])
    xa, xb = F.greatest("xl", F.least("ax", "bx")), F.least("xr", F.greatest("ax", "bx"))
    met = met.select("source_id", "id", "y0", "y1", "ax", "ay", "bx", "by", xa.alias("xa"), xb.alias("xb")).where(
        # An edge below the cell adds nothing.
        "xa < xb and greatest(ay, by) > y0"
    )
    sign = F.when(F.col("ax") > F.col("bx"), 1.0).otherwise(-1.0)
    part = sign * _clamped_integral()
    return met.groupBy("source_id", "id").agg(F.sum(part).alias("overlap")).where("overlap > 0")


def polygon_area(edges: DataFrame, key: str = "source_id") -> DataFrame:
    """Signed shoelace sum over directed edges."""
    return edges.groupBy(key).agg(F.sum((F.col("ax") * F.col("by") - F.col("bx") * F.col("ay")) / 2).alias("area"))


def areal_weight(sources: DataFrame, edges: DataFrame, cells: DataFrame, tile: float = TILE_M) -> DataFrame:
    """Population per cell: each source spreads evenly over its own area."""
    overlap = shares(sources, edges, cells, tile)
    return _spread(sources, overlap, polygon_area(edges), cells)


def masked_weight(
    sources: DataFrame, edges: DataFrame, cells: DataFrame, mask_edges: DataFrame, tile: float = TILE_M
) -> DataFrame:
    """Population per cell: each source spreads over its area inside the union of the masks."""
    boxes = bounds_of(edges, "source_id")
    overlap = masked_area(_pieces(boxes, cells, "source_id", tile), edges, mask_edges, tile)
    # The denominator is the whole masked source, also where no cell covers it:
    # its bounding box, cut into tiles, plays the part of the cells.
    tiles = boxes.select(
        "source_id", "xmin", "ymin", "xmax", "ymax", tile_span(F.col("xmin"), F.col("xmax"), tile).alias("_tx")
    ).select("*", tile_span(F.col("ymin"), F.col("ymax"), tile).alias("id"))
    whole = tiles.select(
        "source_id",
        "id",
        "_tx",
        F.greatest("xmin", F.col("_tx") * F.lit(tile)).alias("xl"),
        F.least("xmax", (F.col("_tx") + 1) * F.lit(tile)).alias("xr"),
        F.greatest("ymin", F.col("id") * F.lit(tile)).alias("y0"),
        F.least("ymax", (F.col("id") + 1) * F.lit(tile)).alias("y1"),
    ).where("xl < xr and y0 < y1")
    area = masked_area(whole, edges, mask_edges, tile).groupBy("source_id").agg(F.sum("overlap").alias("area"))
    return _spread(sources, overlap, area, cells)


def _spread(sources: DataFrame, overlap: DataFrame, area: DataFrame, cells: DataFrame) -> DataFrame:
    density = sources.join(area.where("area > 0"), "source_id").select(
        "source_id", (F.col("population") / F.col("area")).alias("density")
    )
    # A large source may meet a third of all cells: it is looked up, not shuffled to.
    share = (
        overlap.join(if_small(written(density, "density")), "source_id")
        .groupBy("id")
        .agg(F.sum(F.col("density") * F.col("overlap")).alias("population"))
    )
    return cells.select("id").join(share, "id", "left").select("id", F.coalesce("population", F.lit(0.0)).alias("population"))


def _pieces(boxes: DataFrame, cells: DataFrame, key: str, tile: float) -> DataFrame:
    """Cells that may meet a polygon, cut at tile columns.

    Polygon boxes and cells meet on a shared tile. A pair that shares several
    tile rows is kept only in the row that holds its lowest common point.
    """
    filed = boxes.select("*", tile_span(F.col("xmin"), F.col("xmax"), tile).alias("_tx")).select(
        "*", tile_span(F.col("ymin"), F.col("ymax"), tile).alias("_ty")
    )
    cut = cells.select("id", "x0", "y0", "x1", "y1", tile_span(F.col("x0"), F.col("x1"), tile).alias("_tx")).select(
        "*", tile_span(F.col("y0"), F.col("y1"), tile).alias("_ty")
    )
    met = cut.join(if_small(filed), ["_tx", "_ty"]).where(
        (F.col("x0") < F.col("xmax"))
        & (F.col("x1") > F.col("xmin"))
        & (F.col("y0") < F.col("ymax"))
        & (F.col("y1") > F.col("ymin"))
        & (F.col("_ty") == tile_of(F.greatest("y0", "ymin"), tile))
    )
    return met.select(
        key,
        "id",
        "_tx",
        F.greatest("x0", F.col("_tx") * F.lit(tile)).alias("xl"),
        F.least("x1", (F.col("_tx") + 1) * F.lit(tile)).alias("xr"),
        "y0",
        "y1",
    ).where("xl < xr")


def _columns(edges: DataFrame, key: str, tile: float, upright: bool = False) -> DataFrame:
    """Edges filed under every tile column they cross; vertical ones only on request."""
    return (edges if upright else edges.where("ax <> bx")).select(
        key, "ax", "ay", "bx", "by", tile_span(F.least("ax", "bx"), F.greatest("ax", "bx"), tile).alias("_tx")
    )


def _y_at(x: Column) -> Column:
    return F.col("ay") + (F.col("by") - F.col("ay")) * (x - F.col("ax")) / (F.col("bx") - F.col("ax"))


def _clamped_integral() -> Column:
    """Integral over [xa, xb] of the edge's height above y0, held within [0, y1 - y0]."""
    height = F.col("y1") - F.col("y0")
    ua, ub = _y_at(F.col("xa")) - F.col("y0"), _y_at(F.col("xb")) - F.col("y0")
    low, high = F.least(ua, ub), F.greatest(ua, ub)

    def primitive(u: Column) -> Column:
        return F.when(u <= 0, 0.0).when(u <= height, u * u / 2).otherwise(height * u - height * height / 2)

    mean = (
        F.when(high <= 0, 0.0)
        .when(low >= height, height)
        .when((low >= 0) & (high <= height), (low + high) / 2)
        .otherwise((primitive(high) - primitive(low)) / (high - low))
    )
    return mean * (F.col("xb") - F.col("xa"))


def masked_area(pieces: DataFrame, edges: DataFrame, mask_edges: DataFrame, tile: float = TILE_M) -> DataFrame:
    """Area of source x union(mask) inside every piece, by sweeping slabs.

    A piece is cut in x wherever an edge starts, ends, crosses another or leaves
    the piece. Inside a slab no edges cross, so lengths are linear in x and the
    midpoint rule is exact. Running sums of edge direction, from below, tell how
    many sources and masks cover each gap; overlapping masks count once.
    Pieces with many edges are first cut into strips to keep sweeps small.
    """
    piece = ["source_id", "id", "_tx"]
    filed = bounds_of(mask_edges, "mask_id").select("*", tile_span(F.col("xmin"), F.col("xmax"), tile).alias("_tx")).select(
        "*", tile_span(F.col("ymin"), F.col("ymax"), tile).alias("_ty")
    )
    columns = pieces.select(*piece, "xl", "xr", "y0", "y1")
    mask_hits = (
        columns.select(*piece, "xl", "xr", "y0", "y1", tile_span(F.col("y0"), F.col("y1"), tile).alias("_ty"))
        .join(if_small(filed), ["_tx", "_ty"])
        .where("xl < xmax and xr > xmin and y0 < ymax and y1 > ymin")
        .where(F.col("_ty") == tile_of(F.greatest("y0", "ymin"), tile))
        .select(*piece, "mask_id", "xl", "xr", "y0", "y1")
    )
    segments = (
        mask_hits.join(if_small(_columns(mask_edges, "mask_id", tile, True)), ["mask_id", "_tx"])
        .withColumn("kind", F.lit(1))
        .drop("mask_id")
        .unionByName(
            columns.join(if_small(_columns(edges, "source_id", tile, True)), ["source_id", "_tx"]).withColumn("kind", F.lit(0))
        )
        .where("greatest(ax, bx) > xl and least(ax, bx) < xr and least(ay, by) < y1")
    )
    # Read several times below: written once, so nothing is joined again.
    segments = written(segments, "segments")
    in_band = F.greatest("ay", "by") > F.col("y0")
    strips = segments.groupBy(*piece, "xl", "xr").agg(
        F.ceil(F.count(F.when(in_band, 1)) / STRIP_EDGES).alias("k"), F.max("kind").alias("masked"), F.min("kind").alias("sourced")
    )
    strips = (
        strips.where("masked = 1 and sourced = 0")
        .withColumn("k", F.greatest(F.col("k"), F.lit(1)).cast("int"))
        .select(*piece, "k", "xl", "xr", F.explode(F.sequence(F.lit(0), F.col("k") - 1)).alias("strip"))
    )
    width = (F.col("xr") - F.col("xl")) / F.col("k")
    strips = strips.select(
        *piece, "strip", "k", (F.col("xl") + width * F.col("strip")).alias("sl"), (F.col("xl") + width * (F.col("strip") + 1)).alias("sr")
    )
    group = [*piece, "strip"]
    clipped = (
        segments.drop("xl", "xr")
        .join(strips, piece)
        .select(
            *group, "k", "sl", "sr", "y0", "y1", "kind", "ax", "ay", "bx", "by",
            F.greatest("sl", F.least("ax", "bx")).alias("xa"),
            F.least("sr", F.greatest("ax", "bx")).alias("xb"),
        )
        .where("xa < xb or (ax = bx and xa = xb)")
        .select(
            *group, "k", "sl", "sr", "y0", "y1", "kind", "xa", "xb",
            F.when(F.col("ax") == F.col("bx"), F.col("ay")).otherwise(_y_at(F.col("xa"))).alias("ya"),
            F.when(F.col("ax") == F.col("bx"), F.col("by")).otherwise(_y_at(F.col("xb"))).alias("yb"),
            F.when(F.col("ax") < F.col("bx"), 1).otherwise(-1).alias("dir"),
        )
    )
    clipped = written(clipped, "clipped")
    slabs = _slabs(clipped, group)
    xm = (F.col("left") + F.col("right")) / 2
    y = F.col("ya") + F.try_divide((F.col("yb") - F.col("ya")) * (xm - F.col("xa")), F.col("xb") - F.col("xa"))
    swept = (
        slabs.join(clipped.drop("sl", "sr", "k"), group)
        .where((F.col("xa") <= xm) & (F.col("xb") > xm))
        .select(*group, "left", "right", "y1", "kind", "dir", F.least(F.greatest(y, F.col("y0")), F.col("y1")).alias("y"))
    )
    upward = Window.partitionBy(*group, "left").orderBy("y")
    so_far = upward.rowsBetween(Window.unboundedPreceding, 0)
    covered = swept.select(
        "source_id",
        "id",
        F.sum(F.when(F.col("kind") == 0, F.col("dir")).otherwise(0)).over(so_far).alias("in_source"),
        F.sum(F.when(F.col("kind") == 1, F.col("dir")).otherwise(0)).over(so_far).alias("in_mask"),
        ((F.coalesce(F.lead("y").over(upward), F.col("y1")) - F.col("y")) * (F.col("right") - F.col("left"))).alias("gap"),
    )
    return (
        covered.where("in_source > 0 and in_mask > 0 and gap > 0").groupBy("source_id", "id").agg(F.sum("gap").alias("overlap"))
    )


def _slabs(clipped: DataFrame, group: list[str]) -> DataFrame:
    # A vertical edge only says where to cut; it has no slope.
    rise = F.when(F.col("xb") > F.col("xa"), (F.col("yb") - F.col("ya")) / (F.col("xb") - F.col("xa")))
    sloped = clipped.withColumn("m", rise)

    def leaves(level: str) -> Column:
        inside = (F.least("ya", "yb") < F.col(level)) & (F.greatest("ya", "yb") > F.col(level))
        return F.when(inside, F.col("xa") + (F.col(level) - F.col("ya")) / F.col("m"))

    # An edge wholly above or below the piece only adds to the cover count, so
    # its ends need no cut: a change inside the piece shows on the edge there.
    near = (F.greatest("ya", "yb") > F.col("y0")) & (F.least("ya", "yb") < F.col("y1"))
    own = [F.when(near, F.col(c)) for c in ("xa", "xb")]
    ends = sloped.select(*group, F.explode(F.array("sl", "sr", *own, leaves("y0"), leaves("y1"))).alias("x"))
    # Only edges inside the piece's band can change the order there. Edges meet
    # on a shared box: a strip has as many height steps as its piece has strips,
    # so both sides of the box shrink where edges crowd. A crossing found in two
    # boxes is one cut.
    step = (F.col("y1") - F.col("y0")) / F.col("k")

    def level_of(y: Column) -> Column:
        held = F.least(F.greatest(y, F.col("y0")), F.col("y1")) - F.col("y0")
        return F.floor(held / step).cast("int")

    levels = F.explode(F.sequence(level_of(F.least("ya", "yb")), level_of(F.greatest("ya", "yb"))))
    band = sloped.where("greatest(ya, yb) > y0 and least(ya, yb) < y1 and m is not null").select(
        *group, "xa", "xb", "ya", "yb", "m", levels.alias("level")
    )
    other = band.select(*group, "level", *[F.col(c).alias(f"o_{c}") for c in ("xa", "xb", "ya", "yb", "m")])
    above = F.col("o_ya") + F.col("o_m") * (F.col("xa") - F.col("o_xa")) - F.col("ya")
    x = F.col("xa") + F.try_divide(above, F.col("m") - F.col("o_m"))
    crossings = (
        band.join(other, [*group, "level"])
        .where("m > o_m and xa < o_xb and o_xa < xb")
        .where("least(ya, yb) < greatest(o_ya, o_yb) and least(o_ya, o_yb) < greatest(ya, yb)")
        .select(*group, x.alias("x"), F.greatest("xa", "o_xa").alias("lo"), F.least("xb", "o_xb").alias("hi"))
        .where("x > lo and x < hi")
        .select(*group, "x")
    )
    cuts = ends.where("x is not null").unionByName(crossings).distinct()
    after = Window.partitionBy(*group).orderBy("x")
    return cuts.select(*group, F.col("x").alias("left"), F.lead("x").over(after).alias("right")).where("right > left")
