"""Travel times from straight-line distance, for areas without routed times."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from reachgrid.functions.geo import haversine_km
from reachgrid.operators.sizes import if_small, is_small

# Speed, wait, reach and cut-off of the distance model, and the
# time-of-day factors (hours from, to, speed factor, wait factor).
SPEED_KMH = 15.0
WAIT_MIN = 5.0
REACH_M = 13750.0
CUT_MIN = 60.0
DAY_FACTORS = ((7, 9, 1.0, 1.0), (17, 19, 1.0, 1.0), (10, 16, 1.15, 1.5), (20, 22, 1.3, 2.5))
NIGHT_FACTORS = (2.0, 4.0)
JITTER_LOW, JITTER_STEPS = 0.85, 31
SLOTS = tuple(f"{h:02d}:{m:02d}" for h in range(24) for m in (0, 30))


#: Points of a leaf of the tile tree, if it is not as deep as it may be.
LEAF = 2048
#: Times that a tile as wide as the reach may be cut in four.
DEPTH = 6
#: Pairs that a task looks at where destinations are broadcast.
PAIRS = 4_000_000


def near_pairs(cells: DataFrame, dests: DataFrame, reach: float, x: str = "x", y: str = "y", leaf: int = LEAF) -> DataFrame:
    """Cell and destination pairs at most *reach* apart in the plane.

    Few destinations are broadcast, filed under their own tile; a cell looks
    into its own tile and its eight neighbours. Beyond that see
    :func:`leaf_pairs`. The exact distance decides.
    """
    b = dests.select(*[F.col(c).alias(f"d_{c}") for c in dests.columns])
    apart = F.sqrt(F.pow(F.col(x) - F.col(f"d_{x}"), 2) + F.pow(F.col(y) - F.col(f"d_{y}"), 2))
    if is_small(dests):
        a = cells.select("*", *_tile(x, y, reach, "_tx", "_ty"))
        near = b.select("*", *_tile(f"d_{x}", f"d_{y}", reach, "_tx", "_ty"))
        met = around(dealt(a, near)).join(F.broadcast(near), ["_tx", "_ty"]).drop("_tx", "_ty")
    else:
        met = leaf_pairs(cells, b, reach, (x, y), (f"d_{x}", f"d_{y}"), leaf)
    return met.withColumn("metres", apart).where(F.col("metres") <= reach)


def dealt(cells: DataFrame, dests: DataFrame) -> DataFrame:
    """Cells dealt out evenly, by the pairs that they meet: a small table of cells is one file split, and so one task."""
    n, m = (df.groupBy("_tx", "_ty").agg(F.count("*").alias(c)) for df, c in ((cells, "_n"), (dests, "_m")))
    pairs = around(n).join(m, ["_tx", "_ty"]).agg(F.sum(F.col("_n") * F.col("_m"))).head()[0] or 0
    return cells.repartition(-(-pairs // PAIRS)) if pairs > PAIRS else cells


def around(tiled: DataFrame) -> DataFrame:
    """Each row under its tile (_tx, _ty) and the eight tiles around it."""
    step = F.explode(F.sequence(F.lit(-1), F.lit(1)))
    spread = tiled.select("*", step.alias("_i")).select("*", step.alias("_j"))
    return spread.withColumns({"_tx": F.col("_tx") + F.col("_i"), "_ty": F.col("_ty") + F.col("_j")}).drop("_i", "_j")


def leaves_of(points: DataFrame, x: str, y: str, reach: float, leaf: int, name: str) -> tuple[DataFrame, DataFrame]:
    """(points with the leaf of a quad-tree that each lies in, the leaves with their tiles of the reach's width).

    A tile with more than *leaf* points is cut in four, DEPTH times at most. The
    tree comes from counts in the smallest tiles; no point is moved for it.
    """
    fine = [F.floor(F.col(c) / F.lit(reach / (1 << DEPTH))).cast("bigint").alias(n) for c, n in ((x, "_fx"), (y, "_fy"))]
    placed = points.select("*", *fine)
    counts = placed.groupBy("_fx", "_fy").agg(F.count("*").alias("_n"))
    level = F.lit(DEPTH)
    for k in reversed(range(DEPTH)):
        tile = [F.shiftright(F.col(c), DEPTH - k) for c in ("_fx", "_fy")]
        # A tile has at most 4 ** DEPTH rows here.
        level = F.when(F.sum("_n").over(Window.partitionBy(*tile)) <= leaf, k).otherwise(level)
    shifted = counts.select("_fx", "_fy", level.alias("_level"))
    own = F.struct("_level", *[F.expr(f"shiftright({c}, {DEPTH} - _level)").alias(n) for c, n in (("_fx", "_lx"), ("_fy", "_ly"))])
    tree = shifted.select("_fx", "_fy", own.alias(name))
    wide = [F.shiftright(F.col(c), DEPTH).alias(n) for c, n in (("_fx", "_tx"), ("_fy", "_ty"))]
    return placed.join(if_small(tree), ["_fx", "_fy"]).drop("_fx", "_fy"), tree.select(name, *wide).distinct()


def leaf_pairs(cells: DataFrame, dests: DataFrame, reach: float, own: tuple[str, str], theirs: tuple[str, str], leaf: int = LEAF) -> DataFrame:
    """Cells with destinations in leaves that come within *reach* of each other.

    A pair of leaves is a join key, so that none has more than the square of
    *leaf* pairs, however many points a city has. Leaves too far apart are left
    out by the distance of their tiles.
    """
    a, a_leaves = leaves_of(cells, *own, reach, leaf, "_a")
    b, b_leaves = leaves_of(dests, *theirs, reach, leaf, "_b")

    def gap(axis: str) -> Column:
        sides = [F.lit(reach) / F.pow(F.lit(2.0), F.col(f"{n}._level")) for n in ("_a", "_b")]
        low = [F.col(f"{n}.{axis}") * side for n, side in zip(("_a", "_b"), sides)]
        return F.greatest(F.lit(0.0), low[1] - low[0] - sides[0], low[0] - low[1] - sides[1])

    # A little more than the reach, for the rounding of tile borders.
    pairs = a_leaves.join(around(b_leaves), ["_tx", "_ty"]).where(F.hypot(gap("_lx"), gap("_ly")) <= reach * (1 + 1e-9)).select("_a", "_b")
    return a.join(if_small(pairs), "_a").join(b.join(if_small(pairs), "_b"), ["_a", "_b"]).drop("_a", "_b")


def _tile(x: str, y: str, side: float, tx: str, ty: str) -> list[Column]:
    return [F.floor(F.col(c) / F.lit(side)).cast("bigint").alias(n) for c, n in ((x, tx), (y, ty))]


def distance_od(
    cells: DataFrame,
    dests: DataFrame,
    mode: str = "TRANSIT",
    speed_kmh: float = SPEED_KMH,
    wait_min: float = WAIT_MIN,
    reach_m: float = REACH_M,
    max_min: float = CUT_MIN,
) -> DataFrame:
    """One travel time per pair within reach; *cells* and *dests* have id, x, y."""
    minutes = F.col("metres") / 1000.0 / speed_kmh * 60.0 + wait_min
    return (
        near_pairs(cells, dests, reach_m)
        .select(
            F.col("id").alias("origin_cell_id"),
            F.col("d_id").alias("destination_id"),
            F.lit(mode).alias("mode"),
            minutes.alias("travel_time_minutes"),
        )
        .where(F.col("travel_time_minutes") <= max_min)
    )


def slot_factors(slots: tuple[str, ...] = SLOTS) -> list[tuple[str, float, float]]:
    out = []
    for slot in slots:
        hour = int(slot[:2])
        speed, wait = next((f[2:] for f in DAY_FACTORS if f[0] <= hour <= f[1]), NIGHT_FACTORS)
        out.append((slot, speed, wait))
    return out


def slot_od(
    cells: DataFrame,
    dests: DataFrame,
    slots: tuple[str, ...] = SLOTS,
    mode: str = "TRANSIT",
    fraction: float = 1.0,
    jitter: bool = True,
    seed: int = 42,
    max_min: float = CUT_MIN,
) -> DataFrame:
    """Travel times for every slot, with time-of-day factors; *cells* and *dests* have id, lon, lat.

    The cut-off bounds the distance, so only near pairs are formed: degrees are
    stretched to kilometres that are never longer than the true distance, and
    the great-circle distance then decides. *fraction* samples the cells.
    """
    if fraction < 1.0:
        cells = cells.sample(fraction=fraction, seed=seed)
    factors = slot_factors(slots)
    low = JITTER_LOW if jitter else 1.0
    reach_km = max((max_min / low - WAIT_MIN * wait) / 60.0 * SPEED_KMH / speed for _, speed, wait in factors)
    if reach_km <= 0:
        reach_km = 0.001
    # One row: the highest latitude in play fixes a safe length of a degree of longitude.
    lat_bound = cells.select("lat").unionByName(dests.select("lat")).agg(F.max(F.abs("lat")).alias("_lat")).withColumn("_one", F.lit(1))
    km = 111.0

    def flat(df: DataFrame) -> DataFrame:
        return df.withColumn("_one", F.lit(1)).join(F.broadcast(lat_bound), "_one").select(
            "id", "lon", "lat", (F.col("lon") * km * F.cos(F.radians("_lat"))).alias("x"), (F.col("lat") * km).alias("y")
        )

    pairs = near_pairs(flat(cells), flat(dests), reach_km * 1.01)
    km_apart = haversine_km(F.col("lon"), F.col("lat"), F.col("d_lon"), F.col("d_lat"))
    # Slots of the same factors have the same minutes, which are found once.
    alike: dict[tuple[float, float], list[str]] = {}
    for slot, *pair in factors:
        alike.setdefault(tuple(pair), []).append(slot)
    table = F.array(
        *[
            F.struct(F.array(*map(F.lit, names)).alias("slots"), F.lit(a).alias("speed"), F.lit(b).alias("wait"))
            for (a, b), names in alike.items()
        ]
    )
    wobble = (
        F.lit(JITTER_LOW) + F.pmod(F.xxhash64("id", "d_id", F.lit(mode)), F.lit(JITTER_STEPS)) / 100.0
        if jitter
        else F.lit(1.0)
    )
    timed = pairs.select("id", "d_id", km_apart.alias("km"), wobble.alias("wobble")).select("*", F.explode(table).alias("f"))
    minutes = (F.col("km") / SPEED_KMH * 60.0 * F.col("f.speed") + WAIT_MIN * F.col("f.wait")) * F.col("wobble")
    return (
        timed.withColumn("minutes", minutes)
        .where(F.col("minutes") <= max_min)
        .select(
            F.col("id").alias("origin_cell_id"),
            F.col("d_id").alias("destination_id"),
            F.lit(mode).alias("mode"),
            F.col("f.slots").alias("slots"),
            F.round(F.greatest("minutes", F.lit(1.0)), 1).alias("travel_time_minutes"),
        )
        .select("origin_cell_id", "destination_id", "mode", F.explode("slots").alias("departure_time"), "travel_time_minutes")
    )
