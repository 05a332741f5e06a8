import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from reachgrid.functions import geo
from reachgrid.operators import overlay
from reachgrid.operators.contain import contains, polygon_edges
from reachgrid.operators.distance import distance_od, slot_od
from reachgrid.operators.grid import covering_cells, grid_rows
from reachgrid.schemas import RINGS
from shapes import box, cells, edges, people, ring, rings_column

FOUR = {1: (0, 0, 100, 100), 2: (100, 0, 200, 100), 3: (0, 100, 100, 200), 4: (100, 100, 200, 200)}


def result(df):
    return {r.id: r.population for r in df.collect()}


def inside(points, x, y):
    """Even-odd rule on arrays."""
    hit = np.zeros(x.shape, bool)
    for (ax, ay), (bx, by) in zip(points, points[1:] + points[:1]):
        if ay != by:
            hit ^= ((ay > y) != (by > y)) & (x < (bx - ax) * (y - ay) / (by - ay) + ax)
    return hit


@pytest.mark.parametrize(
    "source, boxes, expected",
    [
        (box(0, 0, 200, 200), FOUR, {1: 250, 2: 250, 3: 250, 4: 250}),
        (box(0, 0, 100, 100), {1: (50, 0, 150, 100)}, {1: 500}),
        (box(0, 0, 150, 150), {1: (0, 0, 100, 100)}, {1: 1000 * 10000 / 22500}),
        (box(500, 500, 600, 600), {1: (0, 0, 100, 100)}, {1: 0}),
    ],
)
def test_areal_boxes(spark, source, boxes, expected):
    got = result(overlay.areal_weight(people(spark, {1: 1000}), edges(spark, "source_id", {1: [source]}), cells(spark, boxes), 130.0))
    assert got == pytest.approx(expected)


def test_areal_conserves_concave_triangle_and_hole(spark):
    shapes = {
        1: [ring([(10, 10), (390, 30), (200, 120), (380, 380), (20, 300)])],
        2: [ring([(50, 50), (300, 80), (120, 333)])],
        3: [box(20, 20, 300, 300), list(reversed(box(100, 100, 200, 200)))],
    }
    grid = {i * 8 + j: (50 * i, 50 * j, 50 * i + 50, 50 * j + 50) for i in range(8) for j in range(8)}
    got = result(overlay.areal_weight(people(spark, {1: 700, 2: 200, 3: 100}), edges(spark, "source_id", shapes), cells(spark, grid), 77.0))
    assert sum(got.values()) == pytest.approx(1000, abs=1e-4)
    only_hole = result(overlay.areal_weight(people(spark, {3: 100}), edges(spark, "source_id", {3: shapes[3]}), cells(spark, {1: (120, 120, 180, 180)})))
    assert only_hole == {1: 0}


@pytest.mark.parametrize(
    "masks, expected",
    [
        ({1: [box(0, 0, 150, 200)], 2: [box(50, 0, 200, 200)]}, {1: 250, 2: 250, 3: 250, 4: 250}),
        ({1: [box(0, 0, 100, 100)]}, {1: 1000, 2: 0, 3: 0, 4: 0}),
        ({1: [box(900, 900, 950, 950)]}, {1: 0, 2: 0, 3: 0, 4: 0}),
    ],
)
def test_masked_boxes(spark, masks, expected):
    got = result(
        overlay.masked_weight(
            people(spark, {1: 1000}),
            edges(spark, "source_id", {1: [box(0, 0, 200, 200)]}),
            cells(spark, FOUR),
            edges(spark, "mask_id", masks),
            1000.0,
        )
    )
    assert got == pytest.approx(expected)


def test_masked_denominator_reaches_beyond_the_cells(spark):
    got = result(
        overlay.masked_weight(
            people(spark, {1: 900}),
            edges(spark, "source_id", {1: [box(0, 0, 300, 100)]}),
            cells(spark, {1: (0, 0, 100, 100)}),
            edges(spark, "mask_id", {1: [box(50, 0, 250, 100)]}),
            70.0,
        )
    )
    assert got == pytest.approx({1: 900 * 50 / 200})


@pytest.mark.parametrize("strip_edges", [32, 1])
def test_masked_against_point_count(spark, monkeypatch, strip_edges):
    monkeypatch.setattr(overlay, "STRIP_EDGES", strip_edges)
    sources = {
        1: [ring([(10, 20), (300, 15), (340, 200), (180, 90), (160, 330), (20, 250)])],
        2: [ring([(200, 210), (350, 220), (330, 390), (210, 380)])],
    }
    masks = {
        1: [ring([(50, 50), (150, 40), (120, 160), (60, 150)])],
        2: [ring([(100, 100), (260, 60), (220, 280), (140, 300)])],
        3: [ring([(240, 240), (300, 240), (300, 300)])],
        4: [ring([(500, 500), (600, 500), (550, 600)])],
    }
    pop = {1: 1000, 2: 500}
    grid = {i * 10 + j: (37 * i, 41 * j, 37 * i + 37, 41 * j + 41) for i in range(10) for j in range(10)}
    got = result(
        overlay.masked_weight(people(spark, pop), edges(spark, "source_id", sources), cells(spark, grid), edges(spark, "mask_id", masks), 130.0)
    )
    n = 2000
    x, y = np.meshgrid((np.arange(n) + 0.5) * 370 / n, (np.arange(n) + 0.5) * 410 / n)
    union = np.zeros(x.shape, bool)
    for m in masks.values():
        union |= inside(m[0], x, y)
    cell = (x // 37).astype(int) * 10 + (y // 41).astype(int)
    expected = np.zeros(100)
    for k, shape in sources.items():
        hit = inside(shape[0], x, y) & union
        expected += pop[k] * np.bincount(cell[hit], minlength=100) / hit.sum()
    assert sum(got.values()) == pytest.approx(1500)
    assert max(abs(got[k] - expected[k]) for k in range(100)) < 0.6


def test_containment_against_brute_force(spark):
    shapes = {
        "a": [ring([(0, 0), (900, 100), (500, 400), (950, 900), (50, 800), (300, 400)])],
        "b": [box(100, 100, 800, 800), list(reversed(box(300, 300, 500, 600)))],
        "c": [box(0, 0, 90, 90), box(200, 0, 290, 90)],
    }
    rng = random.Random(7)
    pts = [(i, rng.uniform(-50, 1000), rng.uniform(-50, 1000)) for i in range(800)]
    df = spark.createDataFrame(pts, "id bigint, x double, y double")
    got = {(r.id, r.code) for r in contains(df, edges(spark, "code", shapes), "code", tile=110.0).collect()}
    x, y = np.array([p[1] for p in pts]), np.array([p[2] for p in pts])
    want = set()
    for name, rings in shapes.items():
        hit = np.zeros(x.shape, bool)
        for pts_ in rings:
            hit ^= inside(pts_, x, y)
        want |= {(int(i), name) for i in np.nonzero(hit)[0]}
    assert got == want


def test_border_points_belong_to_both_neighbours(spark):
    shapes = {"left": [box(0, 0, 100, 100)], "right": [box(100, 0, 200, 100)]}
    pts = [(1, 100.0, 50.0), (2, 0.0, 0.0), (3, 200.0, 100.0), (4, 100.0, 100.0), (5, 100.0, 100.1), (6, 50.0, 0.0)]
    df = spark.createDataFrame(pts, "id bigint, x double, y double")
    got = {(r.id, r.code) for r in contains(df, edges(spark, "code", shapes), "code", tile=100.0).collect()}
    assert got == {(1, "left"), (1, "right"), (2, "left"), (3, "right"), (4, "left"), (4, "right"), (6, "left")}


def test_edges_turn_rings_the_right_way(spark):
    backwards = list(reversed(box(0, 0, 10, 10)))
    hole = box(2, 2, 4, 4)
    df = spark.createDataFrame([("p", rings_column(backwards, hole))], f"code string, rings {RINGS}")
    area = overlay.polygon_area(polygon_edges(df, "code"), "code").head().area
    assert area == pytest.approx(100 - 4)


def test_grid_covers_what_brute_force_covers(spark):
    shape = ring([(130, 130), (1620, 260), (900, 700), (1490, 1490), (250, 1100)])
    got = {(r.cx, r.cy) for r in covering_cells(edges(spark, "code", {"a": [shape]}), "code", 250).collect()}
    fine = np.linspace(0, 250, 60)
    want = set()
    for cx in range(0, 7):
        for cy in range(0, 7):
            x, y = np.meshgrid(cx * 250 + fine, cy * 250 + fine)
            if inside(shape, x, y).any():
                want.add((cx, cy))
    assert want <= got
    # Beyond the sampled ones only cells that an edge just clips may appear.
    assert len(got - want) <= 2


def test_grid_counts_touching_cells_inside_the_frame(spark):
    got = {(r.cx, r.cy) for r in covering_cells(edges(spark, "code", {"a": [box(250, 250, 500, 500)]}), "code", 250).collect()}
    assert got == {(1, 1)}
    two = {"a": [box(250, 250, 500, 500)], "b": [box(900, 900, 950, 950)]}
    got = {(r.cx, r.cy) for r in covering_cells(edges(spark, "code", two), "code", 250).collect()}
    assert got == {(1, 1), (2, 1), (1, 2), (2, 2), (3, 3)}


def test_grid_rows_have_unique_ids_and_codes(spark):
    covered = covering_cells(edges(spark, "code", {"a": [box(500010, 4790010, 501000, 4790700)]}), "code", 250)
    rows = grid_rows(covered, "t1").collect()
    assert len({r.id for r in rows}) == len(rows) == len({r.cell_code for r in rows}) == 12
    assert {r.cell_code for r in rows} >= {"E500000_N4790000", "E500750_N4790500"}


@pytest.mark.parametrize(
    "lon, lat, x, y",
    [(-3.0, 43.0, 500000.0, 4760814.80), (-3.0, 0.0, 500000.0, 0.0)],
)
def test_projection_control_points(spark, lon, lat, x, y):
    e, n = geo.project(F.lit(lon), F.lit(lat))
    r = spark.range(1).select(e.alias("e"), n.alias("n")).head()
    assert r.e == pytest.approx(x, abs=0.01)
    assert r.n == pytest.approx(y, abs=1.0)


def test_projection_round_trip_and_scale(spark):
    pts = spark.createDataFrame([(-3.4, 42.95), (-2.3, 43.5), (-2.93, 43.26)], "lon double, lat double")
    e, n = geo.project(F.col("lon"), F.col("lat"))
    back = geo.unproject(e, n)
    e2, n2 = geo.project(F.col("lon"), F.col("lat") + 0.001)
    for r in pts.select("*", back[0].alias("lon2"), back[1].alias("lat2"), F.sqrt((e2 - e) ** 2 + (n2 - n) ** 2).alias("d")).collect():
        assert r.lon2 == pytest.approx(r.lon, abs=1e-9)
        assert r.lat2 == pytest.approx(r.lat, abs=1e-9)
        assert r.d == pytest.approx(111.1, abs=0.2)


def test_ring_area_and_centroid(spark):
    df = spark.createDataFrame([(box(10, 20, 30, 60),)], "pts array<struct<x:double,y:double>>")
    m = geo.ring_moments(F.col("pts"))
    r = df.select(m["a"].alias("a"), (m["mx"] / m["a"]).alias("x"), (m["my"] / m["a"]).alias("y"), geo.signed_area(F.col("pts")).alias("s")).head()
    assert (r.a, r.x, r.y, r.s) == pytest.approx((800, 20, 40, 800))


def test_distance_pairs_are_complete(spark):
    rng = random.Random(3)
    c = [(i, rng.uniform(0, 9000), rng.uniform(0, 9000)) for i in range(120)]
    d = [(i, rng.uniform(0, 9000), rng.uniform(0, 9000)) for i in range(60)]
    schema = "id bigint, x double, y double"
    got = {
        (r.origin_cell_id, r.destination_id): r.travel_time_minutes
        for r in distance_od(spark.createDataFrame(c, schema), spark.createDataFrame(d, schema), reach_m=2500, max_min=12).collect()
    }
    want = {}
    for i, x, y in c:
        for j, u, v in d:
            dist = math.hypot(x - u, y - v)
            if dist <= 2500 and dist / 1000 / 15 * 60 + 5 <= 12:
                want[i, j] = dist / 1000 / 15 * 60 + 5
    assert got == pytest.approx(want)


def test_slot_times_with_jitter_and_sample(spark):
    schema = "id bigint, lon double, lat double"
    c = spark.createDataFrame([(i, -2.97 + 0.002 * i, 43.24 + 0.001 * i) for i in range(40)], schema)
    d = spark.createDataFrame([(1, -2.93, 43.26), (2, -2.92, 43.25)], schema)
    rows = slot_od(c, d).collect()
    assert {r.departure_time for r in rows} and all(1 <= r.travel_time_minutes <= 60 for r in rows)
    base = {(r.origin_cell_id, r.destination_id, r.departure_time): r.travel_time_minutes for r in slot_od(c, d, jitter=False).collect()}
    shared = [r.travel_time_minutes / base[k] for r in rows if (k := (r.origin_cell_id, r.destination_id, r.departure_time)) in base]
    assert 0.83 < min(shared) and max(shared) < 1.17
    assert sorted(map(tuple, rows)) == sorted(map(tuple, slot_od(c, d).collect()))
    part = slot_od(c, d, fraction=0.5).select("origin_cell_id").distinct().count()
    assert 0 < part < 40


def test_rings_without_an_inside_are_left_out(spark):
    from reachgrid.functions.geo import signed_area
    from reachgrid.operators.contain import polygon_edges
    from pyspark.sql import functions as F

    shape = "key string, rings array<struct<part: int, ring: int, pts: array<struct<x: double, y: double>>>>"
    square = [(0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.0, 1.0)]
    df = spark.createDataFrame([("a", [(0, 0, square), (0, 1, []), (0, 2, [(0.5, 0.5)])]), ("b", [(0, 0, [])])], shape)
    edges = polygon_edges(df, "key").collect()
    assert {r.key for r in edges} == {"a"} and len(edges) == 4
    areas = df.select(F.transform("rings", lambda r: signed_area(r["pts"])).alias("a")).collect()
    assert [list(r.a) for r in areas] == [[1.0, 0.0, 0.0], [0.0]]


def star(rng, n, radius, cx=0.0, cy=0.0):
    turn = sorted(rng.random() * 2 * math.pi for _ in range(n))
    return [(cx + math.cos(t) * radius * (0.6 + 0.4 * rng.random()), cy + math.sin(t) * radius * (0.6 + 0.4 * rng.random())) for t in turn]


@pytest.mark.parametrize("tile", [37.0, 400.0, 10_000.0])
def test_cover_by_brute_force(spark, tile):
    """Stars with holes and corners on round coordinates, points on a grid of round coordinates among them."""
    rng = random.Random(int(tile))
    shapes = {i: [ring([(round(x), round(y)) for x, y in star(rng, 25, 600, rng.randrange(-300, 300), rng.randrange(-300, 300))])] for i in range(5)}
    shapes[5] = [box(-500, -500, 500, 500), list(reversed(box(-200, -200, 200, 200)))]
    x, y = (c.ravel().astype(float) for c in np.meshgrid(np.arange(-1000, 1001, 50), np.arange(-1000, 1001, 50)))
    x, y = x + np.where(np.arange(len(x)) % 2, 0.5, 0.0), y + np.where(np.arange(len(x)) % 3, 0.25, 0.0)
    points = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(zip(x, y))], "id long, x double, y double")
    given = edges(spark, "code", shapes)
    got = {(r.id, r.code) for r in contains(points, given, "code", tile=tile).collect()}
    want, unsure = set(), set()
    for code, rings in shapes.items():
        hit = np.zeros(x.shape, bool)
        for r in rings:
            hit ^= inside(r, x, y)
            for (ax, ay), (bx, by) in zip(r, r[1:] + r[:1]):
                on = ((bx - ax) * (y - ay) - (by - ay) * (x - ax) == 0) & (x >= min(ax, bx)) & (x <= max(ax, bx)) & (y >= min(ay, by)) & (y <= max(ay, by))
                unsure |= {(int(i), code) for i in np.flatnonzero(on)}
        want |= {(int(i), code) for i in np.flatnonzero(hit)}
    assert got == want | unsure


def test_cover_of_a_large_polygon(spark):
    """100 km across: fewer than three filed rows for each edge, and most tiles need none."""
    from reachgrid.operators.contain import filed_edges, tile_cover

    rng = random.Random(4)
    given = edges(spark, "code", {1: [ring([(50_000 + math.cos(t / 4000 * math.pi) * 50_000 + rng.random() * 40, 50_000 + math.sin(t / 4000 * math.pi) * 50_000) for t in range(8000)])]})
    filed = filed_edges(given, "code", 2000.0)
    assert filed.count() < 1.5 * given.count()
    cover = tile_cover(given, filed, "code", 2000.0)
    kinds = {r._inner: r["count"] for r in cover.groupBy("_inner").count().collect()}
    assert cover.count() == cover.select("_tx", "_ty").distinct().count()
    assert kinds[True] > 1500 and kinds[False] < 300
    area = 4e6 * (kinds[True] + kinds[False] / 2)
    assert area == pytest.approx(math.pi * 50_000**2, rel=0.02)


@pytest.mark.parametrize("leaf", [8, 60])
def test_near_pairs_in_leaves(spark, monkeypatch, leaf):
    """Most points in two small towns: the same pairs as all with all, and no join key with more than its share."""
    from reachgrid.operators import sizes
    from reachgrid.operators.distance import DEPTH, leaf_pairs, leaves_of, near_pairs

    rng = np.random.default_rng(leaf)
    towns = np.concatenate([rng.normal((300, -900), 60, (150, 2)), rng.normal((-2500, 400), 40, (100, 2)), rng.uniform(-4000, 4000, (80, 2)), [[0.0, 0.0]] * 5])
    shops = np.concatenate([rng.normal((320, -880), 80, (150, 2)), rng.uniform(-4000, 4000, (60, 2)), [[0.0, 1000.0]] * 3])
    frames = [spark.createDataFrame([(i, float(p[0]), float(p[1])) for i, p in enumerate(pts)], "id long, x double, y double") for pts in (towns, shops)]
    apart = np.hypot(*(towns[:, None, :] - shops[None, :, :]).transpose(2, 0, 1))
    want = {(int(i), int(j)) for i, j in zip(*np.nonzero(apart <= 1000.0))}
    few = {(r.id, r.d_id) for r in near_pairs(*frames, 1000.0).collect()}
    monkeypatch.setattr(sizes, "BROADCAST_ROWS", 0)
    got = [(r.id, r.d_id) for r in near_pairs(*frames, 1000.0, leaf=leaf).collect()]
    assert set(got) == want == few and len(got) == len(want)
    points, leaves = leaves_of(frames[0], "x", "y", 1000.0, leaf, "_a")
    sizes_ = points.groupBy("_a").count().collect()
    assert len(sizes_) == leaves.count() and all(r["count"] <= leaf or r["_a"]["_level"] == DEPTH for r in sizes_)
    renamed = frames[1].toDF("d_id", "d_x", "d_y")
    tried = leaf_pairs(frames[0], renamed, 1000.0, ("x", "y"), ("d_x", "d_y"), leaf).count()
    assert tried < 0.75 * len(towns) * len(shops)


def test_near_cells_of_one_file_split_are_dealt_over_tasks(spark, monkeypatch):
    from pyspark.sql import functions as F
    from reachgrid.operators import distance

    monkeypatch.setattr(distance, "PAIRS", 500)
    ids = F.col("id")
    cells = spark.range(0, 100, 1, 1).select("id", (ids * 10).cast("double").alias("x"), (ids * 7 % 90).cast("double").alias("y"))
    dests = spark.range(40).select("id", (ids * 31 % 1000).cast("double").alias("x"), (ids * 13 % 95).cast("double").alias("y"))
    met = distance.near_pairs(cells, dests, 300.0)
    assert met.select(F.spark_partition_id()).distinct().count() > 1
    a, b = cells.collect(), dests.collect()
    want = {(p.id, q.id) for p in a for q in b if math.hypot(p.x - q.x, p.y - q.y) <= 300}
    got = [(r.id, r.d_id) for r in met.collect()]
    assert set(got) == want and len(got) == len(want)


def test_minutes_of_every_slot_by_brute_force(spark):
    """Minutes are found once for slots of the same factors: there are four, not 48."""
    from reachgrid.operators.distance import CUT_MIN, SPEED_KMH, WAIT_MIN, slot_factors

    places = [(i, -2.0 + i * 0.013, 43.0 + i * i % 7 * 0.01) for i in range(12)]
    c = spark.createDataFrame(places, "id long, lon double, lat double")
    od = slot_od(c, c, jitter=False)
    got = {(r.origin_cell_id, r.destination_id, r.departure_time): r.travel_time_minutes for r in od.collect()}

    def km(p, q):
        la, lb = math.radians(p[2]), math.radians(q[2])
        h = math.sin((lb - la) / 2) ** 2 + math.cos(la) * math.cos(lb) * math.sin(math.radians(q[1] - p[1]) / 2) ** 2
        return 2 * 6371 * math.atan2(math.sqrt(h), math.sqrt(1 - h))

    want = {
        (p[0], q[0], slot): minutes
        for p in places
        for q in places
        for slot, speed, wait in slot_factors()
        if (minutes := km(p, q) / SPEED_KMH * 60 * speed + WAIT_MIN * wait) <= CUT_MIN
    }
    assert set(got) == set(want) and len({k[2] for k in got}) == 48
    assert all(abs(got[k] - max(want[k], 1)) <= 0.0500001 for k in got)
