import json

import pandas as pd
import pytest
from pyspark.sql import functions as F

from reachgrid import ScoreParams, Workspace, check_code, check_slot, load_params
from reachgrid.operators import scoring as op
from reachgrid.params import check_choice, check_limit
from reachgrid.plans import areas, cells, jobs, listings, region, transit
from reachgrid.schemas import KEYS, RINGS, SCHEMAS, columns
from reachgrid.sources import sinks
from reachgrid.sources.seed import seed_reference
from shapes import box, ring, rings_column


def layer(spark, rows, table):
    """Layer rows in metres; degrees are not needed here."""
    shown = columns(table)
    fields = {c: t for c, t in zip(shown, [None] * len(shown))}
    out = []
    for row in rows:
        rings = rings_column(*row.pop("shape"))
        out.append([{**dict.fromkeys(fields), **row, "rings": rings, "rings_m": rings}[c] for c in shown])
    return spark.createDataFrame(out, SCHEMAS[table])


def small_region(ws):
    """A boundary of 2 x 2 km, two sections, one settlement and eight destinations."""
    spark, t = ws.spark, ws.tenant
    base = (500000, 4790000)
    at = lambda x0, y0, x1, y1: box(base[0] + x0, base[1] + y0, base[0] + x1, base[1] + y1)
    for name, df in seed_reference(ws).items():
        ws.publish(name, df)
    ws.publish("boundaries", layer(spark, [{"id": 1, "tenant_id": t, "name": "R", "boundary_type": "region", "shape": [at(0, 0, 2000, 2000)]}], "boundaries"))
    ws.publish(
        "population_sources",
        layer(
            spark,
            [
                {"id": 1, "tenant_id": t, "name": "a", "population": 800.0, "source_code": "a", "shape": [at(0, 0, 1000, 2000)]},
                {"id": 2, "tenant_id": t, "name": "b", "population": 600.0, "source_code": "b", "shape": [at(1000, 0, 2000, 2000)]},
            ],
            "population_sources",
        ),
    )
    ws.publish(
        "nucleos",
        layer(
            spark,
            [
                {"id": 1, "tenant_id": t, "code": "n", "nucleo_num": "01", "name": "N", "shape": [at(500, 500, 1500, 1500)]},
                {"id": 2, "tenant_id": t, "code": "d", "nucleo_num": "99", "name": "D", "shape": [at(0, 0, 2000, 2000)]},
            ],
            "nucleos",
        ),
    )
    ws.publish(
        "municipalities",
        layer(
            spark,
            [
                {"id": i, "tenant_id": t, "muni_code": str(i), "name": f"M{i}", "shape": [at(*b)]}
                for i, b in enumerate([(0, 0, 1000, 2000), (1000, 0, 2000, 2000)], 1)
            ],
            "municipalities",
        ),
    )
    rows = [(i, t, 1 + i % 3, f"d{i}", 1.0, "{}", -3.0 + 0.003 * i, 43.2639 + 0.001 * i) for i in range(8)]
    return spark.createDataFrame(rows, SCHEMAS["destinations"])


def matrices(folder, ids, slots):
    folder.mkdir()
    for k, slot in enumerate(slots):
        rows = [(str(c), str(d), float((c * 7 + d * 11 + k) % 130)) for c in ids for d in range(8)]
        pd.DataFrame(rows, columns=["from_id", "to_id", "travel_time_p50"]).to_parquet(folder / f"ttm_transit_{slot}.parquet")
    return str(folder)


def test_full_run(ws, tmp_path):
    ws.publish("destinations", small_region(ws))
    ids = range(1, 65)
    out = jobs.run(ws, matrices(tmp_path / "od", ids, ["0800", "0830"]))
    grid = ws.table("grid_cells")
    assert grid.count() == 64
    report = out["population"].head()
    assert report.masked and report.allocated_population == pytest.approx(1400)
    inside = grid.where("x0 >= 500500 and x0 < 501500 and y0 >= 4790500 and y0 < 4791500")
    assert inside.count() == 16 == report.cells_with_population
    assert grid.agg(F.sum("population")).head()[0] == pytest.approx(1400)
    for name in ("connectivity_scores", "combined_scores", "min_travel_times", "travel_times"):
        table = ws.table(name)
        assert table.columns == columns(name)
        assert table.groupBy(*KEYS[name]).count().where("count > 1").isEmpty()
        assert {r[0] for r in table.select("departure_time").distinct().collect()} == {"08:00", "08:30"}
    ends = ws.table("combined_scores").groupBy("departure_time").agg(
        F.min("combined_score_normalized").alias("lo"), F.max("combined_score_normalized").alias("hi")
    )
    assert {(r.lo, r.hi) for r in ends.collect()} == {(0.0, 100.0)}
    plan = ws.at("combined_scores", "08:30")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(departure_time" in plan

    # Reports over what the jobs wrote.
    assert [r.departure_time for r in cells.slots(ws).collect()] == ["08:00", "08:30"]
    ranking = areas.area_ranking(ws, "municipalities", "08:00").collect()
    assert {r.code for r in ranking} == {"1", "2"} and sum(r.cell_count for r in ranking) == 64
    assert sum(r.population for r in ranking) == pytest.approx(1400)
    detail = areas.area_detail(ws, "municipalities", "1", "08:00")
    assert detail["summary"].head().cell_count == 32
    assert detail["purposes"].count() == detail["coverage"].count() == 3
    with pytest.raises(LookupError):
        areas.area_detail(ws, "municipalities", "nowhere", "08:00")
    cov = region.coverage(ws, "08:00")
    assert cov.where("pop_15min > pop_30min or pop_30min > pop_45min or pop_45min > pop_60min").isEmpty()
    k = region.summary(ws, "08:00").head()
    assert (k.total_cells, k.municipality_count, k.comarca_count, k.transit_stop_count) == (64, 2, 0, 0)
    assert region.histogram(ws, "08:00").agg(F.sum("cell_count")).head()[0] == k.cells_with_scores

    # One slot again, with other parameters: the other slot stays as it is.
    before = sorted(map(tuple, ws.at("combined_scores", "08:30").collect()))
    was = sorted(map(tuple, ws.at("connectivity_scores", "08:00").collect()))
    jobs.score(ws, ScoreParams().with_changes(beta=0.5), slots=["08:00"])
    assert sorted(map(tuple, ws.at("combined_scores", "08:30").collect())) == before
    assert sorted(map(tuple, ws.at("connectivity_scores", "08:00").collect())) != was

    # A slot whose travel times are gone is empty afterwards, and no other slot changes.
    times = ws.table("travel_times")
    ws.frames["travel_times"] = times.where("departure_time <> '08:00'")
    jobs.score(ws, slots=["08:00"])
    assert ws.at("combined_scores", "08:00").isEmpty() and ws.at("connectivity_scores", "08:00").isEmpty()
    assert sorted(map(tuple, ws.at("combined_scores", "08:30").collect())) == before
    del ws.frames["travel_times"]

    # Restricting the cells gives the same raw scores for those cells.
    some = grid.where("id <= 10")
    part = jobs.score_frames(ws, slots=["08:30"], cells=some)["connectivity_scores"]
    full = ws.at("connectivity_scores", "08:30").where("cell_id <= 10")
    pick = lambda df: sorted((r.cell_id, r.purpose, round(r.score, 9)) for r in df.collect())
    assert pick(part) == pick(full)


def test_demo_run(ws):
    dest = small_region(ws)
    out = jobs.run_demo(ws, dest, slots=("08:00", "03:00"))
    assert out["combined_scores"].select("departure_time").distinct().count() == 2
    times = ws.table("travel_times")
    assert times.count() > 0 and times.where("travel_time_minutes < 1 or travel_time_minutes > 60").isEmpty()
    with pytest.raises(ValueError):
        jobs.build_grid(Workspace(ws.spark, ws.root, tenant="nobody"))


def test_areal_run_without_settlements(ws):
    small_region(ws)
    ws.publish("grid_cells", jobs.build_grid(ws))
    filled, report = jobs.spread_population(ws, use_mask=False)
    r = report.head()
    assert (r.masked, r.cells_with_population, r.total_cells) == (False, 64, 64)
    assert filled.where("x0 < 501000").agg(F.sum("population")).head()[0] == pytest.approx(800)
    assert r.loss_pct == pytest.approx(0, abs=1e-9)


def test_scoring_invariants(spark):
    params = ScoreParams().with_changes(impedance={"TRANSIT": {"hospital": 0.05}})
    rows = [("08:00", c, 1, "TRANSIT", float(t)) for c, t in enumerate([5, 10, 20, 30, 45, 60])]
    od = spark.createDataFrame(rows, "departure_time string, origin_cell_id bigint, destination_id bigint, mode string, travel_time_minutes double")
    dest = spark.createDataFrame([(1, 7, 1.0)], "id bigint, type_id int, weight double")
    types = spark.createDataFrame([(7, "hospital"), (8, "zoo")], "id int, code string")
    scores = op.minmax(op.gravity(op.reached(od, dest, types, params), params), "score", op.STRATUM, "n")
    got = [r.n for r in scores.orderBy("cell_id").collect()]
    assert got[0] == 100 and got[-1] == 0 and got == sorted(got, reverse=True)
    flat = op.minmax(scores.where("cell_id = 0"), "score", op.STRATUM, "flat").head().flat
    assert flat == 50
    # Two destinations give less than twice the score of one.
    two = spark.createDataFrame([(1, 7, 1.0), (2, 7, 1.0)], "id bigint, type_id int, weight double")
    both = od.unionByName(od.withColumn("destination_id", F.lit(2).cast("bigint")))
    single = op.gravity(op.reached(od, dest, types, params), params).where("cell_id = 0").head().score
    double = op.gravity(op.reached(both, two, types, params), params).where("cell_id = 0").head().score
    assert single < double < 2 * single
    # Ties go to the smallest id.
    assert {r.nearest_destination_id for r in op.nearest(op.reached(both, two, types, params), 120.0).collect()} == {1}
    # Unmapped types only: empty, no error.
    zoo = spark.createDataFrame([(1, 8, 1.0)], "id bigint, type_id int, weight double")
    none = op.gravity(op.reached(od, zoo, types, params), params)
    strata = op.rescaled_weights(op.extremes(none, "score", op.STRATUM), params)
    assert none.isEmpty() and op.combine(op.normalised(none, strata)).isEmpty()
    negative = od.withColumn("travel_time_minutes", F.lit(-1.0))
    with pytest.raises(Exception, match="negative travel time"):
        op.gravity(op.reached(negative, dest, types, params), params).collect()


def test_nearest_breaks_ties_exactly(spark):
    rows = [(1, 10.1, 7), (1, 10.1, 2**62), (1, 10.1 + 2e-15, 1), (2, 0.0, 2**63 - 1), (2, 0.0, 3), (3, 119.99999999999999, 5), (3, 120.0, 1)]
    df = spark.createDataFrame(rows, "cell_id bigint, travel_time_minutes double, destination_id bigint").select(
        "*", F.lit("08:00").alias("departure_time"), F.lit("TRANSIT").alias("mode"), F.lit("p").alias("purpose")
    )
    out = op.nearest(df, 120.0)
    got = {r.cell_id: (r.min_travel_time_minutes, r.nearest_destination_id) for r in out.collect()}
    assert got == {1: (10.1, 7), 2: (0.0, 3), 3: (119.99999999999999, 5)}
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate" in plan and "SortAggregate" not in plan


def test_weights_follow_the_purposes_present(spark):
    params = ScoreParams().with_changes(weights={"TRANSIT": {"hospital": 0.6, "hacienda": 0.2, "residencia": 0.2}, "BIKE": {"hospital": 0.0}})
    strata = spark.createDataFrame(
        [("08:00", "TRANSIT", "hospital"), ("08:00", "TRANSIT", "hacienda"), ("08:30", "TRANSIT", "residencia"), ("08:00", "BIKE", "hospital")],
        "departure_time string, mode string, purpose string",
    )
    got = {(r.departure_time, r.mode, r.purpose): r.w for r in op.rescaled_weights(strata, params).where("w is not null").collect()}
    assert got == pytest.approx({("08:00", "TRANSIT", "hospital"): 0.75, ("08:00", "TRANSIT", "hacienda"): 0.25, ("08:30", "TRANSIT", "residencia"): 1.0})


def test_missing_inputs_stop_early(ws):
    with pytest.raises(FileNotFoundError):
        jobs.score_frames(ws)
    frames = {n: ws.spark.createDataFrame([], SCHEMAS[n]) for n in ("travel_times", "destinations", "destination_types", "grid_cells")}
    empty = Workspace(ws.spark, ws.root, ws.tenant, frames)
    with pytest.raises(ValueError):
        jobs.score(empty)
    assert all(df.isEmpty() for df in jobs.score_frames(empty).values())


def test_parameters(tmp_path):
    raw = {
        "purpose_map": {"a": "x"},
        "impedance": {"TRANSIT": {"x": 0.1}},
        "diminishing": {"beta": 0.5},
        "max_travel_time": 60,
        "combined_weights": {"TRANSIT": {"x": 0.4}},
    }
    path = tmp_path / "p.json"
    path.write_text(json.dumps(raw))
    with pytest.warns(UserWarning, match="sum to 0.400"):
        assert load_params(path).max_minutes == 60
    assert load_params() == ScoreParams()
    for bad in ({"beta": 1.0}, {"beta": 0.0}, {"impedance": {"TRANSIT": {"x": 0.0}}}):
        with pytest.raises(ValueError):
            ScoreParams().with_changes(**bad)


def test_driver_side_checks():
    assert check_slot("23:30") == "23:30" and check_code("48-a_B") == "48-a_B"
    for bad in ("8:00", "24:00", "08:15", "08:00 ", "0800"):
        with pytest.raises(ValueError):
            check_slot(bad)
    for bad in ("", "a" * 21, "x;y", "a b"):
        with pytest.raises(ValueError):
            check_code(bad)
    with pytest.raises(ValueError):
        check_choice(300, (250, 500, 1000), "resolution")
    with pytest.raises(ValueError):
        check_limit(0, 10)


def test_report_arguments_are_checked(ws):
    with pytest.raises(ValueError):
        cells.cell_metric(ws, "08:10")
    with pytest.raises(ValueError):
        cells.cell_metric(ws, "08:00", metric="speed")
    with pytest.raises(ValueError):
        transit.frequency(ws, "7-9")
    with pytest.raises(ValueError):
        areas.geojson_edges(ws, '{"type": "Point", "coordinates": [1, 2]}')
    with pytest.raises(ValueError):
        areas.geojson_edges(ws, "no json")
    assert transit.frequency(ws).isEmpty() and transit.operators(ws).isEmpty()
    assert transit.transit_stops(ws).isEmpty() and transit.transit_routes(ws).isEmpty()


def test_publishing_switches_versions(ws):
    spark = ws.spark
    old = ws.publish("modes", spark.createDataFrame([(1, "A", "a")], SCHEMAS["modes"]))
    new = ws.publish("modes", spark.createDataFrame([(2, "B", "b")], SCHEMAS["modes"]))
    assert [r.code for r in old.collect()] == ["A"] and [r.code for r in new.collect()] == ["B"]
    assert [r.code for r in ws.table("modes").collect()] == ["B"]
    with pytest.raises(ValueError):
        Workspace(spark).publish("modes", new)


def test_features_and_endpoints(spark, ws, tmp_path):
    df = spark.createDataFrame(
        [(1, "a", None, '{"type":"Point","coordinates":[1,2]}'), (2, 'q"', 1.5, "{broken"), (3, "c", 2.0, None)],
        "id int, name string, score double, g string",
    )
    got = [json.loads(r.feature) for r in sinks.to_features(df, F.col("g"), ["id", "name", "score"]).collect()]
    assert got[0] == {"type": "Feature", "properties": {"id": 1, "name": "a", "score": None}, "geometry": {"type": "Point", "coordinates": [1, 2]}}
    assert got[1]["properties"]["name"] == 'q"' and got[1]["geometry"] is None and got[2]["geometry"] is None
    rings = spark.createDataFrame([([(0, 0, box(0, 0, 1, 1)), (0, 1, ring([(0.2, 0.2), (0.2, 0.4), (0.4, 0.2)])), (1, 0, box(5, 5, 6, 6))],)], f"rings {RINGS}")
    geometry = json.loads(rings.select(F.to_json(sinks.polygon_geometry(F.col("rings"))).alias("g")).head().g)
    assert geometry["type"] == "MultiPolygon"
    assert [[len(r) for r in part] for part in geometry["coordinates"]] == [[5, 4], [5]]
    sinks.write_features(sinks.to_features(df, F.col("g"), ["id"]), str(tmp_path / "f"))
    assert spark.read.text(str(tmp_path / "f")).count() == 3
    ws.publish("destinations", small_region(ws))
    ws.publish("grid_cells", jobs.build_grid(ws))
    paths = sinks.export_endpoints(ws, str(tmp_path / "net"))
    back = spark.read.option("header", True).csv(paths["origins"])
    assert back.columns == ["id", "lon", "lat"] and back.count() == 64
    assert all(len(r.lon.split(".")[1]) == 8 for r in back.collect())
    nucleos = listings.layer(ws, "nucleos", geometry=True)
    text = sinks.to_features(nucleos, sinks.polygon_geometry(F.col("rings")), ["id", "name"]).head().feature
    assert json.loads(text)["geometry"]["type"] == "MultiPolygon"


def test_hotspots_find_profiles_by_code_or_name(spark):
    from reachgrid.plans.social import hotspots

    ranking = spark.createDataFrame(
        [("A", "1", 9000.0, 10.0), ("B", "2", 8000.0, 20.0), ("C", "3", 100.0, 5.0), ("D", "4", 7000.0, 50.0), ("E", "5", 7000.0, 90.0), ("F", "6", 6000.0, None)],
        "name string, code string, population double, weighted_avg_score double",
    )
    people = spark.createDataFrame(
        [("1", "x", 1.0), ("9", "B", 2.0)], "muni_code string, name string, renta_index double"
    ).withColumns({"vehicles_per_inhab": F.lit(0.5), "pct_65_plus": F.lit(20.0)})
    rows = hotspots(ranking, people).collect()
    # The upper median of 0, 5, 10, 20, 50, 90 is 20; an unscored area counts as 0.
    assert [(r.code, r.gap, r.renta_index) for r in rows] == [("1", 10.0, 1.0), ("6", 20.0, None)]
    wide = hotspots(ranking.withColumn("weighted_avg_score", F.col("weighted_avg_score") + F.when(F.col("code") == "4", -35.0).otherwise(0.0)), people)
    assert {r.code for r in wide.collect()} == {"1", "6"}
    low = hotspots(ranking.where("code <> '3'"), people, min_pop=1000, k=1).collect()
    assert [(r.code, r.burden) for r in low] == [("1", 810000.0)]
    named = hotspots(ranking.where("code in ('2', '4', '5')").unionByName(ranking.where("code = '1'")), people).collect()
    assert [(r.code, r.renta_index) for r in named] == [("1", 1.0), ("2", 2.0)]


def test_a_run_leaves_nothing_behind(spark, tmp_path):
    import glob

    from reachgrid.session import scratch, shared_dir, written

    kept = written(spark.range(5), "kept")
    with scratch(spark):
        assert written(spark.range(3), "passing").count() == 3
        assert glob.glob(f"{shared_dir(spark)}/reachgrid/*/run-*/passing-*")
    assert not glob.glob(f"{shared_dir(spark)}/reachgrid/*/run-*") and kept.count() == 5


def test_a_killed_run_goes_on(ws, tmp_path, monkeypatch):
    """Killed after the import it resumes at scoring; a changed layer or file runs again what hangs on it."""
    ws.publish("destinations", small_region(ws))
    path = matrices(tmp_path / "od", range(1, 65), ["0800", "0830"])
    done = []

    def watched(name):
        real = getattr(jobs, name)

        def call(*args, **kwargs):
            done.append(name)
            return real(*args, **kwargs)

        monkeypatch.setattr(jobs, name, call)
        return real

    for name in ("build_grid", "spread_population", "import_travel_times"):
        watched(name)
    score = jobs.score

    def killed(*args, **kwargs):
        raise KeyboardInterrupt

    monkeypatch.setattr(jobs, "score", killed)
    with pytest.raises(KeyboardInterrupt):
        jobs.run(ws, path)
    assert done == ["build_grid", "spread_population", "import_travel_times"] and not ws.has("combined_scores")
    done.clear()
    monkeypatch.setattr(jobs, "score", score)
    out = jobs.run(ws, path)
    assert done == [] and out["skipped"] == ["grid", "population", "import"]
    assert out["population"].head().allocated_population == pytest.approx(1400)
    assert {r.departure_time: r.rows_kept > 0 for r in out["import"].collect()} == {"08:00": True, "08:30": True}
    assert out["combined_scores"].count() == ws.table("combined_scores").count() > 0
    # A finished run is not gone on with.
    monkeypatch.setattr(jobs, "score", killed)
    with pytest.raises(KeyboardInterrupt):
        jobs.run(ws, path)
    assert done == ["build_grid", "spread_population", "import_travel_times"]
    done.clear()
    # New population: the grid stays, all behind it runs again.
    ws.publish("population_sources", ws.table("population_sources").withColumn("population", F.col("population") * 2))
    monkeypatch.setattr(jobs, "score", score)
    out = jobs.run(ws, path)
    assert done == ["spread_population", "import_travel_times"] and out["skipped"] == ["grid"]
    assert out["population"].head().allocated_population == pytest.approx(2800)
    with pytest.raises(ValueError):
        jobs.RunRecord(Workspace(ws.spark), "full")
