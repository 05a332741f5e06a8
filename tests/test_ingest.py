import json
import struct
import random
import zipfile

import pytest
from pyspark.sql import functions as F

from reachgrid import Workspace
from reachgrid.operators import overlay
from reachgrid.operators.contain import polygon_edges
from reachgrid.sources import census, gtfs, indicators, layers, od, pois
from reachgrid.sources.seed import seed_reference
from reachgrid.sources.tables import read_table
from reachgrid.sources.wkb import decode_lines, decode_points, decode_rings

CENSUS = """\
Population by section
x
x
x
x
code;name;district;section;total
"001";"Alpha";"";"000";"3.100"
"";"";"01";"000";"3.100"
"";"";"01";"001";"1.544"
"";"";"";"002";"1.556"
"002";"Beta";"";"000";"10"
"";"";"";"003";"10"
"";"";"02";"001";"n.d."

"";"";"02";"001";"7"
"";"";"02";"001";"8"
"""


def write(path, text, encoding="utf-8"):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text, encoding=encoding)
    return str(path)


def test_census_carries_codes_forward(ws, tmp_path):
    got = {r.source_code: r.population for r in census.read_census(ws, write(tmp_path / "c.csv", CENSUS)).collect()}
    # The district of the municipality before stays until a new one is given;
    # of a repeated key the last line counts.
    assert got == {"4800101001": 1544, "4800101002": 1556, "4800201003": 10, "4800202001": 8}


def test_census_is_the_same_when_read_in_many_splits(ws, tmp_path):
    lines = CENSUS.splitlines()[:6]
    want = {}
    for m in range(300):
        lines.append(f'"{m:03d}";"M{m}";"";"000";"9"')
        for s in range(1, 6):
            lines.append(f'"";"";"{"01" if s == 1 else ""}";"{s:03d}";"{m * 10 + s}"')
            want[f"48{m:03d}01{s:03d}"] = m * 10 + s
    path = write(tmp_path / "big.csv", "\n".join(lines))
    before = ws.spark.conf.get("spark.sql.files.maxPartitionBytes")
    ws.spark.conf.set("spark.sql.files.maxPartitionBytes", "2048")
    ws.spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        df = census.read_census(ws, path)
        got = {r.source_code: r.population for r in df.collect()}
    finally:
        ws.spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        ws.spark.conf.unset("spark.sql.files.openCostInBytes")
    assert got == want


def test_ages_per_municipality(ws, tmp_path):
    rows = CENSUS.splitlines()[:6] + [
        '"001";"A";"01";"000";"300";"";"";"";"20,0";"60,0";"20,0"',
        '"";"";"";"001";"100";"";"";"";"20,0";"60,0";"20,0"',
        '"";"";"";"002";"200";"";"";"";"10,0";"70,0";"x"',
    ]
    path = write(tmp_path / "a.csv", "\n".join(rows))
    r = census.import_demographics(ws, path, 2025).head()
    # bands: 0-19 = 40, 20-64 = 200, 65+ = 20
    assert (r.muni_code, r.year, r.pop_total, r.pop_0_17, r.pop_18_25, r.pop_26_64, r.pop_65_plus) == (
        "48001", 2025, 300, 36, 30, 174, 20)
    assert (r.pct_0_17, r.pct_18_25, r.pct_65_plus) == (12.0, 10.0, 6.67)


def test_indicators(ws, tmp_path):
    text = "﻿Indicador;Renta;;\n\nCodigo municipio;Municipio;2023;2022;nota\n" \
        '48001;"A";"101,5";..;\n48;Prov;1;2;\n48002;B;-;98,25;\n20001;C;5;6;\n48001;"A";;"99,0";\n48003;D;..;-;\n'
    one = indicators.read_indicator(ws, write(tmp_path / "i.csv", text))
    assert {(r.muni_code, r.year): r.value for r in one.collect()} == {("48001", 2022): 99.0, ("48002", 2022): 98.25}
    other = "Codigo;Municipio;2021;2022\n48002;B;7;8,5\n"
    merged = indicators.import_income(
        ws, {"renta_index": str(tmp_path / "i.csv"), "renta_personal_media": write(tmp_path / "p.csv", other)}
    )
    rows = {(r.muni_code, r.year): (r.renta_personal_media, r.renta_disponible_media, r.renta_index) for r in merged.collect()}
    assert rows == {
        ("48001", 2022): (None, None, 99.0),
        ("48002", 2021): (7.0, None, None),
        ("48002", 2022): (8.5, None, 98.25),
    }
    cars = indicators.import_car_ownership(ws, str(tmp_path / "p.csv"))
    assert cars.columns == ["muni_code", "year", "vehicles_per_inhab"] and cars.count() == 2


def test_pois_two_layouts(ws, tmp_path):
    write(
        tmp_path / "pois" / "all.csv",
        "﻿ POI ,Nombre,Longitud,Latitud,weight\nHospital Público,\"Basurto, main\",-2.95,43.26,2\n"
        "hospital público,No weight,-2.9,43.2,\n,No type,-2.9,43.2,1\nEscuela,,-2.9,43.2,1\nEscuela,Far,-5,43.2,1\n"
        "Escuela,Bad,x,43.2,1\nEscuela,Zero,-2.9,43.2,0\nEscuela,Words,-2.9,43.2,many\nEscuela,Edge,-3.5,43.5,0.5\n",
    )
    write(tmp_path / "pois" / "town_hall.csv", "name,lon,lat\nOne,-2.8,43.1\nTwo,-2.8,43.1\n")
    write(tmp_path / "pois" / "odd.csv", "a,b\n1,2\n")
    ws.frames["destination_types"] = seed_reference(ws)["destination_types"]
    table, types, rejected = pois.import_pois(ws, str(tmp_path / "pois"))
    rows = sorted((r.id, r.name, r.weight) for r in table.collect())
    assert rows == [(1, "Basurto, main", 2.0), (2, "No weight", 1.0), (3, "Edge", 0.5), (4, "One", 1.0), (5, "Two", 1.0)]
    new = {(r.code, r.label) for r in types.where("id > 10").collect()}
    assert new == {("hospital_p_blico", "Hospital Público"), ("escuela", "Escuela"), ("town_hall", "Town Hall")}
    assert sorted(r.reason for r in rejected.collect()) == sorted(
        ["missing_type", "missing_name", "outside_box", "invalid_coordinates", "invalid_weight", "invalid_weight"]
    )
    # Again, over what is there: appended or replaced.
    ws.frames.update(destinations=table, destination_types=types)
    twice, same_types, _ = pois.import_pois(ws, str(tmp_path / "pois"))
    assert sorted(r.id for r in twice.collect()) == list(range(1, 11))
    assert same_types.count() == types.count()
    write(tmp_path / "new" / "town_hall.csv", "name,lon,lat\nThree,-2.8,43.1\n")
    cleared, _, _ = pois.import_pois(ws, str(tmp_path / "new"), clear_existing=True)
    assert sorted((r.id, r.name) for r in cleared.collect()) == [(1, "Basurto, main"), (2, "No weight"), (3, "Edge"), (4, "Three")]


def feed(path, members):
    path.parent.mkdir(parents=True, exist_ok=True)
    with zipfile.ZipFile(path, "w") as z:
        for name, text in members.items():
            z.writestr(name, text)


STOPS = "stop_id,stop_name,stop_lat,stop_lon\nA,Alpha,43.1,-2.9\nB,Beta,43.2,-2.8\nC,Gamma,oops,-2.8\n"
TRIPS = "route_id,service_id,trip_id,shape_id\nr1,wk,t1,s1\nr1,wk,t2,s2\nr1,we,t3,s3\nr2,wk,t4,s4\nr1,wk,t5,s4\n"
TIMES = (
    "trip_id,departure_time,stop_id,stop_sequence\nt1,07:10:00,A,1\nt1,07:20:00,B,2\nt2,08:59:59,A,1\nt2,09:00:00,B,2\n"
    "t3,08:00:00,A,1\nt4,25:10:00,A,1\nt1,07:40:00,A,3\nt4,bad,B,1\nt1,07:00:00,C,1\n"
)
SHAPES = (
    "shape_id,shape_pt_lat,shape_pt_lon,shape_pt_sequence\ns1,43.1,-2.9,2\ns1,43.0,-3.0,1\ns2,43.0,-3.0,1\ns2,43.05,-2.95,2\n"
    "s2,43.1,-2.9,3\ns3,43.5,-2.5,1\ns4,43.3,-2.7,1\ns4,43.4,-2.6,10\ns4,43.35,-2.65,9\nlone,43.0,-2.0,1\nlone,43.1,-2.1,2\n"
)


def make_feeds(folder):
    common = {"stops.txt": STOPS, "trips.txt": TRIPS, "stop_times.txt": TIMES}
    feed(
        folder / "Alpha.gtfs.zip",
        {
            **common,
            "calendar.txt": "﻿service_id,monday\nwk,1\nwe,0\n",
            "shapes.txt": SHAPES,
            "routes.txt": "route_id,route_short_name,route_long_name,route_type,route_color\nr1,1,,3,ff0000\nr2,2,Long,1,\n",
        },
    )
    feed(folder / "Dates.gtfs.zip", {**common, "calendar_dates.txt": "service_id,exception_type\nwe,1\nwk,2\n"})
    feed(folder / "Plain.gtfs.zip", common)
    (folder / "Broken.gtfs.zip").write_bytes(b"no zip")
    (folder / "Old.gtfs.zip.disabled").write_bytes(b"x")
    return str(folder)


def test_gtfs_frequency(spark, tmp_path):
    path = make_feeds(tmp_path / "gtfs")
    rows = {(r.operator, r.stop_id, r.time_window): (r.departures, r.departures_per_hour) for r in gtfs.import_frequency(spark, path).collect()}
    assert len(rows) == 6 * 5 and not any(k[1] == "C" for k in rows)
    assert rows["Alpha", "A", "07:00-09:00"] == (2, 1.0)
    assert rows["Alpha", "B", "07:00-09:00"] == (1, 0.5)
    assert rows["Alpha", "B", "09:00-12:00"] == (1, 0.33)
    assert rows["Alpha", "A", "06:00-22:00"] == (2, 0.12)
    assert rows["Alpha", "A", "18:00-21:00"] == (0, 0.0)
    assert rows["Dates", "A", "07:00-09:00"] == (1, 0.5)
    assert rows["Plain", "A", "07:00-09:00"] == (3, 1.5)
    assert ("Dates", "B", "07:00-09:00") not in rows


def test_gtfs_routes_and_stops(spark, tmp_path):
    path = make_feeds(tmp_path / "gtfs")
    stops = gtfs.import_stops(spark, path)
    assert sorted((r.operator, r.stop_id) for r in stops.collect()) == [(o, s) for o in ("Alpha", "Dates", "Plain") for s in "AB"]
    assert sorted(r.id for r in stops.collect()) == list(range(1, 7))
    routes = {r.route_id: r for r in gtfs.import_routes(spark, path).collect()}
    assert set(routes) == {"r1", "lone"}
    # s2 has the end points of s1; s4 belongs to its last trip's route.
    assert [[(p.x, p.y) for p in line] for line in routes["r1"].lines] == [
        [(-3.0, 43.0), (-2.9, 43.1)],
        [(-2.7, 43.3), (-2.65, 43.35), (-2.6, 43.4)],
    ]
    assert (routes["r1"].route_name, routes["r1"].route_type, routes["r1"].route_color) == ("1", 3, "ff0000")
    assert (routes["lone"].route_name, routes["lone"].route_type) == ("", 3)
    report = gtfs.import_report(stops, gtfs.import_routes(spark, path), gtfs.feeds(spark, path))
    assert {r.operator: (r.routes, r.stops, r.fault is None) for r in report.collect()} == {
        "Alpha": (2, 2, True), "Dates": (0, 2, True), "Plain": (0, 2, True), "Broken": (0, 0, False)}
    with pytest.raises(FileNotFoundError):
        gtfs.read_gtfs(spark, str(tmp_path), "stops.txt", ["stop_id"])


def test_damaged_feeds_give_no_rows(spark, tmp_path):
    """Twenty copies with a few bytes changed inside their stops: none keeps a part of its rows."""
    rng = random.Random(2)
    folder = tmp_path / "gtfs"
    folder.mkdir()
    text = "stop_id,stop_name,stop_lat,stop_lon\n" + "".join(f"s{i},name {i * 7919 % 1000},43.{i % 97},-2.{i % 89}\n" for i in range(20_000))
    with zipfile.ZipFile(folder / "Good.gtfs.zip", "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("stops.txt", text)
    whole = (folder / "Good.gtfs.zip").read_bytes()
    for i in range(20):
        hurt = bytearray(whole)
        for _ in range(8):
            hurt[rng.randrange(200, len(hurt) - 400)] ^= 0x55
        (folder / f"Bad{i}.gtfs.zip").write_bytes(bytes(hurt))
    unpacked = gtfs.unpack(spark, str(folder))
    counts = {r["operator"]: r["count"] for r in gtfs.stops(unpacked).groupBy("operator").count().collect()}
    assert counts == {"Good": 20_000}
    faults = {r.operator: r.fault for r in gtfs.feeds(spark, str(folder), unpacked).collect()}
    assert len(faults) == 21 and all((f is None) == (o == "Good") for o, f in faults.items())


@pytest.mark.parametrize(
    "name, mode, slot",
    [
        ("ttm_transit_0830.parquet", "TRANSIT", "08:30"),
        ("TTM_Transit_1900.parquet", "TRANSIT", "19:00"),
        ("ttm_transit.parquet", "TRANSIT", "08:00"),
        ("ttm_walk.parquet", None, "08:00"),
        ("other_0830.parquet", None, "08:00"),
        ("ttm_transit_830.parquet", None, "08:00"),
    ],
)
def test_matrix_file_names(spark, name, mode, slot):
    r = spark.createDataFrame([(name,)], "f string").select(od.mode_of(F.col("f")).alias("m"), od.slot_of(F.col("f")).alias("s")).head()
    assert r.m == mode and (mode is None or r.s == slot)


def test_matrix_value_column():
    assert od.value_column(["from_id", "travel_time_p75", "travel_time_p50", "travel_time"]) == "travel_time_p50"
    assert od.value_column(["travel_time"]) == "travel_time"
    assert od.value_column(["minutes"]) is None


def matrix(folder, name, rows, types=("from_id", "to_id", "travel_time_p50")):
    import pandas as pd

    folder.mkdir(parents=True, exist_ok=True)
    pd.DataFrame(rows, columns=types).to_parquet(folder / name)


def test_od_import(ws, tmp_path):
    folder = tmp_path / "od"
    matrix(folder, "ttm_transit_0830.parquet", [("1", "5", -5), ("1", "6", 0), ("1", "7", 90), ("2", "5", 120), ("2", "6", 121), ("x", "6", 3)])
    matrix(folder, "ttm_transit.parquet", [(1, 5, 10.5, 99.0)], ("from_id", "to_id", "travel_time_p50", "travel_time_p75"))
    matrix(folder, "ttm_walk_0830.parquet", [("1", "5", 5)])
    matrix(folder, "ttm_transit_0900.parquet", [("1", "5", 5)], ("from_id", "to_id", "minutes"))
    table, report = od.import_od(ws, str(folder))
    got = sorted((r.departure_time, r.origin_cell_id, r.destination_id, r.travel_time_minutes) for r in table.collect())
    assert got == [("08:00", 1, 5, 10.5), ("08:30", 1, 6, 0.0), ("08:30", 1, 7, 90.0), ("08:30", 2, 5, 120.0)]
    assert {(x.file, x.reason) for x in od.skipped_files(ws, str(folder)).collect()} == {("ttm_walk_0830.parquet", "mode"), ("ttm_transit_0900.parquet", "columns")}
    r = {x.departure_time: x for x in report.collect()}
    assert (r["08:30"].rows_kept, r["08:30"].rows_not_numeric, r["08:30"].rows_out_of_range) == (3, 1, 2)
    with pytest.raises(FileNotFoundError):
        od.import_od(ws, str(tmp_path / "none"))


def test_matrix_numbers_keep_their_digits(spark):
    df = spark.createDataFrame([("9007199254740993", "7.0", "1e1"), ("1e30", "7", "nan?")], "a string, b string, m string")
    got = [tuple(r) for r in od.typed(df, "a", "b", "m").collect()]
    assert got == [(9007199254740993, 7, 10.0), (None, 7, None)]


def test_malformed_blobs_are_null(spark):
    good = struct.pack("<BIII8d", 1, 3, 1, 4, 0, 0, 1, 0, 1, 1, 0, 0)
    line = struct.pack("<BII4d", 1, 2, 2, 0, 0, 1, 1)
    point = struct.pack("<BI2d", 1, 1, 3, 4)
    rows = [(i, bytearray(b) if b is not None else None) for i, b in enumerate([good, good[:-9], b"", b"\x01", line, line[:-1], point, None])]
    df = spark.createDataFrame(rows, "i int, b binary").select("i", decode_rings("b").alias("r"), decode_lines("b").alias("l"), decode_points("b").alias("p"))
    got = {r.i: r for r in df.where("i in (0, 1, 2, 3, 7)").select("i", "r").collect()}
    assert len(got[0].r) == 1 and got[7].r == [] and all(got[i].r is None for i in (1, 2, 3))
    lines = {r.i: r.l for r in df.where("i in (4, 5)").select("i", "l").collect()}
    assert len(lines[4]) == 1 and lines[5] is None
    points = {r.i: r.p for r in df.where("i in (3, 6)").select("i", "p").collect()}
    assert (points[6].x, points[6].y, points[3].x) == (3, 4, None)


def test_nan_is_not_a_number(spark):
    df = spark.createDataFrame([(1, 2, float("nan")), (1, 2, 5.0), (1, 2, 500.0), (None, 2, 5.0)], "origin_cell_id bigint, destination_id bigint, travel_time_minutes double")
    assert [r.fate for r in od.judged(df).collect()] == ["not_numeric", "kept", "out_of_range", "not_numeric"]


def test_origin_remap_is_skipped_when_ids_are_known(spark):
    cells = spark.createDataFrame([(1, "E0_N0"), (2, "E250_N0")], "id bigint, cell_code string")
    rows = spark.createDataFrame([(1, 9), (2, 9)], "origin_cell_id bigint, destination_id bigint")
    same = spark.createDataFrame([(1, 10.0, 10.0), (2, 260.0, 10.0)], "id bigint, x double, y double")
    assert od.remap_origins(rows, same, cells) is rows
    older = spark.createDataFrame([(1, 260.0, 10.0), (7, 10.0, 10.0), (8, 999.0, 10.0)], "id bigint, x double, y double")
    assert [r.origin_cell_id for r in od.remap_origins(rows, older, cells).collect()] == [2]


def feature(props, geometry):
    return {"type": "Feature", "properties": props, "geometry": geometry}


SQUARE = [[[-3, 43], [-2.9, 43], [-2.9, 43.1], [-3, 43.1], [-3, 43]]]
HOLED = [SQUARE[0], [[-2.98, 43.02], [-2.98, 43.04], [-2.96, 43.04], [-2.98, 43.02]]]


def collection(path, features):
    return write(path, json.dumps({"type": "FeatureCollection", "features": features}))


def test_area_layers(ws, tmp_path):
    path = collection(
        tmp_path / "m.json",
        [
            feature({"MUN_PROV": "48", "EUSTAT": "48001", "NOMBRE_CAS": "A"}, {"type": "Polygon", "coordinates": HOLED}),
            feature({"MUN_PROV": "48", "OBJECTID": 7, "NOMBRE_TOP": "B"}, {"type": "MultiPolygon", "coordinates": [SQUARE, SQUARE]}),
            feature({"MUN_PROV": "48", "EUSTAT": "48003"}, {"type": "GeometryCollection", "geometries": [
                {"type": "Point", "coordinates": [1, 2]}, {"type": "Polygon", "coordinates": SQUARE},
                {"type": "MultiPolygon", "coordinates": [SQUARE]}]}),
            feature({"MUN_PROV": "48", "EUSTAT": "48004"}, None),
            feature({"MUN_PROV": "20", "EUSTAT": "20001"}, {"type": "Polygon", "coordinates": SQUARE}),
        ],
    )
    rows = {r.muni_code: r for r in layers.import_areas(ws, path, "municipalities").collect()}
    assert {k: r.name for k, r in rows.items()} == {"48001": "A", "7": "B", "48003": "Municipality 48003"}
    shape = lambda r: [(x.part, x.ring, len(x.pts)) for x in r.rings]
    assert shape(rows["48001"]) == [(0, 0, 4), (0, 1, 3)]
    assert shape(rows["7"]) == shape(rows["48003"]) == [(0, 0, 4), (1, 0, 4)]
    assert rows["48001"].rings_m[0].pts[0].x == pytest.approx(500000)
    assert sorted(r.id for r in rows.values()) == [1, 2, 3]
    stream = write(tmp_path / "m.jsonl", "\n".join(json.dumps(feature({"COM_PROV": "48", "COM_COM": str(i)}, {"type": "Polygon", "coordinates": SQUARE})) for i in range(3)))
    got = layers.import_areas(ws, stream, "comarcas", lines=True).collect()
    assert [(r.comarca_code, r.name) for r in sorted(got)] == [(str(i), f"Comarca {i}") for i in range(3)]


def test_boundary_choice(ws, tmp_path):
    poly = {"type": "Polygon", "coordinates": SQUARE}
    exact = collection(tmp_path / "a.json", [feature({"CODIGO": "20"}, poly), feature({"CODIGO": "48"}, {"type": "Polygon", "coordinates": HOLED})])
    assert len(layers.import_boundary(ws, exact, "Home").head().rings) == 2
    loose = collection(tmp_path / "b.json", [feature({"x": "away"}, poly), feature({"x": "my HOME land"}, poly)])
    r = layers.import_boundary(ws, loose, "Home").head()
    assert (r.id, r.name, r.boundary_type) == (1, "Home", "region")
    with pytest.raises(ValueError):
        layers.import_boundary(ws, loose, "Elsewhere")


def test_settlements_and_sections(ws, tmp_path):
    poly = {"type": "Polygon", "coordinates": SQUARE}
    base = {"NUC_PROV": "48", "NUC_CL": "c1", "NUC_DS_O": "N", "NUC_MUNI": "001", "NUC_MUNI_D": "A"}
    path = collection(
        tmp_path / "n.json",
        [feature({**base, "NUC_NUCD": " 01 "}, poly), feature({**base, "NUC_NUCD": "99"}, None), feature({"NUC_PROV": "01"}, poly)],
    )
    table, report = layers.import_settlements(ws, path)
    assert sorted((r.nucleo_num, len(r.rings)) for r in table.collect()) == [("01", 1), ("99", 0)]
    assert tuple(report.head()) == (2, 1, 1)
    sections = collection(
        tmp_path / "s.json",
        [
            feature({"SEC_PROV": "48", "SEC_MUNI": "001", "SEC_DIST": "01", "SEC_SECC": s, "SEC_MUNI_D": "Alpha"}, poly)
            for s in ("001", "001", "009")
        ],
    )
    rows = census.read_census(ws, write(tmp_path / "c.csv", CENSUS))
    sources, unmatched, report = census.attach_population(ws, layers.import_sections(ws, sections), rows)
    assert [(r.source_code, r.population, r.name, r.id) for r in sources.collect()] == [("4800101001", 1544.0, "Alpha", 1)]
    assert {r.source_code for r in unmatched.collect()} == {"4800101002", "4800201003", "4800202001"}
    r = report.head()
    assert (r.csv_sections, r.matched, r.unmatched, r.matched_population) == (4, 1, 3, 1544)


def wkb_ring(points, order="<"):
    return struct.pack(order + "I", len(points)) + b"".join(struct.pack(order + "dd", *p) for p in points)


def test_wkb(spark):
    ring = [(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (0.0, 0.0)]
    polygon = struct.pack("<BII", 1, 3, 1) + wkb_ring(ring)
    big = struct.pack(">BII", 0, 3, 1) + wkb_ring(ring, ">")
    multi = struct.pack("<BII", 1, 6, 2) + polygon + big
    point = struct.pack("<BIdd", 1, 1, -2.9, 43.2)
    with_srid = struct.pack("<BIIdd", 1, 1 | 0x20000000, 4326, -2.9, 43.2)
    mixed = struct.pack("<BII", 1, 7, 2) + point + polygon
    line = struct.pack("<BI", 1, 2) + wkb_ring(ring[:2])
    lines = struct.pack("<BII", 1, 5, 2) + line + line
    df = spark.createDataFrame([(1, bytearray(polygon)), (2, bytearray(big)), (3, bytearray(multi)), (4, bytearray(mixed)), (5, None)], "id int, g binary")
    got = {r.id: [(x.part, x.ring, len(x.pts)) for x in r.rings] for r in df.select("id", decode_rings("g").alias("rings")).collect()}
    assert got == {1: [(0, 0, 3)], 2: [(0, 0, 3)], 3: [(0, 0, 3), (1, 0, 3)], 4: [(0, 0, 3)], 5: []}
    pts = spark.createDataFrame([(bytearray(point),), (bytearray(with_srid),), (None,)], "g binary")
    assert [tuple(r.p) for r in pts.select(decode_points("g").alias("p")).collect()][:2] == [(-2.9, 43.2)] * 2
    ls = spark.createDataFrame([(bytearray(lines),)], "g binary").select(decode_lines("g").alias("l")).head().l
    assert [[(p.x, p.y) for p in one] for one in ls] == [ring[:2]] * 2


def test_foreign_tables_are_brought_into_shape(spark, tmp_path):
    point = struct.pack("<BIdd", 1, 1, -2.9, 43.2)
    root = str(tmp_path)
    rows = [("op", f"s{i}", "n", bytearray(point)) for i in range(5)]
    spark.createDataFrame(rows, "operator string, stop_id string, stop_name string, geometry binary").coalesce(1).write.parquet(f"{root}/gtfs_stops.parquet")
    got = read_table(spark, root, "gtfs_stops").collect()
    assert sorted((r.id, r.stop_id) for r in got) == [(i + 1, f"s{i}") for i in range(5)]
    assert (got[0].lon, got[0].lat) == (-2.9, 43.2)
    spark.createDataFrame([(1, "t1", "E500000_N4790000", 3.0), (2, "t2", "E500250_N4790000", 4.0)], "id bigint, tenant_id string, cell_code string, population double").write.parquet(f"{root}/grid_cells.parquet")
    cells = Workspace(spark, root, "t1").table("grid_cells").collect()
    assert [(c.id, c.x0, c.y0, c.size, c.muni_code) for c in cells] == [(1, 500000.0, 4790000.0, 250.0, None)]
    assert cells[0].lon == pytest.approx(-2.99846, abs=1e-4)


def test_missing_tables(ws):
    assert ws.table("gtfs_routes", required=False).count() == 0
    assert not ws.has("gtfs_routes")
    with pytest.raises(FileNotFoundError):
        ws.table("grid_cells")


def test_imported_rings_feed_the_overlay(ws, tmp_path):
    poly = {"type": "Polygon", "coordinates": HOLED}
    path = collection(tmp_path / "m.json", [feature({"MUN_PROV": "48", "EUSTAT": "48001"}, poly)])
    table = layers.import_areas(ws, path, "municipalities")
    area = overlay.polygon_area(polygon_edges(table, "muni_code", "rings_m"), "muni_code").head().area
    assert area == pytest.approx(8140 * 11109 - 0.5 * 1630 * 2222, rel=0.01)


def test_footers_are_read_by_tasks(ws, tmp_path):
    """Two layouts, bad names and a damaged file; one scan for each slot and layout."""
    folder = tmp_path / "od"
    for i in range(6):
        matrix(folder, f"ttm_transit_{7 + i:02d}00.parquet", [(str(i), "5", 10 + i), ("x", "5", 1), ("1", "5", 500)])
    matrix(folder, "ttm_TRANSIT_0700.parquet", [(1, 5, 10.5, 99.0)], ("from_id", "to_id", "travel_time_p50", "travel_time_p25"))
    matrix(folder, "ttm_transit_7.parquet", [("1", "5", 5)])
    (folder / "ttm_transit_2300.parquet").write_bytes(b"PAR1 no parquet")
    (folder / "other.parquet").write_bytes(b"x")
    parts = od.branches(ws, str(folder))
    assert [(m, s, len(df.inputFiles())) for m, s, df in parts] == [("TRANSIT", "07:00", 1), ("TRANSIT", "07:00", 1)] + [("TRANSIT", f"{8 + i:02d}:00", 1) for i in range(5)]
    assert {(x.file, x.reason) for x in od.skipped_files(ws, str(folder)).collect()} == {("ttm_transit_7.parquet", "name"), ("ttm_transit_2300.parquet", "unreadable")}
    plan = od.read_matrices(ws, str(folder)).where("departure_time = '08:00'")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation ") == 1
    rows = sorted((r.departure_time, r.origin_cell_id, r.travel_time_minutes) for r in od.import_od(ws, str(folder))[0].collect())
    # The least percentile of a layout counts.
    assert rows == [("07:00", 0, 10.0), ("07:00", 1, 99.0)] + [(f"{8 + i:02d}:00", 1 + i, 11.0 + i) for i in range(5)]


def test_the_import_report_is_counted_on_the_way(ws, tmp_path, monkeypatch):
    from reachgrid.plans import jobs

    folder = tmp_path / "od"
    for i in range(3):
        matrix(folder, f"ttm_transit_{7 + i:02d}00.parquet", [(str(k), "5", k * 3) for k in range(100)] + [("x", "y", 1), ("1", "5", -1)])
    want = {tuple(r) for r in od.import_od(ws, str(folder))[1].collect()}
    passes = []
    monkeypatch.setattr(jobs, "import_od", lambda *a, **k: passes.append(a) or od.import_od(*a, **k))
    table, report = jobs.import_travel_times(ws, str(folder))
    assert {tuple(r) for r in report.collect()} == want and passes == [] and table.count() == 123
    # Counts that do not agree with the table are taken again.
    monkeypatch.setattr(od.Watched, "report", lambda self: ws.spark.createDataFrame([("TRANSIT", "07:00", 999, 0, 0, 0)], od.REPORT))
    _, report = jobs.import_travel_times(ws, str(folder))
    assert {tuple(r) for r in report.collect()} == want and len(passes) == 1


def test_feed_members_are_read_apart(spark, tmp_path):
    from reachgrid.sources import feed_source

    folder = tmp_path / "gtfs"
    folder.mkdir()
    lines = "".join(f"s{i},\"name, {i}\nof two lines\",43.{i}\n" for i in range(3000))
    with zipfile.ZipFile(folder / "A.gtfs.zip", "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("stops.txt", "﻿stop_id,stop_name,lat\n" + lines.replace("s7,", "s7,x\n\ns7b,", 1) + 'last,"a ""b""",1,2,3\n')
        z.writestr("trips.txt", "trip_id\n")
        z.writestr("empty.txt", "")
        z.writestr("uneven.txt", "a,b,a\n" + "".join(f"{i},x\n" for i in range(20_000)))
    (folder / "B.gtfs.zip").write_bytes(b"no zip")
    wanted = {"stops.txt": ["lat", "stop_id", "none"], "trips.txt": ["trip_id"], "empty.txt": ["x"], "missing.txt": ["x"]}
    df = feed_source.read_feeds(spark, str(folder), wanted, block=4096)
    assert df.rdd.getNumPartitions() == 8
    rows = {(r.operator, r.member, r.row_no): r.cells for r in df.collect()}
    own = [rows["A", "stops.txt", i] for i in range(1, 3003)]
    want = [[f"43.{i}", f"s{i}", None] for i in range(3000)]
    want[7:8] = [[None, "s7", None], ["43.7", "s7b", None]]
    assert own == want + [["1", "last", None]]
    assert {k: v[1] is None for k, v in rows.items() if k[1] == "status" and k[0] == "A"} == {("A", "status", 0): True}
    assert [r.cells[1] is None for r in df.where("operator = 'B' and member = 'status'").collect()] == [False] * 4
    # A member that is asked for alone is read alone, in batches of a block.
    reader = feed_source.FeedReader({"path": str(folder), "members": json.dumps(wanted), "block": "4096"})
    from pyspark.sql.datasource import EqualTo

    assert len(list(reader.pushFilters([EqualTo(("member",), "trips.txt")]))) == 1
    assert [(p.operator, p.member) for p in reader.partitions()] == [("A", "trips.txt"), ("B", "trips.txt")]
    reader = feed_source.FeedReader({"path": str(folder), "members": json.dumps(wanted), "block": "4096"})
    batches = [b.num_rows for p in reader.partitions() if (p.operator, p.member) == ("A", "stops.txt") for b in reader.read(p)]
    assert len(batches) > 10 and max(batches) < 400
    # Rows that all lack a column come in blocks too; of equal names the first counts.
    reader = feed_source.FeedReader({"path": str(folder), "members": json.dumps({"uneven.txt": ["a"]}), "block": "4096"})
    parts = [b for b in reader.read(reader.partitions()[0])][:-1]
    assert [c[0] for b in parts for c in b.column(3).to_pylist()] == [str(i) for i in range(20_000)]
    assert [k for b in parts for k in b.column(2).to_pylist()] == list(range(1, 20_001))
    assert len(parts) > 20 and max(b.num_rows for b in parts) < 2000


def odd_features(n):
    rng = random.Random(n)
    texts = ['a "quoted" {brace}', "back\\slash", "ends \\", '"features":[{', "}]", "é中\U0001f600", "", "\\\\\"", "tab\t\n"]
    out = []
    for i in range(n):
        props = {"id": str(i), "name": rng.choice(texts), rng.choice(texts) or "k": rng.choice(texts)}
        geometry = rng.choice([None, {"type": "Polygon", "coordinates": [[[rng.random(), 1.5], [2, 3], [4, i]]]}, {"type": "GeometryCollection", "geometries": [{"type": "Point", "coordinates": [i, 2]}]}])
        out.append(feature(props, geometry))
    return out


@pytest.mark.parametrize("indent, ascii_", [(None, True), (2, False)])
def test_collections_in_byte_ranges(spark, tmp_path, indent, ascii_):
    """A document read in many ranges, some inside texts and some smaller than a feature, equals one that is read whole."""
    from reachgrid.sources.features import feature_texts

    given = odd_features(60)
    given[7]["properties"]["long"] = "x{[\\\"" * 3000
    document = {"type": "FeatureCollection", "bbox": [1, 2], "crs": {"a": [{"b": 1}], "features": [{"no": 1}]}, "other": [{"c": 1}], "features": given, "tail": [{"d": 2}]}
    path = tmp_path / "c.json"
    path.write_text(json.dumps(document, indent=indent, ensure_ascii=ascii_))
    size = path.stat().st_size
    for limit in (size * 2, size // 4 + 1, 3000, 211):
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(limit))
        spark.conf.set("spark.sql.files.openCostInBytes", "0")
        spark.conf.set("spark.sql.files.minPartitionNum", "1")
        try:
            got = [json.loads(r.text) for r in feature_texts(spark, str(path)).collect()]
        finally:
            for key in ("maxPartitionBytes", "openCostInBytes", "minPartitionNum"):
                spark.conf.unset(f"spark.sql.files.{key}")
        assert sorted(got, key=lambda f: int(f["properties"]["id"])) == given, limit


def test_collections_without_features(spark, tmp_path):
    from reachgrid.sources.features import feature_texts

    for i, text in enumerate(['{"type":"FeatureCollection","features":[]}', "{}", "", '{"features":{"a":[{"b":1}]}}', "[]"]):
        (tmp_path / f"{i}.json").write_text(text)
    assert feature_texts(spark, str(tmp_path)).collect() == []


def by_recursion(buf, at=0):
    """(kind, value), next place: one geometry after the other."""
    order = "<" if buf[at] == 1 else ">"
    code = struct.unpack_from(order + "I", buf, at + 1)[0]
    at += 9 if code & 0x20000000 else 5
    flags, code = code & 0xC0000000, code & 0x0FFFFFFF
    dims = 2 + (bin(flags).count("1") if flags else {0: 0, 1: 1, 2: 1, 3: 2}[code // 1000])
    code %= 1000

    def run(at, n):
        if at + 8 * dims * n > len(buf):
            raise ValueError
        return [struct.unpack_from(order + f"{dims}d", buf, at + 8 * dims * i)[:2] for i in range(n)], at + 8 * dims * n

    if code == 1:
        pts, at = run(at, 1)
        return ("point", pts[0]), at
    n = struct.unpack_from(order + "I", buf, at)[0]
    at += 4
    if code == 2:
        pts, at = run(at, n)
        return ("lines", [pts]), at
    if code == 3:
        rings = []
        for _ in range(n):
            size = struct.unpack_from(order + "I", buf, at)[0]
            pts, at = run(at + 4, size)
            rings.append(pts[:-1] if pts and pts[0] == pts[-1] else pts)
        return ("polygons", [rings] if rings else []), at
    members = []
    for _ in range(n):
        member, at = by_recursion(buf, at)
        members.append(member)
    kind = {5: "lines", 6: "polygons", 7: "polygons"}.get(code, "none")
    return (kind, [p for m in members if m[0] == kind for p in m[1]] if kind != "none" else []), at


def blob(rng, depth=0, only=None):
    order, dims = rng.choice("<>"), rng.choice([2, 2, 3, 4])
    code = only or rng.choice([1, 2, 3, 3, 4, 5, 6, 6, 7, 7] if depth < 3 else [1, 2, 3])
    style = rng.randrange(3)
    head = {2: [0, 0, 0], 3: [1000, 0x80000000, 0x40000000], 4: [3000, 0xC0000000, 0xC0000000]}[dims][style] + code
    srid = style and rng.random() < 0.3
    out = struct.pack(order + "BI", order == "<", head | (0x20000000 if srid else 0)) + (struct.pack(order + "I", 4326) if srid else b"")
    point = lambda: struct.pack(order + f"{dims}d", *[rng.randrange(9) for _ in range(dims)])
    if code == 1:
        return out + point()
    n = rng.randrange(4)
    out += struct.pack(order + "I", n)
    for _ in range(n):
        if code == 2:
            out += point()
        elif code == 3:
            pts = [point() for _ in range(rng.randrange(5))]
            pts += pts[:1] if rng.random() < 0.7 else []
            out += struct.pack(order + "I", len(pts)) + b"".join(pts)
        else:
            out += blob(rng, depth + 1, {4: 1, 5: 2, 6: 3}.get(code))
    return out


def test_blobs_by_recursion():
    import pyarrow as pa

    from reachgrid.sources import wkb

    rng = random.Random(9)
    blobs = [blob(rng) for _ in range(3000)]
    for i in range(0, 3000, 4):
        b = bytearray(blobs[i])
        if rng.random() < 0.5:
            b = b[: rng.randrange(len(b))]
        elif len(b) > 6:
            b[rng.randrange(len(b))] ^= 1 << rng.randrange(8)
        blobs[i] = bytes(b)
    blobs[5] = blobs[6] = None
    rings, lines, points = [], [], []
    for b in blobs:
        try:
            kind, value = ("none", None) if b is None else by_recursion(b)[0]
        except (struct.error, ValueError, IndexError, KeyError, RecursionError):
            kind = "bad"
        rings.append(None if kind == "bad" else [(i, j, r) for i, part in enumerate(value) for j, r in enumerate(part)] if kind == "polygons" else [])
        lines.append(None if kind == "bad" or b is None else value if kind == "lines" else [])
        points.append(value if kind == "point" else (None, None))
    column = pa.array(blobs, pa.binary())
    pts = lambda x: [(p["x"], p["y"]) for p in x]
    shown = repr  # a NaN equals itself in text
    for a, b in zip([None if x is None else [(r["part"], r["ring"], pts(r["pts"])) for r in x] for x in wkb.rings_of(column).to_pylist()], rings):
        assert shown(a) == shown(b)
    for a, b in zip([None if x is None else [pts(line) for line in x] for x in wkb.lines_of(column).to_pylist()], lines):
        assert shown(a) == shown(b)
    for a, b in zip([(p["x"], p["y"]) for p in wkb.points_of(column).to_pylist()], points):
        assert shown(a) == shown(b)
    assert wkb.rings_of(column[10:10]).to_pylist() == [] and len(wkb.rings_of(column[7:90])) == 83
