"""File readers on files that hold the driver tables.

Each query writes a table in the format of its reader to the shared folder and
reads it back, so the reader meets all rows.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, functions as F

from reachgrid.catalog.bindings import TENANT
from reachgrid.catalog.registry import query
from reachgrid.plans.jobs import import_travel_times
from reachgrid.session import shared_dir
from reachgrid.sources import census, gtfs, indicators, layers, od, pois
from reachgrid.sources.wkb import decode_rings
from reachgrid.functions.geo import signed_area
from reachgrid.workspace import Workspace

BOX_AREA = "(x1 - x0) * (y1 - y0)"


def stored(lines: DataFrame, label: str, head: tuple[str, ...] = ()) -> str:
    """Write one column of lines as text; every file starts with the lines of *head*."""
    spark = lines.sparkSession
    path = f"{shared_dir(spark)}/reachgrid/{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex}"

    def headed(batches):
        import pyarrow as pa

        begun = False
        for batch in batches:
            if batch.num_rows and not begun:
                begun = True
                yield pa.RecordBatch.from_arrays([pa.array(head, pa.string())], names=["value"])
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.string())], names=["value"])

    column = lines.toDF("value")
    (column.mapInArrow(headed, "value string") if head else column).write.mode("errorifexists").text(path)
    return path


def quoted(*parts: Column) -> Column:
    return F.concat_ws(";", *[F.concat(F.lit('"'), p, F.lit('"')) for p in parts])


def padded(c: Column, n: int) -> Column:
    return F.lpad(c.cast("string"), n, "0")


def workspace(b) -> Workspace:
    return Workspace(b.spark, tenant="files")


PREAMBLE = ("Population by section", "x", "x", "x", "x", "code;name;district;section;total")


def dotted_people() -> Column:
    return F.replace(F.format_number(F.floor(F.abs("c_acctbal")).cast("int"), 0), F.lit(","), F.lit("."))


@query(
    "s09_census_file",
    """select '48' || lpad(cast(c_nationkey as varchar), 3, '0') || lpad(cast(c_custkey % 7 as varchar), 2, '0')
              || lpad(cast(c_custkey as varchar), 7, '0') as source_code, cast(floor(abs(c_acctbal)) as int) as population
       from customer""",
)
def _(b):
    line = quoted(padded(F.col("c_nationkey"), 3), F.lit("x"), padded(F.col("c_custkey") % 7, 2), padded(F.col("c_custkey"), 7), dotted_people())
    path = stored(b.raw("customer").select(line), "census", PREAMBLE)
    return census.read_census(workspace(b), path)


@query(
    "s10_age_file",
    """select lpad(cast(c_nationkey as varchar), 3, '0') as muni, cast(floor(abs(c_acctbal)) as int) as population,
              c_custkey % 40 + 0.5 as pct_0_19, cast(60 as double) as pct_20_64, 39.5 - c_custkey % 40 as pct_65 from customer""",
    "pct_0_19 pct_20_64 pct_65",
)
def _(b):
    young, old = F.col("c_custkey") % 40, 39 - F.col("c_custkey") % 40
    share = [F.concat(young.cast("string"), F.lit(",5")), F.lit("60,0"), F.concat(old.cast("string"), F.lit(",5"))]
    blank = F.lit("")
    line = quoted(padded(F.col("c_nationkey"), 3), F.lit("x"), F.lit("01"), padded(F.col("c_custkey"), 7), dotted_people(), blank, blank, blank, *share)
    path = stored(b.raw("customer").select(line), "ages", PREAMBLE)
    return census.read_ages(workspace(b), path)


@query(
    "s11_indicator_file",
    """select '48' || lpad(cast(c_nationkey as varchar), 3, '0') as muni_code, cast(year(o_orderdate) as int) as year,
              cast(sum(cast(o_totalprice as decimal(18, 2))) as double) as value
       from orders join customer on o_custkey = c_custkey group by all""",
    "value",
)
def _(b):
    rows = b.raw("orders").join(b.raw("customer"), F.col("o_custkey") == F.col("c_custkey")).withColumn("y", F.year("o_orderdate"))
    # A column for each year, as the file has it.
    years = sorted(r["y"] for r in rows.select("y").distinct().collect())
    sums = rows.groupBy("c_nationkey").pivot("y", years)
    wide = sums.agg(F.sum(F.col("o_totalprice").cast("decimal(18,2)")))
    cells = [F.coalesce(F.replace(F.col(str(y)).cast("string"), F.lit("."), F.lit(",")), F.lit("..")) for y in years]
    line = F.concat_ws(";", F.concat(F.lit("48"), padded(F.col("c_nationkey"), 3)), F.lit('"name"'), *cells)
    path = stored(wide.select(line), "indicator", ("Codigo municipio;Municipio;" + ";".join(map(str, years)),))
    return indicators.read_indicator(workspace(b), path)


@query(
    "s12_poi_file",
    """with p as (select s_suppkey, 'Kind ' || s_nationkey as kind, case when s_suppkey % 11 = 0 then '' else s_name || ', main' end as name,
                         case when s_suppkey % 13 = 0 then null else -3.0 - cast(s_suppkey % 60 as double) / 100 end as lon,
                         43.0 as lat, case when s_suppkey % 7 = 0 then 0 when s_suppkey % 5 = 0 then 1 else 2 end as weight from supplier)
       select 'kind_' || substr(kind, 6) as code, name, lon, weight, case when name = '' then 'missing_name'
              when lon is null then 'invalid_coordinates' when lon not between -3.5 and -2.3 then 'outside_box'
              when weight <= 0 then 'invalid_weight' end as reason from p""",
    "lon weight",
)
def _(b):
    key = F.col("s_suppkey")
    name = F.when(key % 11 == 0, F.lit("")).otherwise(F.concat(F.lit('"'), F.col("s_name"), F.lit(', main"')))
    lon = F.when(key % 13 == 0, F.lit("x")).otherwise((-3.0 - (key % 60) / 100).cast("string"))
    weight = F.when(key % 7 == 0, F.lit("0")).when(key % 5 == 0, F.lit("")).otherwise(F.lit("2"))
    line = F.concat_ws(",", F.concat(F.lit("Kind "), F.col("s_nationkey").cast("string")), name, lon, F.lit("43.0"), weight)
    folder = stored(b.raw("supplier").select(line), "pois", ("POI,Nombre,Longitud,Latitud,weight",))
    return pois.judged(pois.read_pois(workspace(b), folder, "part-*")).select("code", "name", "lon", "weight", "reason")


@query(
    "s14_layer_file",
    f"""select lpad(cast(s_suppkey as varchar), 5, '0') as muni_code, s_name as name, {BOX_AREA} as area
        from fx_population_boxes join supplier on s_suppkey = source_id""",
    "area",
)
def _(b):
    boxes = b.fx("fx_population_boxes").join(b.raw("supplier").select(F.col("s_suppkey").alias("source_id"), "s_name"), "source_id")
    corners = [("x0", "y0"), ("x1", "y0"), ("x1", "y1"), ("x0", "y1"), ("x0", "y0")]
    ring = F.array(*[F.array(F.col(x), F.col(y)) for x, y in corners])
    spec = layers.AREAS["municipalities"]
    props = F.create_map(
        F.lit(spec["ids"][0]), padded(F.col("source_id"), 5), F.lit(spec["names"][0]), F.col("s_name"),
        *[F.lit(x) for pair in spec["where"].items() for x in pair],
    )
    geometry = F.struct(F.lit("Polygon").alias("type"), F.array(ring).alias("coordinates"))
    path = stored(boxes.select(F.to_json(F.struct(props.alias("properties"), geometry.alias("geometry")))), "layer")
    areas = layers.import_areas(workspace(b), path, "municipalities", lines=True)
    return areas.select("muni_code", "name", signed_area(F.col("rings")[0]["pts"]).alias("area"))


@query("s06_wkb_polygons", f"select source_id, {BOX_AREA} as area from fx_population_boxes", "area")
def _(b):
    @F.arrow_udf("binary")
    def packed(x0, y0, x1, y1):
        import struct

        import pyarrow as pa

        def one(a, c, d, e):
            return struct.pack("<BIII10d", 1, 3, 1, 5, a, c, d, c, d, e, a, e, a, c)

        return pa.array([one(*p) for p in zip(*(v.to_pylist() for v in (x0, y0, x1, y1)))], pa.binary())

    blobs = b.fx("fx_population_boxes").select("source_id", packed("x0", "y0", "x1", "y1").alias("geom"))
    shapes = blobs.select("source_id", decode_rings("geom").alias("rings"))
    return shapes.select("source_id", signed_area(F.col("rings")[0]["pts"]).alias("area"))


def collection(features: DataFrame, label: str) -> str:
    """Write one column of features as feature collections, one document for each file."""
    spark = features.sparkSession
    path = f"{shared_dir(spark)}/reachgrid/{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex}"

    def documents(batches):
        import pyarrow as pa

        begun = False
        for batch in batches:
            values = batch.column(0).to_pylist()
            lines = [("," if begun or i else '{"type":"FeatureCollection","features":[') + v for i, v in enumerate(values)]
            begun = begun or bool(values)
            yield pa.RecordBatch.from_arrays([pa.array(lines, pa.string())], names=["value"])
        if begun:
            yield pa.RecordBatch.from_arrays([pa.array(["]}"], pa.string())], names=["value"])

    features.toDF("value").mapInArrow(documents, "value string").write.mode("errorifexists").text(path)
    return path


def box_features(b, properties: dict[str, Column]) -> DataFrame:
    """A feature for each population box, with the supplier's name at hand."""
    boxes = b.fx("fx_population_boxes").join(b.raw("supplier").select(F.col("s_suppkey").alias("source_id"), "s_name", "s_nationkey"), "source_id")
    corners = [("x0", "y0"), ("x1", "y0"), ("x1", "y1"), ("x0", "y1"), ("x0", "y0")]
    ring = F.array(*[F.array(F.col(x), F.col(y)) for x, y in corners])
    props = F.create_map(*[x for k, v in properties.items() for x in (F.lit(k), v)])
    geometry = F.struct(F.lit("Polygon").alias("type"), F.array(ring).alias("coordinates"))
    return boxes.select(F.to_json(F.struct(F.lit("Feature").alias("type"), props.alias("properties"), geometry.alias("geometry"))))


PROVINCE_SQL = "case when s_nationkey < 5 then '20' else '48' end"


def province() -> Column:
    return F.when(F.col("s_nationkey") < 5, "20").otherwise("48")


@query(
    "s15_section_file",
    f"""select '48' || lpad(cast(s_nationkey as varchar), 3, '0') || lpad(cast(s_suppkey % 10 as varchar), 2, '0') || lpad(cast(s_suppkey as varchar), 7, '0') as code,
               s_name || ' {{"x"}}' as name, {BOX_AREA} as area
        from fx_population_boxes join supplier on s_suppkey = source_id where {PROVINCE_SQL} = '48'""",
    "area",
)
def _(b):
    """Sections from collections; the names hold quotes and braces."""
    path = collection(
        box_features(
            b,
            {
                "SEC_PROV": province(), "SEC_MUNI": padded(F.col("s_nationkey"), 3), "SEC_DIST": padded(F.col("source_id") % 10, 2),
                "SEC_SECC": padded(F.col("source_id"), 7), "SEC_MUNI_D": F.concat(F.col("s_name"), F.lit(' {"x"}')),
            },
        ),
        "sections",
    )
    areas = layers.import_sections(workspace(b), path)
    return areas.select("code", "name", signed_area(F.col("rings")[0]["pts"]).alias("area"))


@query(
    "s16_settlement_file",
    f"""select lpad(cast(s_suppkey as varchar), 7, '0') as code, case when s_suppkey % 9 = 0 then '99' else lpad(cast(s_suppkey % 9 as varchar), 2, '0') end as nucleo_num,
               s_name as name, cast(s_nationkey as varchar) as muni_code, s_suppkey % 9 = 0 as dispersed, {BOX_AREA} as area
        from fx_population_boxes join supplier on s_suppkey = source_id where {PROVINCE_SQL} = '48'""",
    "area",
)
def _(b):
    number = F.when(F.col("source_id") % 9 == 0, F.lit(" 99 ")).otherwise(padded(F.col("source_id") % 9, 2))
    path = collection(
        box_features(
            b,
            {
                "NUC_PROV": province(), "NUC_CL": padded(F.col("source_id"), 7), "NUC_NUCD": number, "NUC_DS_O": F.col("s_name"),
                "NUC_MUNI": F.col("s_nationkey").cast("string"),
            },
        ),
        "settlements",
    )
    table, _ = layers.import_settlements(workspace(b), path)
    return table.select("code", "nucleo_num", "name", "muni_code", (F.col("nucleo_num") == "99").alias("dispersed"), signed_area(F.col("rings")[0]["pts"]).alias("area"))


def fresh(b, label: str) -> str:
    return f"{shared_dir(b.spark)}/reachgrid/{b.spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex}"


FEED_HEADS = {
    "stops.txt": "stop_id,stop_name,stop_lat,stop_lon",
    "trips.txt": "route_id,service_id,trip_id",
    "stop_times.txt": "trip_id,departure_time,stop_id",
}
OPERATOR = "concat(event_type, '-', cast(user_id % 16 as string))"


def zipped(lines: DataFrame, folder: str, hurt: str) -> None:
    """Write (operator, member, value) as one feed for each operator, member by member; those of *hurt* lack their end."""

    def write(batches):
        import zipfile

        import pyarrow as pa

        from reachgrid.sources.feed_source import SUFFIX, opened

        system, inside = opened(folder)
        system.create_dir(inside)
        now, stack = (None, None), []

        def closed(bad):
            for x in reversed(stack):
                x.close()
            stack.clear()
            if bad:
                with system.open_input_file(f"{inside}/{now[0]}{SUFFIX}") as file:
                    whole = file.read()
                with system.open_output_stream(f"{inside}/{now[0]}{SUFFIX}") as file:
                    file.write(whole[: len(whole) // 2])

        last_bad = False
        for batch in batches:
            for operator, member, value, bad in zip(*(c.to_pylist() for c in batch.columns)):
                if operator != now[0]:
                    closed(last_bad)
                    out = system.open_output_stream(f"{inside}/{operator}{SUFFIX}")
                    stack += [out, zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED)]
                elif member != now[1]:
                    stack.pop().close()
                if (operator, member) != now:
                    stack.append(stack[1].open(member, "w"))
                    stack[-1].write((FEED_HEADS[member] + "\n").encode())
                now, last_bad = (operator, member), bad
                stack[-1].write((value + "\n").encode())
        closed(last_bad)
        yield pa.RecordBatch.from_arrays([pa.array([now[0]], pa.string())], names=["operator"])

    ordered = lines.select("operator", "member", "value", F.expr(hurt).alias("bad")).repartition("operator").sortWithinPartitions("operator", "member", "value")
    ordered.mapInArrow(write, "operator string").write.format("noop").mode("overwrite").save()


@query(
    "s13_timetable_feeds",
    f"""with e as (select {OPERATOR.replace('as string', 'as varchar')} as operator, cast(hour(ts) as int) * 60 + cast(minute(ts) as int) as dep_min, * from events)
        select operator, operator like 'click-%' and user_id % 16 = 7 as faulty,
               case when operator like 'click-%' and user_id % 16 = 7 then 0 else count(*) end as stop_times,
               case when operator like 'click-%' and user_id % 16 = 7 then 0 else sum(dep_min) end as minutes,
               case when operator like 'click-%' and user_id % 16 = 7 then 0 else count(distinct event_id % 4000) end as trips,
               case when operator like 'click-%' and user_id % 16 = 7 then 0 else count(distinct user_id) end as stops
        from e group by operator, user_id % 16""",
)
def _(b):
    """One zip file for each event type and sixteenth of the users; those of one operator in sixteen of a type are damaged."""
    events = b.raw("events").withColumn("operator", F.expr(OPERATOR))
    clock = F.date_format("ts", "HH:mm:ss")
    trip, stop = (F.col("event_id") % 4000).cast("string"), F.col("user_id").cast("string")
    lines = {
        "stops.txt": events.select("operator", F.concat_ws(",", stop, F.concat(F.lit('"stop, '), stop, F.lit('"')), F.lit("43.0"), F.lit("-2.9")).alias("value")).distinct(),
        "trips.txt": events.select("operator", F.concat(F.lit("r,s,"), trip).alias("value")).distinct(),
        "stop_times.txt": events.select("operator", F.concat_ws(",", trip, clock, stop).alias("value")),
    }
    folder = fresh(b, "feeds")
    parts = [df.withColumn("member", F.lit(m)) for m, df in lines.items()]
    zipped(parts[0].unionByName(parts[1]).unionByName(parts[2]), folder, "operator = 'click-7'")
    unpacked = gtfs.unpack(b.spark, folder)
    times = gtfs.stop_times(unpacked).groupBy("operator").agg(
        F.count("*").alias("stop_times"), F.sum("dep_min").alias("minutes"), F.count_distinct("trip_id").alias("trips")
    )
    stops = gtfs.stops(unpacked).groupBy("operator").agg(F.count("*").alias("stops"))
    found = gtfs.feeds(b.spark, folder, unpacked).select("operator", F.col("fault").isNotNull().alias("faulty"))
    out = found.join(times, "operator", "left").join(stops, "operator", "left")
    return out.na.fill(0, ["stop_times", "minutes", "trips", "stops"])


MATRIX_FILES = """m as (select departure_time, origin_cell_id as o, destination_id as d, travel_time_minutes as v, origin_cell_id % 2 as layout from fx_travel_times),
    k as (select departure_time, case when layout = 1 and o % 11 = 0 then null else o end as o, d, case when layout = 0 then v else v + 100 end as v from m)"""


def matrix_folder(b) -> str:
    """Matrix files of two layouts for each slot, and some that are not accepted: of another mode, of a bad name, without times."""
    folder = fresh(b, "matrices")
    rows = b.fx("fx_travel_times")
    plain = rows.where("origin_cell_id % 2 = 0").select(
        "departure_time", F.col("origin_cell_id").alias("from_id"), F.col("destination_id").cast("int").alias("to_id"),
        F.col("travel_time_minutes").alias("travel_time_p50"), (F.col("travel_time_minutes") + 1).alias("travel_time_p75"),
    )
    origin = F.when(F.col("origin_cell_id") % 11 == 0, F.lit("bad")).otherwise(F.col("origin_cell_id").cast("string"))
    text = rows.where("origin_cell_id % 2 = 1").select(
        "departure_time", origin.alias("from_id"), F.col("destination_id").cast("string").alias("to_id"), (F.col("travel_time_minutes") + 100).cast("string").alias("travel_time"),
    )
    digits = F.concat(F.substring("departure_time", 1, 2), F.substring("departure_time", 4, 2))
    named(b, plain.withColumn("name", F.concat(F.lit("ttm_TRANSIT_"), digits)), folder)
    named(b, text.withColumn("name", F.concat(F.lit("ttm_transit_"), digits)), folder)
    named(b, plain.withColumn("name", F.concat(F.lit("ttm_walk_"), digits)), folder)
    named(b, plain.withColumn("name", F.concat(F.lit("ttm_transit_"), F.substring("departure_time", 1, 2))), folder)
    named(b, plain.drop("travel_time_p50", "travel_time_p75").withColumn("name", F.concat(F.lit("ttm_transit_1"), F.substring("departure_time", 2, 1), F.lit("30"))), folder)
    return folder


def named(b, rows: DataFrame, folder: str) -> None:
    """Write the rows of each name as one Parquet file of that name."""

    def write(batches):
        import pyarrow as pa
        import pyarrow.parquet as pq

        from reachgrid.sources.feed_source import opened

        system, inside = opened(folder)
        system.create_dir(inside)
        now, out = None, None
        for batch in batches:
            names = batch.column("name").to_pylist()
            own = batch.drop_columns(["name"])
            starts = [i for i in range(len(names)) if i == 0 or names[i] != names[i - 1]]
            for i, j in zip(starts, [*starts[1:], len(names)]):
                if names[i] != now:
                    if out is not None:
                        out.close()
                    now, out = names[i], pq.ParquetWriter(f"{inside}/{names[i]}.parquet", own.schema, filesystem=system)
                out.write_batch(own.slice(i, j - i))
        if out is not None:
            out.close()
        yield pa.RecordBatch.from_arrays([pa.array([now], pa.string())], names=["name"])

    given = rows.drop("departure_time").repartition("name").sortWithinPartitions("name")
    given.mapInArrow(write, "name string").write.format("noop").mode("overwrite").save()


@query(
    "s07_s08_matrix_files",
    f"""with {MATRIX_FILES}
        select departure_time, o as origin_cell_id, count(*) as n, sum(v) as minutes from k where o is not null and v between 0 and 120 group by departure_time, o""",
    "minutes",
)
def _(b):
    kept = od.import_od(workspace(b), matrix_folder(b))[0]
    return kept.groupBy("departure_time", "origin_cell_id").agg(F.count("*").alias("n"), F.sum("travel_time_minutes").alias("minutes"))


@query(
    "s07_skipped_files",
    """with s as (select distinct replace(departure_time, ':', '') as t from fx_travel_times)
       select 'ttm_walk_' || t || '.parquet' as file, 'mode' as reason from s
       union all select distinct 'ttm_transit_' || left(t, 2) || '.parquet', 'name' from s
       union all select distinct 'ttm_transit_1' || substr(t, 2, 1) || '30.parquet', 'columns' from s""",
)
def _(b):
    return od.skipped_files(workspace(b), matrix_folder(b))


@query(
    "a23_p05_file_report",
    f"""with {MATRIX_FILES}
        select 'TRANSIT' as mode, departure_time, count(*) filter (where o is not null and v between 0 and 120) as rows_kept,
               count(*) filter (where o is null) as rows_not_numeric, count(*) filter (where o is not null and not v between 0 and 120) as rows_out_of_range,
               count(*) filter (where o is null) as values_not_numeric
        from k group by departure_time""",
)
def _(b):
    """Counted while the rows are published."""
    ws = Workspace(b.spark, fresh(b, "serving"), TENANT)
    return import_travel_times(ws, matrix_folder(b))[1]
