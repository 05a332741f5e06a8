"""Polygon layers from GeoJSON features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from reachgrid.functions.geo import project_rings
from reachgrid.operators.ordering import number_rows
from reachgrid.schemas import RINGS, columns
from reachgrid.sources.features import feature_texts

# Property names of the source layers and the province code.
PROVINCE = "48"
AREAS = {
    "municipalities": {
        "code": "muni_code",
        "ids": ("EUSTAT", "OBJECTID"),
        "names": ("NOMBRE_CAS", "NOMBRE_TOP"),
        "prefix": "Municipality",
        "where": {"MUN_PROV": PROVINCE},
    },
    "comarcas": {
        "code": "comarca_code",
        "ids": ("COM_COM", "OBJECTID"),
        "names": ("COMARCA",),
        "prefix": "Comarca",
        "where": {"COM_PROV": PROVINCE},
    },
}
SETTLEMENT_FIELDS = {
    "code": "NUC_CL",
    "nucleo_num": "NUC_NUCD",
    "name": "NUC_DS_O",
    "entity_name": "NUC_ENTI_D",
    "muni_code": "NUC_MUNI",
    "muni_name": "NUC_MUNI_D",
}
FEATURE = "properties map<string,string>, geometry string"
RING = "array<array<double>>"


def read_features(ws, path: str, lines: bool = False) -> DataFrame:
    """(props, geometry text) of every feature.

    A feature collection is one JSON document per file, which is read in byte
    ranges (:mod:`reachgrid.sources.features`); with *lines* the files hold one
    feature per line.
    """
    if lines:
        found = ws.spark.read.schema(FEATURE).json(path)
    else:
        found = feature_texts(ws.spark, path).select(F.from_json("text", FEATURE).alias("f")).select("f.properties", "f.geometry")
    return found.select(F.col("properties").alias("props"), "geometry")


def rings_of(geometry: Column) -> Column:
    """Numbered rings of GeoJSON text: polygons become one part, collections keep their polygons."""

    def parts(text: Column) -> Column:
        kind = F.get_json_object(text, "$.type")
        coordinates = F.get_json_object(text, "$.coordinates")
        return (
            F.when(kind == "Polygon", F.array(F.from_json(coordinates, f"array<{RING}>")))
            .when(kind == "MultiPolygon", F.from_json(coordinates, f"array<array<{RING}>>"))
            .otherwise(F.array().cast(f"array<array<{RING}>>"))
        )

    members = F.from_json(F.get_json_object(geometry, "$.geometries"), "array<string>")
    collected = F.flatten(F.transform(F.coalesce(members, F.array().cast("array<string>")), parts))
    all_parts = F.when(F.get_json_object(geometry, "$.type") == "GeometryCollection", collected).otherwise(parts(geometry))

    def points(ring: Column) -> Column:
        closed = F.try_element_at(ring, F.lit(1)) == F.try_element_at(ring, F.lit(-1))
        open_ring = F.when(closed, F.slice(ring, 1, F.size(ring) - 1)).otherwise(ring)
        return F.transform(open_ring, lambda p: F.struct(p[0].alias("x"), p[1].alias("y")))

    numbered = F.transform(
        all_parts,
        lambda part, i: F.transform(
            part,
            lambda ring, j: F.struct(i.cast("int").alias("part"), j.cast("int").alias("ring"), points(ring).alias("pts")),
        ),
    )
    return F.flatten(numbered)


def first_of(props: Column, names: tuple[str, ...], default: Column) -> Column:
    return F.coalesce(*[props[n] for n in names], default)


def matching(features: DataFrame, where: dict[str, str]) -> DataFrame:
    for name, value in where.items():
        features = features.where(F.col("props")[name] == value)
    return features


def with_rings(df: DataFrame) -> DataFrame:
    rings = F.coalesce(rings_of(F.col("geometry")), F.array().cast(RINGS))
    return df.withColumn("rings", rings).withColumn("rings_m", project_rings(F.col("rings")))


def import_areas(ws, path: str, layer: str, lines: bool = False, **changes) -> DataFrame:
    """Municipalities or comarcas; features without geometry are dropped."""
    spec = {**AREAS[layer], **changes}
    features = matching(read_features(ws, path, lines), spec["where"]).where("geometry is not null")
    code = first_of(F.col("props"), spec["ids"], F.lit(""))
    named = features.withColumn(spec["code"], code)
    fallback = F.concat_ws(" ", F.lit(spec["prefix"]), F.col(spec["code"]))
    named = named.withColumn("name", first_of(F.col("props"), spec["names"], fallback))
    return _numbered(ws, named, layer, [F.col(spec["code"]), F.col("name")])


def import_boundary(ws, path: str, name: str, aliases: tuple[str, ...] = (), code: str = PROVINCE, lines: bool = False) -> DataFrame:
    """The territory with this code or one of these names, else one that mentions them; the first counts."""
    names = (name, *aliases)
    features = read_features(ws, path, lines).where("geometry is not null")
    label = F.coalesce(F.col("props")["NOMBRE_CAS"], F.lit(""))
    exact = F.coalesce(F.col("props")["CODIGO"] == code, F.lit(False))
    text = F.lower(F.to_json("props"))
    loose = F.lit(False)
    for n in names:
        exact = exact | label.contains(n)
        loose = loose | text.contains(n.lower())
    rank = F.when(exact, 0).when(loose, 1)
    place = F.monotonically_increasing_id()
    chosen = features.select("geometry", rank.alias("rank"), place.alias("place")).where("rank is not null").orderBy("rank", "place").limit(1)
    if chosen.isEmpty():
        raise ValueError(f"no territory {name!r} in {path}")
    row = chosen.select("geometry", F.lit(name).alias("name"), F.lit("region").alias("boundary_type"))
    return _numbered(ws, row, "boundaries", [F.col("name")])


def import_settlements(ws, path: str, province: str = PROVINCE, lines: bool = False) -> tuple[DataFrame, DataFrame]:
    """(nucleos, one-row report); number 99 marks dispersed settlement."""
    features = matching(read_features(ws, path, lines), {"NUC_PROV": province})
    if features.isEmpty():
        raise ValueError(f"no settlements of province {province} in {path}")
    props = F.col("props")
    fields = {n: F.coalesce(props[p], F.lit("")) for n, p in SETTLEMENT_FIELDS.items()}
    fields["nucleo_num"] = F.trim(fields["nucleo_num"])
    table = _numbered(ws, features.withColumns(fields), "nucleos", [F.col("code"), F.col("nucleo_num")])
    dispersed = F.col("nucleo_num") == "99"
    report = table.agg(
        F.count("*").alias("total"), F.count_if(~dispersed).alias("settlements"), F.count_if(dispersed).alias("dispersed")
    )
    return table, report


def import_sections(ws, path: str, province: str = PROVINCE, lines: bool = False) -> DataFrame:
    """Census-section polygons (id, code, name, rings) with the key of the census file."""
    props = F.col("props")
    features = matching(read_features(ws, path, lines), {"SEC_PROV": province})
    keyed = features.select(
        "geometry",
        F.concat(F.lit(province), props["SEC_MUNI"], props["SEC_DIST"], props["SEC_SECC"]).alias("code"),
        F.coalesce(props["SEC_MUNI_D"], F.lit("")).alias("name"),
    ).withColumn("_place", F.monotonically_increasing_id())
    numbered = number_rows(with_rings(keyed).drop("geometry"), [F.col("_place")], "id")
    return numbered.select("id", "code", "name", "rings", "rings_m")


def _numbered(ws, df: DataFrame, table: str, order: list[Column]) -> DataFrame:
    shaped = with_rings(df).withColumn("tenant_id", F.lit(ws.tenant))
    wanted = [c for c in columns(table) if c != "id"]
    return number_rows(shaped.select(*wanted), order, "id").select(*columns(table))
