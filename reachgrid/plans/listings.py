"""Plain listings of layers, destinations and their types."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from reachgrid.workspace import Workspace

# Fixed value: number of the settlement rows that stand for scattered houses.
DISPERSED = "99"

SHOWN = {
    "boundaries": (["id", "name", "boundary_type"], []),
    "municipalities": (["id", "muni_code", "name"], ["name"]),
    "comarcas": (["id", "comarca_code", "name"], ["name"]),
    "nucleos": (["id", "code", "nucleo_num", "name", "entity_name", "muni_code", "muni_name"], ["muni_name", "name"]),
}


def layer(
    ws: Workspace,
    name: str,
    include_dispersed: bool = False,
    name_like: str | None = None,
    geometry: bool = False,
) -> DataFrame:
    """Rows of an area layer in listing order; geometry only on request."""
    shown, order = SHOWN[name]
    rows = ws.table(name)
    if name == "nucleos" and not include_dispersed:
        rows = rows.where(settled())
    if name_like is not None:
        rows = rows.where(name_contains(F.col("name"), name_like))
    listed = rows.select(*shown, *(["rings"] if geometry else []))
    return listed.orderBy(*order, "id") if order else listed


def settled() -> Column:
    return F.col("nucleo_num") != DISPERSED


def name_contains(name: Column, query: str) -> Column:
    """Case-insensitive search."""
    return F.lower(name).contains(query.lower())


def destination_types(ws: Workspace) -> DataFrame:
    return ws.table("destination_types").select("code", "label").orderBy("code")


def destinations(ws: Workspace) -> DataFrame:
    types = ws.table("destination_types").select(
        F.col("id").alias("type_id"), F.col("code").alias("type"), F.col("label").alias("type_label")
    )
    return (
        ws.table("destinations")
        .join(types, "type_id")
        .select("id", "name", "type", "type_label", "weight", "lon", "lat")
    )
