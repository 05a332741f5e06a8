"""Column layout of the serving tables, and their natural keys.

Geometry is kept as plain columns: ``rings`` in degrees and ``rings_m`` in
metres, points as lon/lat and x/y, so reports need no geometry type.
"""

from __future__ import annotations

POINTS = "array<struct<x:double,y:double>>"
RINGS = f"array<struct<part:int,ring:int,pts:{POINTS}>>"
LINES = f"array<{POINTS}>"

SCHEMAS: dict[str, str] = {
    "tenants": "id string, name string, slug string, config string",
    "modes": "id int, code string, label string",
    "destination_types": "id int, code string, label string, description string",
    "boundaries": f"id bigint, tenant_id string, name string, boundary_type string, rings {RINGS}, rings_m {RINGS}",
    "municipalities": f"id bigint, tenant_id string, muni_code string, name string, rings {RINGS}, rings_m {RINGS}",
    "comarcas": f"id bigint, tenant_id string, comarca_code string, name string, rings {RINGS}, rings_m {RINGS}",
    "nucleos": (
        "id bigint, tenant_id string, code string, nucleo_num string, name string, entity_name string, "
        f"muni_code string, muni_name string, rings {RINGS}, rings_m {RINGS}"
    ),
    "population_sources": (
        "id bigint, tenant_id string, name string, population double, source_code string, "
        f"rings {RINGS}, rings_m {RINGS}"
    ),
    "grid_cells": (
        "id bigint, tenant_id string, cell_code string, x0 double, y0 double, size double, "
        "lon double, lat double, population double, muni_code string"
    ),
    "destinations": (
        "id bigint, tenant_id string, type_id int, name string, weight double, metadata string, "
        "lon double, lat double"
    ),
    "travel_times": (
        "tenant_id string, origin_cell_id bigint, destination_id bigint, mode string, "
        "travel_time_minutes double, departure_time string"
    ),
    "connectivity_scores": (
        "tenant_id string, cell_id bigint, mode string, purpose string, score double, "
        "score_normalized double, departure_time string"
    ),
    "combined_scores": (
        "tenant_id string, cell_id bigint, combined_score double, combined_score_normalized double, "
        "weights string, departure_time string"
    ),
    "min_travel_times": (
        "tenant_id string, cell_id bigint, mode string, purpose string, min_travel_time_minutes double, "
        "nearest_destination_id bigint, departure_time string"
    ),
    "gtfs_routes": (
        "id bigint, operator string, route_id string, route_name string, route_type int, route_color string, "
        f"lines {LINES}"
    ),
    "gtfs_stops": "id bigint, operator string, stop_id string, stop_name string, lon double, lat double",
    "stop_frequency": (
        "id bigint, operator string, stop_id string, stop_name string, time_window string, departures bigint, "
        "departures_per_hour double, lon double, lat double"
    ),
    "municipality_demographics": (
        "muni_code string, year int, pop_total bigint, pop_0_17 bigint, pop_18_25 bigint, pop_26_64 bigint, "
        "pop_65_plus bigint, pct_0_17 double, pct_18_25 double, pct_65_plus double"
    ),
    "municipality_income": (
        "muni_code string, year int, renta_personal_media double, renta_disponible_media double, renta_index double"
    ),
    "municipality_car_ownership": "muni_code string, year int, vehicles_per_inhab double",
}

SLOT_TABLES = ("travel_times", "connectivity_scores", "combined_scores", "min_travel_times")

KEYS: dict[str, tuple[str, ...]] = {
    "travel_times": ("tenant_id", "origin_cell_id", "destination_id", "mode", "departure_time"),
    "connectivity_scores": ("tenant_id", "cell_id", "mode", "purpose", "departure_time"),
    "combined_scores": ("tenant_id", "cell_id", "departure_time"),
    "min_travel_times": ("tenant_id", "cell_id", "mode", "purpose", "departure_time"),
    "municipality_demographics": ("muni_code", "year"),
    "municipality_income": ("muni_code", "year"),
    "municipality_car_ownership": ("muni_code", "year"),
    "stop_frequency": ("operator", "stop_id", "time_window"),
}

# Layer -> column that holds the area's code.
LAYERS = {"municipalities": "muni_code", "comarcas": "comarca_code"}


def columns(name: str) -> list[str]:
    depth, names, start = 0, [], 0
    text = SCHEMAS[name] + ","
    for i, ch in enumerate(text):
        depth += (ch == "<") - (ch == ">")
        if ch == "," and depth == 0:
            names.append(text[start:i].split()[0])
            start = i + 1
    return names
