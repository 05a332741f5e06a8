"""Reference rows of a new tenant."""

from __future__ import annotations

from pyspark.sql import DataFrame

from reachgrid.functions.text import label_from_code
from reachgrid.params import PURPOSES
from reachgrid.schemas import SCHEMAS

# What each destination type stands for.
DESCRIPTIONS = (
    "Airports",
    "Secondary / vocational schools (BHI)",
    "Education centres",
    "Urban centres",
    "GP / general health consultations",
    "Government tax / finance offices",
    "Hospitals",
    "Osakidetza health service locations",
    "Residential care facilities",
    "Universities",
)


def seed_reference(ws, name: str = "Demo region") -> dict[str, DataFrame]:
    """Frames for tenants, modes and the ten destination types."""
    make = ws.spark.createDataFrame
    slug = name.lower().replace(" ", "-")
    types = [(i, p, None, d) for i, (p, d) in enumerate(zip(PURPOSES, DESCRIPTIONS), 1)]
    labelled = make(types, SCHEMAS["destination_types"])
    return {
        "tenants": make([(ws.tenant, name, slug, '{"crs_projected": 25830}')], SCHEMAS["tenants"]),
        "modes": make([(1, "TRANSIT", "Public Transport")], SCHEMAS["modes"]),
        "destination_types": labelled.withColumn("label", label_from_code(labelled.code)),
    }
