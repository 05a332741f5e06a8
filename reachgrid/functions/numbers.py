"""Shares and display rounding; used only where results are presented."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def pct(part: Column, total: Column, digits: int | None = 1) -> Column:
    """Share in percent, 0 when the total is 0 or missing."""
    share = F.when(total > 0, F.coalesce(part, F.lit(0.0)) / total * 100.0).otherwise(F.lit(0.0))
    return share if digits is None else F.round(share, digits)


def display(value: Column, digits: int = 2) -> Column:
    return F.round(value, digits)


def age_split(band_0_19: Column, band_20_64: Column, band_65: Column) -> dict[str, Column]:
    """Four age groups from three broad bands; every step truncates."""
    young = (band_0_19 * 0.9).cast("int")
    early = (band_20_64 * 6 / 45).cast("int")
    return {
        "pop_0_17": young,
        "pop_18_25": (band_0_19 - young + early).cast("int"),
        "pop_26_64": (band_20_64 - early).cast("int"),
        "pop_65_plus": band_65.cast("int"),
    }
