"""Codes, labels, clock times and European numbers."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def slug(raw: Column) -> Column:
    """Lower case, every run of other characters to one underscore, none at the ends."""
    return F.trim(F.regexp_replace(F.lower(F.trim(raw)), "[^a-z0-9]+", "_"), F.lit("_"))


def label_from_code(code: Column) -> Column:
    return F.initcap(F.replace(code, F.lit("_"), F.lit(" ")))


def unquote(part: Column) -> Column:
    """Drop surrounding double quotes, then surrounding blanks."""
    return F.trim(F.trim(part, F.lit('"')))


def clock_minutes(text: Column) -> Column:
    """``HH:MM[:SS]`` to minutes; hours past 24 are kept, anything else is null."""
    parts = F.split(F.trim(text), ":")
    whole = [F.get(parts, F.lit(i)).try_cast("int") for i in (0, 1)]
    return whole[0] * 60 + whole[1]


def dotted_int(text: Column) -> Column:
    """Integer with dots as thousands separators; null when not a number."""
    return F.trim(F.replace(unquote_only(text), F.lit("."), F.lit(""))).try_cast("int")


def unquote_only(part: Column) -> Column:
    return F.trim(part, F.lit('"'))


def comma_float(text: Column) -> Column:
    """Decimal with a comma; null when not a number."""
    return F.replace(unquote(text), F.lit(","), F.lit(".")).try_cast("double")


def comma_percent(text: Column) -> Column:
    """As :func:`comma_float`, but an unreadable percentage counts as 0."""
    return F.coalesce(comma_float(text), F.lit(0.0))


def section_key(province: Column, municipality: Column, district: Column, section: Column) -> Column:
    return F.concat(province, municipality, district, section)


def full_municipality(code: Column, province: str) -> Column:
    """Three-digit codes get the province in front."""
    return F.when(F.length(code) == 3, F.concat(F.lit(province), code)).otherwise(code)
