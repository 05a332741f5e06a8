"""Distance decay, diminishing returns and the weighted means of the reports."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def impedance(minutes: Column, alpha: Column | float) -> Column:
    """exp(-alpha * minutes); a negative time is an input error, not a score."""
    alpha = alpha if isinstance(alpha, Column) else F.lit(_positive(alpha))
    return F.when(minutes < 0, F.raise_error(F.lit("negative travel time")).cast("double")).otherwise(
        F.exp(-alpha * minutes)
    )


def _positive(alpha: float) -> float:
    if alpha <= 0:
        raise ValueError("alpha must be positive")
    return float(alpha)


def concave(raw: Column, beta: float) -> Column:
    """raw ** beta with 0 -> 0."""
    if not 0 < beta < 1:
        raise ValueError("beta must lie strictly between 0 and 1")
    return F.pow(raw, F.lit(float(beta)))


def scaled(value: Column, low: Column, high: Column) -> Column:
    """Min-max to 0..100; a flat group sits in the middle."""
    return F.when(high == low, F.lit(50.0)).otherwise((value - low) / (high - low) * 100.0)


def unit(value: Column, low: Column, high: Column) -> Column:
    """Min-max to 0..1; a flat dimension gives 0."""
    return F.when(high > low, (value - low) / (high - low)).otherwise(F.lit(0.0))


def weighted_mean(value: Column, weight: Column, null_mode: str = "zero") -> Column:
    """Aggregate expression for the four weighted means in use.

    ``zero``    missing values count as 0; plain mean when the weights sum to 0
    ``skip``    missing values leave the numerator only; same fallback
    ``scored``  missing values leave numerator and denominator; same fallback
    ``strict``  as ``zero`` but null when the weights sum to 0
    """
    total = F.sum(weight)
    if null_mode == "scored":
        seen = F.sum(F.when(value.isNotNull(), weight))
        return F.coalesce(F.sum(weight * value) / F.nullif(seen, F.lit(0.0)), F.avg(value))
    if null_mode == "skip":
        return F.when(total > 0, F.sum(weight * value) / total).otherwise(F.avg(value))
    ratio = F.when(total > 0, F.sum(weight * F.coalesce(value, F.lit(0.0))) / total)
    if null_mode == "zero":
        return ratio.otherwise(F.avg(value))
    if null_mode == "strict":
        return ratio
    raise ValueError(f"unknown null_mode {null_mode!r}")
