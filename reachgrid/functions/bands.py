"""Classes used on maps and charts."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Band edges and labels shown by the reports.
TIME_EDGES = ((30, "< 30 min"), (45, "30-45 min"), (60, "45-60 min"), (75, "60-75 min"), (90, "75-90 min"))
TIME_BEYOND = "> 90 min"
SCORE_STOPS = (0, 9, 18, 27, 36, 45, 54, 63, 72, 81, 90, 100)
FREQUENCY_EDGES = ((6.0, "high"), (3.0, "medium"), (1.0, "low"))
TIER_EDGES = ((0.6, "high"), (0.35, "medium"))


def time_band(minutes: Column) -> Column:
    """Travel-time band; unknown or 90 and more is 'beyond'."""
    out = F
    for edge, label in TIME_EDGES:
        out = out.when(minutes < edge, F.lit(label))
    return out.otherwise(F.lit(TIME_BEYOND))


def score_class(score: Column) -> Column:
    """Index (1-12) of the last colour stop at or below the score."""
    passed = [F.when(score >= stop, 1).otherwise(0) for stop in SCORE_STOPS[1:]]
    return F.when(score.isNotNull(), sum(passed, F.lit(1)))


def frequency_band(per_hour: Column) -> Column:
    """Service level of a stop; null when nothing departs."""
    out = F
    for edge, label in FREQUENCY_EDGES:
        out = out.when(per_hour >= edge, F.lit(label))
    return out.when(per_hour > 0, F.lit("very_low"))


def vulnerability_tier(index: Column) -> Column:
    out = F
    for edge, label in TIER_EDGES:
        out = out.when(index >= edge, F.lit(label))
    return out.otherwise(F.when(index.isNotNull(), F.lit("low")))


def histogram_bucket(score: Column) -> Column:
    """Bucket 1-10 of a 0-100 score; exactly 100 belongs to the last."""
    return F.least(F.greatest(F.floor(score / 10).cast("int") + 1, F.lit(1)), F.lit(10))
