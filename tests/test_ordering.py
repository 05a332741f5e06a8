import random
import statistics

import pytest
from pyspark.sql import functions as F

from reachgrid.operators.ordering import at_ranks, latest, median, number_rows


def test_median_per_group_is_exact_with_ties_and_skew(spark):
    rng = random.Random(1)
    groups = {"one": [5.0], "two": [1.0, 2.0], "flat": [3.0] * 5000, "wide": [rng.gauss(0, 1e6) for _ in range(20001)]}
    groups["hot"] = [0.0] * 9000 + [rng.random() for _ in range(9000)]
    rows = [(k, v) for k, vs in groups.items() for v in vs] + [("wide", None)]
    df = spark.createDataFrame(rows, "k string, v double").repartition(7)
    got = {r.k: r.m for r in median(df, ["k"], "v", "m").collect()}
    assert got == pytest.approx({k: statistics.median(v) for k, v in groups.items()}, rel=1e-12)
    total = median(df, [], "v", "m").head().m
    assert total == pytest.approx(statistics.median([v for _, v in rows if v is not None]))
    assert median(df.where("v > 1e12"), [], "v", "m").isEmpty()


def test_rank_outside_the_bracket_is_an_error(spark):
    df = spark.range(100_000).select((F.col("id") * 1.0).alias("v"))
    assert at_ranks(df, [], "v", {"x": lambda n: F.floor(n / 2)}).head().x == 50_000
    with pytest.raises(Exception, match="outside the bracket"):
        at_ranks(df, [], "v", {"x": lambda n: n - 1}).collect()


def test_row_numbers_follow_the_order_over_many_files(spark):
    df = spark.range(20_000).select("id", (F.col("id") * 7919 % 1000).alias("v")).repartition(13)
    got = number_rows(df, [F.col("v").desc(), F.col("id")], "n").collect()
    want = sorted(got, key=lambda r: (-r.v, r.id))
    assert [r.n for r in want] == list(range(1, 20_001))


def test_latest_row(spark):
    df = spark.createDataFrame([("a", 1, 5), ("a", 3, 6), ("a", 2, 9), ("b", 1, 1)], "k string, year int, v int")
    assert {(r.k, r.year, r.v) for r in latest(df, "k", "year").collect()} == {("a", 3, 6), ("b", 1, 1)}
