"""The way beyond a broadcast: the same results when every side counts as large."""

import pytest
from pyspark.sql import functions as F

import compare
from reachgrid import ScoreParams
from reachgrid.operators import scoring as op
from reachgrid.operators import sizes

FOLDER = f"{compare.DATA}/sf0.001"


@pytest.fixture
def shuffled(spark, monkeypatch):
    monkeypatch.setattr(sizes, "BROADCAST_ROWS", 0)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


@pytest.mark.parametrize(
    "name",
    [
        "a01_gravity",
        "a04_nearest",
        "j04_cells_in_municipalities",
        "j06_a21_areal_weighting",
        "j07_masked_weighting",
        "j09_distance_od",
        "j15_origin_remap",
        "a19_stop_frequency",
    ],
)
def test_shuffle_joins_give_the_same(spark, shuffled, name):
    assert compare.compare(spark, compare.oracle(FOLDER), name, FOLDER) is None


def test_one_destination_with_most_rows(spark, shuffled):
    """A hot destination and a hot cell; sums against plain arithmetic."""
    ids = F.col("id")
    od = spark.range(30_000).select(
        F.lit("08:00").alias("departure_time"),
        F.when(ids % 3 == 0, 1).otherwise(ids % 500).cast("bigint").alias("origin_cell_id"),
        F.when(ids % 2 == 0, 7).otherwise(ids % 40).cast("bigint").alias("destination_id"),
        F.lit("TRANSIT").alias("mode"),
        (ids % 100).cast("double").alias("travel_time_minutes"),
    )
    dest = spark.range(40).select("id", F.lit(1).alias("type_id"), F.lit(2.0).alias("weight"))
    types = spark.createDataFrame([(1, "hospital")], "id int, code string")
    got = op.gravity(op.reached(od, dest, types, ScoreParams()), ScoreParams())
    want = sum(2 * 2.718281828459045 ** (-0.03 * (i % 100)) for i in range(30_000))
    assert got.agg(F.sum("raw_score")).head()[0] == pytest.approx(want)
    hot = sum(2 * 2.718281828459045 ** (-0.03 * (i % 100)) for i in range(30_000) if i % 3 == 0 or i % 500 == 1)
    assert got.where("cell_id = 1").head().raw_score == pytest.approx(hot)
