"""Travel times made from the driver tables, and scores written from them."""

import pytest
from pyspark.sql import functions as F

import compare
from reachgrid import ScoreParams
from reachgrid.catalog import bindings
from reachgrid.operators.scoring import gravity_and_nearest, reached
from reachgrid.session import written

FOLDER = f"{compare.DATA}/sf0.001"
COLUMNS = ["origin_cell_id", "destination_id", "mode", "departure_time", "travel_time_minutes"]


@pytest.mark.parametrize("part", [500_000, 1_000])
def test_travel_times_are_the_rows_of_the_statement(spark, monkeypatch, part):
    monkeypatch.setattr(bindings, "PART", part)
    b = bindings.Bound(spark, FOLDER)
    got, want = b.travel_times().select(*COLUMNS), b.fx("fx_travel_times").select(*COLUMNS)
    assert got.schema.simpleString() == want.schema.simpleString()
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_scores_need_no_further_shuffle_of_travel_times(spark, monkeypatch):
    monkeypatch.setattr(bindings, "PART", 1_000)
    ws = bindings.Bound(spark, FOLDER).workspace()
    rows = reached(ws.table("travel_times"), ws.table("destinations"), ws.table("destination_types"), ScoreParams())
    plan = gravity_and_nearest(rows, ScoreParams())._jdf.queryExecution().executedPlan().toString()
    moved = [line for line in plan.splitlines() if "Exchange hashpartitioning(" in line]
    assert sum("o_custkey" in line for line in moved) == 1
    assert not any("purpose" in line or "l_suppkey" in line for line in moved)


def test_tasks_write_their_rows_where_they_are(spark):
    before = spark.conf.get("spark.sql.maxConcurrentOutputFileWriters")
    df = spark.range(0, 100, 1, 4).select("id", (F.col("id") % 2).alias("k"))
    out = written(df, "stay", ["k"], move=False)
    assert out.select(F.input_file_name()).distinct().count() == 8
    assert sorted(map(tuple, out.select("id", "k").collect())) == [(i, i % 2) for i in range(100)]
    assert spark.conf.get("spark.sql.maxConcurrentOutputFileWriters") == before
