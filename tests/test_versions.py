"""Versions of published tables: what a change leaves alone, and two writers at once."""

import threading

import pytest
from pyspark.sql import functions as F

from reachgrid.sources import versions


@pytest.fixture
def root(tmp_path):
    return str(tmp_path / "serving")


def rows(spark, n, slots):
    return spark.range(n).select(F.col("id").alias("cell_id"), F.element_at(F.array(*[F.lit(s).cast("string") for s in slots]), (F.col("id") % len(slots) + 1).cast("int")).alias("slot"), F.col("id").cast("double").alias("v"))


def read(spark, root, name="t", number=None):
    return versions.read_version(spark, root, name, versions.manifest(spark, root, name, number))


def files(df):
    return {r[0]: r[1] for r in df.groupBy(F.input_file_name()).agg(F.min("slot")).collect()}


def held(df):
    return sorted((r.slot is None, r.slot or "", r.cell_id, r.v) for r in df.collect())


def test_a_slot_run_writes_only_its_slot(spark, root):
    versions.publish(rows(spark, 40, ["08:00", "08:30", "09:00", None]), root, "t", ["slot"])
    old, before = read(spark, root), files(read(spark, root))
    was = held(old)
    new = rows(spark, 10, ["08:30"]).withColumn("v", F.col("v") + 1000)
    made = versions.replace_partitions(new, root, "t", "slot", ["08:30"])
    after = files(read(spark, root))
    assert {f for f, s in before.items() if s != "08:30"} == {f for f, s in after.items() if s != "08:30"}
    assert not {f for f, s in before.items() if s == "08:30"} & set(after)
    assert held(read(spark, root)) == sorted([r for r in was if r[1] != "08:30"] + held(new))
    # The version before is still there for who reads it.
    assert held(old) == was and held(read(spark, root, number=made.number - 1)) == was
    # A named value without rows becomes empty; rows of other values are not written.
    versions.replace_partitions(new.withColumn("slot", F.lit("09:00")), root, "t", "slot", ["08:00"])
    assert {r.slot for r in read(spark, root).select("slot").distinct().collect()} == {"08:30", "09:00", None}
    # Without names those that occur are replaced, null too.
    versions.replace_partitions(rows(spark, 3, [None]), root, "t", "slot")
    assert read(spark, root).where("slot is null").count() == 3
    versions.replace_partitions(new, root, "t", "slot", [])
    assert read(spark, root).where("slot is null").count() == 3
    with pytest.raises(ValueError):
        versions.replace_partitions(new, root, "t", "cell_id")
    with pytest.raises(ValueError):
        versions.publish(new, root, "t", ["slot", "cell_id"])


def test_filters_prune_directories(spark, root):
    versions.publish(rows(spark, 40, ["08:00", "08:30"]), root, "t", ["slot"])
    versions.replace_partitions(rows(spark, 10, ["08:30"]), root, "t", "slot")
    one = read(spark, root).where("slot = '08:30'")
    assert one.count() == 10 and len(one.inputFiles()) >= 1
    assert "PartitionFilters: [isnotnull(slot" in one._jdf.queryExecution().executedPlan().toString()
    assert read(spark, root).columns == ["cell_id", "slot", "v"]


def test_a_writer_that_comes_second_keeps_what_the_first_did(spark, root):
    versions.publish(rows(spark, 40, ["08:00", "08:30"]), root, "t", ["slot"])
    tries = []

    def change(now):
        tries.append(now.number)
        if len(tries) == 1:
            # Another writer puts its version in place in between.
            versions.replace_partitions(rows(spark, 5, ["08:00"]), root, "t", "slot")
        return versions.Manifest(0, now.column, now.schema, {p: d for p, d in now.parts.items() if versions.value_of(p) != "08:30"})

    made = versions.commit(spark, root, "t", change)
    assert tries == [1, 2] and made.number == 3
    assert [(r.slot, r["count"]) for r in read(spark, root).groupBy("slot").count().collect()] == [("08:00", 5)]


def test_writers_side_by_side(spark, root):
    slots = [f"{h:02d}:00" for h in range(6)]
    versions.publish(rows(spark, 60, slots), root, "t", ["slot"])
    errors = []

    def work(i, slot):
        try:
            versions.replace_partitions(rows(spark, i + 1, [slot]), root, "t", "slot", [slot])
        except Exception as error:  # noqa: BLE001
            errors.append(error)

    threads = [threading.Thread(target=work, args=x) for x in enumerate(slots)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert not errors
    assert {r.slot: r["count"] for r in read(spark, root).groupBy("slot").count().collect()} == {s: i + 1 for i, s in enumerate(slots)}
    assert versions.numbers(spark, root, "t") == list(range(1, 8))


def test_only_one_takes_a_place(spark, tmp_path):
    path = str(tmp_path / "1.json")
    assert versions.place(spark, path, "a") and not versions.place(spark, path, "b")
    assert open(path).read() == "a" and sorted(p.name for p in tmp_path.iterdir() if not p.name.endswith(".crc")) == ["1.json"]


def test_empty_tables_and_old_directories(spark, root):
    none = rows(spark, 0, ["08:00"])
    versions.publish(none, root, "t", ["slot"])
    assert read(spark, root).collect() == [] and read(spark, root).columns == none.columns
    versions.publish(none, root, "flat")
    assert read(spark, root, "flat").collect() == []
    for n in (3, 4, 5):
        versions.publish(rows(spark, n, ["08:00", "08:30"]), root, "t", ["slot"])
        versions.publish(rows(spark, n, ["08:00"]), root, "flat")
    assert versions.expire(spark, root, "t", keep=1) == 0
    assert versions.expire(spark, root, "t", keep=1, older_than=0) == 4 and versions.expire(spark, root, "flat", keep=2, older_than=0) == 2
    assert read(spark, root).count() == read(spark, root, "flat").count() == 5
    assert versions.numbers(spark, root, "t") == [4] and versions.expire(spark, root, "none") == 0
    assert versions.manifest(spark, root, "none") is None
