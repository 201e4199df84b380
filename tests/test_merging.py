"""Merges that touch only their batch's days: plans, files, batches that come twice, and crashes between write and commit."""

import os

import pytest
from pyspark.sql import functions as F

from tidemark.operators import keys, merging
from tidemark.streaming import runs

SCHEMA = "k int, at int, v string, day date"


def frame(spark, rows):
    raw = spark.createDataFrame(rows, "k int, at int, v string, day string")
    return raw.withColumn("day", F.col("day").cast("date"))


STORED = [(1, 5, "a", "2024-01-01"), (2, 5, "b", "2024-01-01"), (1, 5, "c", "2024-01-02"), (3, 5, "d", "2024-01-03"), (4, 5, "none", None)]
BATCH = [(1, 9, "newer", "2024-01-02"), (2, 1, "new", "2024-01-02"), (5, 0, "first", "2024-02-01"), (4, 4, "stale", None)]


@pytest.fixture
def table(spark, tmp_path):
    path = f"file://{tmp_path}/table"
    merging.write_days(frame(spark, STORED), path, "day")
    return path, f"file://{tmp_path}/staging"


def held(spark, path):
    return sorted((tuple(r) for r in merging.read_table(spark, path, frame(spark, STORED).schema).withColumn("day", F.col("day").cast("string")).collect()), key=repr)


def files(path):
    root = path.removeprefix("file://")
    return {os.path.relpath(os.path.join(d, f), root) for d, _, names in os.walk(root) for f in names if f.endswith(".parquet")}


def merged(stored, batch, merge):
    return sorted((tuple(r) for r in merge(stored, batch).withColumn("day", F.col("day").cast("string")).collect()), key=repr)


@pytest.mark.parametrize("kind", ["newest", "upsert", "replace"])
def test_same_rows_as_a_merge_of_all(spark, table, kind):
    path, staging = table
    merge = {"newest": merging.newest_wins(["k", "day"], "at"), "upsert": merging.upsert(["k", "day"]), "replace": merging.replace(["day"])}[kind]
    whole = {"newest": lambda a, b: keys.newest_wins_merge(a, b, ["k", "day"], "at"), "upsert": lambda a, b: keys.plain_upsert(a, b, ["k", "day"]), "replace": lambda a, b: keys.replace_slice(a, b, ["day"])}[kind]
    want = merged(frame(spark, STORED), frame(spark, BATCH), whole)
    before = files(path)
    merging.merge_into(spark, path, frame(spark, BATCH), "day", merge, staging)
    assert held(spark, path) == want
    untouched = {f for f in before if "2024-01-01" in f or "2024-01-03" in f}
    assert len(untouched) == 2 and untouched <= files(path)  # files of other days keep their names


def test_plan_filters_the_stored_side_by_partition(spark, table):
    path, _ = table
    one_day = frame(spark, [(1, 9, "x", "2024-01-02")])
    plan = merging.merged_days(spark, path, one_day, "day", merging.upsert(["k", "day"]))._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "2024-01-02" in plan.split("PartitionFilters: [")[1].split("]")[0]
    days = one_day.select("day").distinct()
    assert merging.stored_days(spark, path, one_day.schema, "day", days).count() == 1


def test_many_days_are_joined(spark, table):
    path, _ = table
    assert isinstance(merging.touched_days(frame(spark, STORED), "day", most=2), type(frame(spark, STORED)))
    got = merging.stored_days(spark, path, frame(spark, STORED).schema, "day", merging.touched_days(frame(spark, BATCH), "day", most=1))
    assert sorted(r["v"] for r in got.collect()) == ["c", "none"]


@pytest.mark.parametrize("crash", ["staging", "amid", "after"])
def test_a_crash_and_a_second_delivery_change_nothing(spark, table, crash, monkeypatch):
    path, staging = table
    batch, merge = frame(spark, BATCH), merging.newest_wins(["k", "day"], "at")
    want = merged(frame(spark, STORED), batch, lambda a, b: keys.newest_wins_merge(a, b, ["k", "day"], "at"))
    write = merging.write_days

    def dies(df, at, day):
        if crash == "after":
            write(df, at, day)
        if crash == "amid":  # one day is already gone when the job dies
            import shutil

            shutil.rmtree(f"{path.removeprefix('file://')}/day=2024-01-02")
        raise RuntimeError("executor lost")

    if crash == "staging":  # half-written staged days, without Spark's mark
        os.makedirs(f"{staging.removeprefix('file://')}/3")
    else:
        monkeypatch.setattr(merging, "write_days", dies)
        with pytest.raises(RuntimeError):
            merging.merge_into(spark, path, batch, "day", merge, staging, 3)
        monkeypatch.undo()
    for _ in range(2):
        merging.merge_into(spark, path, batch, "day", merge, staging, 3)
        assert held(spark, path) == want


def test_into_no_table_and_an_empty_batch(spark, tmp_path):
    path, staging = f"file://{tmp_path}/none", f"file://{tmp_path}/s"
    assert held(spark, path) == []
    merging.merge_into(spark, path, frame(spark, BATCH), "day", merging.upsert(["k", "day"]), staging, 0)
    assert len(held(spark, path)) == 4
    merging.merge_into(spark, path, frame(spark, BATCH).where("false"), "day", merging.upsert(["k", "day"]), staging, 1)
    assert len(held(spark, path)) == 4


def test_batches_of_a_stream_replace_themselves(spark, tmp_path):
    sink = runs.once_per_batch(f"file://{tmp_path}/out")
    for rows, batch in (([1, 2], 0), ([3], 1), ([3], 1), ([1, 2], 0)):
        sink(spark.createDataFrame([(r,) for r in rows], "a int"), batch)
    assert sorted(r["a"] for r in spark.read.parquet(f"file://{tmp_path}/out").collect()) == [1, 2, 3]


def test_a_failed_run_goes_on_from_its_checkpoint(spark, tmp_path):
    source, done = f"file://{tmp_path}/in", []
    spark.createDataFrame([(1,), (2,)], "a int").write.parquet(source)
    stream = lambda: spark.readStream.schema("a int").parquet(source)
    write = runs.once_per_batch(f"file://{tmp_path}/out")

    def fails(batch, batch_id):
        write(batch, batch_id)
        raise RuntimeError("between write and commit")

    with pytest.raises(Exception, match="between write and commit"):
        runs.run_available(stream(), fails, f"file://{tmp_path}/checkpoint")
    runs.run_available(stream(), lambda batch, i: (write(batch, i), done.append(i)), f"file://{tmp_path}/checkpoint")
    assert done == [0] and sorted(r["a"] for r in spark.read.parquet(f"file://{tmp_path}/out").collect()) == [1, 2]
