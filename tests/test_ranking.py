"""Distributed places, ranks and tiles against SQL windows."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.operators import periods, ranking


@pytest.fixture(scope="module")
def rows(spark):
    rnd = random.Random(4)
    values = [None if rnd.random() < 0.1 else 7 if rnd.random() < 0.4 else rnd.randint(0, 50) for _ in range(500)]
    return spark.createDataFrame([(i, v, rnd.choice(["a", "a", "a", "b", None])) for i, v in enumerate(values)], "id int, v int, g string").repartition(5)


def in_window(df, expr):
    return sorted(df.withColumn("w", expr).select("id", "w").collect())


@pytest.mark.parametrize("partitions", [1, 3, 40])
def test_positions_are_row_numbers(rows, partitions):
    got = ranking.positions(rows, [F.desc_nulls_last("v"), F.asc("id")], "w", total="n", partitions=partitions)
    assert {r["n"] for r in got.collect()} == {500}
    assert sorted(got.select("id", "w").collect()) == in_window(rows, F.row_number().over(Window.orderBy(F.desc_nulls_last("v"), "id")) - 1)


@pytest.mark.parametrize("partitions", [1, 7])
def test_positions_within_groups(rows, partitions):
    got = ranking.positions_within(rows, ["g"], [F.asc("v"), F.asc("id")], "w", partitions)
    assert sorted(got.select("id", "w").collect()) == in_window(rows, F.row_number().over(Window.partitionBy("g").orderBy("v", "id")) - 1)
    assert got.columns == [*rows.columns, "w"]


def test_ranks_share_ties(rows):
    got = ranking.ranks(rows, [F.desc("v")], ["v"], "w", 6)
    assert sorted(got.select("id", "w").collect()) == in_window(rows, F.rank().over(Window.orderBy(F.desc("v"))))


@pytest.mark.parametrize("n", [0, 1, 2, 3, 7, 10])
def test_tiles(spark, n):
    df = spark.range(n).withColumnRenamed("id", "id")
    got = ranking.positions(df, [F.asc("id")], "p", total="n", partitions=3).withColumn("w", ranking.tile(F.col("p"), F.col("n"), 3))
    assert sorted(got.select("id", "w").collect()) == in_window(df, F.ntile(3).over(Window.orderBy("id")))


def test_equal_rows_fill_many_ranges(spark):
    rows = ranking.ranged(spark.range(4000).select(F.lit(1).alias("v")).repartition(4), [F.asc("v")], 8)
    assert rows.select("_range").distinct().count() > 4


def test_equal_sums_rank_by_asset(spark):
    days = [("b", "2026-01-01", 0.1), ("b", "2026-01-02", 0.2), ("b", "2026-01-03", 0.3), ("a", "2026-01-01", 0.3), ("a", "2026-01-02", 0.2), ("a", "2026-01-03", 0.1)]
    df = spark.createDataFrame([(a, d, v, 1.0) for a, d, v in days], "asset string, day string, value double, discharge double").withColumn("day", F.col("day").cast("date")).coalesce(1)
    got = periods.asset_leaderboard(df, "asset", "day", "value", "discharge", "2026-01-01", "2026-12-31").collect()
    assert sorted((r["rank"], r["asset"], r["value"]) for r in got) == [(1, "a", 0.6), (2, "b", 0.6)]
