"""Places in an order over a whole table, without bringing the table into one task.

Rows are dealt by ranges of the order and sorted within each range; the sizes of the ranges, one row each, give the
offset at which a range starts. The ranged table is written once, as ranges are cut by a sample and would differ when cut
again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.storage import written

#: Bits of Spark's increasing ids that count rows within a partition.
WITHIN = 33


def ranged(df: DataFrame, order: list[Column], partitions: int | None = None) -> DataFrame:
    """df in ranges of the order, with _at: growing in the order, consecutive within a range, and _range, the range's
    number. Rows that are equal in the order are spread by a tie-breaker, so a value that most rows share fills many
    ranges."""
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    by = [*order, F.col("_tie").asc()]
    dealt = df.withColumn("_tie", F.monotonically_increasing_id()).repartitionByRange(n, *by).sortWithinPartitions(*by)
    at = dealt.withColumn("_at", F.monotonically_increasing_id()).drop("_tie")
    return written(at.withColumn("_range", F.shiftright("_at", WITHIN)))


def positions(df: DataFrame, order: list[Column], name: str, total: str | None = None, partitions: int | None = None) -> DataFrame:
    """df with the place of each row in the order, from 0, and with total, the number of rows. Rows equal in the order are
    placed in any order. Only the ranges' sizes, one row for each, meet in one task and are broadcast."""
    rows = ranged(df, order, partitions)
    sizes = rows.groupBy("_range").agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    whole = Window.partitionBy()
    before = F.sum("_n").over(whole.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))
    starts = sizes.select("_range", "_first", F.coalesce(before, F.lit(0)).alias("_before"), F.sum("_n").over(whole).alias("_rows"))
    placed = rows.join(F.broadcast(starts), "_range").withColumn(name, F.col("_before") + F.col("_at") - F.col("_first"))
    return placed.select(*df.columns, name, *([F.col("_rows").alias(total)] if total else []))


def positions_within(df: DataFrame, group: list[str], order: list[Column], name: str, partitions: int | None = None) -> DataFrame:
    """df with the place of each row in the order of its group, from 0; null group parts count as equal. A group that holds
    most rows lies in many ranges, and its place in each is joined by group and range."""
    rows = ranged(df, [*(F.col(g).asc() for g in group), *order], partitions)
    sizes = rows.groupBy(*group, "_range").agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    # a group has at most one row per range here
    earlier = Window.partitionBy(*group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(*[F.col(g).alias(f"_g{i}") for i, g in enumerate(group)], F.col("_range").alias("_in"), "_first", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    same = F.col("_range") == F.col("_in")
    for i, g in enumerate(group):
        same = same & F.col(g).eqNullSafe(F.col(f"_g{i}"))
    placed = rows.join(starts, same).withColumn(name, F.col("_before") + F.col("_at") - F.col("_first"))
    return placed.select(*df.columns, name)


def ranks(df: DataFrame, order: list[Column], ties: list[str], name: str, partitions: int | None = None) -> DataFrame:
    """df with the rank of each row, from 1: rows equal in `ties`, the columns that the order reads, share the least place.
    The least places are found before rows meet, one row per distinct value and range."""
    placed = positions(df, order, "_place", partitions=partitions)
    least = placed.groupBy(*[F.col(t).alias(f"_t{i}") for i, t in enumerate(ties)]).agg((F.min("_place") + 1).alias(name))
    same = F.lit(True)
    for i, t in enumerate(ties):
        same = same & F.col(t).eqNullSafe(F.col(f"_t{i}"))
    return placed.join(least, same).select(*df.columns, name)


def tile(position: Column, total: Column, k: int) -> Column:
    """SQL's ntile(k) of a place from 0: the first total mod k tiles hold one row more."""
    small, more = F.floor(total / k), total % k
    large = more * (small + 1)
    return F.when(position < large, F.floor(position / (small + 1))).otherwise(more + F.floor((position - large) / F.greatest(small, F.lit(1)))).cast("int") + 1
