"""Natural keys: one row per key, merges by revision, gaps and coverage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def dedupe_last(df: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """The last row of each key. `order` must be total within a key."""
    place = F.row_number().over(Window.partitionBy(*key).orderBy(*[c.desc() for c in order]))
    return df.withColumn("_place", place).where("_place = 1").drop("_place")


def same_key(a: DataFrame, b: DataFrame, key: list[str]) -> Column:
    on = F.lit(True)
    for k in key:
        on = on & a[k].eqNullSafe(b[k])
    return on


def newest_wins_merge(stored: DataFrame, incoming: DataFrame, key: list[str], updated: str) -> DataFrame:
    """stored with incoming merged in. An incoming row gives way only if both stamps exist and its own is older; ties
    and missing stamps overwrite. Keys are unique on either side; null key parts count as equal."""
    held = stored.select(*key, F.col(updated).alias("_held"), F.lit(True).alias("_stored"))
    stale = F.col("_stored") & (F.col(updated) < F.col("_held"))
    kept = incoming.join(held, same_key(incoming, held, key), "left").where(~F.coalesce(stale, F.lit(False))).select(*[incoming[c] for c in incoming.columns])
    rest = stored.join(kept.select(*key), same_key(stored, kept, key), "left_anti")
    return rest.unionByName(kept)


def plain_upsert(stored: DataFrame, incoming: DataFrame, key: list[str]) -> DataFrame:
    """stored with the rows of incoming in place of those of the same key, and new ones added. Null key parts count as
    equal; keys are unique on either side; either side may be empty."""
    return stored.join(incoming.select(*key), same_key(stored, incoming, key), "left_anti").unionByName(incoming)


def superseded(stored: DataFrame, incoming: DataFrame, key: list[str], updated: str) -> DataFrame:
    """One row: how many incoming rows newest_wins_merge leaves out as older than what is stored, and how many it takes."""
    held = stored.select(*key, F.col(updated).alias("_held"))
    stale = F.coalesce(F.col(updated) < F.col("_held"), F.lit(False))
    return incoming.join(held, same_key(incoming, held, key), "left").agg(F.count_if(stale).alias("superseded"), F.count_if(~stale).alias("kept"))


def replace_slice(stored: DataFrame, incoming: DataFrame, slice_cols: list[str]) -> DataFrame:
    """All of the slices that incoming touches are replaced. Null slice columns count as equal; an empty incoming changes
    nothing; repeated rows stay."""
    touched = incoming.select(*slice_cols).distinct()
    return stored.join(touched, same_key(stored, touched, slice_cols), "left_anti").unionByName(incoming)


def orphan_split(df: DataFrame, dim: DataFrame, key: list[str]) -> tuple[DataFrame, DataFrame]:
    """Rows whose key the dimension holds, and the others; a null key part is in no dimension. Repeated rows stay."""
    known = dim.select(*key)
    return df.join(known, key, "left_semi"), df.join(known, key, "left_anti")


def null_unknown_fk(df: DataFrame, dim: DataFrame, column: str, dim_key: str) -> DataFrame:
    """All rows, the column null where the dimension does not hold it. Repeated rows and dimension keys change nothing."""
    known = dim.select(F.col(dim_key).alias("_known")).distinct()
    return df.join(known, df[column] == F.col("_known"), "left").withColumn(column, F.col("_known")).drop("_known")


def source_coverage(facts: DataFrame, source: str, day: str) -> DataFrame:
    """First and last day and number of rows per source; null days count as rows only. An empty table gives no rows."""
    return facts.groupBy(source).agg(F.min(day).alias("earliest"), F.max(day).alias("latest"), F.count("*").alias("rows_stored"))


def coverage_margin(coverage: DataFrame, windows: DataFrame, gaps: DataFrame, today: Column, urgent_days: int = 7) -> DataFrame:
    """How long each source can stay unread before rows leave its window at the publisher.

    coverage: source, earliest, latest; windows: source, direction ('backward' or 'forward') and window_days (null: no
    end); gaps: source, missing_days. A backward source is behind by today - latest days and loses rows window_days less
    those from now; a forward one is ahead by latest - today and loses none. urgent: at most `urgent_days` left, or any gap. A source without rows
    has nulls, and is urgent only by its gaps.
    """
    df = windows.join(coverage, "source", "left").join(gaps, "source", "left").withColumn("missing_days", F.coalesce("missing_days", F.lit(0)))
    back, lag = F.col("direction") == "backward", F.date_diff(today, "latest")
    out = df.withColumns({"days_behind": F.when(back, lag), "days_ahead": F.when(~back, -lag), "days_until_loss": F.when(back, F.col("window_days") - lag)})
    return out.withColumn("urgent", F.coalesce(F.col("days_until_loss") <= urgent_days, F.lit(False)) | (F.col("missing_days") > 0))


def missing_days(df: DataFrame, day: str) -> DataFrame:
    """Calendar days between the first and the last held that no row has."""
    held = df.select(F.col(day).cast("date").alias("day")).distinct()
    span = held.agg(F.min("day").alias("a"), F.max("day").alias("b")).where("a IS NOT NULL")
    return span.select(F.explode(F.sequence("a", "b")).alias("day")).join(held, "day", "left_anti")


def completeness_gate(df: DataFrame, key: str, day: Column, expected: int) -> DataFrame:
    """Keys and days whose number of rows is not the expected one; days on which others have rows count as zero. Rows
    without a day are left out. Only the days that a key lacks are added, from the array of all days, which the calendar
    bounds; no grid of keys and days is made."""
    counted = df.groupBy(F.col(key), day.alias("day")).agg(F.count("*").alias("n")).where("day IS NOT NULL")
    wrong = counted.where(F.col("n") != expected)
    if expected == 0:
        return wrong
    days = counted.agg(F.collect_set("day").alias("_all"))
    held = counted.groupBy(key).agg(F.collect_set("day").alias("_held"))
    lacking = held.crossJoin(F.broadcast(days)).select(key, F.explode(F.array_except("_all", "_held")).alias("day"), F.lit(0).cast("long").alias("n"))  # one row
    return wrong.unionByName(lacking)


def overlap_check(df: DataFrame, key: str, start: str, end: str) -> DataFrame:
    """Rows whose range (both ends inclusive, a null end open) starts before an earlier one of the key has ended."""
    order = Window.partitionBy(key).orderBy(start, F.coalesce(end, F.lit("9999-12-31").cast("date")))
    reach = F.max(F.coalesce(end, F.lit("9999-12-31").cast("date"))).over(order.rowsBetween(Window.unboundedPreceding, -1))
    return df.withColumn("_reach", reach).where(F.col("_reach") >= F.col(start)).drop("_reach")
