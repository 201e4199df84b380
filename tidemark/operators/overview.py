"""The network at a glance: counts, pipelines, storage by facility, headline tiles."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .gas import END_USE, seasonal_percentile


def system_counts(counted: dict[str, tuple[DataFrame, Column | None]]) -> DataFrame:
    """One row with a number per name: rows of each frame, or those for which its condition holds."""
    each = [df.agg((F.count("*") if rule is None else F.count_if(rule)).alias(name)) for name, (df, rule) in counted.items()]
    return reduce(lambda a, b: a.crossJoin(b), each)  # one row each


def pipeline_registry(pipelines: DataFrame, legs: DataFrame, points: DataFrame) -> DataFrame:
    """Per pipeline (facility): legs in force, the largest capacity, the date that it holds from, connection points, and
    whether gas may flow back (more than one leg). legs: facility, effective_date, capacity; points: facility. Unrated
    pipelines stay with no legs and nulls."""
    rated = legs.groupBy("facility").agg(F.count("*").alias("legs"), F.max("capacity").alias("max_capacity"), F.max("effective_date").alias("effective_date"))
    held = points.groupBy("facility").agg(F.count("*").alias("connection_points"))
    df = pipelines.join(rated, "facility", "left").join(held, "facility", "left").withColumns({"legs": F.coalesce("legs", F.lit(0)), "connection_points": F.coalesce("connection_points", F.lit(0))})
    return df.withColumn("reverse_haul", F.col("legs") > 1)


def storage_rows(flows: DataFrame, facility: str, day: str, kind: str, held: str) -> DataFrame:
    """Per storage facility and day: held (null as zero), injected (demand), withdrawn (supply) and net."""
    s = flows.where(F.col(kind) == "STOR").groupBy(day, facility).agg(F.coalesce(F.sum(held), F.lit(0.0)).alias("held"), F.sum("demand").alias("injected"), F.sum("supply").alias("withdrawn"))
    return s.withColumn("net", F.col("injected") - F.col("withdrawn"))


def day_totals(flows: DataFrame, day: str, kind: str, facility: str) -> DataFrame:
    """Per day: rows, reporting facilities, end-use demand, pipeline receipts (kept apart, as they come again as end use) and
    supply of production and storage."""
    total = lambda rule, c: F.coalesce(F.sum(F.when(rule, F.col(c))), F.lit(0.0))
    k = F.col(kind)
    return flows.groupBy(day).agg(F.count("*").alias("rows"), F.count_distinct(facility).alias("reporting_facilities"), total(k.isin(*END_USE), "demand").alias("end_use_total"), total(k == "PIPE", "demand").alias("pipeline_receipts"), total(k.isin("PROD", "STOR"), "supply").alias("supply_total"))


def facility_storage_latest(held: DataFrame, facility: str, day: str, value: str) -> DataFrame:
    """Per facility: first and last day, its value on the last day of all (null and absent if it did not report), and the
    median of that calendar day in other years. One row per facility and day."""
    last = held.agg(F.max(day).alias("_last"))
    df = held.crossJoin(F.broadcast(last))  # one row
    d, z = F.col(day), F.col("_last")
    same = (F.month(d) == F.month(z)) & (F.dayofmonth(d) == F.dayofmonth(z)) & (F.year(d) != F.year(z))
    return df.groupBy(facility).agg(F.min(day).alias("first_day"), F.max(day).alias("last_day"), F.max(F.when(d == z, F.col(value))).alias("latest"), F.median(F.when(same, F.col(value))).alias("reference_latest")).withColumn("absent", F.col("latest").isNull())


def steady_storage(held: DataFrame, facility: str, day: str, value: str, at: Column) -> DataFrame:
    """(day, value): total of the facilities that report on day `at`, on the days when all of them do."""
    now = held.where(F.col(day) == at).select(facility).distinct()
    today = now.agg(F.count("*").alias("_today"))  # one row
    s = held.join(now, facility, "left_semi").groupBy(F.col(day).alias("day")).agg(F.sum(value).alias("value"), F.count_distinct(facility).alias("_n"))
    return s.crossJoin(F.broadcast(today)).where("_n = _today").select("day", "value")


def headline_tiles(series: dict[str, DataFrame], at: Column) -> DataFrame:
    """One row per series that has a value on day `at`: value, change and percentage against seven days before, direction,
    and the percentile among the same season of other years. Each series is (day, value), one row per day; days apart are
    nulls, and a change of nothing is flat."""
    long = reduce(DataFrame.unionByName, [df.select(F.lit(name).alias("tile"), "day", F.col("value").cast("double").alias("value")) for name, df in series.items()])
    now = long.where(F.col("day") == at)
    before = long.where(F.col("day") == F.date_sub(at, 7)).select("tile", F.col("value").alias("week_ago"))
    ranks = reduce(DataFrame.unionByName, [seasonal_percentile(df.select("day", F.col("value").cast("double").alias("value")), "day", "value").where(F.col("day") == at).select(F.lit(name).alias("tile"), "percentile") for name, df in series.items()])
    change = F.col("value") - F.col("week_ago")
    df = now.join(before, "tile", "left").join(ranks, "tile", "left").withColumns({"change": change, "change_pct": F.when(F.col("week_ago") != 0, 100 * change / F.col("week_ago"))})
    return df.select("tile", "value", "change", "change_pct", F.when(F.col("change") > 0, "up").when(F.col("change") < 0, "down").otherwise("flat").alias("direction"), "percentile")
