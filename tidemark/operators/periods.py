"""Daily summaries of assets over weeks and quarters."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .ranking import positions

#: Days of a week and of a quarter, the anchor included.
WEEK, QUARTER = 7, 91


def period_options(summaries: DataFrame, asset: str, day: str, grain: str = "week") -> DataFrame:
    """The days that a period may end on, per asset: Saturdays and the last day held, or each month's last day held."""
    days = summaries.select(asset, day).distinct()
    if grain == "week":
        last = F.max(day).over(Window.partitionBy(asset))
        return days.withColumn("_last", last).where((F.weekday(day) == 5) | (F.col(day) == F.col("_last"))).select(asset, F.col(day).alias("anchor"))
    return days.groupBy(asset, F.trunc(day, "month").alias("_m")).agg(F.max(day).alias("anchor")).select(asset, "anchor")


def period_summary(summaries: DataFrame, anchors: DataFrame, asset: str, day: str, sums: list[str], best: str, actual: str, benchmark: str, span: int = WEEK) -> DataFrame:
    """Sums over the `span` days up to each anchor, coverage, complete and benchmarked days, the captured part of the
    benchmark (on benchmarked days) and the best day. Days are dealt into buckets of `span`, so that a period lies in two
    of them and the join is one of equality."""
    bucket = lambda d: F.floor(F.unix_date(d) / span)
    rows = summaries.withColumn("_b", F.explode(F.array(bucket(F.col(day)), bucket(F.col(day)) + 1)))
    joined = rows.join(anchors.withColumn("_b", bucket(F.col("anchor"))), [asset, "_b"]).where(F.col(day).between(F.date_sub("anchor", span - 1), F.col("anchor")))
    marked = F.col(benchmark).isNotNull()
    found = joined.groupBy(asset, "anchor").agg(
        F.count("*").alias("days"), F.count_if(F.col("status") == "complete").alias("complete_days"), F.count_if(marked).alias("benchmark_days"), *[F.sum(c).alias(c) for c in sums],
        F.sum(benchmark).alias("benchmark_value"), F.sum(F.when(marked, F.col(actual))).alias("_actual"), F.min_by(day, F.struct(-F.col(best), F.col(day))).alias("best_day"),
    )
    return found.withColumns({"coverage_pct": 100 * F.col("days") / span, "capture_pct": F.when(F.col("benchmark_value") > 0, 100 * F.col("_actual") / F.col("benchmark_value"))}).drop("_actual")


def weekly_rollup(summaries: DataFrame, asset: str, day: str, sums: list[str], actual: str, benchmark: str) -> DataFrame:
    """Sums per week that ends on a Saturday, the last one cut at the asset's last day; partial if any day is."""
    end = F.date_add(F.col(day), F.pmod(F.lit(5) - F.weekday(day), F.lit(7)))
    last = F.max(day).over(Window.partitionBy(asset))
    marked = F.col(benchmark).isNotNull()
    weeks = summaries.withColumn("week_end", F.least(end, last)).groupBy(asset, "week_end").agg(
        *[F.sum(c).alias(c) for c in sums], F.sum(benchmark).alias("benchmark_value"), F.sum(F.when(marked, F.col(actual))).alias("_actual"),
        F.when(F.bool_or(F.col("status") == "partial"), "partial").otherwise("complete").alias("status"),
    )
    return weeks.withColumn("capture_pct", F.when(F.col("benchmark_value") > 0, 100 * F.col("_actual") / F.col("benchmark_value"))).drop("_actual")


def asset_leaderboard(summaries: DataFrame, asset: str, day: str, value: str, discharge: str, start: str, end: str) -> DataFrame:
    """Value, discharge, value per MWh and rank of the assets over a range of days, ties by asset. Sums are taken in
    millionths, so that equal ones tie in whatever order their days came. The order is global and dealt by ranges, see
    ranking."""
    held = summaries.where(F.col(day).between(F.lit(start).cast("date"), F.lit(end).cast("date")))
    summed = held.groupBy(asset).agg(F.round(F.sum(value), 6).alias("value"), F.round(F.sum(discharge), 6).alias("discharge_mwh"))
    placed = positions(summed, [F.col("value").desc(), F.col(asset).asc()], "_place")
    return placed.withColumns({"value_per_mwh": F.try_divide("value", "discharge_mwh"), "rank": (F.col("_place") + 1).cast("int")}).drop("_place")


def asset_interval_series(intervals: DataFrame, asset: str, ts: str, mw: str, storage: str, price: str) -> DataFrame:
    """Units of an asset as one physical series: sums of the readings there are, null where there is none."""
    return intervals.groupBy(asset, ts).agg(F.sum(storage).alias("storage_mwh"), F.sum(mw).alias("mw"), F.max(price).alias("rrp"), F.sum("energy_value").alias("energy_value"))


def price_windows(series: DataFrame, by: list[str], price: str, order: list[str], low: float = 0.15, high: float = 0.85) -> DataFrame:
    """charge at or under the low percentile of the group's prices, discharge at or over the high one, else hold.
    Percentiles are by nearest rank: the price at place round((n - 1) * p), half to even, of the sorted ones."""
    of = Window.partitionBy(*by)
    placed = series.where(F.col(price).isNotNull()).withColumns({"_k": F.row_number().over(of.orderBy(price, *order)) - 1, "_n": F.count(price).over(of)})
    at = lambda p: F.max(F.when(F.col("_k") == F.bround((F.col("_n") - 1) * F.lit(p), 0).cast("int"), F.col(price))).over(of)
    ends = placed.withColumns({"low_price": at(low), "high_price": at(high)})
    action = F.when(F.col(price) <= F.col("low_price"), "charge").when(F.col(price) >= F.col("high_price"), "discharge").otherwise("hold")
    return ends.withColumn("action", action).drop("_k", "_n")
