"""Forecast runs looked back on: origins, horizons, errors and rankings."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def backtest_origins(latest: DataFrame, day: str, weeks: int) -> DataFrame:
    """The latest Sunday at or before `day` of each row and the `weeks` Sundays before it."""
    sunday = F.date_sub(F.to_date(day), F.pmod(F.weekday(day) + 1, F.lit(7)))
    return latest.select(*[c for c in latest.columns if c != day], F.explode(F.sequence(F.date_sub(sunday, 7 * weeks), sunday, F.expr("interval 7 days"))).alias("origin"))


def target_grid(origins: DataFrame, origin: str, days: int = 7, per_day: int = 48) -> DataFrame:
    """Each origin with the ends of the intervals of its horizon; the first ends one interval after the origin."""
    step = F.make_dt_interval(mins=F.lit(1440 // per_day))
    at = F.col(origin).cast("timestamp")
    return origins.withColumn("interval_end", F.explode(F.sequence(at + step, at + F.make_dt_interval(days=F.lit(days)), step)))


def completed_origins(runs: DataFrame, prices: DataFrame, region: str, origin: str, day: str, horizon: int = 7) -> DataFrame:
    """Distinct origins whose horizon lies within what is held of the region, numbered from the newest."""
    held = prices.groupBy(region).agg(F.max(day).alias("_last"))
    done = runs.select(region, origin).distinct().join(held, region).where(F.date_add(origin, horizon) <= F.col("_last")).drop("_last")
    return done.withColumn("place", F.row_number().over(Window.partitionBy(region).orderBy(F.col(origin).desc())))


def forecast_errors(points: DataFrame, actuals: DataFrame, on: list[str], origin: str, day: str, actual: str) -> DataFrame:
    """Points with their horizon in days, the settled value and the error; unsettled ones stay with nulls."""
    joined = points.join(actuals.select(*on, F.col(actual).alias("actual")), on, "left")
    return joined.withColumns({"horizon_days": F.date_diff(day, origin), "error": F.col("predicted") - F.col("actual")})


def performance_summary(scores: DataFrame, region: str, model: str, origin: str, baseline: str, safe: str | None = None) -> DataFrame:
    """Per region and model, over all scored origins: weeks, mean errors, the worst one, skill from the mean errors, and
    beside them the newest origin of the region and its error. With safe, a boolean column, also whether all origins are
    leakage-safe."""
    more = [F.bool_and(safe).alias("leakage_safe")] if safe else []
    newest = F.max(origin).over(Window.partitionBy(region))
    all_weeks = scores.withColumn("_newest", newest).groupBy(region, model).agg(
        F.count_distinct(origin).alias("weeks"), F.avg("mae").alias("avg_mae"), F.avg("median_ae").alias("avg_median_ae"), F.max("max_ae").alias("worst_error"),
        F.max("_newest").alias("last_origin"), F.max(F.when(F.col(origin) == F.col("_newest"), F.col("mae"))).alias("last_mae"), *more,
    )
    base = F.max(F.when(F.col(model) == baseline, F.col("avg_mae"))).over(Window.partitionBy(region))
    return all_weeks.withColumn("avg_skill", 1 - F.try_divide(F.col("avg_mae"), base))


def model_ranking(summary: DataFrame, region: str, model: str, baseline: str) -> DataFrame:
    """The best model of each region by mean skill, the baseline apart."""
    place = F.row_number().over(Window.partitionBy(region).orderBy(F.col("avg_skill").desc_nulls_last(), model))
    return summary.where(F.col(model) != baseline).withColumn("_k", place).where("_k = 1").drop("_k")


def forecast_vs_actual(points: DataFrame, actuals: DataFrame, on: list[str], model: str, models: list[str], actual: str) -> DataFrame:
    """One row per interval: the settled value beside a column per model; either may be missing."""
    wide = points.groupBy(*on).agg(*[F.max(F.when(F.col(model) == m, F.col("predicted"))).alias(m) for m in models])
    return wide.join(actuals.select(*on, F.col(actual).alias("actual")), on, "full")


def forecast_axis(points: DataFrame, actuals: DataFrame, by: list[str], ts: str, origin: str, actual: str, model: str, models: list[str], days: int = 7) -> DataFrame:
    """What a chart of each run (by: the region, and origin) shows: the settled intervals of the `days` before the origin,
    then those forecast, with the settled value and a column per model, which is null before the origin. context tells the
    two apart."""
    ahead = points.groupBy(*by, origin, ts).agg(*[F.max(F.when(F.col(model) == m, F.col("predicted"))).alias(m) for m in models]).join(actuals.select(*by, ts, F.col(actual).alias("actual")), [*by, ts], "left").withColumn("context", F.lit(False))
    runs = points.select(*by, origin).distinct()
    behind = runs.join(actuals.select(*by, ts, F.col(actual).alias("actual")).where("actual IS NOT NULL"), by).where((F.col(ts) <= F.col(origin)) & (F.col(ts) > F.col(origin) - F.make_dt_interval(days=F.lit(days))))
    behind = behind.withColumns({m: F.lit(None).cast("double") for m in models}).withColumn("context", F.lit(True))
    return ahead.unionByName(behind)


def forecast_progress(points: DataFrame, actuals: DataFrame, on: list[str], by: list[str], actual: str) -> DataFrame:
    """Per run: intervals forecast, those settled, and whether all are. Repeated points of several models count once."""
    asked = points.select(*by, *[c for c in on if c not in by]).distinct()
    settled = asked.join(actuals.select(*on, F.col(actual).alias("_a")), on, "left")
    return settled.groupBy(*by).agg(F.count("*").alias("total"), F.count("_a").alias("settled")).withColumn("complete", F.col("settled") == F.col("total"))


def weather_error(readings: DataFrame, key: list[str], kind: str, value: str) -> DataFrame:
    """Observed and forecast readings side by side, and forecast minus observed; one that is missing is null, and so is the
    error. Of repeated readings the greatest counts."""
    of = lambda k: F.max(F.when(F.col(kind) == k, F.col(value)))
    return readings.groupBy(*key).agg(of("observed").alias("observed"), of("forecast").alias("forecast")).withColumn("error", F.col("forecast") - F.col("observed"))
