"""Interval price series: roll-ups, weighted aggregates, weekly-lag forecasts and their scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.calendar import interval_end
from .order_stats import order_statistics, quantile

#: Fixed value: the market's floor price.
FLOOR = -1000.0


def half_hour_rollup(df: DataFrame, key: list[str], ts: str, columns: list[str], minutes: int = 30) -> DataFrame:
    """Means per key and interval, stamped by the interval's end."""
    return df.groupBy(*key, interval_end(F.col(ts), minutes).alias("interval_end")).agg(*[F.avg(c).alias(c) for c in columns])


def interpolate_half_hours(df: DataFrame, key: list[str], ts: str, value: str) -> DataFrame:
    """Hourly readings, and the midpoint to a next reading that is exactly an hour later."""
    order = Window.partitionBy(*key).orderBy(ts)
    after, later = F.lead(value).over(order), F.lead(ts).over(order)
    own = F.struct(F.col(ts).alias("t"), F.col(value).alias("v"))
    middle = F.struct((F.col(ts) + F.expr("interval 30 minutes")).alias("t"), ((F.col(value) + F.col("_after")) / 2).alias("v"))
    both = df.withColumns({"_after": after, "_later": later}).withColumn("_x", F.explode(F.when(F.col("_later") == F.col(ts) + F.expr("interval 1 hour"), F.array(own, middle)).otherwise(F.array(own))))
    return both.select(*key, F.col("_x.t").alias(ts), F.col("_x.v").alias(value))


def demand_shares(df: DataFrame, region: str, demand: str) -> DataFrame:
    """Each region's part of all demand."""
    total = df.groupBy(region).agg(F.sum(demand).alias("_d"))
    return total.crossJoin(F.broadcast(total.agg(F.sum("_d").alias("_all")))).select(region, F.try_divide("_d", "_all").alias("share"))


def market_aggregate(df: DataFrame, region: str, ts: str, price: str, demand: str, market: str = "ALL") -> DataFrame:
    """Demand-weighted price and total demand of each interval over the regions present, never over the market itself."""
    rows = df.where((F.col(region) != market) & F.col(price).isNotNull() & F.col(demand).isNotNull())
    summed = rows.groupBy(ts).agg(F.sum(F.col(price) * F.col(demand)).alias("_w"), F.sum(demand).alias(demand)).where(F.col(demand) != 0)
    return summed.select(F.lit(market).alias(region), ts, (F.col("_w") / F.col(demand)).alias(price), demand)


def lagged(df: DataFrame, key: list[str], day: str, value: str, lags: list[int]) -> DataFrame:
    """(key, day, lag, lag_value): each value moved forward by each lag in days. One explode, so that a single join on
    (key, day) serves all lags."""
    return df.select(*key, F.explode(F.array(*[F.lit(x) for x in lags])).alias("lag"), F.col(day).alias("_d"), F.col(value).alias("lag_value")).select(*key, F.date_add("_d", F.col("lag")).alias(day), "lag", "lag_value")


def seasonal_naive(df: DataFrame, grid: DataFrame, key: list[str], day: str, value: str, lag: int = 7) -> DataFrame:
    """The value a week before, not under the floor; no row where there is none."""
    return grid.join(lagged(df, key, day, value, [lag]), [*key, day]).select(*grid.columns, F.greatest(F.lit(FLOOR), "lag_value").alias("predicted"))


def rolling_median(df: DataFrame, grid: DataFrame, key: list[str], day: str, value: str, weeks: int = 4) -> DataFrame:
    """The median of the same weekday over the weeks before, of those there are."""
    joined = grid.join(lagged(df, key, day, value, [7 * k for k in range(1, weeks + 1)]), [*key, day])
    return joined.groupBy(*grid.columns).agg(F.greatest(F.lit(FLOOR), F.median("lag_value")).alias("predicted"))


def score_runs(points: DataFrame, actuals: DataFrame, run: list[str], on: list[str], actual: str, large: bool = False) -> DataFrame:
    """n, mean, median and largest absolute error of each run over what is settled. large: runs whose distinct errors one
    task should not hold; the median then comes from refined histograms, and is the same."""
    error = F.abs(F.col("predicted") - F.col(actual))
    if large:
        met = points.join(actuals.select(*on, actual), on).select(*run, error.alias("_error"))
        found = met.groupBy(*run).agg(F.count("*").alias("_all"), F.avg("_error").alias("mae"), F.max("_error").alias("max_ae"))
        middle = order_statistics(met, run, "_error", {"median_ae": quantile(0.5)}).select(*run, "median_ae")
        return found.join(middle, run, "left").select(*run, F.col("_all").alias("n"), "mae", "median_ae", "max_ae")
    return points.join(actuals.select(*on, actual), on).groupBy(*run).agg(F.count("*").alias("n"), F.avg(error).alias("mae"), F.median(error).alias("median_ae"), F.max(error).alias("max_ae"))


def skill(scores: DataFrame, by: list[str], model: str, baseline: str) -> DataFrame:
    """1 - MAE / MAE of the baseline of the same origin; null without a baseline."""
    base = F.max(F.when(F.col(model) == baseline, F.col("mae"))).over(Window.partitionBy(*by))
    return scores.withColumn("skill", 1 - F.try_divide(F.col("mae"), base))


def temperature_pairs(df: DataFrame, key: list[str], day: str, price: str, temperature: str, lag: int = 7, comfort: float = 18.0) -> DataFrame:
    """Week-on-week changes of price, of cooling and of heating degrees."""
    before = df.select(*key, F.date_add(day, lag).alias(day), F.col(price).alias("_p"), F.col(temperature).alias("_t"))
    cooling = lambda t: F.greatest(F.lit(0.0), t - comfort)
    heating = lambda t: F.greatest(F.lit(0.0), comfort - t)
    return df.join(before, [*key, day]).select(*key, day, (cooling(F.col(temperature)) - cooling(F.col("_t"))).alias("d_cool"), (heating(F.col(temperature)) - heating(F.col("_t"))).alias("d_heat"), (F.col(price) - F.col("_p")).alias("d_price"))


def fit_betas(pairs: DataFrame, by: list[str], least: int = 40, large: bool = False) -> DataFrame:
    """Least squares through the origin of d_price on d_cool and d_heat per group, without prices outside the 2nd to
    98th percentile; groups of fewer pairs get zeros and a reason. Where the inputs are collinear, cooling alone is fitted if
    it varies at all, else heating alone. large: groups whose distinct prices one task should not hold; the percentiles
    then come from refined histograms, and are the same."""
    if large:
        bounds = order_statistics(pairs, by, "d_price", {"_lo": quantile(0.02), "_hi": quantile(0.98)}).withColumnRenamed("n", "_n")
    else:
        bounds = pairs.groupBy(*by).agg(F.count("*").alias("_n"), F.percentile("d_price", 0.02).alias("_lo"), F.percentile("d_price", 0.98).alias("_hi"))
    kept = pairs.join(bounds, by).where(F.col("d_price").between(F.col("_lo"), F.col("_hi")))
    c, h, p = F.col("d_cool"), F.col("d_heat"), F.col("d_price")
    s = kept.groupBy(*by).agg(F.sum(c * c).alias("cc"), F.sum(h * h).alias("hh"), F.sum(c * h).alias("ch"), F.sum(c * p).alias("cp"), F.sum(h * p).alias("hp"), F.max("_n").alias("n_pairs"))
    det = F.col("cc") * F.col("hh") - F.col("ch") * F.col("ch")
    few, whole = F.col("n_pairs") < least, det != 0
    cool = F.when(few, 0.0).when(whole, F.try_divide(F.col("cp") * F.col("hh") - F.col("hp") * F.col("ch"), det)).when(F.col("cc") != 0, F.try_divide("cp", "cc")).otherwise(0.0)
    heat = F.when(few, 0.0).when(whole, F.try_divide(F.col("hp") * F.col("cc") - F.col("cp") * F.col("ch"), det)).when((F.col("cc") == 0) & (F.col("hh") != 0), F.try_divide("hp", "hh")).otherwise(0.0)
    return s.select(*by, "n_pairs", cool.alias("beta_cool"), heat.alias("beta_heat"), F.when(few, "too few pairs").alias("reason"))


def headline_stats(df: DataFrame, region: str, day: str, price: str, demand: str, days: int = 7) -> DataFrame:
    """Price statistics and peak demand over each region's last days."""
    last = df.groupBy(region).agg(F.max(day).alias("_last"))
    rows = df.join(last, region).where(F.col(day) > F.date_sub("_last", days))
    return rows.groupBy(region).agg(F.avg(price).alias("avg_price"), F.min(price).alias("min_price"), F.max(price).alias("max_price"), F.count("*").alias("n"), (100 * F.avg((F.col(price) < 0).cast("int"))).alias("pct_negative"), F.max(demand).alias("peak_demand"))


def daily_history(df: DataFrame, key: list[str], ts: str, price: str, days: int | None = None) -> DataFrame:
    """By the date of the interval's end: midnight belongs to the day that it starts. With days, the last so many days up to
    the newest of the whole frame."""
    each = df.groupBy(*key, F.to_date(ts).alias("day")).agg(F.avg(price).alias("avg_price"), F.min(price).alias("min_price"), F.max(price).alias("max_price"))
    if days is None:
        return each
    return each.crossJoin(F.broadcast(df.agg(F.max(F.to_date(ts)).alias("_last")))).where(F.col("day") > F.date_sub("_last", days)).drop("_last")  # one row
