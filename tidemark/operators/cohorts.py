"""Country cohorts: growth, validity, complete sets of inputs, weighted rankings and their distribution."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def growth_derivatives(obs: DataFrame, country: str, year: str, value: str, least: int = 5, last: int = 3) -> DataFrame:
    """Mean of the newest `last` values and population deviation of all, of countries with `least` years or more."""
    back = F.row_number().over(Window.partitionBy(country).orderBy(F.col(year).desc()))
    summed = obs.where(F.col(value).isNotNull()).withColumn("_k", back).groupBy(country).agg(F.count("*").alias("n"), F.avg(F.when(F.col("_k") <= last, F.col(value))).alias("recent_mean"), F.stddev_pop(value).alias("volatility"), F.max(year).alias("year"))
    return summed.where(F.col("n") >= least)


def valid_value(value: Column, year: Column, transform: Column, aggregation: Column, estimated: Column, first: int = 2020) -> Column:
    """Whether a prepared value counts: finite, above zero under log10, and recent if it is a latest one that is not
    estimated. Never null."""
    finite = value.isNotNull() & ~F.isnan(value) & (F.abs(value) != float("inf"))
    positive = (transform != "log10") | (value > 0)
    recent = (aggregation != "latest") | estimated | (year >= first)
    return F.coalesce(finite & positive & recent, F.lit(False))


def complete_cohort(values: DataFrame, country: str, indicator: str, inputs: list[str], score: DataFrame, n: int) -> DataFrame:
    """The n countries of highest provisional score among those that have all inputs; the ranking sees one row per
    country. Fewer complete countries than n give fewer rows, which the caller must treat as an error."""
    whole = values.where(F.col(indicator).isin(*inputs)).groupBy(country).agg(F.count_distinct(indicator).alias("_n")).where(F.col("_n") == len(inputs)).select(country)
    place = F.row_number().over(Window.orderBy(F.col("score").desc(), country))
    return score.join(whole, country, "left_semi").withColumn("place", place).where(F.col("place") <= n)


def weighted_ranking(pillars: DataFrame, weights: DataFrame, country: str, pillar: str) -> DataFrame:
    """Scores under a user's weights, which are normalised to sum to one (all zero: scores zero), and ranks."""
    share = F.coalesce(F.try_divide(F.col("weight"), F.sum("weight").over(Window.partitionBy())), F.lit(0.0))  # one row per pillar
    scored = pillars.join(weights.withColumn("_share", share), pillar).groupBy(country).agg(F.sum(F.col("pillar_score") * F.col("_share")).alias("score"))
    return scored.withColumn("rank", F.row_number().over(Window.orderBy(F.col("score").desc(), country)))


def score_histogram(scores: DataFrame, value: str, bins: int = 10) -> DataFrame:
    """Counts in equal bins between the least and the largest value, which falls in the last bin."""
    ends = scores.agg(F.min(value).alias("_a"), F.max(value).alias("_b"))
    at = F.coalesce(F.least(F.lit(bins - 1), F.floor(F.try_divide((F.col(value) - F.col("_a")) * bins, F.col("_b") - F.col("_a")))), F.lit(0)).cast("int")
    return scores.where(F.col(value).isNotNull()).crossJoin(F.broadcast(ends)).groupBy(at.alias("bin")).agg(F.count("*").alias("n"), F.min(value).alias("least"), F.max(value).alias("most"))


def rank_surprise(scores: DataFrame, sizes: DataFrame, country: str, size: str, k: int = 5) -> DataFrame:
    """Rank by size minus rank by score: the k countries furthest above and the k furthest below their size. Rankings see
    one row per country."""
    joined = scores.select(country, "score").join(sizes.select(country, size), country)
    ranked = joined.withColumns({"score_rank": F.row_number().over(Window.orderBy(F.col("score").desc(), country)), "size_rank": F.row_number().over(Window.orderBy(F.col(size).desc(), country))})
    both = ranked.withColumn("surprise", F.col("size_rank") - F.col("score_rank"))
    up = both.orderBy(F.col("surprise").desc(), country).limit(k).withColumn("side", F.lit("above"))
    return up.unionByName(both.orderBy("surprise", country).limit(k).withColumn("side", F.lit("below")))
