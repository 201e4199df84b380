"""Country indicators: effective partners, z-scores, rankings, trade links."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def effective_count(edges: DataFrame, key: str, value: str, keys: DataFrame | None = None) -> DataFrame:
    """1 / sum of squared shares: how many equal partners would be as concentrated. With keys, those without any positive
    value have 0."""
    share = F.col(value) / F.sum(value).over(Window.partitionBy(key))
    found = edges.where(F.col(value) > 0).withColumn("_s", share).groupBy(key).agg((1 / F.sum(F.col("_s") * F.col("_s"))).alias("effective_count"))
    return found if keys is None else keys.select(key).join(found, key, "left").select(key, F.coalesce("effective_count", F.lit(0.0)).alias("effective_count"))


def transformed(value: Column, transform: Column) -> Column:
    """log10 or log1p of the value, or the value itself; null where a logarithm has none."""
    return F.when(transform == "log10", F.when(value > 0, F.log10(value))).when(transform == "log1p", F.when(value > -1, F.log1p(value))).otherwise(value)


def zscores(values: DataFrame, indicator: str, value: str, direction: str, transform: str | None = None, estimated: str | None = None) -> DataFrame:
    """Population z-score per indicator, turned by its direction (1 or -1), to four places; zero where nothing varies.

    transform: column with log10, log1p or null, applied first. estimated: boolean column; mean and deviation come from
    the values that are not estimated, or from all where those are under two. A null value has a null score.
    """
    w = Window.partitionBy(indicator)
    x = transformed(F.col(value), F.col(transform)) if transform else F.col(value)
    real = F.when(~F.coalesce(F.col(estimated), F.lit(False)), x) if estimated else x
    used = F.when(F.count(real).over(w) >= 2, real).otherwise(x)
    df = values.withColumn("_x", x).withColumn("_u", used)
    spread = F.stddev_pop("_u").over(w)
    z = F.when(spread > 1e-12, (F.col("_x") - F.avg("_u").over(w)) / spread * F.col(direction)).when(F.col("_x").isNotNull(), 0.0)
    return df.withColumn("z", F.round(z, 4)).drop("_x", "_u")


def pillar_scores(z: DataFrame, country: str, pillar: str) -> DataFrame:
    """Mean of the scores of each country and pillar, to four places; null scores are left out."""
    return z.groupBy(country, pillar).agg(F.round(F.avg("z"), 4).alias("pillar_score"))


def model_scores(pillars: DataFrame, country: str) -> DataFrame:
    """Mean over pillars and rank; the ranking sees one row per country."""
    scored = pillars.groupBy(country).agg(F.round(F.avg("pillar_score"), 4).alias("score"))
    return scored.withColumn("rank", F.row_number().over(Window.orderBy(F.col("score").desc(), country)))


def trade_links(edges: DataFrame, country: str, partner: str, value: str, k: int = 6) -> DataFrame:
    """The k largest partners of each country with their share of all its exports."""
    w = Window.partitionBy(country)
    place = F.row_number().over(w.orderBy(F.col(value).desc(), partner))
    return edges.where(F.col(value) > 0).withColumns({"share": F.col(value) / F.sum(value).over(w), "rank": place}).where(F.col("rank") <= k)


def prepare_indicators(obs: DataFrame, country: str, indicator: str, year: str, value: str, first: int = 2015, least: int = 5) -> DataFrame:
    """Latest value, and mean with at least `least` observations, of years from `first` on."""
    s = obs.where((F.col(year) >= first) & F.col(value).isNotNull()).groupBy(country, indicator)
    return s.agg(F.max(year).alias("year"), F.max_by(value, year).alias("latest"), F.when(F.count("*") >= least, F.avg(value)).alias("average"), F.count("*").alias("n"))
