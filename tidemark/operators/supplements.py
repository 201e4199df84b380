"""Country indicators made from others or filled from other sources. Prepared rows are (country, key, raw, observations,
year), one per country and key; the year of an average is null."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PREPARED = ("country", "key", "raw", "observations", "year")


def derived(prepared: DataFrame, first: str, second: str, key: str, rule) -> DataFrame:
    """An indicator of countries that have both others; rule makes its value from theirs. Its year is the earlier one.
    Where the rule gives null, there is no row."""
    of = lambda k, column: F.max(F.when(F.col("key") == k, F.col(column)))
    both = prepared.where(F.col("key").isin(first, second)).groupBy("country").agg(of(first, "raw").alias("_a"), of(second, "raw").alias("_b"), F.min("year").alias("year"))
    made = both.where("_a IS NOT NULL AND _b IS NOT NULL").withColumn("raw", rule(F.col("_a"), F.col("_b"))).where("raw IS NOT NULL")
    return made.select("country", F.lit(key).alias("key"), "raw", F.lit(1).cast("long").alias("observations"), "year")


def working_age(prepared: DataFrame, population: str, share: str, key: str) -> DataFrame:
    return derived(prepared, population, share, key, lambda people, percent: people * percent / 100)


def reserve_cover(prepared: DataFrame, reserves: str, imports: str, key: str) -> DataFrame:
    return derived(prepared, reserves, imports, key, lambda held, spent: F.when(spent != 0, held / spent))


def latest_value(observations: DataFrame, year: str, order: str, value: str) -> DataFrame:
    """Per country and key the value of the latest year, and of its last row by order. Nulls do not count."""
    usable = observations.where(F.col(value).isNotNull() & F.col(year).isNotNull())
    found = usable.groupBy("country", "key").agg(F.max_by(F.struct(F.col(value).alias("v"), F.col(year).alias("y")), F.struct(year, order)).alias("_l"))
    return found.select("country", "key", F.col("_l.v").alias("raw"), F.lit(1).cast("long").alias("observations"), F.col("_l.y").alias("year"))


def _filled(prepared: DataFrame, latest: DataFrame, stays: Column) -> DataFrame:
    both = prepared.alias("p").join(latest.alias("s"), (F.col("p.country") == F.col("s.country")) & (F.col("p.key") == F.col("s.key")), "full")
    keep = F.col("s.key").isNull() | (F.col("p.key").isNotNull() & stays)
    side = lambda c: F.when(keep, F.col(f"p.{c}")).otherwise(F.col(f"s.{c}")).alias(c)
    return both.select(*[side(c) for c in PREPARED], (~keep).alias("filled"))


def supplement_latest(prepared: DataFrame, latest: DataFrame, valid: Column) -> DataFrame:
    """Prepared rows that are not valid, and missing ones, are taken from latest where that has them. valid is over p.*;
    null counts as not valid."""
    return _filled(prepared, latest, F.coalesce(valid, F.lit(False)))


def supplement_newer(prepared: DataFrame, latest: DataFrame, valid: Column, since: int = 2015) -> DataFrame:
    """As above, and newer rows of latest win too; those before `since` never do. No year counts as year 0."""
    as_new = F.coalesce(F.col("p.year"), F.lit(0)) >= F.col("s.year")
    return _filled(prepared, latest.where(F.col("year") >= since), F.coalesce(valid, F.lit(False)) & as_new)
