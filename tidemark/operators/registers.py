"""Registers against what is held: system summary, second-pass notes, missing runs, mapping and fleet coverage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def system_summary(facilities: DataFrame, kind: str, active: Column) -> DataFrame:
    """Facilities by kind, in all and active. A null state is not active."""
    return facilities.groupBy(kind).agg(F.count("*").alias("total"), F.count_if(active).alias("active"))


def annotate(points: DataFrame, notes: DataFrame, keys: list[str], column: str) -> DataFrame:
    """Points with `column` taken from notes (one row per key) where those have it; no point is added. `updated` tells which."""
    found = notes.select(*keys, F.col(column).alias("_note"))
    joined = points.join(found, keys, "left").withColumn(column, F.coalesce("_note", column))
    return joined.withColumn("updated", F.col("_note").isNotNull()).drop("_note")


def unmatched(points: DataFrame, notes: DataFrame, keys: list[str]) -> DataFrame:
    """Notes on points that are not held."""
    return notes.join(points.select(*keys), keys, "left_anti")


def missing_runs(regions: DataFrame, runs: DataFrame, region: str, origin: str) -> DataFrame:
    """Regions without a run for the latest origin that any region has; without runs, all of them."""
    last = runs.agg(F.max(origin).alias("_last"))  # one row
    current = runs.join(F.broadcast(last), F.col(origin) == F.col("_last"), "left_semi").select(region)
    return regions.join(current, region, "left_anti")


def mapped_energy(readings: DataFrame, registry: DataFrame, unit: str, value: str, label: str) -> DataFrame:
    """Readings above zero with their five-minute energy and the label of their unit, null if the registry (one row per unit) lacks it."""
    energy = (F.greatest(F.col(value), F.lit(0.0)) / 12).alias("energy")
    return readings.select("*", energy).where("energy > 0").join(registry.select(unit, label), unit, "left")


def mapping_coverage(mapped: DataFrame, day: str, label: str, least: float = 0.95) -> DataFrame:
    """Per day the mapped and unknown energy, the mapped share, and whether it is `least` or more."""
    known = F.col(label).isNotNull()
    part = lambda rule, name: F.sum(F.when(rule, F.col("energy")).otherwise(0.0)).alias(name)
    sums = mapped.groupBy(day).agg(part(known, "mapped_mwh"), part(~known, "unknown_mwh"))
    share = F.col("mapped_mwh") / (F.col("mapped_mwh") + F.col("unknown_mwh"))
    return sums.withColumn("coverage", share).withColumn("passed", (F.col("mapped_mwh") > 0) & (F.col("coverage") >= least))


def unknown_units(mapped: DataFrame, unit: str, label: str) -> DataFrame:
    return mapped.where(F.col(label).isNull()).groupBy(unit).agg(F.sum("energy").alias("unknown_mwh"))


def fleet_coverage(assets: DataFrame, totals: DataFrame, region: str, capacity: str, total: str) -> DataFrame:
    """Per region of totals (one row each): covered assets and capacity, and their percentage of the region's total."""
    covered = assets.groupBy(region).agg(F.count("*").alias("assets"), F.sum(capacity).alias("covered"))
    both = totals.join(covered, region, "left").withColumns({"assets": F.coalesce("assets", F.lit(0)), "covered": F.coalesce("covered", F.lit(0.0))})
    return both.withColumn("covered_pct", F.when(F.col(total) > 0, 100 * F.col("covered") / F.col(total)))
