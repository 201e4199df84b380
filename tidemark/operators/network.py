"""The network of a day: legs in force, nodes, legend values, balance over time."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .gas import END_USE, SUPPLY
from .order_stats import order_statistics, quantile

#: Kind of an export facility, first day with end-use facilities, quantiles and step of a legend.
EXPORT, EXPANSION, LEGEND_QUANTILES, LEGEND_STEP = "LNG", "2023-03-15", (0.25, 0.60, 0.95), 5


def latest_day(flows: DataFrame, day: str) -> DataFrame:
    """One row with the newest day held; null without rows."""
    return flows.agg(F.max(day).alias("latest"))


def legs_in_force(ratings: DataFrame, in_force: DataFrame, facility: str, day: str, effective: str, capacity: str) -> DataFrame:
    """All legs of the rating that is in force on each facility's day; in_force has its effective_date."""
    legs = ratings.select(facility, F.col(effective).alias("effective_date"), F.col(capacity).alias("leg_capacity"))
    return in_force.select(facility, day, "effective_date").join(legs, [facility, "effective_date"])


def network_nodes(flows: DataFrame, edges: DataFrame, day: str, place: str, kind: str) -> DataFrame:
    """Supply, demand, net and role of every place of a day that supplies, uses or ends an edge."""
    own = flows.where(F.col(kind).isin(*SUPPLY, *END_USE)).select(
        day, F.col(place).alias("place"), F.when(F.col(kind).isin(*SUPPLY), F.col("supply")).otherwise(0.0).alias("supply"), F.when(F.col(kind).isin(*END_USE), F.col("demand")).otherwise(0.0).alias("demand"))
    ends = edges.select(day, F.explode(F.array("src", "dst")).alias("place"), F.lit(0.0).alias("supply"), F.lit(0.0).alias("demand"))
    net = F.col("supply") - F.col("demand")
    summed = own.unionByName(ends).groupBy(day, "place").agg(F.sum("supply").alias("supply"), F.sum("demand").alias("demand"))
    return summed.withColumns({"net": net, "role": F.when(net > 0, "supply").when(net < 0, "demand").otherwise("transit")})


def edge_export_split(edges: DataFrame, flows: DataFrame, day: str, place: str, kind: str, volume: str) -> DataFrame:
    """Edges with whether they touch a place of an export facility of the day, and the largest volume of their part."""
    at = flows.where(F.col(kind) == EXPORT).select(day, F.col(place).alias("_place")).distinct()
    touched = edges.select("*", F.explode(F.array("src", "dst")).alias("_place")).join(at, [day, "_place"], "left_semi").select(day, "src", "dst").distinct().withColumn("_hit", F.lit(True))
    marked = edges.join(touched, [day, "src", "dst"], "left").withColumn("export", F.coalesce("_hit", F.lit(False))).drop("_hit")
    return marked.withColumn("peak", F.max(volume).over(Window.partitionBy(day, "export")))


def unplaced_nodes(nodes: DataFrame, locations: DataFrame, place: str) -> DataFrame:
    """Distinct places of nodes that no location is held for; null places are not listed."""
    return nodes.where(F.col(place).isNotNull()).select(place).distinct().join(locations.select(place), place, "left_anti")


def legend_examples(values: DataFrame, by: list[str], value: str, large: bool = False) -> DataFrame:
    """Distinct positive quantiles of each group's values, to the nearest step (half to even). large: groups whose distinct
    values one task should not hold; quantiles then come from refined histograms, and are the same."""
    if large:
        places = {f"_q{i}": quantile(p) for i, p in enumerate(LEGEND_QUANTILES)}
        found = order_statistics(values, by, value, places).select(*by, F.explode(F.array(*places)).alias("_v"))
    else:
        found = values.groupBy(*by).agg(F.percentile(value, list(LEGEND_QUANTILES)).alias("_q")).select(*by, F.explode("_q").alias("_v"))
    return found.select(*by, (F.bround(F.col("_v") / LEGEND_STEP, 0) * LEGEND_STEP).alias("example")).where("example > 0").distinct()


def balance_series(flows: DataFrame, day: str, kind: str, days: int = 90, first: str = EXPANSION) -> DataFrame:
    """Supply, end use, export and domestic use of the last `days` days, not before `first`, with the export share of
    the whole window in percent and whether `first` cut it. At most `days` rows see the window over all."""
    start = F.date_sub(F.max(day), days - 1)
    span = flows.agg(F.greatest(start, F.lit(first).cast("date")).alias("_from"), (start < F.lit(first).cast("date")).alias("truncated"))
    part = lambda kinds, column: F.sum(F.when(F.col(kind).isin(*kinds), F.col(column)).otherwise(0.0))
    held = flows.where(F.col(kind).isin(*SUPPLY, *END_USE)).crossJoin(F.broadcast(span)).where(F.col(day) >= F.col("_from"))  # span is one row
    daily = held.groupBy(day, "truncated").agg(part(SUPPLY, "supply").alias("supply"), part(END_USE, "demand").alias("demand"), part([EXPORT], "demand").alias("export"))
    every = Window.partitionBy()
    return daily.withColumns({"domestic": F.col("demand") - F.col("export"), "export_share_pct": 100 * F.try_divide(F.sum("export").over(every), F.sum("demand").over(every))})
