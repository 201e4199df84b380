"""Exact order statistics in bounded memory, by histograms that are refined around the places asked for.

A pass counts the values of an interval in equal bins, which combines before it shuffles; the bin that holds a place
becomes its next interval, from the least to the greatest value in it. A place is found once both are the same, so ties
end at once, and a pass divides what is left by BINS. No task holds a column or a group.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.storage import written

BINS = 1024
#: A place in a group of n values, from 0; between two places the values are interpolated.
Place = Callable[[Column], Column]


def quantile(p: float) -> Place:
    return lambda n: (n - 1) * F.lit(float(p))


def same(by: list[str]) -> Column:
    on = F.lit(True)
    for i, c in enumerate(by):
        on = on & F.col(c).eqNullSafe(F.col(f"_g{i}"))
    return on


def order_statistics(df: DataFrame, by: list[str], value: str, places: dict[str, Place], bins: int = BINS) -> DataFrame:
    """One row per group that has values: by, n and a double for each place, as percentile() gives it for quantile(p).

    Values are finite numbers; null and NaN ones are left out; null group parts count as equal; by may be empty, which
    gives one row, or none without values. A place under 0 or over n - 1 is the nearest value. Groups may be many and of
    any size: each pass is a join by group, of as many rows as there are open places, and an aggregate.
    """
    rows = df.select(*by, F.col(value).cast("double").alias("_v")).where(F.col("_v").isNotNull() & ~F.isnan("_v"))
    sizes = written(rows.groupBy(*by).agg(F.count("*").alias("n"), F.min("_v").alias("_low"), F.max("_v").alias("_high")).where("n > 0"))
    n = F.col("n")
    at = {name: F.greatest(F.lit(0.0), F.least((n - 1).cast("double"), place(n).cast("double"))) for name, place in places.items()}
    ranks = F.array_distinct(F.flatten(F.array(*[F.array(F.floor(p), F.ceil(p)) for p in at.values()])))
    keys = [F.col(c).alias(f"_g{i}") for i, c in enumerate(by)]
    todo = written(sizes.select(*keys, F.explode(ranks).alias("rank"), F.lit(0).cast("long").alias("before"), F.col("_low").alias("low"), F.col("_high").alias("high")))
    names = [f"_g{i}" for i in range(len(by))]
    span = [*names, "low", "high", "before"]
    found = todo.where("low = high")
    todo = todo.where("low < high")
    while not todo.isEmpty():
        spans = todo.select(*span).distinct()
        inside = rows.join(spans, same(by)).where(F.col("_v").between(F.col("low"), F.col("high")))
        # halves, as the width of a span may be more than a double holds
        share = (F.col("_v") / 2 - F.col("low") / 2) / (F.col("high") / 2 - F.col("low") / 2)
        binned = inside.groupBy(*span, F.least(F.lit(bins - 1), F.floor(share * bins)).alias("_bin")).agg(F.count("*").alias("_n"), F.min("_v").alias("_least"), F.max("_v").alias("_most"))
        earlier = Window.partitionBy(*span).orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)  # at most `bins` rows
        placed = binned.withColumn("_start", F.col("before") + F.coalesce(F.sum("_n").over(earlier), F.lit(0)))
        on = F.lit(True)
        for c in span:
            on = on & F.col(f"t.{c}").eqNullSafe(F.col(f"b.{c}"))
        hit = on & (F.col("t.rank") >= F.col("b._start")) & (F.col("t.rank") < F.col("b._start") + F.col("b._n"))
        narrower = todo.alias("t").join(placed.alias("b"), hit).select(*[f"t.{c}" for c in names], "t.rank", F.col("b._start").alias("before"), F.col("b._least").alias("low"), F.col("b._most").alias("high"))
        todo = written(narrower)
        found = found.unionByName(todo.where("low = high"))
        todo = todo.where("low < high")
    values = found.groupBy(*names).agg(F.map_from_entries(F.collect_list(F.struct("rank", "low"))).alias("_found"))  # two per place at most
    out = sizes.join(values, same(by))
    made = []
    for name, p in at.items():
        low, high = F.floor(p), F.ceil(p)
        a, b = F.element_at("_found", low), F.element_at("_found", high)
        made.append(F.when(low == high, a).otherwise((high - p) * a + (p - low) * b).alias(name))
    return out.select(*by, "n", *made)
