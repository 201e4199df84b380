"""Recurring revenue: series, concentration, movement, trends."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def arr_series(timeline: DataFrame) -> DataFrame:
    """Revenue and accounts with any, per month; null revenue counts as none."""
    return timeline.groupBy("month").agg(F.sum("arr").alias("arr"), F.count_if(F.col("arr") > 0).alias("active"))


def concentration_series(timeline: DataFrame) -> DataFrame:
    """Share of the largest 1, 5 and 10 accounts of each month in its positive revenue."""
    place = F.row_number().over(Window.partitionBy("month").orderBy(F.col("arr").desc(), "account_id"))
    ranked = timeline.where("arr > 0").withColumn("_k", place)
    top = lambda k: (100 * F.sum(F.when(F.col("_k") <= k, F.col("arr")).otherwise(0.0)) / F.sum("arr")).alias(f"top{k}_pct")
    return ranked.groupBy("month").agg(top(1), top(5), top(10), F.count("*").alias("active"))


def arr_change(timeline: DataFrame, rows: int = 12) -> DataFrame:
    """The last row against the one `rows` before it, or the first: by position, not by calendar."""
    back = F.row_number().over(Window.partitionBy("account_id").orderBy(F.col("month").desc()))
    window = timeline.withColumn("_k", back).where(F.col("_k") <= rows + 1)
    ends = window.groupBy("account_id").agg(F.max_by("arr", "month").alias("end_arr"), F.min_by("arr", "month").alias("start_arr"))
    change = F.col("end_arr") - F.col("start_arr")
    return ends.withColumns({"change": change, "change_pct": F.when(F.col("start_arr") > 0, 100 * change / F.col("start_arr"))})


def arr_movement(timeline: DataFrame) -> DataFrame:
    """New, expansion, contraction, churn and net between consecutive months of the whole book. An account without a
    row before is new; one that had zero expands."""
    months = timeline.select("month").distinct().withColumn("after", F.lead("month").over(Window.orderBy("month")))  # one row per month held
    before = timeline.join(F.broadcast(months), "month").where("after IS NOT NULL").select("account_id", F.col("after").alias("month"), F.col("arr").alias("old"))
    now = timeline.join(F.broadcast(months.where("after IS NOT NULL").select(F.col("after").alias("month"))), "month").select("account_id", "month", F.col("arr").alias("new"))
    both = now.join(before, ["account_id", "month"], "full")
    d = F.coalesce(F.col("new"), F.lit(0.0)) - F.coalesce(F.col("old"), F.lit(0.0))
    part = lambda rule, name: F.sum(F.when(rule, d).otherwise(0.0)).alias(name)
    gone = F.col("new").isNull() | (F.col("new") == 0)
    return both.groupBy("month").agg(part(F.col("old").isNull(), "new_arr"), part(F.col("old").isNotNull() & (d > 0), "expansion"), part(F.col("old").isNotNull() & (d < 0) & ~gone, "contraction"), part(F.col("old").isNotNull() & (d < 0) & gone, "churn"), F.sum(d).alias("net"))


def growers_decliners(changes: DataFrame, k: int = 5) -> DataFrame:
    """The k largest falls and the k largest rises; in a small book an account may be both."""
    down = changes.orderBy(F.col("change"), "account_id").limit(k).withColumn("side", F.lit("decliner"))
    return down.unionByName(changes.orderBy(F.col("change").desc(), "account_id").limit(k).withColumn("side", F.lit("grower")))


def trend_evidence(timeline: DataFrame, usage: str, rows: int = 13, least_span: int = 12, least_rows: int = 10, least_usage: int = 8) -> DataFrame:
    """Change of revenue (percent) and of usage (points) over the last rows of each account, one row per account and
    month. An eligible account compares the medians of its first and last three values, others the first and the last.
    Accounts with less than two values of either are left out."""
    by = lambda *c: Window.partitionBy("account_id", *c)
    recent = timeline.withColumn("_k", F.row_number().over(by().orderBy(F.col("month").desc()))).where(F.col("_k") <= rows)
    found = [F.count("*").alias("n"), F.min("month").alias("start_month"), F.max("month").alias("end_month")]
    for name, c in (("arr", "arr"), ("usage", usage)):
        held = F.col(c).isNotNull()
        w = by(held)
        recent = recent.withColumns({f"_{name}_a": F.row_number().over(w.orderBy("month")), f"_{name}_z": F.row_number().over(w.orderBy(F.col("month").desc()))})
        value = lambda side, k, c=c, name=name: F.when(F.col(f"_{name}_{side}") <= k, F.col(c))
        found += [F.count(c).alias(f"{name}_n")] + [f(value(side, k)).alias(f"_{name}_{side}{k}") for side in "az" for f, k in ((F.max, 1), (F.median, 3))]
    ends = recent.groupBy("account_id").agg(*found).where("arr_n >= 2 AND usage_n >= 2").withColumn("span_months", F.round(F.months_between("end_month", "start_month")).cast("int"))
    ends = ends.withColumn("eligible", (F.col("span_months") >= least_span) & (F.col("n") >= least_rows) & (F.col("usage_n") >= least_usage))
    end = lambda name, side: F.when(F.col("eligible"), F.col(f"_{name}_{side}3")).otherwise(F.col(f"_{name}_{side}1"))
    rise = F.when(end("arr", "a") > 0, 100 * (end("arr", "z") - end("arr", "a")) / end("arr", "a"))
    return ends.select("account_id", "n", "usage_n", "start_month", "end_month", "span_months", "eligible", F.round(rise, 1).alias("arr_change_pct"), F.round(end("usage", "z") - end("usage", "a"), 1).alias("usage_change_pp"))


def revenue_by_group(timeline: DataFrame, accounts: DataFrame, dimensions: list[str], top: int = 5) -> DataFrame:
    """Revenue per month of the `top` groups of each dimension by the dimension's last month; the others, and accounts
    without a group, are Other. Windows run over months and groups, after the accounts are summed."""
    cells = timeline.join(accounts, "account_id").groupBy("month", *dimensions).agg(F.sum("arr").alias("arr"))
    group = F.explode(F.array(*[F.struct(F.lit(d).alias("dimension"), F.coalesce(F.col(d).cast("string"), F.lit("Other")).alias("group")) for d in dimensions]))
    long = cells.select("month", group.alias("_g"), "arr").select("month", "_g.*", "arr").groupBy("month", "dimension", "group").agg(F.sum("arr").alias("arr"))
    last = long.withColumn("_last", F.max("month").over(Window.partitionBy("dimension")))
    now = last.groupBy("dimension", "group").agg(F.sum(F.when(F.col("month") == F.col("_last"), F.col("arr")).otherwise(0.0)).alias("_now"))
    place = F.row_number().over(Window.partitionBy("dimension").orderBy(F.col("_now").desc(), "group"))
    named = now.withColumn("shown", F.when(place <= top, F.col("group")).otherwise("Other")).drop("_now")
    return long.join(named, ["dimension", "group"]).groupBy("month", "dimension", "shown").agg(F.sum("arr").alias("arr"))
