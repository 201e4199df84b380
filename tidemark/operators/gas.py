"""Daily network: capacity in force, utilisation, seasonal references, flow edges, constraints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed values of the network jobs.
END_USE, SUPPLY = ("DISTR", "POWER", "INDUS", "LNG"), ("PROD", "STOR")
PLAUSIBLE_SHARE, PLAUSIBLE_FLOOR, LEAST_EDGE, CHRONIC = 0.5, 200.0, 5.0, 2 / 3


def capacity_in_force(ratings: DataFrame, days: DataFrame, facility: str, effective: str, capacity: str, day: str) -> DataFrame:
    """days (facility, day) with the largest leg of the newest rating that is in force on the day; no row before the
    first rating. Ratings and days of a facility are put in one line by date, so nothing is multiplied: the last rating
    seen is carried forward."""
    rated = ratings.groupBy(facility, F.col(effective).alias("_at")).agg(F.max(capacity).alias("_c")).select(facility, "_at", F.lit(0).alias("_what"), F.struct(F.col("_at").alias("effective"), F.col("_c").alias("capacity")).alias("_r"))
    asked = days.select(facility, F.col(day).alias("_at")).distinct().select(facility, "_at", F.lit(1).alias("_what"), F.lit(None).cast(rated.schema["_r"].dataType).alias("_r"))
    line = Window.partitionBy(facility).orderBy("_at", "_what").rowsBetween(Window.unboundedPreceding, 0)
    seen = rated.unionByName(asked).withColumn("_r", F.last("_r", ignorenulls=True).over(line)).where("_what = 1 AND _r IS NOT NULL")
    return seen.select(facility, F.col("_at").alias(day), F.col("_r.effective").alias("effective_date"), F.col("_r.capacity").alias("capacity"))


def pipeline_utilisation(flows: DataFrame, in_force: DataFrame, facility: str, day: str, least_capacity: float = 1.0) -> DataFrame:
    """Receipts and deliveries per pipeline and day against the capacity in force; under `least_capacity` counts as
    unrated, over 100 % marks the denominator as suspect."""
    summed = flows.groupBy(facility, day).agg(F.sum(F.col("supply") + F.col("transfer_in")).alias("received"), F.sum(F.col("demand") + F.col("transfer_out")).alias("delivered"))
    rated = F.when(F.col("capacity") >= least_capacity, F.col("capacity"))
    used = F.try_divide(100 * F.col("received"), rated)
    return summed.join(in_force.select(facility, day, "capacity"), [facility, day], "left").select(facility, day, "received", "delivered", rated.alias("capacity"), used.alias("utilisation_pct"), F.coalesce(used > 100, F.lit(False)).alias("denominator_suspect"))


def utilisation_summary(used: DataFrame, day: str, facility: str) -> DataFrame:
    """Per day of pipeline_utilisation's rows: rated and suspect pipelines, those at 90 and at 70 percent or more, and the
    busiest one; suspect denominators count in none of the latter. Ties go to the lower number; days without rated
    pipelines have zeros and nulls."""
    pct = F.when(~F.col("denominator_suspect"), F.col("utilisation_pct"))
    best = F.max_by(F.col(facility), F.when(pct.isNotNull(), F.struct(pct, -F.col(facility))))
    return used.groupBy(day).agg(F.count("capacity").alias("rated"), F.count_if("denominator_suspect").alias("suspect"), F.count_if(pct >= 90).alias("at_90"), F.count_if(pct >= 70).alias("at_70"), best.alias("busiest"), F.max(pct).alias("busiest_pct"))


def day_picture(flows: DataFrame, day: str, kind: str, facility: str) -> DataFrame:
    """End-use demand per day and type: total, facilities, share of the day."""
    summed = flows.where(F.col(kind).isin(*END_USE)).groupBy(day, kind).agg(F.sum("demand").alias("demand"), F.count_distinct(facility).alias("n_facilities"))
    return summed.withColumn("share_pct", F.try_divide(100 * F.col("demand"), F.sum("demand").over(Window.partitionBy(day))))


def storage_totals(flows: DataFrame, day: str, held: str, facility: str) -> DataFrame:
    """Total held and reporting facilities per day; null holdings report nothing."""
    return flows.where(F.col(held).isNotNull()).groupBy(day).agg(F.sum(held).alias("held"), F.count_distinct(facility).alias("n_reporting"))


def seasonal_reference(held: DataFrame, facility: str, day: str, value: str) -> DataFrame:
    """Each day's total and the sum of its facilities' medians of the same month and day in other years, null unless
    every facility of the day has one. The years of a facility's calendar day are few, so they are gathered and sorted
    in place instead of joined with each other."""
    d = F.col(day)
    same = Window.partitionBy(facility, F.month(d), F.dayofmonth(d))
    years = F.collect_list(F.struct(F.year(d).alias("y"), F.col(value).alias("v"))).over(same)
    others = F.array_sort(F.transform(F.filter(years, lambda x: x["y"] != F.year(d)), lambda x: x["v"]))
    n = F.size("_o")
    middle = (F.get("_o", F.floor((n - 1) / 2).cast("int")) + F.get("_o", F.floor(n / 2).cast("int"))) / 2
    each = held.withColumn("_o", others).withColumn("_m", F.when(n > 0, middle))
    return each.groupBy(day).agg(F.sum(value).alias("held"), F.when(F.count("_m") == F.count("*"), F.sum("_m")).alias("reference"))


def drop_implausible(held: DataFrame, facility: str, day: str, value: str, share: float = PLAUSIBLE_SHARE, floor: float = PLAUSIBLE_FLOOR) -> DataFrame:
    """Rows with `kept`: a day goes if it is further than max(median * share, floor) from the last day kept.

    The rule depends on what was kept before, so a facility's days, one row each, are sorted into an array and folded with
    the last kept value as state; facilities are independent. Null values are left out; a facility's first day is kept.
    """
    rows = held.where(F.col(value).isNotNull()).select(F.col(facility).alias("_f"), F.col(day).alias("_d"), F.col(value).cast("double").alias("_v"))
    walks = rows.groupBy("_f").agg(F.array_sort(F.collect_list(F.struct("_d", "_v"))).alias("_days"), F.greatest(F.median("_v") * share, F.lit(float(floor))).alias("_reach"))

    def step(state: Column, x: Column) -> Column:
        kept = state["last"].isNull() | (F.abs(x["_v"] - state["last"]) <= F.col("_reach"))
        return F.struct(F.when(kept, x["_v"]).otherwise(state["last"]).alias("last"), F.concat(state["kept"], F.array(kept)).alias("kept"))

    start = F.struct(F.lit(None).cast("double").alias("last"), F.array().cast("array<boolean>").alias("kept"))
    walked = walks.select("_f", F.explode(F.arrays_zip("_days", F.aggregate("_days", start, step, lambda s: s["kept"]).alias("_kept"))).alias("x"))
    return walked.select(F.col("_f").alias(facility), F.col("x._days._d").alias(day), F.col("x._days._v").alias(value), F.col("x._kept").alias("kept"))


def flow_edges(flows: DataFrame, facility: str, day: str, place: str, least: float = LEAST_EDGE) -> DataFrame:
    """Receipts allotted to deliveries at other places in proportion; parts under `least` go before they are summed by
    source and destination, with the pipelines' numbers in order. An edge is inferred if a pipeline had several receipts and
    several deliveries. Null places and volumes make no edge."""
    at = flows.groupBy(day, facility, place).agg(F.sum(F.col("supply") + F.col("transfer_in")).alias("r"), F.sum(F.col("demand") + F.col("transfer_out")).alias("d"))
    of = Window.partitionBy(day, facility)
    receipts = at.where("r > 0").withColumn("n_r", F.count("*").over(of)).select(day, facility, F.col(place).alias("src"), "r", "n_r")
    deliveries = at.where("d > 0").withColumns({"n_d": F.count("*").over(of), "all_d": F.sum("d").over(of)}).select(day, facility, F.col(place).alias("dst"), "d", "n_d", "all_d")
    pairs = receipts.join(deliveries, [day, facility]).where("src <> dst").withColumn("volume", F.col("r") * F.col("d") / F.col("all_d")).where(F.col("volume") >= least)
    return pairs.groupBy(day, "src", "dst").agg(F.sum("volume").alias("volume"), F.count_distinct(facility).alias("n_pipelines"), F.array_sort(F.collect_set(facility)).alias("pipelines"), F.bool_or((F.col("n_r") > 1) & (F.col("n_d") > 1)).alias("inferred"))


def net_opposing_edges(edges: DataFrame, by: list[str]) -> DataFrame:
    """Edges both ways become one in the direction of the larger, with the difference as its net volume; the pipelines of
    both are named together."""
    ahead = F.sum(F.when(F.col("src") <= F.col("dst"), F.col("volume")).otherwise(0.0))
    back = F.sum(F.when(F.col("src") > F.col("dst"), F.col("volume")).otherwise(0.0))
    both = edges.groupBy(*by, F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).agg(ahead.alias("ab"), back.alias("ba"), F.bool_or("inferred").alias("inferred"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("pipelines")))).alias("pipelines"))
    forward = F.col("ab") >= F.col("ba")
    return both.select(*by, F.when(forward, F.col("a")).otherwise(F.col("b")).alias("src"), F.when(forward, F.col("b")).otherwise(F.col("a")).alias("dst"), F.abs(F.col("ab") - F.col("ba")).alias("net"), F.greatest("ab", "ba").alias("gross"), F.least("ab", "ba").alias("counterflow"), "inferred", "pipelines")


def seasonal_percentile(series: DataFrame, day: str, value: str, reach: int = 7) -> DataFrame:
    """Mid-rank percentile of each day's value among other years' days within `reach` of the same month and day; null
    without any. Each day is offered to the days that may ask for it by an equality join."""
    d = F.col(day)
    asked = series.select(d, F.col(value).alias("x"))
    years = series.select(F.year(d).alias("y")).distinct()
    anchors = asked.crossJoin(F.broadcast(years)).where(F.col("y") != F.year(d))  # a few tens of years
    anchor = F.concat_ws("-", F.col("y").cast("string"), F.lpad(F.month(d).cast("string"), 2, "0"), F.lpad(F.dayofmonth(d).cast("string"), 2, "0")).try_cast("date")
    near = anchors.withColumn("_a", anchor).where("_a IS NOT NULL").withColumn("_near", F.explode(F.sequence(F.date_sub("_a", reach), F.date_add("_a", reach))))
    found = near.join(series.select(d.alias("_near"), F.col(value).alias("v")), "_near")
    rank = F.sum(F.when(F.col("v") < F.col("x"), 1.0).when(F.col("v") == F.col("x"), 0.5).otherwise(0.0))
    return asked.join(found.groupBy(day).agg((100 * rank / F.count("*")).alias("percentile"), F.count("*").alias("n_compared")), day, "left").select(day, F.col("x").alias(value), "percentile", F.coalesce("n_compared", F.lit(0)).alias("n_compared"))


def state_balance(flows: DataFrame, state: str, kind: str) -> DataFrame:
    """Supply, end use and pipeline deliveries per state and in total (state ALL); a blank state is Unknown."""
    named = flows.withColumn("_s", F.coalesce(F.nullif(F.trim(F.col(state)), F.lit("")), F.lit("Unknown")))
    named = named.withColumns({"_supply": F.when(F.col(kind).isin(*SUPPLY), F.col("supply")).otherwise(0.0), "_use": F.when(F.col(kind).isin(*END_USE), F.col("demand")).otherwise(0.0), "_pipe": F.when(F.col(kind) == "PIPE", F.col("demand")).otherwise(0.0)})
    return named.rollup("_s").agg(F.sum("_supply").alias("supply"), F.sum("_use").alias("end_use"), F.sum("_pipe").alias("pipeline_delivered"), F.grouping("_s").alias("_all")).select(F.when(F.col("_all") == 1, "ALL").otherwise(F.col("_s")).alias(state), "supply", "end_use", "pipeline_delivered")


def demand_composition(flows: DataFrame, day: str, kind: str) -> DataFrame:
    """A row per day, a column per end use, absent ones zero."""
    return flows.where(F.col(kind).isin(*END_USE)).groupBy(day).agg(*[F.sum(F.when(F.col(kind) == k, F.col("demand")).otherwise(0.0)).alias(k.lower()) for k in END_USE])


def demand_matrix(flows: DataFrame, day: str, kind: str, days: int = 365) -> DataFrame:
    """(day, kind, demand) for every day held of the last `days` and every end use that occurs in them, in fixed order by
    `place`; zero where a day lacks one. The kinds are at most four rows."""
    last = flows.agg(F.date_sub(F.max(day), days).alias("_from"))  # one row
    held = flows.crossJoin(F.broadcast(last)).where(F.col(day) > F.col("_from"))
    used = held.where(F.col(kind).isin(*END_USE)).groupBy(day, kind).agg(F.sum("demand").alias("demand"))
    place = F.array_position(F.array(*map(F.lit, END_USE)), F.col(kind)).cast("int")
    grid = held.select(day).distinct().crossJoin(F.broadcast(used.select(kind).distinct()))
    return grid.join(used, [day, kind], "left").select(day, kind, F.coalesce("demand", F.lit(0.0)).alias("demand"), place.alias("place"))


def constraint_grid(flags: DataFrame, facility: str, day: str, flag: str, days: int = 180) -> DataFrame:
    """(facility, day, flag) of every facility ever AMBER or RED in the last `days` days, for every day that has any flag;
    blank where the facility has none. One flag per facility and day."""
    last = flags.agg(F.date_sub(F.max(day), days).alias("_from"))  # one row
    held = flags.crossJoin(F.broadcast(last)).where(F.col(day) > F.col("_from")).select(facility, day, flag)
    ever = held.where(F.col(flag).isin("AMBER", "RED")).select(facility).distinct()
    return ever.crossJoin(held.select(day).distinct()).join(held, [facility, day], "left").select(facility, day, F.coalesce(flag, F.lit("")).alias(flag))


def constraint_totals(flags: DataFrame, facility: str, day: str, flag: str) -> DataFrame:
    """Constrained and assessed facilities per day."""
    return flags.groupBy(day).agg(F.count_distinct(F.when(F.col(flag).isin("AMBER", "RED"), F.col(facility))).alias("constrained"), F.count_distinct(facility).alias("assessed"))


def constraint_history(flags: DataFrame, facility: str, day: str, flag: str) -> DataFrame:
    """Facilities ever AMBER or RED: constrained and assessed days, their share, chronic from two thirds on."""
    bad = F.col(flag).isin("AMBER", "RED")
    counted = flags.groupBy(facility).agg(F.count_distinct(F.when(bad, F.col(day))).alias("constrained_days"), F.count_distinct(day).alias("assessed_days"))
    share = F.col("constrained_days") / F.col("assessed_days")
    return counted.where("constrained_days > 0").withColumn("share", share).withColumn("chronic", F.col("share") >= CHRONIC)


def constraint_outlook(flags: DataFrame, facility: str, day: str, flag: str, today: str, trailing: int | None = None) -> DataFrame:
    """Assessed and flagged facilities per day, the constrained ones by number, and whether the day lies before today. Days
    from today on end before the first that assesses under half of the largest number that any of them does; earlier days
    are observed and stay, the last `trailing` of them if given. One flag per facility and day."""
    now = F.lit(today).cast("date")
    held = flags if trailing is None else flags.where(F.col(day) >= F.date_sub(now, trailing))
    daily = held.groupBy(day).agg(F.count_distinct(facility).alias("assessed"), *[F.count_if(F.col(flag) == f).alias(f.lower()) for f in ("GREEN", "AMBER", "RED")], F.array_sort(F.collect_set(F.when(F.col(flag).isin("AMBER", "RED"), F.col(facility)))).alias("constrained")).withColumn("observed", F.col(day) < now)
    most = daily.where(~F.col("observed")).agg(F.max("assessed").alias("_most"))
    thin = daily.crossJoin(F.broadcast(most)).where(~F.col("observed") & (F.col("assessed") < F.col("_most") / 2)).agg(F.min(day).alias("_stop"))
    return daily.crossJoin(F.broadcast(thin)).where(F.col("_stop").isNull() | (F.col(day) < F.col("_stop"))).drop("_stop")  # one row
