"""Generation by fuel: labels, daily energy, mix and trend."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: What counts as renewable and as fossil (storage is neither), the groups of the mix, and the statuses of
#: units that may generate.
RENEWABLE, FOSSIL = ("Wind", "Solar", "Hydro", "Biomass"), ("Black coal", "Brown coal", "Gas", "Liquid Fuel", "Other")
GROUPS = {"Coal": ("Black coal", "Brown coal"), "Gas": ("Gas", "Liquid Fuel", "Other"), "Renewables": RENEWABLE, "Storage": ("Battery",)}
OPERATING = ("In Service", "In Commissioning", "Announced Withdrawal")


def classify_fuel(technology: Column, detail: Column, gas_fuel: Column) -> Column:
    """The fuel that a unit's technology names, else the one that a gas turbine burns, else what its detail says; first
    rule that holds, in lower case and trimmed. Nulls are empty; nothing known is Other."""
    t, d, g = (F.lower(F.trim(F.coalesce(c, F.lit("")))) for c in (technology, detail, gas_fuel))
    any_of = lambda x, *parts: F.rlike(x, F.lit("|".join(parts)))
    turbine = F.when(any_of(g, "diesel", "fuel oil"), "Liquid Fuel").otherwise("Gas")
    return (
        F.when(t == "coal", F.when(d.contains("brown"), "Brown coal").otherwise("Black coal")).when(t == "battery storage", "Battery").when(t == "hydro", "Hydro").when(t == "wind", "Wind").when(t == "solar pv", "Solar")
        .when(any_of(g, "biofuel", "biomass", "landfill"), "Biomass").when(t == "gas turbine", turbine).when(d.contains("biomass"), "Biomass").otherwise("Other")
    )


def unit_registry(rows: DataFrame, *, units: str, region: str, technology: str, detail: str, gas_fuel: str, status: str, line: str) -> DataFrame:
    """(unit, state, fuel) of operating rows, one per unit. A cell may name several units, apart by commas, semicolons or
    white space; the state is the region without a 1 at its end. Of a unit's rows the first by line counts, but the first
    with a known fuel beats those of Other. Null cells name no unit."""
    r = F.trim(F.coalesce(F.col(region), F.lit("")))
    named = rows.where(F.trim(status).isin(*OPERATING)).select(F.explode(F.filter(F.split(F.trim(F.col(units)), r"[,;\s]+"), lambda x: x != "")).alias("unit"), F.regexp_replace(r, "1$", "").alias("state"), classify_fuel(F.col(technology), F.col(detail), F.col(gas_fuel)).alias("fuel"), F.col(line).alias("_line"))
    place = F.row_number().over(Window.partitionBy("unit").orderBy((F.col("fuel") == "Other").cast("int"), "_line"))
    return named.withColumn("_k", place).where("_k = 1").select("unit", "state", "fuel")


def daily_generation(df: DataFrame, unit: str, ts: str, mw: str, day: Column, by: list[str], line: str) -> DataFrame:
    """MWh per day and group: the last reading of a unit and interval counts, negative ones as zero."""
    order = Window.partitionBy(unit, ts).orderBy(F.col(line).desc())
    last = df.withColumn("_k", F.row_number().over(order)).where("_k = 1")
    return last.groupBy(day.alias("day"), *by).agg(F.sum(F.greatest(F.col(mw), F.lit(0.0)) / 12).alias("mwh"))


def fuel_mix(gen: DataFrame, day: str, state: str, fuel: str, days: int = 7) -> DataFrame:
    """MWh and percentage per fuel over the last days, for each state and for the market (state ALL)."""
    last = gen.agg(F.max(day).alias("_last"))
    recent = gen.crossJoin(F.broadcast(last)).where((F.col(day) > F.date_sub("_last", days)) & (F.col("mwh") > 0))
    both = recent.groupBy(state, fuel).agg(F.sum("mwh").alias("mwh"))
    both = both.unionByName(both.groupBy(fuel).agg(F.sum("mwh").alias("mwh")).select(F.lit("ALL").alias(state), fuel, "mwh"))
    return both.withColumn("pct", 100 * F.col("mwh") / F.sum("mwh").over(Window.partitionBy(state)))


def fuel_groups(gen: DataFrame, day: str, state: str, fuel: str, days: int = 7) -> DataFrame:
    """MWh and percentage of the mix of each of GROUPS over the last days, for each state that generated and for the
    market (state ALL); a group without any has zero. An empty table gives no rows."""
    mix = fuel_mix(gen, day, state, fuel, days)
    total = lambda fuels: F.sum(F.when(F.col(fuel).isin(*fuels), F.col("mwh")).otherwise(0.0))
    wide = mix.groupBy(state).agg(F.sum("mwh").alias("_all"), *[total(fuels).alias(f"_{g}") for g, fuels in GROUPS.items()])
    parts = F.explode(F.array(*[F.struct(F.lit(g).alias("g"), F.col(f"_{g}").alias("m")) for g in GROUPS])).alias("_x")
    return wide.select(state, "_all", parts).select(state, F.col("_x.g").alias("fuel_group"), F.col("_x.m").alias("mwh"), (100 * F.col("_x.m") / F.col("_all")).alias("pct"))


def renewable_trend(gen: DataFrame, day: str, state: str, fuel: str, days: int | None = 92) -> DataFrame:
    """Renewable and fossil MWh per day and state and for the market (state ALL) over the last `days` days (all, if None);
    storage is in neither, and a day of storage alone has no row."""
    held = gen.where(F.col(fuel).isin(*RENEWABLE, *FOSSIL))
    if days is not None:
        held = held.crossJoin(F.broadcast(gen.agg(F.max(day).alias("_last")))).where(F.col(day) > F.date_sub("_last", days))  # one row
    of = lambda names: F.sum(F.when(F.col(fuel).isin(*names), F.col("mwh")).otherwise(0.0))
    each = held.groupBy(day, state).agg(of(RENEWABLE).alias("renewable"), of(FOSSIL).alias("fossil"))
    market = each.groupBy(day).agg(F.sum("renewable").alias("renewable"), F.sum("fossil").alias("fossil")).select(day, F.lit("ALL").alias(state), "renewable", "fossil")
    return each.unionByName(market)
