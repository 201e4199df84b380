"""Five-minute dispatch: interval values, daily summaries, the hindsight benchmark."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import pairwise

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Intervals of an hour and of a day, round-trip efficiency and levels of the benchmark.
PER_HOUR, PER_DAY, ROUND_TRIP, LEVELS = 12, 288, 0.9, 201
#: Days that a task solves side by side, and the relative difference under which two ways count as equally good.
DAYS, NEAR = 100, 1e-9


def effective_registrations(regs: DataFrame, days: DataFrame, day: str, start: str, end: str) -> DataFrame:
    """Registrations that hold on each day, both ends inclusive, a null end open.

    An interval join: ranges are cut into the months that they touch and that have days at all, and meet the days by
    month, so Spark has an equality to hash or sort by. A range without a start, or that ends before it starts, holds on
    no day. The span of months that bounds open ends is one row.
    """
    month = lambda c: F.months_between(F.trunc(c, "month"), F.lit("2000-01-01").cast("date")).cast("int")
    dated = days.withColumn("_month", month(F.col(day)))
    span = dated.agg(F.min("_month").alias("_low"), F.max("_month").alias("_high"))
    ranges = regs.join(F.broadcast(span), F.lit(True))  # one row
    low, high = F.greatest(month(F.col(start)), F.col("_low")), F.least(F.coalesce(month(F.col(end)), F.col("_high")), F.col("_high"))
    cut = ranges.where(F.col(start).isNotNull() & (low <= high)).withColumn("_month", F.explode(F.sequence(low, high))).drop("_low", "_high")
    held = (F.col(start) <= F.col(day)) & (F.col(end).isNull() | (F.col(day) <= F.col(end)))
    return cut.join(dated, "_month").where(held).drop("_month")


def join_dispatch(prices: DataFrame, regs: DataFrame, dispatch: DataFrame, scada: DataFrame) -> DataFrame:
    """One row per unit and interval that has a price in the unit's region and a dispatch row; its reading, where there is
    one. prices: region, ts, rrp, fcas_prices; regs: day-wise registrations with asset, unit, region, day, power_mw,
    capacity_mwh; dispatch: unit, ts, day, target_mw, storage_mwh, enablement; scada: unit, ts, scada_mw.

    Equi-joins only. Keys are unique on each side; a unit without an effective registration, an interval without a price
    or a null key gives no row.
    """
    held = dispatch.join(regs, ["unit", "day"]).join(prices, ["region", "ts"])
    return held.join(scada, ["unit", "ts"], "left")


def interval_value(df: DataFrame, mw: str, price: str, enablement: str | None = None, fcas_prices: str | None = None) -> DataFrame:
    """Energy and money of each interval; without a reading the energy is null and all else zero, and a null price counts
    as zero. With enablement and fcas_prices (maps by service) also gross_fcas_value and observable_gross_value, the sum
    of both."""
    mwh = F.col(mw) / PER_HOUR
    known = F.coalesce(mwh, F.lit(0.0))
    charge, discharge, money = F.greatest(F.lit(0.0), -known), F.greatest(F.lit(0.0), known), F.coalesce(F.col(price), F.lit(0.0))
    out = df.withColumns({"energy_mwh": mwh, "charge_mwh": charge, "discharge_mwh": discharge, "charging_cost": charge * money, "discharge_value": discharge * money, "energy_value": known * money})
    if enablement is None:
        return out
    out = out.withColumn("gross_fcas_value", fcas_value(F.col(enablement), F.col(fcas_prices)))
    return out.withColumn("observable_gross_value", F.col("energy_value") + F.col("gross_fcas_value"))


def service_values(enablement: F.Column, prices: F.Column) -> F.Column:
    """Map of service to what is enabled, not under zero, times its price; null where either map is null."""
    return F.map_zip_with(enablement, prices, lambda k, e, p: F.greatest(F.coalesce(e, F.lit(0.0)), F.lit(0.0)) * F.coalesce(p, F.lit(0.0)) / PER_HOUR)


def fcas_value(enablement: F.Column, prices: F.Column) -> F.Column:
    """Sum over services of what is enabled, not under zero, times its price; without either map zero."""
    return F.coalesce(F.aggregate(F.map_values(service_values(enablement, prices)), F.lit(0.0), lambda a, x: a + x), F.lit(0.0))


def fcas_breakdown(df: DataFrame, by: list[str], enablement: str, fcas_prices: str, least: float = 0.005) -> DataFrame:
    """Value per group and service, without those under half a cent."""
    each = df.select(*by, F.explode(service_values(F.col(enablement), F.col(fcas_prices))).alias("service", "value"))
    return each.groupBy(*by, "service").agg(F.sum("value").alias("value")).where(F.abs("value") >= least)


def quality_flags(mw: F.Column, storage: F.Column, capacity: F.Column) -> F.Column:
    """Names of what is odd about an interval; a null or zero capacity is not compared with."""
    return F.array_compact(F.array(F.when(mw.isNull(), "missing_scada"), F.when(storage.isNull(), "missing_storage"), F.when(storage < 0, "storage_below_zero"), F.when((capacity != 0) & (storage > 1.02 * capacity), "storage_above_public_capacity")))


def daily_summary(intervals: DataFrame, asset: str, day: str, mw: str, expected: int = PER_DAY) -> DataFrame:
    """Sums, value per MWh, captured price, peaks and completeness per asset and day."""
    s = intervals.groupBy(asset, day).agg(F.count("*").alias("n"), F.sum("charge_mwh").alias("charge_mwh"), F.sum("discharge_mwh").alias("discharge_mwh"), F.sum("charging_cost").alias("charging_cost"), F.sum("discharge_value").alias("discharge_value"), F.sum("energy_value").alias("energy_value"), F.max(mw).alias("peak_mw"), F.min(mw).alias("least_mw"))
    return s.withColumns({"throughput_mwh": F.col("charge_mwh") + F.col("discharge_mwh"), "value_per_mwh": F.try_divide("energy_value", "discharge_mwh"), "capture_price": F.try_divide("discharge_value", "discharge_mwh"), "status": F.when(F.col("n") == expected, "complete").otherwise("partial")})


def operating_summary(intervals: DataFrame, capacity: DataFrame, per_day: int = PER_DAY) -> DataFrame:
    """The whole daily record of each asset: one row per asset and day with intervals.

    intervals: asset, day, ts, scada_mw, storage_mwh, flags and the columns of interval_value with FCAS; capacity: asset,
    day, units, capacity_mwh. Status is complete if rows, readings and storage values are all units * per_day; notes say
    what is short, then which flags rose but for those of missing values. An asset-day without capacity has no cycles and
    no states of charge. A day's intervals are ranked in one window for the best five.
    """
    best = F.row_number().over(Window.partitionBy("asset", "day").orderBy(F.col("observable_gross_value").desc(), "ts"))
    total = {c: F.sum(c).alias(c) for c in ("charge_mwh", "discharge_mwh", "charging_cost", "discharge_value", "energy_value", "gross_fcas_value", "observable_gross_value")}
    s = intervals.withColumn("_k", best).groupBy("asset", "day").agg(
        F.count("*").alias("interval_count"), F.count("scada_mw").alias("scada_interval_count"), F.count("storage_mwh").alias("storage_interval_count"), *total.values(), F.max("scada_mw").alias("_most"), F.min("scada_mw").alias("_least"), F.min("storage_mwh").alias("min_storage_mwh"), F.max("storage_mwh").alias("max_storage_mwh"),
        F.sum(F.when(F.col("_k") <= 5, F.col("observable_gross_value"))).alias("_five"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("flags")))).alias("_flags"),
    )
    s = s.join(capacity, ["asset", "day"], "left")
    wanted = F.coalesce(F.col("units"), F.lit(0)) * per_day
    held = F.when(F.col("capacity_mwh") != 0, F.col("capacity_mwh"))
    note = lambda count, words: F.when(F.col(count) != wanted, F.concat(F.lit(words), F.lit(" "), F.col(count).cast("string"), F.lit(" of "), wanted.cast("string")))
    short = F.array_compact(F.array(note("interval_count", "intervals"), note("scada_interval_count", "readings"), note("storage_interval_count", "storage values")))
    odd = F.filter("_flags", lambda x: ~x.isin("missing_scada", "missing_storage"))
    return s.withColumns({
        "throughput_mwh": F.col("charge_mwh") + F.col("discharge_mwh"), "equivalent_cycles": F.coalesce(F.try_divide(F.col("discharge_mwh"), held), F.lit(0.0)), "value_per_discharge_mwh": F.try_divide("observable_gross_value", "discharge_mwh"), "capture_price": F.try_divide("discharge_value", "discharge_mwh"),
        "peak_charge_mw": F.when(F.col("_least") < 0, F.abs("_least")).otherwise(0.0), "peak_discharge_mw": F.coalesce("_most", F.lit(0.0)), "min_soc_pct": 100 * F.try_divide(F.col("min_storage_mwh"), held), "max_soc_pct": 100 * F.try_divide(F.col("max_storage_mwh"), held),
        "top_five_share": F.when(F.col("observable_gross_value") > 0, F.col("_five") / F.col("observable_gross_value")), "status": F.when(F.size(short) == 0, "complete").otherwise("partial"), "notes": F.concat(short, odd),
    }).drop("_most", "_least", "_five", "_flags", "units", "power_mw", "capacity_mwh")


def interval_inspector(intervals: DataFrame, capacity: DataFrame) -> DataFrame:
    """Each asset's units as one series by interval end: sums of what is known, share of capacity, value parts and all
    flags, sorted; midnight is shown as 24:00 of the day that it ends."""
    s = intervals.groupBy("asset", "day", "ts").agg(
        F.sum("scada_mw").alias("scada_mw"), F.sum("target_mw").alias("target_mw"), F.sum("storage_mwh").alias("storage_mwh"), F.max("rrp").alias("rrp"), F.sum("energy_value").alias("energy_value"), F.sum("gross_fcas_value").alias("fcas_value"), F.sum("observable_gross_value").alias("observable_value"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("flags")))).alias("flags"),
    )
    time = F.date_format("ts", "HH:mm")
    held = F.when(F.col("capacity_mwh") != 0, F.col("capacity_mwh"))
    return s.join(capacity.select("asset", "day", "capacity_mwh"), ["asset", "day"], "left").withColumns({"time": F.when(time == "00:00", "24:00").otherwise(time), "storage_pct": 100 * F.try_divide(F.col("storage_mwh"), held)}).drop("capacity_mwh")


def recalculate_summaries(intervals: DataFrame, capacity: DataFrame, levels: int = LEVELS) -> DataFrame:
    """operating_summary of all asset-days held, with the benchmark's value and the part of it that was made."""
    series = intervals.groupBy("asset", "day", "ts").agg(F.sum("storage_mwh").alias("storage_mwh"), F.max("rrp").alias("rrp"), F.sum("energy_value").alias("energy_value"))
    best = opportunity_benchmark(series, capacity, levels).select("asset", "day", "benchmark_value", "capture_ratio")
    return operating_summary(intervals, capacity).join(best, ["asset", "day"], "left")


def top_value_share(intervals: DataFrame, asset: str, day: str, order: list[str], k: int = 5) -> DataFrame:
    """Part of a day's energy value that its k best intervals make; null if the day made nothing."""
    place = F.row_number().over(Window.partitionBy(asset, day).orderBy(F.col("energy_value").desc(), *order))
    s = intervals.withColumn("_k", place).groupBy(asset, day).agg(F.sum(F.when(F.col("_k") <= k, F.col("energy_value"))).alias("_top"), F.sum("energy_value").alias("_all"))
    return s.select(asset, day, F.when(F.col("_all") > 0, F.col("_top") / F.col("_all")).alias("top_share"))


# The hindsight benchmark: a dynamic programme over storage levels, for many days at once


def sliding_max(values: np.ndarray, before: int) -> np.ndarray:
    """Along the last axis the largest of each value and the `before` ones ahead of it, in time that does not depend on
    `before`: maxima from either end of blocks as long as the window, two of which cover any window."""
    n, width = values.shape[-1], before + 1
    padded = np.full((*values.shape[:-1], -(-(n + before) // width) * width), -np.inf)
    padded[..., before : before + n] = values
    cut = padded.reshape(*values.shape[:-1], -1, width)
    ahead = np.maximum.accumulate(cut, axis=-1).reshape(padded.shape)
    back = np.maximum.accumulate(cut[..., ::-1], axis=-1)[..., ::-1].reshape(padded.shape)
    return np.maximum(back[..., :n], ahead[..., before : before + n])


@dataclass
class Day:
    """Prices of a day's intervals, the battery, and its storage before the first and after the last of them."""

    prices: np.ndarray
    power: float
    capacity: float
    start: float
    end: float


def benchmark_days(days: list[Day], levels: int = LEVELS, round_trip: float = ROUND_TRIP) -> tuple[np.ndarray, list[np.ndarray]]:
    """Best energy value of each day with perfect foresight between two storage levels, and the MW of each interval that
    make it.

    Days are solved side by side. What a level is worth after an interval is the largest of the levels that reach it, each
    with its linear cost of charging or discharging taken off, so a step is two sliding maxima. An end that cannot be
    reached gives way to the nearest level that can, the lower of two. The way back takes, of moves that are as good but
    for rounding (NEAR), the one from the lowest level; the value is added up along it, so it has no rounding of the maxima.
    """
    if not days:
        return np.empty(0), []
    top, one_way = levels - 1, np.sqrt(round_trip)
    at = np.arange(levels)
    column = lambda f: np.array([f(d) for d in days], float)[:, None]
    capacity, limit = column(lambda d: d.capacity), column(lambda d: d.power) / PER_HOUR
    step = capacity / top
    nearest = lambda f: np.rint(np.clip(column(f), 0.0, capacity) / step).astype(int)[:, 0]
    first, wanted = nearest(lambda d: d.start), nearest(lambda d: d.end)
    up = np.minimum((limit * one_way / step + 1e-9).astype(int), top)[:, 0]
    down = np.minimum((limit / one_way / step + 1e-9).astype(int), top)[:, 0]
    size = np.array([len(d.prices) for d in days])
    prices = np.zeros((len(days), size.max(initial=0)))
    for row, d in zip(prices, days, strict=True):
        row[: len(d.prices)] = d.prices
    charge, discharge = step / one_way * at, step * one_way * at  # MWh at the grid from level 0
    value = np.full((len(days), levels), -np.inf)
    value[np.arange(len(days)), first] = 0.0
    held = [value]
    for t in range(prices.shape[1]):
        price, new = prices[:, t : t + 1], value.copy()
        for moves, worth, turn in ((up, charge * price, slice(None)), (down, discharge * price, slice(None, None, -1))):
            for width in np.unique(moves[t < size]):
                own = (moves == width) & (t < size)
                reached = sliding_max((value[own] + worth[own])[:, turn], int(width))[:, turn] - worth[own]
                new[own] = np.maximum(new[own], reached)
        value = new
        held.append(value)
    apart = np.where(value > -np.inf, np.abs(at - wanted[:, None]), levels)
    level = apart.argmin(axis=1)  # the lower of two
    grids = np.zeros(prices.shape)
    for t in range(prices.shape[1] - 1, -1, -1):
        move = level[:, None] - at  # levels up from each one before
        grid = np.where(move > 0, -move * step / one_way, -move * step * one_way)
        ways = np.where((move <= up[:, None]) & (move >= -down[:, None]), held[t] + grid * prices[:, t : t + 1], -np.inf)
        most = ways.max(axis=1, keepdims=True)
        before = (ways >= most - NEAR * np.maximum(1.0, np.abs(most))).argmax(axis=1)
        own = t < size
        grids[own, t] = grid[np.arange(len(days)), before][own]
        level = np.where(own, before, level)
    best = np.zeros(len(days))
    for t in range(prices.shape[1]):
        best = best + grids[:, t] * prices[:, t]
    return best, [row[:n] * PER_HOUR for row, n in zip(grids, size, strict=True)]


def benchmark_day(prices: np.ndarray, power: float, capacity: float, start: float, end: float, levels: int = LEVELS, round_trip: float = ROUND_TRIP) -> tuple[float, np.ndarray]:
    """benchmark_days of one day."""
    best, mw = benchmark_days([Day(np.asarray(prices, float), power, capacity, start, end)], levels, round_trip)
    return float(best[0]), mw[0]


def _solved(rows: pd.DataFrame, bounds: np.ndarray, levels: int) -> tuple[list[float | None], list[np.ndarray]]:
    """Days of rows in time order, each from one bound to the next: a null price counts as zero; storage starts and ends as
    first and last known, else half full; without power or capacity there is no benchmark."""
    prices, storage = rows["rrp"].fillna(0.0).to_numpy(float), rows["storage_mwh"].to_numpy(float)
    power, capacity = (rows[c].to_numpy(float) for c in ("power_mw", "capacity_mwh"))
    days, where = [], []
    for k, (a, b) in enumerate(pairwise(bounds)):
        if power[a] > 0 and capacity[a] > 0:
            known = storage[a:b][~np.isnan(storage[a:b])]
            start, end = (known[0], known[-1]) if len(known) else (capacity[a] / 2,) * 2
            days.append(Day(prices[a:b], power[a], capacity[a], start, end))
            where.append(k)
    best: list[float | None] = [None] * (len(bounds) - 1)
    mw = [np.full(b - a, np.nan) for a, b in pairwise(bounds)]
    for low in range(0, len(days), DAYS):
        values, plans = benchmark_days(days[low : low + DAYS], levels)
        for k, value, plan in zip(where[low:], values.tolist(), plans, strict=False):
            best[k], mw[k] = value, plan
    return best, mw


def _by_day(series: DataFrame, capacity: DataFrame, solve: Callable[[pd.DataFrame, np.ndarray], pd.DataFrame], schema: str) -> DataFrame:
    """Runs solve over whole asset-days: their rows are dealt by asset and day over all shuffle partitions, which Spark does
    not join again, sorted there, and handed on in batches cut between days. A task holds one batch and one day more."""
    df = series.select("asset", "day", "ts", F.col("rrp").cast("double").alias("rrp"), F.col("storage_mwh").cast("double").alias("storage_mwh"), F.col("energy_value").cast("double").alias("energy_value"))
    df = df.join(capacity.select("asset", "day", "power_mw", "capacity_mwh"), ["asset", "day"], "left")
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def cut(rows: pd.DataFrame) -> np.ndarray:
        codes = np.stack([pd.factorize(rows[c])[0] for c in ("asset", "day")])
        return np.flatnonzero(np.concatenate([[True], (codes[:, 1:] != codes[:, :-1]).any(axis=0)]))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept, size = [], 0
        for batch in batches:
            kept.append(batch)
            size += len(batch)
            if size < DAYS * PER_DAY:
                continue
            rows = pd.concat(kept, ignore_index=True)
            starts = cut(rows)
            if len(starts) > 1:
                yield solve(rows.iloc[: starts[-1]], starts)
            kept = [rows.iloc[starts[-1] :]]
            size = len(kept[0])
        if size:
            rows = pd.concat(kept, ignore_index=True)
            yield solve(rows, np.append(cut(rows), len(rows)))

    return df.repartition(n, "asset", "day").sortWithinPartitions("asset", "day", "ts").mapInPandas(run, schema)


def opportunity_benchmark(series: DataFrame, capacity: DataFrame, levels: int = LEVELS) -> DataFrame:
    """Per asset and day: n, energy_value, benchmark_value and capture_ratio (null unless the benchmark is above zero).
    series: asset, day, ts, rrp, storage_mwh, energy_value, one row per interval; capacity: asset, day, power_mw,
    capacity_mwh. Days are solved in batches, see _by_day."""
    kinds = dict(series.dtypes)

    def solve(rows: pd.DataFrame, bounds: np.ndarray) -> pd.DataFrame:
        best, _ = _solved(rows, bounds, levels)
        value = np.add.reduceat(rows["energy_value"].fillna(0.0).to_numpy(float), bounds[:-1])
        ratio = [v / b if b is not None and b > 0 else None for v, b in zip(value, best, strict=True)]
        first = rows.iloc[bounds[:-1]]
        return pd.DataFrame({"asset": first["asset"].to_numpy(), "day": first["day"].to_numpy(), "n": np.diff(bounds), "energy_value": value, "benchmark_value": best, "capture_ratio": ratio})

    return _by_day(series, capacity, solve, f"asset {kinds['asset']}, day {kinds['day']}, n long, energy_value double, benchmark_value double, capture_ratio double")


def benchmark_schedule(series: DataFrame, capacity: DataFrame, levels: int = LEVELS) -> DataFrame:
    """Per interval the benchmark's MW (null without one): asset, day, ts, rrp, benchmark_mw. See opportunity_benchmark."""
    kinds = dict(series.dtypes)

    def solve(rows: pd.DataFrame, bounds: np.ndarray) -> pd.DataFrame:
        return rows[["asset", "day", "ts", "rrp"]].assign(benchmark_mw=np.concatenate(_solved(rows, bounds, levels)[1]))

    return _by_day(series, capacity, solve, f"asset {kinds['asset']}, day {kinds['day']}, ts {kinds['ts']}, rrp double, benchmark_mw double")
