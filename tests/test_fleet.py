"""Batteries, generation and keys against hand-made values and plain searches."""

import datetime
import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import battery, documents, fuel, keys

DAY = datetime.date(2026, 7, 1)


def at(minutes):
    return datetime.datetime(2026, 7, 1) + datetime.timedelta(minutes=minutes)


def test_interval_value(spark):
    rows = [(120.0, 100.0, {"raise": 12.0}, {"raise": 50.0}), (-60.0, -100.0, {"raise": -5.0}, {"raise": 50.0}), (None, 100.0, None, None), (12.0, None, {"raise": None}, {})]
    df = spark.createDataFrame(rows, "mw double, rrp double, e map<string,double>, p map<string,double>")
    got = [tuple(r) for r in battery.interval_value(df, "mw", "rrp", "e", "p").select("charge_mwh", "discharge_mwh", "charging_cost", "discharge_value", "energy_value", "gross_fcas_value", "observable_gross_value").collect()]
    assert got == [(0.0, 10.0, 0.0, 1000.0, 1000.0, 50.0, 1050.0), (5.0, 0.0, -500.0, 0.0, 500.0, 0.0, 500.0), (0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0), (0.0, 1.0, 0.0, 0.0, 0.0, 0.0, 0.0)]


def test_flags(spark):
    df = spark.createDataFrame([(1.0, 5.0, 4.0), (None, None, 4.0), (0.0, -1.0, None), (0.0, 9.0, 0.0), (0.0, 4.05, 4.0)], "mw double, s double, c double")
    assert [r[0] for r in df.select(battery.quality_flags(F.col("mw"), F.col("s"), F.col("c"))).collect()] == [["storage_above_public_capacity"], ["missing_scada", "missing_storage"], ["storage_below_zero"], [], []]


def searched(prices, power, capacity, start, end, levels):
    """Best value and first best schedule over all ways, by memory of (interval, level)."""
    step, one_way, limit = capacity / (levels - 1), math.sqrt(0.9), power / 12
    up, down = int(limit * one_way / step + 1e-9), int(limit / one_way / step + 1e-9)
    best = {round(max(0.0, min(capacity, start)) / step): 0.0}
    for price in prices:
        after = {}
        for level in sorted(best):
            for to in range(max(0, level - down), min(levels - 1, level + up) + 1):
                d = (to - level) * step
                value = best[level] + (-d / one_way * price if d > 0 else -d * one_way * price)
                if value > after.get(to, -math.inf):
                    after[to] = value
        best = after
    goal = round(max(0.0, min(capacity, end)) / step)
    return best[min(sorted(best), key=lambda k: abs(k - goal))]


def test_benchmark_is_the_search():
    rnd = random.Random(4)
    for _ in range(60):
        levels, n = rnd.choice([5, 11, 21]), rnd.randint(1, 10)
        prices = np.array([rnd.choice([-50, 0, 20, 100, 300]) + rnd.random() for _ in range(n)])
        case = (rnd.choice([6.0, 12.0, 60.0]), rnd.choice([2.0, 10.0]), rnd.uniform(-1, 11), rnd.uniform(-1, 11), levels)
        value, mw = battery.benchmark_day(prices, *case)
        assert abs(value - searched(prices, *case)) < 1e-9
        assert abs(value - float((mw / 12 * prices).sum())) < 1e-9 and np.abs(mw).max() <= case[0] + 1e-6


def test_benchmark_jobs(spark):
    series = [("a", DAY, at(5 * k), p, s, 1.0) for k, (p, s) in enumerate([(0.0, 5.0), (None, None), (200.0, None), (200.0, 5.0)])] + [("b", DAY, at(5), 10.0, None, 1.0), ("c", DAY, at(5), 10.0, 1.0, 1.0)]
    df = spark.createDataFrame(series, "asset string, day date, ts timestamp_ntz, rrp double, storage_mwh double, energy_value double")
    capacity = spark.createDataFrame([("a", DAY, 12.0, 10.0), ("b", DAY, 0.0, 10.0)], "asset string, day date, power_mw double, capacity_mwh double")
    got = {r["asset"]: r for r in battery.opportunity_benchmark(df, capacity).collect()}
    assert got["a"]["benchmark_value"] > 100 and got["a"]["capture_ratio"] == 4.0 / got["a"]["benchmark_value"]
    assert (got["b"]["benchmark_value"], got["b"]["capture_ratio"], got["c"]["benchmark_value"]) == (None, None, None)
    plan = {r["ts"]: r["benchmark_mw"] for r in battery.benchmark_schedule(df, capacity).where("asset = 'a'").collect()}
    assert plan[at(0)] < 0 < plan[at(15)]
    assert battery.opportunity_benchmark(df.where("false"), capacity).count() == 0


def test_operating_summary(spark):
    def day(asset, n, missing=0):
        return [(asset, DAY, at(5 * k + 5), 12.0 if k % 2 else -12.0, None if k < missing else 2.0, 12.0, [] if k >= missing else ["missing_storage"]) for k in range(n)]

    rows = day("whole", 288) + day("short", 287) + day("blank", 288, missing=3)
    df = spark.createDataFrame(rows, "asset string, day date, ts timestamp_ntz, scada_mw double, storage_mwh double, rrp double, flags array<string>").withColumn("e", F.create_map(F.lit("raise"), F.lit(0.0)))
    valued = battery.interval_value(df, "scada_mw", "rrp", "e", "e")
    capacity = spark.createDataFrame([(a, DAY, 1, 24.0) for a in ("whole", "short", "blank")], "asset string, day date, units int, capacity_mwh double")
    got = {r["asset"]: r for r in battery.operating_summary(valued, capacity).collect()}
    assert (got["whole"]["status"], got["whole"]["notes"], got["whole"]["equivalent_cycles"], got["whole"]["capture_price"]) == ("complete", [], 6.0, 12.0)
    assert got["short"]["status"] == "partial" and got["short"]["notes"] == ["intervals 287 of 288", "readings 287 of 288", "storage values 287 of 288"]
    assert got["blank"]["notes"] == ["storage values 285 of 288"]


def test_recalculation_is_summary_and_benchmark(spark):
    from tidemark.plans import fleet

    sf = "/root/testdata/sf0.001"
    again = {(r["asset"], r["day"]): r for r in fleet.b18_recalculate_summaries(spark, sf).collect()}
    best = {(r["asset"], r["day"]): r for r in fleet.b9_opportunity_benchmark(spark, sf).collect()}
    assert again and set(again) == set(best)
    assert all((again[k]["benchmark_value"] is None) == (best[k]["benchmark_value"] is None) for k in best)
    assert all(best[k]["benchmark_value"] is None or abs(again[k]["benchmark_value"] - best[k]["benchmark_value"]) < 1e-5 for k in best)


def test_fuel_rules(spark):
    cases = [(("Coal", "Brown coal", ""), "Brown coal"), (("coal", None, None), "Black coal"), ((" Battery Storage", "", ""), "Battery"), (("Gas Turbine", "", "Natural gas"), "Gas"), (("Gas Turbine", "", "Diesel"), "Liquid Fuel"), (("Steam", "", "Landfill methane"), "Biomass"), (("Steam", "Biomass", ""), "Biomass"), ((None, None, None), "Other"), (("Gas turbine", "", "Fuel Oil / biofuel"), "Biomass"), (("solar pv", "", "diesel"), "Solar")]
    df = spark.createDataFrame([c for c, _ in cases], "t string, d string, g string")
    assert [r[0] for r in df.select(fuel.classify_fuel(F.col("t"), F.col("d"), F.col("g"))).collect()] == [w for _, w in cases]


def test_registry(spark):
    rows = [(1, "A1, B1;C1", "NSW1", "steam", "", "", "In Service"), (2, "A1", "QLD1", "wind", "", "", "In Service"), (3, "B1", "VIC1", "wind", "", "", "Closed"), (4, "C1", "VIC1", "steam", "", "", "In Commissioning"), (5, None, "SA1", "wind", "", "", "In Service")]
    df = spark.createDataFrame(rows, "line int, units string, region string, t string, d string, g string, status string")
    got = {tuple(r) for r in fuel.unit_registry(df, units="units", region="region", technology="t", detail="d", gas_fuel="g", status="status", line="line").collect()}
    assert got == {("A1", "QLD", "Wind"), ("B1", "NSW", "Other"), ("C1", "NSW", "Other")}


def test_keys_with_nulls(spark):
    a = spark.createDataFrame([(1, "x", 1), (None, "x", 2), (2, None, 3)], "k int, s string, v int")
    b = spark.createDataFrame([(None, "x", 20), (3, "y", 30)], "k int, s string, v int")
    rows = lambda df: sorted(map(tuple, df.collect()), key=repr)
    assert rows(keys.plain_upsert(a, b, ["k", "s"])) == rows(spark.createDataFrame([(1, "x", 1), (2, None, 3), (None, "x", 20), (3, "y", 30)], a.schema))
    assert rows(keys.replace_slice(a, b, ["k"])) == rows(spark.createDataFrame([(1, "x", 1), (2, None, 3), (None, "x", 20), (3, "y", 30)], a.schema))
    assert rows(keys.replace_slice(a, b.where("false"), ["k"])) == rows(a) and rows(keys.plain_upsert(a.where("false"), b, ["k"])) == rows(b)
    assert rows(documents.append_new(a, b.unionAll(b), ["k", "s"])) == rows(a.unionAll(b.where("k = 3")))
    assert rows(keys.newest_wins_merge(a, b, ["k", "s"], "v")) == rows(keys.plain_upsert(a, b, ["k", "s"])) and keys.superseded(a, b.withColumn("v", F.lit(2)), ["k", "s"], "v").first() == (0, 2)
    known, lost = keys.orphan_split(a, spark.createDataFrame([(1,), (1,), (None,)], "k int"), ["k"])
    assert rows(known) == [(1, "x", 1)] and lost.count() == 2
    assert [r["k"] for r in keys.null_unknown_fk(a, b.where("k = 3").selectExpr("1 AS id", "v"), "k", "id").orderBy("v").collect()] == [1, None, None]


def test_replace_day_and_documents(spark):
    stored = spark.createDataFrame([("u", "d1", "old"), ("u", "d2", "keep"), (None, "d1", "none")], "user string, day string, task string")
    new = spark.createDataFrame([("u", "d1", "new"), ("u", "d9", "not asked for")], stored.schema)
    days = spark.createDataFrame([("u", "d1"), (None, "d1")], "user string, day string")
    assert sorted(map(tuple, documents.replace_day(stored, new, days, "user", "day").collect())) == [("u", "d1", "new"), ("u", "d2", "keep")]
    tables = {"tasks": (stored.where("user = 'u'"), "day", "task"), "notes": (new.where("day = 'd9'"), "day", "task")}
    got = documents.rebuild_documents(tables, "user").first()["document"]
    again = documents.decompose_documents(spark.createDataFrame([("u", got)], "user string, document string"), "user", "document").collect()
    assert {r["namespace"] for r in again} == {"tasks", "notes"}
    import json

    assert json.loads(json.loads(got)["tasks"]) == {"d1": "old", "d2": "keep"}


def test_orders_of_merge_agree(spark):
    base = [(1, 5, "a")]
    for order in itertools.permutations([(1, 4, "stale"), (1, 5, "tie"), (1, 9, "new")]):
        stored = spark.createDataFrame(base, "k int, at int, v string")
        for row in order:
            stored = keys.newest_wins_merge(stored, spark.createDataFrame([row], stored.schema), ["k"], "at")
        assert [tuple(r) for r in stored.collect()] == [(1, 9, "new")]


def test_drop_implausible_by_plain_walk(spark):
    from tidemark.operators import gas

    rnd = random.Random(9)
    rows = [(f, DAY + datetime.timedelta(days=d), float(rnd.choice([100, 1000, 1100, 1250, 5000, 0]) + rnd.randint(0, 90))) for f in range(6) for d in range(40) if rnd.random() < 0.9]
    got = {(r["f"], r["d"]): r["kept"] for r in gas.drop_implausible(spark.createDataFrame([*rows, (9, DAY, None)], "f int, d date, v double"), "f", "d", "v").collect()}
    for f in range(6):
        mine = sorted((d, v) for g, d, v in rows if g == f)
        reach, last = max(float(np.median([v for _, v in mine])) * 0.5, 200.0), None
        for d, v in mine:
            good = last is None or abs(v - last) <= reach
            assert got[(f, d)] == good
            last = v if good else last
    assert len(got) == len(rows)


@pytest.mark.parametrize("before", [0, 1, 3, 8, 200])
def test_sliding_maximum(before):
    values = np.random.default_rng(before).normal(size=(4, 37))
    values[1, ::3] = -np.inf
    want = [[max(row[max(0, k - before) : k + 1]) for k in range(37)] for row in values]
    assert np.array_equal(battery.sliding_max(values, before), want)


def test_days_of_any_size_are_solved_side_by_side():
    rnd = np.random.default_rng(3)
    days = [battery.Day(np.round(rnd.normal(40, 80, n), 1), power, capacity, start, capacity / 3) for n, power, capacity, start in ((7, 5, 10, 0), (288, 50, 100, 40), (1, 200, 50, 50), (40, 1, 400, 399), (12, 30, 60, 7))]
    best, mw = battery.benchmark_days(days)
    for day, value, plan in zip(days, best, mw, strict=True):
        alone, own = battery.benchmark_day(day.prices, day.power, day.capacity, day.start, day.end)
        assert alone == value and np.array_equal(own, plan) and len(plan) == len(day.prices)
        assert abs(float((plan / 12 * day.prices).sum()) - value) < 1e-6


def test_registrations_meet_days_by_an_equality(spark):
    """No product of both sides where Spark may not broadcast; open and reversed ranges, missing starts, months apart."""
    date = datetime.date
    regs = spark.createDataFrame([("a", date(2024, 1, 31), date(2024, 2, 1)), ("b", date(2023, 5, 1), None), ("c", None, None), ("d", date(2024, 3, 1), date(2024, 2, 1)), ("e", date(2019, 1, 1), date(2030, 1, 1)), ("f", date(2024, 2, 2), date(2024, 2, 2))], "unit string, s date, e date")
    days = spark.createDataFrame([(date(2024, 1, 31),), (date(2024, 2, 1),), (date(2024, 2, 2),), (date(2024, 4, 1),), (None,)], "day date")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        held = battery.effective_registrations(regs, days, "day", "s", "e")
        plan = held._jdf.queryExecution().executedPlan().toString()
        got = sorted((r["unit"], r["day"]) for r in held.collect())
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "CartesianProduct" not in plan and "SortMergeJoin" in plan
    assert got == sorted((u, d) for u, s, e in (tuple(r) for r in regs.collect()) for (d,) in days.collect() if d and s and s <= d and (e is None or d <= e))
