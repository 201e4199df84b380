"""Nulls, missing rows and empty tables in registers, supplements and account evidence."""

from datetime import date

from pyspark.sql import functions as F

from tidemark.operators import accounts, registers, supplements

PREPARED = "country string, key string, raw double, observations long, year int"


def test_annotate_updates_only_held_points(spark):
    points = spark.createDataFrame([(1, "a"), (2, None), (3, "c")], "id int, zone string")
    notes = spark.createDataFrame([(2, "x"), (9, "y")], "id int, zone string")
    assert sorted(map(tuple, registers.annotate(points, notes, ["id"], "zone").collect())) == [(1, "a", False), (2, "x", True), (3, "c", False)]
    assert [r["id"] for r in registers.unmatched(points, notes, ["id"]).collect()] == [9]


def test_missing_runs_without_any_run(spark):
    regions = spark.createDataFrame([("A",), ("B",)], "region string")
    runs = spark.createDataFrame([("A", 2), ("B", 1)], "region string, origin int")
    assert [r[0] for r in registers.missing_runs(regions, runs, "region", "origin").collect()] == ["B"]
    assert registers.missing_runs(regions, runs.limit(0), "region", "origin").count() == 2


def test_charging_is_no_generation(spark):
    readings = spark.createDataFrame([("d", "u", 12.0), ("d", "u", -60.0), ("d", "v", 24.0), ("d", "v", None)], "day string, unit string, mw double")
    mapped = registers.mapped_energy(readings, spark.createDataFrame([("u", "Coal")], "unit string, label string"), "unit", "mw", "label")
    assert [(r["mapped_mwh"], r["unknown_mwh"], r["passed"]) for r in registers.mapping_coverage(mapped, "day", "label").collect()] == [(1.0, 2.0, False)]


def test_supplements(spark):
    held = spark.createDataFrame([("A", "k", 5.0, 3, None), ("B", "k", 5.0, 1, 2020), ("C", "k", None, 1, 2020), ("D", "k", 5.0, 1, 2001)], PREPARED)
    seen = spark.createDataFrame([("A", "k", 2016, 1, 7.0), ("B", "k", 2019, 1, 7.0), ("C", "k", 2019, 1, 6.0), ("C", "k", 2019, 2, 7.0), ("C", "k", 2020, 1, None), ("D", "k", 2014, 1, 7.0), ("E", "k", 2018, 1, 7.0)], "country string, key string, year int, ord int, value double")
    latest = supplements.latest_value(seen, "year", "ord", "value")
    raw = lambda df: {r["country"]: (r["raw"], r["filled"]) for r in df.collect()}
    assert raw(supplements.supplement_latest(held, latest, F.col("p.raw") > 0)) == {"A": (5.0, False), "B": (5.0, False), "C": (7.0, True), "D": (5.0, False), "E": (7.0, True)}
    assert raw(supplements.supplement_newer(held, latest, F.col("p.raw") > 0)) == {"A": (7.0, True), "B": (5.0, False), "C": (7.0, True), "D": (5.0, False), "E": (7.0, True)}
    assert supplements.supplement_latest(held.limit(0), latest.limit(0), F.col("p.raw") > 0).count() == 0


def test_reserve_cover_needs_imports(spark):
    held = spark.createDataFrame([("A", "r", 10.0, 1, 2020), ("A", "m", 4.0, 1, 2018), ("B", "r", 1.0, 1, 2020), ("B", "m", 0.0, 1, 2020), ("C", "r", 1.0, 1, 2020)], PREPARED)
    assert [tuple(r) for r in supplements.reserve_cover(held, "r", "m", "cover").collect()] == [("A", "cover", 2.5, 1, 2018)]


def test_trend_evidence(spark):
    steady = [(1, date(2024 + m // 12, m % 12 + 1, 1), 100.0 + 10 * m, float(m)) for m in range(13)]
    short = [(2, date(2024, 1, 1), 0.0, 10.0), (2, date(2024, 3, 1), 5.0, None), (2, date(2024, 4, 1), 8.0, 4.0), (3, date(2024, 1, 1), 1.0, 1.0)]
    found = {r["account_id"]: r for r in accounts.trend_evidence(spark.createDataFrame(steady + short, "account_id int, month date, arr double, usage double"), "usage").collect()}
    assert set(found) == {1, 2}
    assert (found[1]["eligible"], found[1]["arr_change_pct"], found[1]["usage_change_pp"]) == (True, 90.9, 10.0)
    assert (found[2]["eligible"], found[2]["arr_change_pct"], found[2]["usage_change_pp"], found[2]["span_months"]) == (False, None, -6.0, 3)


def test_completeness_by_brute_force(spark):
    from pyspark.sql import functions as F

    from tidemark.operators import keys

    rows = [("a", 1), ("a", 1), ("a", 2), ("b", 2), ("b", 3), ("c", None), (None, 1), ("d", 4), ("d", 4)]
    df = spark.createDataFrame(rows, "k string, d int")
    held = [r for r in rows if r[1] is not None]
    for expected in (0, 1, 2):
        want = {(k, d, n) for k in {r[0] for r in held} for d in {r[1] for r in held} if (n := held.count((k, d))) != expected}
        got = keys.completeness_gate(df, "k", F.col("d"), expected)
        assert {tuple(r) for r in got.collect()} == want and got.count() == len(want)
    assert keys.completeness_gate(df.where("false"), "k", F.col("d"), 1).count() == 0
