"""Forecast jobs: the leakage guard, temperatures and their sources, features, coefficients, learned models."""

import datetime
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions import calendar
from tidemark.operators import forecast, price

HALF = datetime.timedelta(minutes=30)
ORIGIN = datetime.datetime(2026, 6, 7)  # a Sunday
WEEK = datetime.timedelta(days=7)
PRICES, WEATHER = "region string, ts timestamp_ntz, rrp double, demand double", "region string, ts timestamp_ntz, kind string, temperature double"


def series(weeks, value):
    return [("r", ORIGIN - k * HALF, value(ORIGIN - k * HALF), 1000.0) for k in range(336 * weeks)]


def test_nothing_after_the_origin_is_used(spark):
    rows = series(5, lambda t: 100.0) + [("r", ORIGIN + k * HALF, 99999.0, 1000.0) for k in range(1, 337)]
    weather = [("r", ORIGIN + k * HALF, "observed", 20.0) for k in range(-336 * 5, 337)]
    prices, w = spark.createDataFrame(rows, PRICES), spark.createDataFrame(weather, WEATHER)
    grid = spark.createDataFrame([("r", ORIGIN, ORIGIN + k * HALF) for k in range(1, 337)], "region string, origin timestamp_ntz, ts timestamp_ntz")
    ladder = forecast.forecast_ladder(prices, w, grid)
    got = {r["model"]: r for r in ladder.groupBy("model").agg(F.count("*").alias("n"), F.max("predicted").alias("most"), F.min("leakage_safe").alias("safe"), F.max("temperature_source").alias("source")).collect()}
    assert {m: (r["n"], r["most"]) for m, r in got.items()} == dict.fromkeys(("seasonal_naive", "rolling_median", "temperature_adjusted"), (336, 100.0))
    assert (got["temperature_adjusted"]["safe"], got["temperature_adjusted"]["source"], got["seasonal_naive"]["safe"]) == (False, "observed-fallback", True)


def test_reference_and_target_temperatures(spark):
    w = spark.createDataFrame([("r", ORIGIN - HALF, "observed", 1.0), ("r", ORIGIN - HALF, "forecast", 2.0), ("r", ORIGIN, "forecast", 3.0), ("r", ORIGIN + HALF, "forecast", 4.0), ("r", ORIGIN + HALF, "observed", 5.0), ("s", ORIGIN + HALF, "observed", 6.0), ("s", ORIGIN + 2 * WEEK, "forecast", 7.0), ("s", None, "observed", 1.0), ("r", ORIGIN + 2 * HALF, "observed", 8.0)], WEATHER)
    ref = {(r["region"], r["ts"]): r["temperature"] for r in forecast.reference_temperature(w).collect()}
    assert ref[("r", ORIGIN - HALF)] == 1.0 and ref[("r", ORIGIN)] == 3.0
    o = spark.createDataFrame([("r", ORIGIN), ("s", ORIGIN), ("t", ORIGIN)], "region string, origin timestamp_ntz")
    assert {(r["region"], r["ts"], r["temperature"], r["source"]) for r in forecast.target_temperature(w, o).collect()} == {("r", ORIGIN + HALF, 4.0, "forecast"), ("s", ORIGIN + HALF, 6.0, "observed-fallback")}


def test_market_temperature(spark):
    prices = spark.createDataFrame([("a", ORIGIN, 100.0, 8000.0), ("b", ORIGIN, 50.0, 2000.0)], PRICES)
    w = spark.createDataFrame([("a", ORIGIN, "observed", 20.0), ("b", ORIGIN, "observed", 10.0), ("a", ORIGIN + HALF, "forecast", 20.0), ("b", ORIGIN + HALF, "forecast", 10.0), ("ALL", ORIGIN, "observed", 99.0)], WEATHER)
    got = forecast.market_temperature(w, prices, price.demand_shares(prices, "region", "demand")).collect()
    assert {(r["ts"], round(r["temperature"], 9)) for r in got} == {(ORIGIN, 18.0), (ORIGIN + HALF, 18.0)}
    market = price.market_aggregate(prices, "region", "ts", "rrp", "demand").first()
    assert (market["rrp"], market["demand"]) == (90.0, 10000.0)


def test_bands_and_slots(spark):
    times = [datetime.datetime(2026, 8, 4, 0, 0), datetime.datetime(2026, 8, 4, 17, 0), datetime.datetime(2026, 8, 4, 17, 30), datetime.datetime(2026, 8, 4, 9, 0), datetime.datetime(2026, 8, 4, 9, 30)]
    df = spark.createDataFrame([(t,) for t in times], "t timestamp_ntz")
    rows = df.select(calendar.week_slot(F.col("t")), calendar.time_band(F.col("t")), calendar.latest_sunday(F.to_date("t"))).collect()
    assert [r[0] for r in rows] == [47, 81, 82, 65, 66] and [r[1] for r in rows] == ["late", "afternoon", "evening", "morning", "midday"]
    assert {r[2] for r in rows} == {datetime.date(2026, 8, 2)}
    ends = [(0, 5, 0, 30), (0, 30, 0, 30), (23, 35, 24, 0)]
    got = spark.createDataFrame([(datetime.datetime(2026, 8, 4, h, m),) for h, m, *_ in ends], "t timestamp_ntz").select(calendar.interval_end(F.col("t"))).collect()
    assert [r[0] for r in got] == [datetime.datetime(2026, 8, 4) + datetime.timedelta(hours=h, minutes=m) for *_, h, m in ends]


def test_betas_find_the_slopes(spark):
    rnd = random.Random(1)
    temp = {ORIGIN - k * HALF: rnd.uniform(5, 30) for k in range(336 * 4)}
    rows = [("r", t, 50 + 3 * max(c - 18, 0) + 2 * max(18 - c, 0), 1000.0) for t, c in temp.items()]
    prices, w = spark.createDataFrame(rows, PRICES), spark.createDataFrame([("r", t, "observed", c) for t, c in temp.items()], WEATHER)
    o = spark.createDataFrame([("r", ORIGIN), ("r", ORIGIN - WEEK * 10)], "region string, origin timestamp_ntz")
    table = forecast.beta_table(forecast.origin_betas(forecast.interval_pairs(prices, forecast.reference_temperature(w)), o)).collect()
    assert len(table) == 6 and all(abs(r["beta_cool"] - 3) < 1e-6 and abs(r["beta_heat"] - 2) < 1e-6 and r["reason"] is None for r in table)


def test_collinear_inputs_fit_cooling_first(spark):
    pairs = [("x", float(k % 5), 0.0, 2.0 * (k % 5)) for k in range(60)] + [("y", 0.0, float(k % 5), 3.0 * (k % 5)) for k in range(60)] + [("z", 0.0, 0.0, 1.0)] * 60 + [("few", 1.0, 1.0, 1.0)] * 3
    got = {r["band"]: (round(r["beta_cool"], 9), round(r["beta_heat"], 9), r["reason"]) for r in price.fit_betas(spark.createDataFrame(pairs, "band string, d_cool double, d_heat double, d_price double"), ["band"]).collect()}
    assert got == {"x": (2.0, 0.0, None), "y": (0.0, 3.0, None), "z": (0.0, 0.0, None), "few": (0.0, 0.0, "too few pairs")}


def test_features_by_hand(spark):
    value = lambda t: float((t - datetime.datetime(2026, 1, 1)).total_seconds() // 1800 % 97)
    prices = spark.createDataFrame(series(5, value), PRICES)
    target = ORIGIN + datetime.timedelta(hours=17, minutes=30)
    ref = spark.createDataFrame([("r", target - WEEK, 12.0)], "region string, ts timestamp_ntz, temperature double")
    ahead = spark.createDataFrame([("r", ORIGIN, target, 21.0), ("r", ORIGIN, target + HALF, 21.0)], "region string, origin timestamp_ntz, ts timestamp_ntz, temperature double")
    points = spark.createDataFrame([("r", ORIGIN, target), ("r", ORIGIN, target + HALF), ("r", ORIGIN, target + 20 * WEEK)], "region string, origin timestamp_ntz, ts timestamp_ntz")
    (row,) = forecast.feature_matrix(points, prices, ref, ahead).collect()
    lags = [value(target - k * WEEK) for k in (1, 2, 3, 4)]
    assert len(forecast.FEATURES) == 29 and [row[f"price_lag_{k}w"] for k in (1, 2, 3, 4)] == lags
    assert row["price_lag_median_4w"] == float(np.median(lags)) and row["price_lag_spread_4w"] == max(lags) - min(lags) and row["horizon_days"] == 17.5 / 24
    assert (row["temp_delta_1w"], row["cooling_delta_1w"], row["heating_delta_1w"], row["band_evening"], row["is_weekend"]) == (9.0, 3.0, -6.0, 1.0, 1.0)
    assert abs(row["hour_sin"] - math.sin(2 * math.pi * 34 / 48)) < 1e-12 and abs(row["month_cos"] - math.cos(2 * math.pi * 5 / 12)) < 1e-12


@pytest.mark.parametrize("kind", ["forest", "boosting", "network"])
def test_learned_models_stay_within_what_they_saw(spark, kind):
    rnd = random.Random(2)
    rows = series(8, lambda t: 40 + 30 * math.sin(t.hour / 24 * 2 * math.pi) + rnd.random()) + [("r", ORIGIN + k * HALF, 99999.0, 1000.0) for k in range(1, 337)]
    w = spark.createDataFrame([("r", ORIGIN + k * HALF, "observed", 15.0 + 5 * math.sin(k / 48 * 2 * math.pi)) for k in range(-336 * 8, 337)], WEATHER)
    prices = spark.createDataFrame(rows, PRICES)
    grid = spark.createDataFrame([("r", ORIGIN, ORIGIN + k * HALF) for k in range(1, 337)], "region string, origin timestamp_ntz, ts timestamp_ntz")
    runs, reference = grid.select("region", "origin").distinct(), forecast.reference_temperature(w)
    train, ask = forecast.training_matrix(prices, reference, runs), forecast.feature_matrix(grid, prices, reference, forecast.target_temperature(w, runs))
    small = {"forest": {"trees": 10, "depth": 6}, "boosting": {"rounds": 60}}
    made = forecast.fit_predict_network(train, ask) if kind == "network" else forecast.fit_predict_trees(train, ask, kind, **small[kind])[0]
    got = {r["ts"]: r["predicted"] for r in made.collect()}
    truth = {ORIGIN + k * HALF: 40.5 + 30 * math.sin((ORIGIN + k * HALF).hour / 24 * 2 * math.pi) for k in range(1, 337)}
    assert set(got) == set(truth) and max(got.values()) <= 71.0
    assert np.mean([abs(got[t] - truth[t]) for t in truth]) < 6
    few = train.where(F.col("ts") > F.lit(ORIGIN - datetime.timedelta(days=3)))
    assert (forecast.fit_predict_network(few, ask) if kind == "network" else forecast.fit_predict_trees(few, ask, kind)[0]).count() == 0


def test_interpolation_and_rollup(spark):
    hourly = spark.createDataFrame([("r", ORIGIN, 10.0), ("r", ORIGIN + 2 * HALF, 20.0), ("r", ORIGIN + 6 * HALF, 40.0)], "region string, ts timestamp_ntz, v double")
    got = sorted((r["ts"], r["v"]) for r in price.interpolate_half_hours(hourly, ["region"], "ts", "v").collect())
    assert got == [(ORIGIN, 10.0), (ORIGIN + HALF, 15.0), (ORIGIN + 2 * HALF, 20.0), (ORIGIN + 6 * HALF, 40.0)]
    five = spark.createDataFrame([("r", ORIGIN + datetime.timedelta(minutes=5 * k), 10.0 * k) for k in range(1, 7)], "region string, ts timestamp_ntz, v double")
    assert [tuple(r) for r in price.half_hour_rollup(five, ["region"], "ts", ["v"]).collect()] == [("r", ORIGIN + HALF, 35.0)]


def plain_split(x, y, leaf, l2=0.0):
    """The best first split by trying all, as (gain, feature, rows to the left)."""
    best = (0.0, None, None)
    whole = y.sum() ** 2 / (len(y) + l2)
    for f in range(x.shape[1]):
        for cut in np.unique(x[:, f])[:-1]:
            left = x[:, f] <= cut
            if min(left.sum(), (~left).sum()) >= leaf:
                gain = y[left].sum() ** 2 / (left.sum() + l2) + y[~left].sum() ** 2 / ((~left).sum() + l2) - whole
                if gain > best[0] + 1e-9:
                    best = (gain, f, frozenset(np.flatnonzero(left)))
    return best


@pytest.mark.parametrize("leaf", [1, 5, 20])
def test_trees_split_where_brute_force_does(leaf):
    from tidemark.functions import trees

    rnd = np.random.default_rng(leaf)
    x, y = np.round(rnd.normal(size=(60, 4)), 1), rnd.normal(size=60)
    edges = trees.bin_edges(x)
    codes = trees.binned(x, edges)
    for l2 in (0.0, 1.0):
        tree = trees.grow(codes, y, 1, leaf, l2)
        gain, f, left = plain_split(x, y, leaf, l2)
        assert tree.feature[0] == f and frozenset(np.flatnonzero(codes[:, f] <= tree.bin[0])) == left
        assert abs(tree.gains[f] - gain) < 1e-9
        one = tree.predict(codes)
        for side in (sorted(left), sorted(set(range(60)) - left)):
            assert np.allclose(one[side], y[side].sum() / (len(side) + l2))
    deep = trees.grow(codes, y, 14, leaf)
    at = deep.predict(codes)
    assert all((at == v).sum() >= leaf for v in np.unique(at)) and (deep.feature >= 0).sum() == (deep.feature < 0).sum() - 1
    if leaf == 1:
        groups = {tuple(c): [] for c in codes}
        for c, v in zip(codes, y, strict=True):
            groups[tuple(c)].append(v)
        assert np.allclose(at, [np.mean(groups[tuple(c)]) for c in codes])


def test_forest_and_boosting_learn():
    from tidemark.functions import trees

    rnd = np.random.default_rng(1)
    x = rnd.uniform(-1, 1, size=(1500, 5))
    y = np.where(x[:, 0] > 0, 3.0, -1.0) + x[:, 1] + 0.05 * rnd.normal(size=1500)
    for fit, params in ((trees.forest, {"trees": 30, "depth": 8}), (trees.boosting, {"rounds": 150})):
        made, shares = fit(x[:1200], y[:1200], x[1200:], 7, **params)
        assert np.abs(made - y[1200:]).mean() < 0.15 and shares.argmax() == 0 and abs(shares.sum() - 1) < 1e-9
        assert np.array_equal(made, fit(x[:1200], y[:1200], x[1200:], 7, **params)[0])
        constant, _ = fit(np.zeros((40, 2)), np.full(40, 2.0), np.zeros((3, 2)), 7)
        assert np.allclose(constant, 2.0)


def test_all_runs_are_fitted_at_once(spark):
    """Runs of two regions and two origins: facts for each, those with too few rows named as not trained, and no job per run."""
    rows = [(g, ORIGIN - k * HALF, 40 + 10 * math.sin(k / 24) + d, 1000.0) for g, d in (("a", 0), ("b", 20)) for k in range(336 * 7)]
    w = spark.createDataFrame([(g, ORIGIN + k * HALF, "observed", 15.0) for g in "ab" for k in range(-336 * 7, 337)], WEATHER)
    prices = spark.createDataFrame(rows, PRICES)
    grid = spark.createDataFrame([(g, o, o + k * HALF) for g in "ab" for o in (ORIGIN, ORIGIN - WEEK * 2) for k in range(1, 337)], "region string, origin timestamp_ntz, ts timestamp_ntz")
    runs, reference = grid.select("region", "origin").distinct(), forecast.reference_temperature(w)
    train, ask = forecast.training_matrix(prices, reference, runs), forecast.feature_matrix(grid, prices, reference, forecast.target_temperature(w, runs))
    made, told = forecast.fit_predict_forest(train, ask, trees=5)
    facts = {(r["region"], r["origin"]): r for r in told.collect()}
    assert len(facts) == 4 and facts["a", ORIGIN]["trained"] and facts["a", ORIGIN]["training_rows"] == 336 * 3 and len(facts["b", ORIGIN]["top_features"]) == 10
    assert not facts["a", ORIGIN - WEEK * 2]["trained"] and {(r["region"], r["origin"]) for r in made.select("region", "origin").distinct().collect()} == {("a", ORIGIN), ("b", ORIGIN)}
    assert made.count() == 2 * 336


def test_ladder_reads_lines_into_series_once(spark):
    from tidemark.plans import ladder

    found = ladder.p20_forecast_ladder(spark, "/root/testdata/sf0.001").inputFiles()
    assert found and not any("lineitem" in f for f in found)
