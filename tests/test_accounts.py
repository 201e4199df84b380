"""Account scores, evidence and archetypes against hand-made values and plain Python."""

import datetime
import itertools
import math
import random

from pyspark.sql import functions as F

from tidemark.operators import accounts, archetypes, health

TODAY = datetime.date(2026, 7, 30)
ACCOUNT = "account_id string, account_name string, segment string, customer_since date, contract_start date, renewal_date date, last_qbr_date date, overdue_flag boolean, tickets_12mo int, pct_high_priority double, seat_utilisation_pct double, active_user_pct double, term_length_months int, current_arr double, avg_monthly_revenue_6mo double, entry_arr double, total_revenue_36mo double, arr_trend_pct double"
TIMELINE = "account_id string, month date, arr double, seat_utilisation_pct double, active_user_pct double, tickets_opened int"


def back(days):
    return TODAY - datetime.timedelta(days=days)


def account(name, **given):
    row = dict.fromkeys(c.split()[0] for c in ACCOUNT.split(", ")) | {"account_id": name, "account_name": name} | given
    return tuple(row.values())


def month(k):
    return datetime.date(2024 + (k // 12), k % 12 + 1, 1)


def test_compass_and_pulse(spark):
    rows = [
        account("best", segment="SMB", customer_since=back(3000), contract_start=back(100), renewal_date=back(-900), last_qbr_date=back(10), overdue_flag=False, tickets_12mo=0, pct_high_priority=0.0, seat_utilisation_pct=95.0, active_user_pct=90.0, term_length_months=36),
        account("worst", segment="Enterprise", customer_since=back(400), contract_start=back(10), renewal_date=back(-30), last_qbr_date=back(399), overdue_flag=True, tickets_12mo=40, pct_high_priority=100.0, seat_utilisation_pct=5.0, active_user_pct=5.0, term_length_months=12, arr_trend_pct=-20.0),
        account("nothing"), account("no review", segment="Other", customer_since=back(200), contract_start=back(190), term_length_months=24),
    ]
    df = spark.createDataFrame(rows, ACCOUNT)
    got = {r["account_id"]: r for r in health.signal_compass(df, F.lit(TODAY)).collect()}
    assert (got["best"]["score"], got["best"]["band"], got["best"]["data_completeness"], got["best"]["positive_points"]) == (100.0, "Healthy", 100.0, 14.0)
    assert got["worst"]["score"] == 0.0 and got["worst"]["band"] == "Critical"
    assert [(d["signal"], d["value"]) for d in got["worst"]["drivers"]] == [("QBR overdue", 25.0), ("Support load", 22.5), ("Payment overdue", 20.0), ("Low seat utilisation", 15.0), ("12-month contract", 15.0), ("Low active-user rate", 10.0)]
    assert (got["nothing"]["score"], got["nothing"]["data_completeness"], got["nothing"]["days_since_qbr"]) == (100.0, 0.0, None)
    # (200 - 120) / (365 - 120) of 25 for the review; a new customer's two-year term costs nothing
    assert got["no review"]["score"] == round(100 - 25 * 80 / 245, 1) and got["no review"]["drivers"][0]["signal"] == "No QBR recorded"
    plain = {r["account_id"]: r for r in health.plain_pulse(df, F.lit(TODAY)).collect()}
    assert plain["worst"]["raw_deduction"] == 85.0 and plain["worst"]["score"] == 17.0 and plain["best"]["model_adjustment"] == 14.0
    assert health.signal_compass(df.where("false"), F.lit(TODAY)).count() == 0


def test_trajectory_takes_rows_before_nulls(spark):
    rows = [("a", month(k), 100_000.0 + 5_000 * k, None if k > 2 else 50.0, 40.0 + k, None) for k in range(16)] + [("b", month(0), 1.0, 1.0, 1.0, 1)]
    got = {r["account_id"]: r for r in health.trajectory(spark.createDataFrame(rows, TIMELINE)).collect()}
    a = got["a"]
    assert set(got) == {"a"} and (a["n"], a["span_months"], a["eligible"], a["utilisation_n"], a["tickets_n"]) == (13, 12, True, None, None)
    level = sorted(100_000 + 5_000 * k for k in range(3, 16))[6]
    assert a["arr_change"] == round(60_000 / level * 100, 2) and a["active_users_change"] == 12.0 and a["arr_r2"] == 1.0
    assert a["confidence"] == round(100 * (0.6 + 0.4 * 2 / 4), 1)
    assert health.linear_trend(spark.createDataFrame(rows, TIMELINE), "utilisation").count() == 0


def test_change_and_overrides(spark):
    t = spark.createDataFrame([("a", month(k), 100_000.0 + 5_000 * k, 50.0, None, None) for k in range(13)], TIMELINE)
    row = accounts.arr_change(t).first()
    assert (row["change"], row["change_pct"]) == (60_000.0, 60.0)
    df = spark.createDataFrame([account("a", current_arr=1.0), account("b", avg_monthly_revenue_6mo=10.0), account("c")], ACCOUNT).drop("arr_trend_pct")
    got = {r["account_id"]: r for r in health.timeline_overrides(df, t).collect()}
    assert (got["a"]["current_arr"], got["a"]["entry_arr"], got["a"]["arr_trend_pct"], got["a"]["arr_change_dollars"]) == (160_000.0, 100_000.0, 60.0, 60_000.0)
    assert got["a"]["total_revenue_36mo"] == round(sum(100_000 + 5_000 * k for k in range(13)) / 12, 2) and got["b"]["current_arr"] == 120.0 and got["c"]["current_arr"] == 0.0


def test_horizon_is_bounded(spark):
    t = spark.createDataFrame([("a", month(k), 1000.0 - 60 * k, 90.0 - 6 * k, 80.0 - 6 * k, k) for k in range(13)], TIMELINE)
    df = spark.createDataFrame([account("a", customer_since=back(5000), last_qbr_date=back(5)), account("b", last_qbr_date=back(5))], ACCOUNT)
    got = {r["account_id"]: r for r in health.retention_horizon(df, health.trajectory(t), F.lit(TODAY)).collect()}
    assert got["a"]["trajectory_adjustment"] == -17.0 and got["a"]["score"] == 83.0
    assert [d["signal"] for d in got["a"]["drivers"]] == ["Falling adoption trajectory", "Declining ARR trajectory", "Rising support pressure"]
    assert (got["b"]["trajectory_adjustment"], got["b"]["score"], got["b"]["trajectory_confidence"]) == (0.0, 100.0, 0.0)


def distance(a, b):
    return math.sqrt(sum((x - y) ** 2 for x, y in zip(a, b, strict=True)))


def test_archetypes_by_plain_python(spark):
    rnd = random.Random(3)
    corners = [(2, 2, 2, 2, 2), (-2, -2, -2, -2, -2), (2, -2, 0, 2, -2)]
    vectors = {i: tuple(round(c + rnd.uniform(-0.5, 0.5), 3) for c in corners[i % 3]) for i in range(24)}
    df = spark.createDataFrame([(i, *map(float, v)) for i, v in vectors.items()], "account_id int, " + ", ".join(f"{c} double" for c in archetypes.FEATURES))
    mean = [sum(v[k] for v in vectors.values()) / len(vectors) for k in range(5)]
    centres = [min(vectors, key=lambda i: (distance(vectors[i], mean), i))]
    while len(centres) < 3:
        centres.append(max(vectors, key=lambda i: (min(distance(vectors[i], vectors[c]) for c in centres), -i)))
    centres = [vectors[c] for c in centres]
    for _ in range(20):
        near = {i: min(range(3), key=lambda k: (distance(v, centres[k]), k)) for i, v in vectors.items()}
        centres = [[sum(vectors[i][d] for i in near if near[i] == k) / sum(x == k for x in near.values()) for d in range(5)] for k in range(3)]
    found, got = archetypes.cluster_accounts(df)
    assert {r["account_id"]: r["cluster"] for r in found.collect()} == near
    assert all(abs(a - b) < 1e-9 for x, y in zip(got, centres, strict=True) for a, b in zip(x, y, strict=True))
    names = archetypes.named(got)
    assert names.count(archetypes.STABLE) == 1 and len(set(names)) == 3
    book = spark.createDataFrame([(i, 10.0 * i, 50.0 + i, "Watch") for i in vectors], "account_id int, current_arr double, score double, band string")
    profiles = archetypes.archetype_profiles(found, got, book).collect()
    assert sum(r["accounts"] for r in profiles) == 24 and abs(sum(r["arr_share"] for r in profiles) - 100) < 0.3
    assert archetypes.cluster_accounts(df.where("account_id < 10"))[0].count() == 0


def test_robust_scale(spark):
    rows = [(1, 1.0, None), (2, 2.0, 5.0), (3, 3.0, 5.0), (4, 10.0, 5.0), (5, 100.0, 5.0)]
    got = {r["account_id"]: (r["x"], r["y"]) for r in archetypes.robust_scale(spark.createDataFrame(rows, "account_id int, x double, y double"), ("x", "y")).collect()}
    spread = 55.0 - 1.5  # medians of (10, 100) and of (1, 2)
    assert got[1] == ((1 - 3) / spread, 0.0) and abs(got[5][0] - 97 / spread) < 1e-12 and all(v[1] == 0.0 for v in got.values())


def test_attention_rules(spark):
    cases = list(itertools.product([-20.0, 0.0, 15.0, 30.0, None], [-20.0, -7.0, 0.0, 15.0], [True, False]))
    df = spark.createDataFrame([(str(k), 12, a, u, e) for k, (a, u, e) in enumerate(cases)], "account_id string, n int, arr_change_pct double, usage_change_pp double, eligible boolean")
    got = {r["account_id"]: r["attention_state"] for r in health.attention(df).collect()}
    for k, (a, u, e) in enumerate(cases):
        want = "standard"
        if a is not None and e and ((a >= -2 and u <= -10) or (a >= 20 and u <= 2) or (a <= -10 and u <= -5)):
            want = "attention"
        elif a is not None and a >= 10 and u >= 10:
            want = "acceleration"
        assert got[str(k)] == want


def test_fits_of_all_k_at_once_by_brute_force(spark):
    """A thousand accounts: the shared passes give each k what a fit of its own gives."""
    import numpy as np

    rnd = np.random.default_rng(5)
    points = np.round(rnd.normal(size=(1000, 5)) + rnd.integers(-2, 3, size=(1000, 1)), 3)
    df = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(points)], "account_id int, " + ", ".join(f"{c} double" for c in archetypes.FEATURES)).repartition(5)
    apart = lambda centres: np.sqrt(((points[:, None, :] - np.array(centres)[None]) ** 2).sum(axis=2))
    got = archetypes.seeded_kmeans(df, [3, 4, 5])
    scores = archetypes.silhouettes(df, got)
    for k in (3, 4, 5):
        centres = [points[apart([points.mean(axis=0)])[:, 0].argmin()]]
        while len(centres) < k:
            centres.append(points[apart(centres).min(axis=1).argmax()])
        before = None
        for _ in range(archetypes.ROUNDS):
            near = apart(centres).argmin(axis=1)
            if before is not None and (near == before).all():
                break
            before = near
            centres = [points[near == j].mean(axis=0) for j in range(k)]
        assert np.allclose(got[k], centres, atol=1e-9)
        near = apart(got[k]).argmin(axis=1)
        square = ((points[:, None, :] - points[None]) ** 2).sum(axis=2)
        means = np.array([[square[i, near == j].sum() / max(1, (near == j).sum() - (near[i] == j)) for j in range(k)] for i in range(1000)])
        own = means[np.arange(1000), near]
        means[np.arange(1000), near] = np.inf
        value = np.where(np.bincount(near, minlength=k)[near] > 1, (means.min(axis=1) - own) / np.maximum(means.min(axis=1), own), 0.0)
        assert abs(scores[k][0] - value.mean()) < 1e-9 and scores[k][1] == np.bincount(near).min()


def test_halves_that_doubles_miss_are_rounded_up(spark):
    values = [83.025, 81.85, 100 - 16.5 * 1.1, 16.449999999999996, -0.6499999999999999, 0.0, None]
    got = [r[0] for r in spark.createDataFrame([(v,) for v in values], "v double").coalesce(1).select(health.to_places(F.col("v"), 1)).collect()]
    assert got == [83.0, 81.9, 81.9, 16.5, -0.7, 0.0, None]
    # 100 - (25 + 15 + 15 * 13 / 16 * 1.12) + 10 is 56.35, and doubles hold less
    df = spark.createDataFrame([account("half", segment="Public", customer_since=back(3000), contract_start=back(1000), renewal_date=back(-615), tickets_12mo=15, pct_high_priority=24.0, active_user_pct=70.0, term_length_months=10)], ACCOUNT)
    assert health.signal_compass(df, F.lit(TODAY)).first()["score"] == 56.4


def test_robust_scale_reads_features_once(spark):
    seen = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def told(account_id):
        seen.add(1)
        return account_id

    rnd = random.Random(3)
    df = spark.createDataFrame([(f"a{i}", *(rnd.random() for _ in archetypes.FEATURES)) for i in range(50)], "account_id string, " + ", ".join(f"{c} double" for c in archetypes.FEATURES))
    df = df.select(told("account_id").alias("account_id"), *[F.when(told("account_id").isNotNull(), F.col(c)).alias(c) for c in archetypes.FEATURES])
    assert archetypes.robust_scale(df).count() == 50
    once, seen.value = seen.value, 0
    df.write.format("noop").mode("overwrite").save()
    assert once == seen.value
