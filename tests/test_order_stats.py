"""Order statistics by refined histograms against Spark's exact percentiles."""

import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import network, order_stats, price

POINTS = (0.0, 0.02, 0.25, 0.5, 0.9, 0.98, 1.0)


@pytest.fixture(scope="module")
def rows(spark):
    rnd = random.Random(8)
    made = [("ties", float(rnd.choice([1, 1, 1, 2, 7]))) for _ in range(900)] + [("spread", rnd.lognormvariate(0, 4)) for _ in range(800)] + [("near", 1e9 + k * 1e-6) for k in range(300)]
    made += [("huge", rnd.choice([-1e308, 1e308, 0.0, 5.0])) for _ in range(30)] + [("one", 3.5), ("none", None), (None, -1.0), (None, 2.0), ("nan", float("nan")), ("nan", 4.0), ("two", 1.0), ("two", 2.0)]
    rnd.shuffle(made)
    return spark.createDataFrame(made, "g string, v double").repartition(6)


@pytest.mark.parametrize("bins", [2, 16, 1024])
def test_quantiles_of_groups(rows, bins):
    got = order_stats.order_statistics(rows, ["g"], "v", {f"q{i}": order_stats.quantile(p) for i, p in enumerate(POINTS)}, bins)
    want = rows.where("v IS NOT NULL AND NOT isnan(v)").groupBy("g").agg(F.count("*").alias("n"), F.percentile("v", list(POINTS)).alias("q"))
    mine = {r["g"]: (r["n"], [r[f"q{i}"] for i in range(len(POINTS))]) for r in got.collect()}
    assert mine == {r["g"]: (r["n"], list(r["q"])) for r in want.collect()}


def test_without_groups_and_without_values(rows):
    got = order_stats.order_statistics(rows.where("g = 'spread'"), [], "v", {"m": order_stats.quantile(0.5), "low": lambda n: n * 0 - 5})
    want = rows.where("g = 'spread'").agg(F.count("*"), F.median("v"), F.min("v")).first()
    assert tuple(got.first()) == tuple(want)
    assert order_stats.order_statistics(rows.where("g = 'none'"), [], "v", {"m": order_stats.quantile(0.5)}).count() == 0


def test_switches_give_the_same(spark, rows):
    plain = rows.where("g IN ('ties', 'spread', 'two')")
    assert sorted(map(tuple, network.legend_examples(plain, ["g"], "v", large=True).collect())) == sorted(map(tuple, network.legend_examples(plain, ["g"], "v").collect()))
    pairs = plain.select("g", (F.col("v") % 5).alias("d_cool"), (F.col("v") % 3).alias("d_heat"), F.col("v").alias("d_price"))
    assert sorted(map(tuple, price.fit_betas(pairs, ["g"], large=True).collect())) == sorted(map(tuple, price.fit_betas(pairs, ["g"]).collect()))
    points = plain.select("g", F.monotonically_increasing_id().alias("k"), F.col("v").alias("predicted")).persist()
    actual = points.select("k", (F.col("k") % 7).cast("double").alias("actual"))
    score = lambda large: sorted(map(tuple, price.score_runs(points, actual, ["g"], ["k"], "actual", large).collect()))
    assert score(True) == score(False)
