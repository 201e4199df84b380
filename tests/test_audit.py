"""The five audit exports: columns, texts and files."""

import datetime
import glob
import os

import pytest
from pyspark.sql import functions as F

from tidemark.operators import forecast
from tidemark.plans import exports, ladder
from tidemark.sources import audit, ingest

T0 = datetime.datetime(2026, 6, 7)
HALF = datetime.timedelta(minutes=30)


def test_numbers_as_text(spark):
    df = spark.createDataFrame([(0.125,), (-0.125,), (-0.001,), (1234567.0,), (0.000123456789,), (0.0,), (None,)], "v double")
    assert [r[0] for r in df.select(audit.fixed(F.col("v"))).collect()] == ["0.13", "-0.13", "0.00", "1234567.00", "0.00", "0.00", None]
    got = [r[0] for r in df.select(audit.significant(F.col("v"))).collect()]
    assert got == ["0.125", "-0.125", "-0.001", "1234570", "0.000123457", "0", None]


def test_exports_are_written_by_region_in_order(spark, tmp_path):
    prices = spark.createDataFrame([(g, T0 + k * HALF, 10.0 * k, 100.0) for g in ("a", "b") for k in range(-336 * 2, 337)], "region string, ts timestamp_ntz, rrp double, demand double")
    weather = spark.createDataFrame([("a", T0, "observed", 20.0), ("a", T0, "forecast", 21.5), ("b", T0, "forecast", 3.0)], "region string, ts timestamp_ntz, kind string, temperature double")
    runs = spark.createDataFrame([(g, m, T0, T0 + k * HALF, p, "none", True) for g in ("a", "b") for m, p in (("seasonal_naive", 0.0), ("own", 5.0)) for k in (1, 2)], "region string, model string, origin timestamp_ntz, ts timestamp_ntz, predicted double, temperature_source string, leakage_safe boolean")
    train = spark.createDataFrame([("a", T0, *[float(i) for i in range(len(forecast.FEATURES))], 7.005)], "region string, ts timestamp_ntz, " + ", ".join(f"{c} double" for c in forecast.FEATURES) + ", rrp double")
    made = audit.audit_exports(prices, weather, train, runs)
    assert list(made) == ["prices", "weather", "features", "forecasts", "scores"]
    ingest.write_csv_exports(made, f"file://{tmp_path}")
    heads = {name: open(sorted(glob.glob(f"{tmp_path}/{name}/region=a/*.csv"))[0], encoding="utf-8").read().splitlines() for name in made}
    assert heads["prices"][0] == "interval_end_nem,rrp_aud_per_mwh,total_demand_mw" and heads["prices"][1] == "2026-05-24T00:00:00+10:00,-6720.00,100.00"
    assert heads["prices"][1:] == sorted(heads["prices"][1:])
    assert heads["weather"][1:] == ["2026-06-07T00:00:00+10:00,20.00,21.50,1.50"]
    assert heads["features"][0].split(",")[1:-1] == list(forecast.FEATURES) and heads["features"][1].endswith(",7.01")
    assert heads["forecasts"][1] == "2026-06-07T00:00:00+10:00,own,own,2026-06-07T00:30:00+10:00,0.0208,5.00,10.00,-5.00,none"
    assert heads["scores"][1:] == ["2026-06-07T00:00:00+10:00,own,own,2,10.00,10.00,15.00,33.33,yes", "2026-06-07T00:00:00+10:00,seasonal_naive,Same as last week,2,15.00,15.00,20.00,0.00,yes"]


@pytest.mark.parametrize("name", ["prices", "weather", "features", "forecasts", "scores"])
def test_empty_tables(spark, name):
    none = lambda schema: spark.createDataFrame([], schema)
    made = audit.audit_exports(
        none("region string, ts timestamp_ntz, rrp double, demand double"), none("region string, ts timestamp_ntz, kind string, temperature double"), none("region string, ts timestamp_ntz, " + ", ".join(f"{c} double" for c in forecast.FEATURES) + ", rrp double"),
        none("region string, model string, origin timestamp_ntz, ts timestamp_ntz, predicted double, temperature_source string, leakage_safe boolean"),
    )
    assert made[name].count() == 0


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="the driver's tables are not here")
def test_features_of_the_driver_tables(spark):
    """The newest origin's training rows, a line each: the features and price that the matrix has."""
    at = "/root/testdata/sf0.01"
    train = ladder.matrices(*ladder.series(spark, at))[0].where(F.col("run") == F.lit(ladder.ORIGINS[-1]).cast("timestamp_ntz"))
    want = {(r["region"], f"{r['ts'].isoformat()}+10:00"): (r["price_lag_1w"], r["rrp"]) for r in train.collect()}
    got = {(r["region"], r["interval_end_nem"]): (float(r["price_lag_1w"]), float(r["target_rrp"])) for r in exports.i13_export_features(spark, at).collect()}
    assert got.keys() == want.keys() and got
    assert all(abs(x - y) <= 0.006 for k in got for x, y in zip(got[k], want[k], strict=True))
