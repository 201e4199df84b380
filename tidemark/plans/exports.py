"""The audit exports over the driver's tables, written as CSV by region and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.storage import new_path
from ..operators import forecast
from ..sources import audit, ingest
from . import ladder
from .queries import query


def exported(spark, name, df):
    path = new_path(spark, "exports")
    ingest.write_csv_exports({name: df}, path)
    text = ", ".join(f"{c} string" for c in df.columns if c != "region")
    return spark.read.schema(f"{text}, region string").option("header", True).csv(f"{path}/{name}").select(*df.columns)


def stamped(c):
    return f"strftime({c}, '%Y-%m-%dT%H:%M:%S+10:00')"


def fixed(x, places=2):
    return f"CAST(CAST(round(CAST({x} AS DECIMAL(24,10)), {places}) AS DECIMAL(24,{places})) AS VARCHAR)"


def labelled(c):
    return f"CASE {c} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in audit.LABELS.items()) + " END"


@query(f"SELECT {stamped('ts')} AS interval_end_nem, region, {fixed('rrp')} AS rrp_aud_per_mwh, {fixed('demand')} AS total_demand_mw FROM ({ladder.PRICES})")
def i13_export_prices(spark, sf_dir):
    return exported(spark, "prices", audit.price_export(ladder.prices(spark, sf_dir)))


@query(f"""SELECT {stamped('ts')} AS interval_end_nem, region, {fixed('o')} AS observed_c, {fixed('f')} AS forecast_c, {fixed('f - o')} AS forecast_minus_observed_c FROM (SELECT region, ts, max(temperature) FILTER (kind = 'observed') AS o, max(temperature) FILTER (kind = 'forecast') AS f FROM ({ladder.WEATHER}) GROUP BY 1, 2)""")
def i13_export_weather(spark, sf_dir):
    return exported(spark, "weather", audit.weather_export(ladder.weather(spark, sf_dir)))


@query(None)
def i13_export_features(spark, sf_dir):
    """The newest origin's training matrix, which p17 has as numbers; held against them in the tests."""
    train, _ = ladder.matrices(*ladder.series(spark, sf_dir))
    return exported(spark, "features", audit.feature_export(train.where(F.col("run") == F.lit(ladder.ORIGINS[-1]).cast("timestamp_ntz"))))


RUNS = f"""SELECT g.region, 'seasonal_naive' AS model, g.origin, g.ts, greatest(-1000.0, p.rrp) AS predicted, 'none' AS temperature_source FROM ({ladder.GRID}) g JOIN ({ladder.PRICES}) p ON p.region = g.region AND p.ts = g.ts - INTERVAL 7 DAY
UNION ALL SELECT g.region, 'rolling_median', g.origin, g.ts, greatest(-1000.0, median(p.rrp)), 'none' FROM ({ladder.GRID}) g JOIN ({ladder.PRICES}) p ON p.region = g.region AND p.ts IN (g.ts - INTERVAL 7 DAY, g.ts - INTERVAL 14 DAY, g.ts - INTERVAL 21 DAY, g.ts - INTERVAL 28 DAY) GROUP BY 1, 2, 3, 4
UNION ALL SELECT region, 'temperature_adjusted', origin, ts, predicted, coalesce(source, 'none') FROM ({ladder.ADJUSTED}) LEFT JOIN (SELECT region, origin, max(source) AS source FROM ({ladder.TARGET}) GROUP BY 1, 2) USING (region, origin)"""


def runs(spark, sf_dir):
    # to the sixth decimal, so that a half of a cent is one on both sides
    df = forecast.forecast_ladder(ladder.prices(spark, sf_dir), ladder.weather(spark, sf_dir), ladder.grid(spark, sf_dir))
    return df.withColumn("predicted", F.round("predicted", 6))


_ROUNDED = f"SELECT * REPLACE (round(predicted, 6) AS predicted) FROM ({RUNS})"


@query(f"""SELECT {stamped('origin')} AS issued_at_nem, r.region, model AS model_key, {labelled('model')} AS model_label, {stamped('r.ts')} AS target_interval_end_nem, {fixed('epoch(r.ts - origin) / 86400', 4)} AS horizon_days,
    {fixed('predicted')} AS predicted_rrp, {fixed('rrp')} AS actual_rrp, {fixed('predicted - rrp')} AS predicted_minus_actual, temperature_source FROM ({_ROUNDED}) r LEFT JOIN ({ladder.PRICES}) p ON p.region = r.region AND p.ts = r.ts""")
def i13_export_forecasts(spark, sf_dir):
    return exported(spark, "forecasts", audit.forecast_export(runs(spark, sf_dir), ladder.prices(spark, sf_dir)))


@query(f"""WITH s AS (SELECT r.region, model, origin, count(*) AS n, avg(abs(predicted - rrp)) AS mae, median(abs(predicted - rrp)) AS medae, max(abs(predicted - rrp)) AS worst, bool_and(temperature_source <> 'observed-fallback') AS safe FROM ({_ROUNDED}) r JOIN ({ladder.PRICES}) p ON p.region = r.region AND p.ts = r.ts
    WHERE (r.region, CAST(origin AS DATE)) IN (SELECT x.region, CAST(x.origin AS DATE) FROM ({_ROUNDED}) x JOIN (SELECT region, max(ts) AS z FROM ({ladder.PRICES}) GROUP BY 1) l ON l.region = x.region WHERE CAST(x.origin AS DATE) + 7 <= z) GROUP BY 1, 2, 3)
SELECT {stamped('origin')} AS issued_at_nem, region, model AS model_key, {labelled('model')} AS model_label, n::VARCHAR AS intervals_scored, {fixed('mae')} AS mae, {fixed('medae')} AS median_ae, {fixed('worst')} AS worst_interval,
    {fixed('100 * (1 - mae / nullif(b, 0))')} AS skill_pct_vs_baseline, CASE WHEN safe THEN 'yes' ELSE 'no' END AS leakage_safe FROM (SELECT *, max(mae) FILTER (model = 'seasonal_naive') OVER (PARTITION BY region, origin) AS b FROM s)""")
def i13_export_scores(spark, sf_dir):
    return exported(spark, "scores", audit.score_export(runs(spark, sf_dir), ladder.prices(spark, sf_dir)))
