"""Week-ahead forecasts over the driver's tables: a region is a line status, six intervals a day, one in each band."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.storage import written
from ..operators import forecast, price, reviews
from . import frames
from .queries import as_text, query, rounded

#: Minutes of the day at which the six intervals end; newest origins, a week apart.
SLOTS = (180, 450, 720, 960, 1170, 1350)
ORIGINS = ("2001-06-03", "2001-06-10", "2001-06-17", "2001-06-24")


def lines(spark, sf_dir):
    slot = F.get(F.array(*map(F.lit, SLOTS)), (F.col("l_partkey") % 6).cast("int"))
    line = frames.table(spark, sf_dir, "lineitem")
    return line.select(F.col("l_linestatus").alias("region"), (F.date_trunc("day", "l_shipdate").cast("timestamp_ntz") + F.make_dt_interval(mins=slot)).alias("ts"), "l_partkey", "l_quantity", F.round(F.col("l_extendedprice") * 100).cast("long").alias("cents"))


def prices(spark, sf_dir):
    return lines(spark, sf_dir).groupBy("region", "ts").agg((F.sum("cents").cast("double") / F.count("*") / 10000 - 300).alias("rrp"), F.sum("l_quantity").alias("demand"))


def weather(spark, sf_dir):
    s = lines(spark, sf_dir).groupBy("region", "ts").agg(F.sum("l_partkey").alias("k"))
    t = F.col("k") % 4000 / 100
    kinds = F.explode(F.array_compact(F.array(F.when(F.col("k") % 10 != 0, F.struct(F.lit("observed").alias("kind"), t.alias("temperature"))), F.when((F.col("k") % 3 == 0) & ~((F.col("region") == "O") & (F.col("ts") > F.lit("2001-06-24").cast("timestamp_ntz"))), F.struct(F.lit("forecast").alias("kind"), (t + 1.5).alias("temperature")))))).alias("_x")
    return s.select("region", "ts", kinds).select("region", "ts", "_x.*")


def grid(spark, sf_dir, p=None):
    """The intervals that have a price in the week after each origin."""
    p = p or prices(spark, sf_dir)
    origins = F.explode(F.array(*[F.lit(o).cast("timestamp_ntz") for o in ORIGINS])).alias("origin")
    return p.select("region", "ts", origins).where((F.col("ts") > F.col("origin")) & (F.col("ts") <= F.col("origin") + forecast.days(7))).select("region", "origin", "ts")


_SLOT = f"([{', '.join(map(str, SLOTS))}])[l_partkey % 6 + 1]"
LINES = f"SELECT l_linestatus AS region, date_trunc('day', l_shipdate)::TIMESTAMP + to_minutes({_SLOT}) AS ts, l_partkey, l_quantity, round(l_extendedprice * 100)::BIGINT AS cents FROM lineitem"
PRICES = f"SELECT region, ts, sum(cents)::DOUBLE / count(*) / 10000 - 300 AS rrp, sum(l_quantity) AS demand FROM ({LINES}) GROUP BY 1, 2"
_K = f"SELECT region, ts, sum(l_partkey)::BIGINT AS k FROM ({LINES}) GROUP BY 1, 2"
WEATHER = f"SELECT region, ts, 'observed' AS kind, (k % 4000)::DOUBLE / 100 AS temperature FROM ({_K}) WHERE k % 10 <> 0 UNION ALL SELECT region, ts, 'forecast', (k % 4000)::DOUBLE / 100 + 1.5 FROM ({_K}) WHERE k % 3 = 0 AND NOT (region = 'O' AND ts > TIMESTAMP '2001-06-24')"
RUNS = "SELECT unnest([" + ", ".join(f"TIMESTAMP '{o}'" for o in ORIGINS) + "]) AS origin"
GRID = f"SELECT region, origin, ts FROM ({PRICES}), ({RUNS}) WHERE ts > origin AND ts <= origin + INTERVAL 7 DAY"
REFERENCE = f"SELECT region, ts, coalesce(max(temperature) FILTER (kind = 'observed'), max(temperature) FILTER (kind = 'forecast')) AS temperature FROM ({WEATHER}) GROUP BY 1, 2"
TARGET = f"""SELECT region, origin, ts, temperature, CASE WHEN f THEN 'forecast' ELSE 'observed-fallback' END AS source FROM (SELECT *, bool_or(kind = 'forecast') OVER (PARTITION BY region, origin) AS f FROM ({WEATHER}) JOIN (SELECT DISTINCT region, origin FROM ({GRID})) USING (region)
    WHERE ts > origin AND ts <= origin + INTERVAL 7 DAY) WHERE kind = CASE WHEN f THEN 'forecast' ELSE 'observed' END"""
_COOL, _HEAT = (lambda x: f"(CASE WHEN {x} IS NOT NULL THEN greatest({x} - 18.0::DOUBLE, 0) END)"), (lambda x: f"(CASE WHEN {x} IS NOT NULL THEN greatest(18.0::DOUBLE - {x}, 0) END)")
_BAND = "CASE WHEN h >= 21 THEN 'late' WHEN h >= 17 THEN 'evening' WHEN h >= 15 THEN 'afternoon' WHEN h >= 9 THEN 'midday' WHEN h >= 6 THEN 'morning' ELSE 'overnight' END".replace("h >=", "hour(ts - INTERVAL 30 MINUTE) >=")
PAIRS = f"""WITH b AS (SELECT region, ts, rrp, temperature AS t FROM ({PRICES}) JOIN ({REFERENCE}) USING (region, ts)) SELECT n.region, n.ts, {_COOL("n.t")} - {_COOL("o.t")} AS d_cool, {_HEAT("n.t")} - {_HEAT("o.t")} AS d_heat, n.rrp - o.rrp AS d_price FROM b n JOIN b o ON n.region = o.region AND n.ts = o.ts + INTERVAL 7 DAY"""
BETAS = f"""SELECT region, origin, band, max(n) AS n_pairs, CASE WHEN max(n) < 40 THEN 0 WHEN sum(c * c) * sum(h * h) - sum(c * h) * sum(c * h) <> 0 THEN (sum(c * p) * sum(h * h) - sum(h * p) * sum(c * h)) / (sum(c * c) * sum(h * h) - sum(c * h) * sum(c * h)) WHEN sum(c * c) <> 0 THEN sum(c * p) / sum(c * c) ELSE 0 END AS beta_cool,
    CASE WHEN max(n) < 40 THEN 0 WHEN sum(c * c) * sum(h * h) - sum(c * h) * sum(c * h) <> 0 THEN (sum(h * p) * sum(c * c) - sum(c * p) * sum(c * h)) / (sum(c * c) * sum(h * h) - sum(c * h) * sum(c * h)) WHEN sum(c * c) = 0 AND sum(h * h) <> 0 THEN sum(h * p) / sum(h * h) ELSE 0 END AS beta_heat
    FROM (SELECT *, count(*) OVER w AS n, quantile_cont(p, 0.02) OVER w AS lo, quantile_cont(p, 0.98) OVER w AS hi FROM (SELECT region, origin, ts, {_BAND} AS band, d_cool AS c, d_heat AS h, d_price AS p FROM ({PAIRS}) JOIN (SELECT DISTINCT region, origin FROM ({GRID})) USING (region)
    WHERE ts <= origin AND ts - INTERVAL 7 DAY > origin - INTERVAL 364 DAY) WINDOW w AS (PARTITION BY region, origin, band)) WHERE p BETWEEN lo AND hi GROUP BY 1, 2, 3"""
ADJUSTED = f"""SELECT g.region, g.origin, g.ts, greatest(-1000.0, p.rrp + coalesce(b.beta_cool * ({_COOL("a.temperature")} - {_COOL("r.temperature")}) + b.beta_heat * ({_HEAT("a.temperature")} - {_HEAT("r.temperature")}), 0)) AS predicted FROM (SELECT *, {_BAND} AS band FROM ({GRID})) g JOIN ({PRICES}) p ON p.region = g.region AND p.ts = g.ts - INTERVAL 7 DAY
    LEFT JOIN ({REFERENCE}) r ON r.region = g.region AND r.ts = g.ts - INTERVAL 7 DAY LEFT JOIN ({TARGET}) a ON a.region = g.region AND a.origin = g.origin AND a.ts = g.ts LEFT JOIN ({BETAS}) b ON b.region = g.region AND b.origin = g.origin AND b.band = g.band"""


def origins(spark, sf_dir):
    return grid(spark, sf_dir).select("region", "origin").distinct()


@query(REFERENCE)
def p4_reference_temperature(spark, sf_dir):
    return forecast.reference_temperature(weather(spark, sf_dir))


@query(TARGET)
def p5_target_temperature(spark, sf_dir):
    return forecast.target_temperature(weather(spark, sf_dir), origins(spark, sf_dir))


@query(f"""SELECT 'ALL' AS region, ts, kind, round(sum(temperature * w) / sum(w), 6) AS temperature FROM (SELECT w.*, coalesce(p.demand, s.share) AS w FROM ({WEATHER}) w LEFT JOIN ({PRICES}) p USING (region, ts) LEFT JOIN (SELECT region, sum(demand) / (SELECT sum(demand) FROM ({PRICES})) AS share FROM ({PRICES}) GROUP BY 1) s USING (region)) GROUP BY 2, 3""")
def p8_market_temperature(spark, sf_dir):
    p = prices(spark, sf_dir)
    return rounded(forecast.market_temperature(weather(spark, sf_dir), p, price.demand_shares(p, "region", "demand")))


@query(f"SELECT region, ts, band, round(d_cool, 6) + 0.0 AS d_cool, round(d_heat, 6) + 0.0 AS d_heat, d_price FROM (SELECT *, {_BAND} AS band FROM ({PAIRS}))")
def p14_temperature_pairs(spark, sf_dir):
    df = forecast.interval_pairs(prices(spark, sf_dir), forecast.reference_temperature(weather(spark, sf_dir)))
    return df.select("region", "ts", "band", *[(F.round(c, 6) + F.lit(0.0)).alias(c) for c in ("d_cool", "d_heat")], "d_price")


@query(f"SELECT region, origin, ts, round(predicted, 5) AS predicted FROM ({ADJUSTED})")
def p16_temperature_adjusted(spark, sf_dir):
    p, w, g = prices(spark, sf_dir), weather(spark, sf_dir), grid(spark, sf_dir)
    reference = forecast.reference_temperature(w)
    betas = forecast.origin_betas(forecast.interval_pairs(p, reference), origins(spark, sf_dir))
    return rounded(forecast.temperature_adjusted(p, g, reference, forecast.target_temperature(w, origins(spark, sf_dir)), betas), 5)


@query(f"""SELECT g.region, g.origin, b.place, b.band, round(coalesce(t.beta_cool, 0), 4) + 0.0 AS beta_cool, round(coalesce(t.beta_heat, 0), 4) + 0.0 AS beta_heat, coalesce(t.n_pairs, 0) AS n_pairs, CASE WHEN t.n_pairs IS NULL THEN 'no pairs' WHEN t.n_pairs < 40 THEN 'too few pairs' END AS reason
FROM (SELECT DISTINCT region, origin FROM ({BETAS})) g, (VALUES {", ".join(f"({k}, '{b}')" for k, b in enumerate(forecast.BAND_NAMES))}) b(place, band) LEFT JOIN ({BETAS}) t ON t.region = g.region AND t.origin = g.origin AND t.band = b.band""")
def p29_beta_table(spark, sf_dir):
    reference = forecast.reference_temperature(weather(spark, sf_dir))
    return rounded(forecast.beta_table(forecast.origin_betas(forecast.interval_pairs(prices(spark, sf_dir), reference), origins(spark, sf_dir))), 4)


_LAGS = " ".join(f"JOIN ({PRICES}) l{w} ON l{w}.region = g.region AND l{w}.ts = g.ts - INTERVAL {7 * w} DAY" for w in forecast.LAG_WEEKS)
_DEG = {"temp_forecast": "a.temperature", "cooling_degrees": _COOL("a.temperature"), "heating_degrees": _HEAT("a.temperature"), "temp_lag_1w": "r.temperature", "temp_delta_1w": "a.temperature - r.temperature", "cooling_delta_1w": f"{_COOL('a.temperature')} - {_COOL('r.temperature')}", "heating_delta_1w": f"{_HEAT('a.temperature')} - {_HEAT('r.temperature')}"}
_ROUND = {"hour": ("hour(s) * 2 + minute(s) // 30", 48), "dow": ("isodow(s) - 1", 7), "month": ("month(s) - 1", 12)}
_MATRIX = {f"{n}_{f}": f"{f}(2 * pi() * (({v})::DOUBLE / {k}))" for n, (v, k) in _ROUND.items() for f in ("sin", "cos")} | {"is_weekend": "(isodow(s) >= 6)::INT::DOUBLE", "horizon_days": "epoch(g.ts - g.origin) / 86400"} | {f"band_{b}": f"(g.band = '{b}')::INT::DOUBLE" for b in forecast.BAND_NAMES} | {f"price_lag_{w}w": f"l{w}.rrp" for w in forecast.LAG_WEEKS} | {"price_lag_mean_4w": "(l1.rrp + l2.rrp + l3.rrp + l4.rrp) / 4", "price_lag_median_4w": "list_aggregate([l1.rrp, l2.rrp, l3.rrp, l4.rrp], 'median')", "price_lag_spread_4w": "greatest(l1.rrp, l2.rrp, l3.rrp, l4.rrp) - least(l1.rrp, l2.rrp, l3.rrp, l4.rrp)", "demand_lag_1w": "l1.demand"} | _DEG


@query(f"""SELECT g.region, g.origin, g.ts, {", ".join(f"{_MATRIX[c]} AS {c}" if "lag" in c else f"round({_MATRIX[c]}, 4) + 0.0 AS {c}" for c in forecast.FEATURES)} FROM (SELECT *, ts - INTERVAL 30 MINUTE AS s, {_BAND} AS band FROM ({GRID})) g {_LAGS}
JOIN ({REFERENCE}) r ON r.region = g.region AND r.ts = g.ts - INTERVAL 7 DAY JOIN ({TARGET}) a ON a.region = g.region AND a.origin = g.origin AND a.ts = g.ts""")
def p17_feature_matrix(spark, sf_dir):
    w = weather(spark, sf_dir)
    df = forecast.feature_matrix(grid(spark, sf_dir), prices(spark, sf_dir), forecast.reference_temperature(w), forecast.target_temperature(w, origins(spark, sf_dir)))
    return df.select("region", "origin", "ts", *[c if "lag" in c else (F.round(c, 4) + F.lit(0.0)).alias(c) for c in forecast.FEATURES])


def series(spark, sf_dir):
    """Prices, weather and grid. The first two are written, as a ladder reads them dozens of times: they have a row per
    region and interval, however many lines there are."""
    p, w = written(prices(spark, sf_dir)), written(weather(spark, sf_dir))
    return p, w, grid(spark, sf_dir, p)


def matrices(p, w, g):
    """Training and prediction rows of all origins."""
    runs, reference = g.select("region", "origin").distinct(), forecast.reference_temperature(w)
    return forecast.training_matrix(p, reference, runs), forecast.feature_matrix(g, p, reference, forecast.target_temperature(w, runs))


@query(None)
def p18_fit_predict_forest(spark, sf_dir):
    """Trained: no SQL. The tests hold it against the leakage guard and a plain mean."""
    return forecast.fit_predict_forest(*matrices(*series(spark, sf_dir)))[0]


@query(None)
def p18_fit_predict_boosting(spark, sf_dir):
    return forecast.fit_predict_boosting(*matrices(*series(spark, sf_dir)))[0]


@query(None)
def p19_fit_predict_network(spark, sf_dir):
    return forecast.fit_predict_network(*matrices(*series(spark, sf_dir)))


_SOURCE = f"SELECT region, origin, max(source) AS source FROM ({TARGET}) GROUP BY 1, 2"


@query(f"""SELECT region, model, origin, ts, CASE WHEN model = 'temperature_adjusted' THEN round(predicted, 4) ELSE predicted END AS predicted, source AS temperature_source, source <> 'observed-fallback' AS leakage_safe FROM (SELECT g.region, 'seasonal_naive' AS model, g.origin, g.ts, greatest(-1000.0, p.rrp) AS predicted, 'none' AS source FROM ({GRID}) g JOIN ({PRICES}) p ON p.region = g.region AND p.ts = g.ts - INTERVAL 7 DAY
UNION ALL SELECT g.region, 'rolling_median', g.origin, g.ts, greatest(-1000.0, median(p.rrp)), 'none' FROM ({GRID}) g JOIN ({PRICES}) p ON p.region = g.region AND p.ts IN (g.ts - INTERVAL 7 DAY, g.ts - INTERVAL 14 DAY, g.ts - INTERVAL 21 DAY, g.ts - INTERVAL 28 DAY) GROUP BY 1, 3, 4
UNION ALL SELECT region, 'temperature_adjusted', origin, ts, predicted, coalesce(source, 'none') FROM ({ADJUSTED}) LEFT JOIN ({_SOURCE}) USING (region, origin))""")
def p20_forecast_ladder(spark, sf_dir):
    df = forecast.forecast_ladder(*series(spark, sf_dir))
    return df.withColumn("predicted", F.when(F.col("model") == "temperature_adjusted", F.round("predicted", 4)).otherwise(F.col("predicted")))


@query(None)
def p20_learned_ladder(spark, sf_dir):
    """All six models. Trained ones have no SQL; the tests hold the other three against p20_forecast_ladder."""
    held = series(spark, sf_dir)
    return forecast.forecast_ladder(*held, forecast.learned_models(*matrices(*held)))


@query(f"SELECT region, ts, observed, forecast, round(forecast - observed, 6) AS error FROM (SELECT region, ts, max(temperature) FILTER (kind = 'observed') AS observed, max(temperature) FILTER (kind = 'forecast') AS forecast FROM ({WEATHER}) GROUP BY 1, 2)")
def p30_weather_error(spark, sf_dir):
    return reviews.weather_error(weather(spark, sf_dir), ["region", "ts"], "kind", "temperature").withColumn("error", F.round("error", 6))


@query(f"SELECT region, CAST(ts AS DATE) AS day, round(avg(rrp), 8) AS avg_price, min(rrp) AS min_price, max(rrp) AS max_price FROM ({PRICES}) WHERE CAST(ts AS DATE) > (SELECT max(CAST(ts AS DATE)) FROM ({PRICES})) - 90 GROUP BY 1, 2")
def p27_daily_price_history(spark, sf_dir):
    return price.daily_history(prices(spark, sf_dir), ["region"], "ts", "rrp", days=90).withColumn("avg_price", F.round("avg_price", 8))


@query(f"""WITH t AS (SELECT region, ts, temperature, lead(ts) OVER w AS later, lead(temperature) OVER w AS after FROM (SELECT DISTINCT event_type AS region, date_trunc('hour', ts) AS ts, max(value) AS temperature FROM events GROUP BY 1, 2) WINDOW w AS (PARTITION BY region ORDER BY ts))
SELECT region, ts, temperature FROM t UNION ALL SELECT region, ts + INTERVAL 30 MINUTE, (temperature + after) / 2 FROM t WHERE later = ts + INTERVAL 1 HOUR""")
def p2_interpolate_half_hours(spark, sf_dir):
    hourly = frames.table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("region"), F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("ts")).agg(F.max("value").alias("temperature"))
    return price.interpolate_half_hours(hourly, ["region"], "ts", "temperature")


for _name, _columns in {"p4_reference_temperature": ("ts",), "p5_target_temperature": ("origin", "ts"), "p8_market_temperature": ("ts",), "p14_temperature_pairs": ("ts",), "p16_temperature_adjusted": ("origin", "ts"), "p29_beta_table": ("origin",), "p17_feature_matrix": ("origin", "ts"), "p18_fit_predict_forest": ("origin", "ts"), "p18_fit_predict_boosting": ("origin", "ts"), "p19_fit_predict_network": ("origin", "ts"), "p20_forecast_ladder": ("origin", "ts"), "p30_weather_error": ("ts",), "p27_daily_price_history": ("day",), "p2_interpolate_half_hours": ("ts",)}.items():
    as_text(_name, _columns)
