"""More queries with their SQL: periods, forecast reviews, networks, cohorts, books of accounts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import battery, cohorts, network, periods, price, reviews, standing, world
from . import frames
from .queries import EDGES, IN_FORCE, INDICATORS, MEDIAN, NAIVE, as_text, edges, in_force, query, rounded, valued

# Periods of batteries

SUMS = ["charge_mwh", "discharge_mwh", "energy_value"]
DAILY = f"""SELECT asset, day, count(*) AS n, sum(charge_mwh) AS charge_mwh, sum(discharge_mwh) AS discharge_mwh, sum(energy_value) AS energy_value, CASE WHEN count(*) = 16 THEN 'complete' ELSE 'partial' END AS status,
    CASE WHEN count(*) > 1 THEN sum(discharge_value) END AS benchmark FROM ({frames.VALUED}) GROUP BY 1, 2"""


def daily(spark, sf_dir):
    s = battery.daily_summary(valued(spark, sf_dir), "asset", "day", "mw", expected=16)
    return s.select("asset", "day", *SUMS, "status", F.when(F.col("n") > 1, F.col("discharge_value")).alias("benchmark"))


@query(f"SELECT asset, ts, round(sum(storage), 6) AS storage_mwh, round(sum(mw), 6) AS mw, round(max(rrp), 6) AS rrp, round(sum(energy_value), 6) + 0.0 AS energy_value FROM ({frames.VALUED}) GROUP BY 1, 2")
def b8_asset_interval_series(spark, sf_dir):
    return rounded(periods.asset_interval_series(valued(spark, sf_dir), "asset", "ts", "mw", "storage", "rrp"))


@query(f"""WITH p AS (SELECT *, row_number() OVER (PARTITION BY asset, day ORDER BY rrp, ts, event_id) - 1 AS k, count(*) OVER (PARTITION BY asset, day) AS n FROM ({frames.VALUED}) WHERE rrp IS NOT NULL),
e AS (SELECT *, max(CASE WHEN k = round_even((n - 1) * 0.15::DOUBLE, 0)::INT THEN rrp END) OVER (PARTITION BY asset, day) AS lo, max(CASE WHEN k = round_even((n - 1) * 0.85::DOUBLE, 0)::INT THEN rrp END) OVER (PARTITION BY asset, day) AS hi FROM p)
SELECT event_id, round(lo, 6) AS low_price, round(hi, 6) AS high_price, CASE WHEN rrp <= lo THEN 'charge' WHEN rrp >= hi THEN 'discharge' ELSE 'hold' END AS action FROM e""")
def b10_price_windows(spark, sf_dir):
    return rounded(periods.price_windows(valued(spark, sf_dir), ["asset", "day"], "rrp", ["ts", "event_id"]).select("event_id", "low_price", "high_price", "action"))


WEEKS = f"SELECT asset, day AS anchor FROM (SELECT *, max(day) OVER (PARTITION BY asset) AS last FROM ({DAILY})) WHERE isodow(day) = 6 OR day = last"
MONTHS = f"SELECT asset, max(day) AS anchor FROM ({DAILY}) GROUP BY asset, date_trunc('month', day)"


@query(f"SELECT 'week' AS grain, * FROM ({WEEKS}) UNION ALL SELECT 'month' AS grain, * FROM ({MONTHS})")
def b11_period_options(spark, sf_dir):
    s = daily(spark, sf_dir)
    week, month = (periods.period_options(s, "asset", "day", g).select(F.lit(g).alias("grain"), "asset", "anchor") for g in ("week", "month"))
    return week.unionByName(month)


@query(f"""SELECT a.asset, anchor, count(*) AS days, count_if(status = 'complete')::BIGINT AS complete_days, count(benchmark) AS benchmark_days, round(sum(charge_mwh), 4) AS charge_mwh, round(sum(discharge_mwh), 4) AS discharge_mwh, round(sum(energy_value), 4) + 0.0 AS energy_value,
    round(sum(benchmark), 4) AS benchmark_value, first(day ORDER BY energy_value DESC, day) AS best_day, round(100.0 * count(*) / 91, 4) AS coverage_pct,
    round(CASE WHEN sum(benchmark) > 0 THEN 100 * sum(CASE WHEN benchmark IS NOT NULL THEN energy_value END) / sum(benchmark) END, 2) + 0.0 AS capture_pct
FROM ({MONTHS}) a JOIN ({DAILY}) s ON a.asset = s.asset AND s.day BETWEEN a.anchor - 90 AND a.anchor GROUP BY 1, 2""")
def b12_period_summary(spark, sf_dir):
    s = daily(spark, sf_dir)
    found = periods.period_summary(s, periods.period_options(s, "asset", "day", "month"), "asset", "day", SUMS, "energy_value", "energy_value", "benchmark", periods.QUARTER)
    return rounded(found.withColumn("capture_pct", F.round("capture_pct", 2)), 4)


@query(f"""SELECT asset, week_end, round(sum(charge_mwh), 4) AS charge_mwh, round(sum(discharge_mwh), 4) AS discharge_mwh, round(sum(energy_value), 4) + 0.0 AS energy_value, round(sum(benchmark), 4) AS benchmark_value,
    CASE WHEN bool_or(status = 'partial') THEN 'partial' ELSE 'complete' END AS status, round(CASE WHEN sum(benchmark) > 0 THEN 100 * sum(CASE WHEN benchmark IS NOT NULL THEN energy_value END) / sum(benchmark) END, 2) + 0.0 AS capture_pct
FROM (SELECT *, least(CAST(day + ((13 - isodow(day)) % 7)::INT AS DATE), max(day) OVER (PARTITION BY asset)) AS week_end FROM ({DAILY})) GROUP BY 1, 2""")
def b13_weekly_rollup(spark, sf_dir):
    return rounded(periods.weekly_rollup(daily(spark, sf_dir), "asset", "day", SUMS, "energy_value", "benchmark").withColumn("capture_pct", F.round("capture_pct", 2)), 4)


@query(f"""SELECT asset, round(v, 4) + 0.0 AS value, round(m, 4) AS discharge_mwh, round(v / nullif(m, 0), 4) + 0.0 AS value_per_mwh, row_number() OVER (ORDER BY v DESC, asset)::INT AS rank FROM (SELECT asset, round(sum(energy_value), 6) AS v, round(sum(discharge_mwh), 6) AS m FROM ({DAILY}) GROUP BY 1)""")
def b14_asset_leaderboard(spark, sf_dir):
    return rounded(periods.asset_leaderboard(daily(spark, sf_dir), "asset", "day", "energy_value", "discharge_mwh", "1900-01-01", "2200-01-01"), 4)


# Forecast reviews

POINTS = f"""SELECT *, CAST(day - 1 - (isodow(day - 1) % 7)::INT AS DATE) AS origin FROM (SELECT 'naive' AS model, region, day, predicted FROM ({NAIVE}) UNION ALL SELECT 'median' AS model, region, day, predicted FROM ({MEDIAN}))"""
RUNS = f"""SELECT model, region, origin, avg(abs(predicted - rrp)) AS mae, median(abs(predicted - rrp)) AS median_ae, max(abs(predicted - rrp)) AS max_ae FROM ({POINTS}) JOIN ({frames.PRICES}) USING (region, day) GROUP BY 1, 2, 3"""
PERFORMANCE = f"""SELECT *, 1 - avg_mae / nullif(max(CASE WHEN model = 'naive' THEN avg_mae END) OVER (PARTITION BY region), 0) AS avg_skill FROM (SELECT model, region, count(DISTINCT origin) AS weeks, avg(mae) AS avg_mae, avg(median_ae) AS avg_median_ae, max(max_ae) AS worst_error,
    max(newest) AS last_origin, max(CASE WHEN origin = newest THEN mae END) AS last_mae FROM (SELECT *, max(origin) OVER (PARTITION BY region) AS newest FROM ({RUNS})) GROUP BY 1, 2)"""
SHOWN = "model, region, weeks, round(avg_mae, 4) AS avg_mae, round(avg_median_ae, 4) AS avg_median_ae, round(worst_error, 4) AS worst_error, last_origin, round(last_mae, 4) AS last_mae, round(avg_skill, 4) + 0.0 AS avg_skill"


def points(spark, sf_dir):
    p = frames.prices(spark, sf_dir)
    grid, before = p.select("region", "day"), F.date_sub("day", 1)
    both = price.seasonal_naive(p, grid, ["region"], "day", "rrp").withColumn("model", F.lit("naive")).unionByName(price.rolling_median(p, grid, ["region"], "day", "rrp").withColumn("model", F.lit("median")))
    return p, both.withColumn("origin", F.date_sub(before, F.pmod(F.weekday(before) + 1, F.lit(7))))


def performance(spark, sf_dir):
    p, both = points(spark, sf_dir)
    return reviews.performance_summary(price.score_runs(both, p, ["model", "region", "origin"], ["region", "day"], "rrp"), "region", "model", "origin", "naive")


@query(f"SELECT region, CAST(last - (isodow(last) % 7)::INT - (7 * k)::INT AS DATE) AS origin FROM (SELECT region, max(day) AS last FROM ({frames.PRICES}) GROUP BY 1), range(0, 5) t(k)")
def p3_backtest_origins(spark, sf_dir):
    return reviews.backtest_origins(frames.prices(spark, sf_dir).groupBy("region").agg(F.max("day").alias("day")), "day", 4)


@query(f"SELECT region, origin, origin::TIMESTAMP + to_minutes(30 * k) AS interval_end FROM (SELECT DISTINCT region, origin FROM ({POINTS})), range(1, 337) t(k)")
def p11_target_grid(spark, sf_dir):
    return reviews.target_grid(points(spark, sf_dir)[1].select("region", "origin").distinct(), "origin")


@query(f"""SELECT region, origin, row_number() OVER (PARTITION BY region ORDER BY origin DESC)::INT AS place FROM (SELECT DISTINCT region, origin FROM ({POINTS})) JOIN (SELECT region, max(day) AS last FROM ({frames.PRICES}) GROUP BY 1) USING (region) WHERE origin + 7 <= last""")
def p23_completed_origins(spark, sf_dir):
    p, both = points(spark, sf_dir)
    return reviews.completed_origins(both, p, "region", "origin", "day")


@query(f"SELECT {SHOWN} FROM ({PERFORMANCE})")
def p24_performance_summary(spark, sf_dir):
    return rounded(performance(spark, sf_dir), 4)


@query(f"SELECT {SHOWN} FROM (SELECT *, row_number() OVER (PARTITION BY region ORDER BY avg_skill DESC NULLS LAST, model) AS k FROM ({PERFORMANCE}) WHERE model <> 'naive') WHERE k = 1")
def p25_model_ranking(spark, sf_dir):
    return rounded(reviews.model_ranking(performance(spark, sf_dir), "region", "model", "naive"), 4)


@query(f"""WITH w AS (SELECT region, day, max(CASE WHEN model = 'naive' THEN predicted END) AS naive, max(CASE WHEN model = 'median' THEN predicted END) AS median FROM ({POINTS}) GROUP BY 1, 2)
SELECT region, day, naive, median, rrp AS actual FROM w FULL JOIN ({frames.PRICES}) USING (region, day)""")
def p28_forecast_vs_actual(spark, sf_dir):
    p, both = points(spark, sf_dir)
    return reviews.forecast_vs_actual(both, p, ["region", "day"], "model", ["naive", "median"], "rrp")


@query(f"SELECT model, region, origin, day, predicted, rrp AS actual, (day - origin)::INT AS horizon_days, predicted - rrp AS error FROM ({POINTS}) LEFT JOIN (SELECT region, day, rrp FROM ({frames.PRICES})) USING (region, day)")
def p31_forecast_errors(spark, sf_dir):
    p, both = points(spark, sf_dir)
    errors = reviews.forecast_errors(both, p, ["region", "day"], "origin", "day", "rrp")
    return errors  # the same doubles in either engine


# Networks


@query(f"SELECT i.facility, i.gas_date, i.effective_date, round(r.capacity, 6) AS leg_capacity FROM ({IN_FORCE}) i JOIN ({frames.RATINGS}) r ON i.facility = r.facility AND i.effective_date = r.effective_date")
def g7_legs_in_force(spark, sf_dir):
    held = in_force(spark, sf_dir, frames.flows(spark, sf_dir))
    return rounded(network.legs_in_force(frames.ratings(spark, sf_dir), held, "facility", "gas_date", "effective_date", "capacity"))


NODES = f"""SELECT gas_date, place, sum(s) AS supply, sum(d) AS demand FROM (SELECT gas_date, place, CASE WHEN kind IN ('PROD', 'STOR') THEN supply ELSE 0 END AS s, CASE WHEN kind IN ('DISTR', 'POWER', 'INDUS', 'LNG') THEN demand ELSE 0 END AS d FROM ({frames.FLOWS}) WHERE kind <> 'PIPE'
    UNION ALL SELECT gas_date, src, 0, 0 FROM ({EDGES}) UNION ALL SELECT gas_date, dst, 0, 0 FROM ({EDGES})) GROUP BY 1, 2"""


@query(f"SELECT gas_date, place, round(supply, 6) AS supply, round(demand, 6) AS demand, round(supply - demand, 6) AS net, CASE WHEN supply > demand THEN 'supply' WHEN supply < demand THEN 'demand' ELSE 'transit' END AS role FROM ({NODES})")
def g15_network_nodes(spark, sf_dir):
    return rounded(network.network_nodes(frames.flows(spark, sf_dir), edges(spark, sf_dir), "gas_date", "place", "kind"))


@query(f"""WITH e AS ({EDGES}), x AS (SELECT DISTINCT gas_date, place FROM ({frames.FLOWS}) WHERE kind = 'LNG'), m AS (SELECT e.*, EXISTS (FROM x WHERE x.gas_date = e.gas_date AND x.place IN (e.src, e.dst)) AS export FROM e)
SELECT gas_date, src, dst, round(volume, 6) AS volume, export, round(max(volume) OVER (PARTITION BY gas_date, export), 6) AS peak FROM m""")
def g16_edge_export_split(spark, sf_dir):
    return rounded(network.edge_export_split(edges(spark, sf_dir), frames.flows(spark, sf_dir), "gas_date", "place", "kind", "volume").select("gas_date", "src", "dst", "volume", "export", "peak"))


@query(f"SELECT DISTINCT * FROM (SELECT gas_date, round_even(unnest(quantile_cont(volume, [0.25, 0.6, 0.95])) / 5, 0) * 5 AS example FROM ({EDGES}) GROUP BY 1) WHERE example > 0")
def g17_legend_examples(spark, sf_dir):
    return network.legend_examples(edges(spark, sf_dir), ["gas_date"], "volume")


@query(f"""WITH f AS ({frames.FLOWS}), s AS (SELECT gas_date, sum(CASE WHEN kind IN ('PROD', 'STOR') THEN supply ELSE 0 END) AS supply, sum(CASE WHEN kind IN ('DISTR', 'POWER', 'INDUS', 'LNG') THEN demand ELSE 0 END) AS demand, sum(CASE WHEN kind = 'LNG' THEN demand ELSE 0 END) AS export
    FROM f WHERE kind <> 'PIPE' AND gas_date >= (SELECT greatest(max(gas_date) - 364, DATE '1992-06-01') FROM f) GROUP BY 1)
SELECT gas_date, (SELECT max(gas_date) - 364 < DATE '1992-06-01' FROM f) AS truncated, round(supply, 6) AS supply, round(demand, 6) AS demand, round(export, 6) AS export, round(demand - export, 6) AS domestic, round(100 * sum(export) OVER () / nullif(sum(demand) OVER (), 0), 6) AS export_share_pct FROM s""")
def g21_balance_series(spark, sf_dir):
    return rounded(network.balance_series(frames.flows(spark, sf_dir), "gas_date", "kind", days=365, first="1992-06-01"))


# Cohorts of countries

OUTPUT = "SELECT c_nationkey AS country, year(o_orderdate)::INT AS year, sum(o_totalprice) / 1e6 AS value FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2"
PILLARS = f"""SELECT country, indicator AS pillar, round(CASE WHEN sp > 1e-12 THEN (value - m) / sp * direction ELSE 0 END, 4) AS pillar_score FROM (SELECT *, stddev_pop(value) OVER (PARTITION BY indicator) AS sp, avg(value) OVER (PARTITION BY indicator) AS m FROM ({INDICATORS}))"""
RANKED = f"SELECT country, sum(pillar_score * CASE pillar WHEN 'balance' THEN 0.75 ELSE 0.25 END) AS score FROM ({PILLARS}) GROUP BY 1"


def pillars(spark, sf_dir):
    a = frames.table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("country")).agg(F.avg("c_acctbal").alias("value")).select("country", F.lit("balance").alias("pillar"), F.lit(1).alias("direction"), "value")
    b = frames.table(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("country")).agg(F.count("*").cast("double").alias("value")).select("country", F.lit("suppliers").alias("pillar"), F.lit(-1).alias("direction"), "value")
    return world.zscores(a.unionByName(b), "pillar", "value", "direction").select("country", "pillar", F.col("z").alias("pillar_score"))


def ranked(spark, sf_dir):
    weights = spark.createDataFrame([("balance", 3.0), ("suppliers", 1.0)], "pillar string, weight double")
    return cohorts.weighted_ranking(pillars(spark, sf_dir), weights, "country", "pillar").withColumn("score", F.round("score", 6))


@query(f"""SELECT country, count(*) AS n, round(avg(CASE WHEN k <= 3 THEN value END), 4) AS recent_mean, round(stddev_pop(value), 4) AS volatility, max(year) AS year FROM (SELECT *, row_number() OVER (PARTITION BY country ORDER BY year DESC) AS k FROM ({OUTPUT})) GROUP BY 1 HAVING count(*) >= 5""")
def w2_growth_derivatives(spark, sf_dir):
    o, c = frames.table(spark, sf_dir, "orders"), frames.table(spark, sf_dir, "customer")
    obs = o.join(c, F.col("o_custkey") == F.col("c_custkey")).groupBy(F.col("c_nationkey").alias("country"), F.year("o_orderdate").alias("year")).agg((F.sum("o_totalprice") / 1e6).alias("value"))
    return rounded(cohorts.growth_derivatives(obs, "country", "year", "value"), 4)


@query(f"SELECT country, round(score, 6) + 0.0 AS score, row_number() OVER (ORDER BY round(score, 6) DESC, country)::INT AS place FROM ({RANKED}) WHERE country IN (SELECT country FROM ({PILLARS}) GROUP BY 1 HAVING count(DISTINCT pillar) = 2) QUALIFY place <= 10")
def w10_complete_cohort(spark, sf_dir):
    p = pillars(spark, sf_dir)
    whole = ranked(spark, sf_dir).select("country", "score")
    return rounded(cohorts.complete_cohort(p, "country", "pillar", ["balance", "suppliers"], whole, 10))


@query(f"SELECT country, round(score, 6) + 0.0 AS score, row_number() OVER (ORDER BY round(score, 6) DESC, country)::INT AS rank FROM ({RANKED})")
def w13_weighted_ranking(spark, sf_dir):
    return rounded(ranked(spark, sf_dir).select("country", "score", "rank"))


@query(f"""WITH s AS (SELECT round(score, 6) AS score FROM ({RANKED})), e AS (SELECT min(score) AS a, max(score) AS b FROM s)
SELECT coalesce(least(9, floor((score - a) * 10 / nullif(b - a, 0))), 0)::INT AS bin, count(*) AS n, round(min(score), 6) + 0.0 AS least, round(max(score), 6) + 0.0 AS most FROM s, e GROUP BY 1""")
def w16_score_histogram(spark, sf_dir):
    return rounded(cohorts.score_histogram(ranked(spark, sf_dir), "score"))


@query(f"""WITH j AS (SELECT country, round(score, 6) AS score, n FROM ({RANKED}) JOIN (SELECT c_nationkey AS country, count(*) AS n FROM customer GROUP BY 1) USING (country)),
r AS (SELECT *, row_number() OVER (ORDER BY score DESC, country)::INT AS score_rank, row_number() OVER (ORDER BY n DESC, country)::INT AS size_rank FROM j), d AS (SELECT *, size_rank - score_rank AS surprise FROM r)
SELECT country, score_rank, size_rank, surprise, 'above' AS side FROM (SELECT * FROM d ORDER BY surprise DESC, country LIMIT 5) UNION ALL SELECT country, score_rank, size_rank, surprise, 'below' FROM (SELECT * FROM d ORDER BY surprise, country LIMIT 5)""")
def w17_rank_surprise(spark, sf_dir):
    sizes = frames.table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("country")).agg(F.count("*").alias("n"))
    return cohorts.rank_surprise(ranked(spark, sf_dir), sizes, "country", "n").select("country", "score_rank", "size_rank", "surprise", "side")


# Books of accounts

BOOK = """SELECT c_custkey AS account_id, c_mktsegment AS industry, coalesce(round(arr, 2), 0.0) AS arr, 50 + c_acctbal / 200 AS score, c_custkey % 1300 - 60 AS days_to_renewal, c_custkey % 4000 AS tenure_days, c_custkey % 5 * 6 + 6 AS term_months
    FROM customer LEFT JOIN (SELECT o_custkey, sum(o_totalprice) AS arr FROM orders GROUP BY 1) ON c_custkey = o_custkey"""
VALUE = "round(arr * term_months / 12, 2)"


def book(spark, sf_dir):
    c, k = frames.table(spark, sf_dir, "customer"), F.col("c_custkey")
    revenue = frames.table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.sum("o_totalprice").alias("arr"))
    return c.join(revenue, k == F.col("o_custkey"), "left").select(k.alias("account_id"), F.col("c_mktsegment").alias("industry"), F.coalesce(F.round("arr", 2), F.lit(0.0)).alias("arr"), (50 + F.col("c_acctbal") / 200).alias("score"), (k % 1300 - 60).alias("days_to_renewal"), (k % 4000).alias("tenure_days"), (k % 5 * 6 + 6).alias("term_months"))


def steps_sql(steps):
    return f"(VALUES {', '.join(f"('{s[1]}')" for s in steps)})"


def label_sql(column, steps):
    return "CASE " + " ".join(f"WHEN {column} <= {s[0]} THEN '{s[1]}'" for s in steps[:-1]) + f" ELSE '{steps[-1][1]}' END"


@query(f"SELECT round(sum(score * arr) / sum(arr), 4) AS weighted_health, round(avg(score), 4) AS plain_health, count(*) AS accounts FROM ({BOOK})")
def a17_portfolio_health(spark, sf_dir):
    return rounded(standing.portfolio_health(book(spark, sf_dir)), 4)


@query(f"SELECT account_id, round(arr, 2) AS arr, round({VALUE}, 1) AS contract_value, round(100 * arr / total, 4) AS share_pct, round(100 * sum(arr) OVER (ORDER BY arr DESC, account_id ROWS UNBOUNDED PRECEDING) / total, 4) AS running_share_pct FROM ({BOOK}), (SELECT sum(arr) AS total FROM ({BOOK})) ORDER BY arr DESC, account_id LIMIT 50")
def a19_customer_concentration(spark, sf_dir):
    return rounded(standing.customer_concentration(book(spark, sf_dir)).withColumns({"arr": F.round("arr", 2), "contract_value": F.round("contract_value", 1)}), 4)


@query(f"""SELECT d.runway, count(account_id) AS accounts, round(coalesce(sum(arr), 0), 2) AS arr, round(coalesce(3 * sum(arr), 0), 2) AS resign_value, round(coalesce(sum({VALUE}), 0), 2) AS secured_value, round(coalesce(sum(CASE WHEN term_months <= 12 THEN arr ELSE 0 END), 0), 2) AS one_year_arr
FROM {steps_sql(standing.RUNWAY)} d(runway) LEFT JOIN ({BOOK}) b ON d.runway = {label_sql("days_to_renewal", standing.RUNWAY)} GROUP BY 1""")
def a21_contract_runway(spark, sf_dir):
    return rounded(standing.contract_runway(book(spark, sf_dir)), 2)


@query(f"""SELECT d.tenure, count(account_id) AS accounts, round(coalesce(sum(arr), 0), 2) AS arr, round(coalesce(sum({VALUE}), 0), 2) AS contract_value FROM {steps_sql(standing.TENURE)} d(tenure) LEFT JOIN ({BOOK}) b ON d.tenure = {label_sql("tenure_days", standing.TENURE)} GROUP BY 1""")
def a22_customer_tenure(spark, sf_dir):
    return rounded(standing.customer_tenure(book(spark, sf_dir)), 2)


@query(f"""SELECT industry, count(*) AS accounts, round(sum(arr), 2) AS total_arr, {", ".join(f"round(sum(CASE WHEN {label_sql('score', standing.BANDS)} = '{b}' THEN arr ELSE 0 END), 2) AS {b.lower()}_arr" for _, b in standing.BANDS)},
    round(coalesce(sum(score * arr) / nullif(sum(arr), 0), 0), 2) AS health, round(coalesce(100 * max(arr) / nullif(sum(arr), 0), 0), 2) AS largest_share_pct FROM ({BOOK}) GROUP BY 1""")
def a23_industry_portfolio(spark, sf_dir):
    return rounded(standing.industry_portfolio(book(spark, sf_dir), "industry"), 2)


@query(f"SELECT d.band, count(account_id) AS accounts, round(coalesce(sum(arr), 0), 2) AS arr FROM {steps_sql(standing.BANDS)} d(band) LEFT JOIN ({BOOK}) b ON d.band = {label_sql('score', standing.BANDS)} GROUP BY 1")
def a24_health_distribution(spark, sf_dir):
    return rounded(standing.health_distribution(book(spark, sf_dir)), 2)


@query(f"""SELECT account_id, round(arr, 2) AS arr, {label_sql("days_to_renewal", standing.RUNWAY)} AS runway, round(arr * greatest(1.0, 100 - score) * CASE WHEN days_to_renewal <= 183 THEN 2.0 WHEN days_to_renewal <= 548 THEN 1.5 WHEN days_to_renewal <= 1095 THEN 1.15 ELSE 1.0 END, 2) AS priority FROM ({BOOK}) ORDER BY priority DESC, account_id LIMIT 6""")
def a26_priority_accounts(spark, sf_dir):
    return rounded(standing.priority_accounts(book(spark, sf_dir)).select("account_id", "arr", "runway", "priority"), 2)


AS_TEXT = {
    "b8_asset_interval_series": ("ts",), "b11_period_options": ("anchor",), "b12_period_summary": ("anchor", "best_day"), "b13_weekly_rollup": ("week_end",),
    "p3_backtest_origins": ("origin",), "p11_target_grid": ("origin", "interval_end"), "p23_completed_origins": ("origin",), "p24_performance_summary": ("last_origin",), "p25_model_ranking": ("last_origin",),
    "p28_forecast_vs_actual": ("day",), "p31_forecast_errors": ("origin", "day"), "g7_legs_in_force": ("gas_date", "effective_date"), "g15_network_nodes": ("gas_date",), "g16_edge_export_split": ("gas_date",),
    "g17_legend_examples": ("gas_date",), "g21_balance_series": ("gas_date",),
}

for _name, _columns in AS_TEXT.items():
    as_text(_name, _columns)
