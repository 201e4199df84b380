"""Queries of jobs that the others use, or of parts that they leave out."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import calendar
from ..operators import accounts, cohorts, documents, estimates, gas, keys, network, price, reviews, world
from . import frames, intake, ladder, summaries
from .queries import EDGES, as_text, edges, query, rounded

# Keys


@query("""WITH s AS (SELECT o_custkey AS k, max(o_orderdate) AS u FROM orders WHERE o_orderstatus = 'F' GROUP BY 1), i AS (SELECT o_custkey AS k, max(o_orderdate) AS u FROM orders WHERE o_orderstatus <> 'F' GROUP BY 1)
SELECT count_if(i.u < s.u)::BIGINT AS superseded, count_if(s.u IS NULL OR i.u >= s.u)::BIGINT AS kept FROM i LEFT JOIN s USING (k)""")
def d2_superseded(spark, sf_dir):
    o = frames.table(spark, sf_dir, "orders")
    latest = lambda df: df.groupBy(F.col("o_custkey").alias("k")).agg(F.max("o_orderdate").alias("updated_at"))
    return keys.superseded(latest(o.where("o_orderstatus = 'F'")), latest(o.where("o_orderstatus <> 'F'")), ["k"], "updated_at")


@query("SELECT l_orderkey, l_linenumber, l_suppkey, l_suppkey IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0) AS known FROM lineitem")
def d3_orphan_split(spark, sf_dir):
    dim = frames.table(spark, sf_dir, "supplier").where("s_acctbal > 0").select(F.col("s_suppkey").alias("l_suppkey"))
    known, lost = keys.orphan_split(frames.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey"), dim, ["l_suppkey"])
    return known.withColumn("known", F.lit(True)).unionByName(lost.withColumn("known", F.lit(False)))


@query("SELECT c_custkey, CASE WHEN n_nationkey IS NOT NULL THEN c_nationkey END AS c_nationkey FROM customer LEFT JOIN (SELECT n_nationkey FROM nation WHERE n_regionkey <> 2) ON c_nationkey = n_nationkey")
def d4_null_unknown_fk(spark, sf_dir):
    c = frames.table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    return keys.null_unknown_fk(c, frames.table(spark, sf_dir, "nation").where("n_regionkey <> 2"), "c_nationkey", "n_nationkey")


_CELLS = "SELECT {k} AS k, max(round(c_acctbal, 2)) AS v FROM customer WHERE {w} GROUP BY 1"


@query(f"WITH s AS ({_CELLS.format(k='CASE WHEN c_nationkey > 0 THEN c_nationkey END', w='c_custkey % 2 = 0')}), i AS ({_CELLS.format(k='CASE WHEN c_nationkey > 0 THEN c_nationkey END', w='c_nationkey < 10 AND c_custkey % 2 = 1')}) SELECT * FROM i UNION ALL SELECT * FROM s WHERE NOT EXISTS (SELECT 1 FROM i WHERE i.k IS NOT DISTINCT FROM s.k)")
def d6_plain_upsert(spark, sf_dir):
    c = frames.table(spark, sf_dir, "customer")
    cells = lambda rule: c.where(rule).groupBy(F.when(F.col("c_nationkey") > 0, F.col("c_nationkey")).alias("k")).agg(F.max(F.round("c_acctbal", 2)).alias("v"))
    return keys.plain_upsert(cells("c_custkey % 2 = 0"), cells("c_nationkey < 10 AND c_custkey % 2 = 1"), ["k"])


@query("WITH i AS (SELECT o_orderkey, o_custkey FROM orders WHERE o_orderstatus = 'P') SELECT * FROM i UNION ALL SELECT o_orderkey, o_custkey FROM orders WHERE o_orderstatus = 'F' AND o_custkey NOT IN (SELECT o_custkey FROM i)")
def d7_replace_slice(spark, sf_dir):
    of = lambda status: frames.table(spark, sf_dir, "orders").where(F.col("o_orderstatus") == status).select("o_orderkey", "o_custkey")
    return keys.replace_slice(of("F"), of("P"), ["o_custkey"])


# Time


@query("""SELECT event_id, ((isodow(s) - 1) * 48 + hour(s) * 2 + minute(s) // 30)::INT AS week_slot, CASE WHEN hour(s) >= 21 THEN 'late' WHEN hour(s) >= 17 THEN 'evening' WHEN hour(s) >= 15 THEN 'afternoon' WHEN hour(s) >= 9 THEN 'midday' WHEN hour(s) >= 6 THEN 'morning' ELSE 'overnight' END AS band, (CAST(e AS DATE) - (isodow(e) % 7)::INT)::VARCHAR AS sunday, CAST(ts - INTERVAL 1 MICROSECOND AS DATE)::VARCHAR AS operating_day
FROM (SELECT *, e - INTERVAL 30 MINUTE AS s FROM (SELECT *, TIMESTAMP '1970-01-01' + to_minutes(-CAST(floor(-epoch_us(ts) / 1.8e9) AS BIGINT) * 30) AS e FROM events))""")
def p9_market_calendar(spark, sf_dir):
    e = frames.table(spark, sf_dir, "events")
    end = calendar.interval_end(F.col("ts"))
    return e.select("event_id", calendar.week_slot(end).cast("int").alias("week_slot"), calendar.time_band(end).alias("band"), calendar.latest_sunday(F.to_date(end)).cast("string").alias("sunday"), calendar.operating_day(F.col("ts")).cast("string").alias("operating_day"))


# Network

_USED = f"""SELECT gas_date, facility, received, CASE WHEN c >= 1 THEN c END AS capacity, 100 * received / CASE WHEN c >= 1 THEN c END AS pct FROM (SELECT gas_date, facility, sum(supply + transfer_in) AS received FROM ({frames.FLOWS}) GROUP BY 1, 2)
    ASOF LEFT JOIN (SELECT facility AS f, effective_date AS e, max(capacity) AS c FROM ({frames.RATINGS}) GROUP BY 1, 2) ON facility = f AND gas_date >= e"""


@query(f"""SELECT gas_date, count(capacity) AS rated, count_if(coalesce(pct > 100, false))::BIGINT AS suspect, count_if(coalesce(pct <= 100 AND pct >= 90, false))::BIGINT AS at_90, count_if(coalesce(pct <= 100 AND pct >= 70, false))::BIGINT AS at_70, round(max(pct) FILTER (pct <= 100), 6) AS busiest_pct FROM ({_USED}) GROUP BY 1""")
def g8_utilisation_summary(spark, sf_dir):
    flows = frames.flows(spark, sf_dir)
    in_force = gas.capacity_in_force(frames.ratings(spark, sf_dir), flows.select("facility", "gas_date").distinct(), "facility", "effective_date", "capacity", "gas_date")
    return rounded(gas.utilisation_summary(gas.pipeline_utilisation(flows, in_force, "facility", "gas_date"), "gas_date", "facility").drop("busiest"))


@query(f"SELECT DISTINCT p AS place FROM (SELECT src AS p FROM ({EDGES}) UNION SELECT dst FROM ({EDGES})) WHERE p NOT IN (SELECT n_nationkey FROM nation WHERE n_regionkey < 3)")
def g16_unplaced_nodes(spark, sf_dir):
    nodes = edges(spark, sf_dir).select(F.explode(F.array("src", "dst")).alias("place"))
    return network.unplaced_nodes(nodes, frames.table(spark, sf_dir, "nation").where("n_regionkey < 3").select(F.col("n_nationkey").cast("long").alias("place")), "place")


@query(f"""WITH f AS (SELECT * FROM ({frames.FLOWS}) WHERE gas_date > (SELECT max(gas_date) - 365 FROM ({frames.FLOWS}))), u AS (SELECT gas_date, kind, sum(demand) AS demand FROM f WHERE kind IN ('DISTR', 'POWER', 'INDUS', 'LNG') GROUP BY 1, 2)
SELECT gas_date, kind, coalesce(demand, 0) AS demand, list_position(['DISTR', 'POWER', 'INDUS', 'LNG'], kind)::INT AS place FROM (SELECT * FROM (SELECT DISTINCT gas_date FROM f), (SELECT DISTINCT kind FROM u)) LEFT JOIN u USING (gas_date, kind)""")
def g22_demand_matrix(spark, sf_dir):
    return gas.demand_matrix(frames.flows(spark, sf_dir), "gas_date", "kind")


_HELD = f"SELECT facility, gas_date, min(flag) AS flag FROM ({frames.FLAGS}) GROUP BY 1, 2"


def one_flag(spark, sf_dir):
    return frames.flags(spark, sf_dir).groupBy("facility", "gas_date").agg(F.min("flag").alias("flag"))


@query(f"""WITH h AS (SELECT * FROM ({_HELD}) WHERE gas_date > (SELECT max(gas_date) - 180 FROM ({_HELD}))) SELECT facility, gas_date, coalesce(flag, '') AS flag FROM (SELECT * FROM (SELECT DISTINCT facility FROM h WHERE flag IN ('AMBER', 'RED')), (SELECT DISTINCT gas_date FROM h)) LEFT JOIN h USING (facility, gas_date)""")
def g23_constraint_grid(spark, sf_dir):
    return gas.constraint_grid(one_flag(spark, sf_dir), "facility", "gas_date", "flag")


@query(f"SELECT gas_date, count(DISTINCT CASE WHEN flag <> 'GREEN' THEN facility END) AS constrained, count(DISTINCT facility) AS assessed FROM ({frames.FLAGS}) GROUP BY 1")
def g23_constraint_totals(spark, sf_dir):
    return gas.constraint_totals(frames.flags(spark, sf_dir), "facility", "gas_date", "flag")


# Forecasts

_LADDER = f"""SELECT region, 'seasonal_naive' AS model, origin, ts, p.rrp AS predicted, true AS safe FROM ({ladder.GRID}) g JOIN ({ladder.PRICES}) p USING (region) WHERE p.ts = g.ts - INTERVAL 7 DAY""".replace("origin, ts, p.rrp", "origin, g.ts, p.rrp")
_SCORED = f"""SELECT model, region, origin, avg(abs(predicted - rrp)) AS mae, median(abs(predicted - rrp)) AS median_ae, max(abs(predicted - rrp)) AS max_ae, bool_and(safe) AS safe FROM ({_LADDER} UNION ALL SELECT g.region, 'rolling_median', g.origin, g.ts, greatest(-1000.0, median(p.rrp)), true FROM ({ladder.GRID}) g JOIN ({ladder.PRICES}) p ON p.region = g.region AND p.ts IN (g.ts - INTERVAL 7 DAY, g.ts - INTERVAL 14 DAY, g.ts - INTERVAL 21 DAY, g.ts - INTERVAL 28 DAY) GROUP BY 1, 2, 3, 4
    UNION ALL SELECT region, 'temperature_adjusted', origin, ts, predicted, coalesce(source, 'none') <> 'observed-fallback' FROM ({ladder.ADJUSTED}) LEFT JOIN (SELECT region, origin, max(source) AS source FROM ({ladder.TARGET}) GROUP BY 1, 2) USING (region, origin))
    JOIN ({ladder.PRICES}) USING (region, ts) GROUP BY 1, 2, 3"""


@query(f"SELECT model, region, count(*) AS weeks, round(avg(mae), 3) AS avg_mae, round(max(max_ae), 3) AS worst_error, bool_and(safe) AS leakage_safe FROM ({_SCORED}) GROUP BY 1, 2")
def p24_leakage_safe_summary(spark, sf_dir):
    p, w, g = ladder.prices(spark, sf_dir), ladder.weather(spark, sf_dir), ladder.grid(spark, sf_dir)
    runs = ladder.forecast.forecast_ladder(p, w, g)
    safe = runs.groupBy("model", "region", "origin").agg(F.bool_and("leakage_safe").alias("safe"))
    scores = price.score_runs(runs, p, ["model", "region", "origin"], ["region", "ts"], "rrp").join(safe, ["model", "region", "origin"])
    df = reviews.performance_summary(scores, "region", "model", "origin", "seasonal_naive", safe="safe")
    return df.select("model", "region", "weeks", F.round("avg_mae", 3).alias("avg_mae"), F.round("worst_error", 3).alias("worst_error"), "leakage_safe")


@query(f"SELECT region, origin, count(*) AS total, count(rrp) AS settled, count(rrp) = count(*) AS complete FROM (SELECT region, origin, ts FROM ({ladder.GRID}) UNION SELECT region, origin, ts + INTERVAL 1 DAY FROM ({ladder.GRID})) LEFT JOIN ({ladder.PRICES}) USING (region, ts) GROUP BY 1, 2")
def p28_forecast_progress(spark, sf_dir):
    g = ladder.grid(spark, sf_dir)
    points = g.unionByName(g.withColumn("ts", F.col("ts") + F.make_dt_interval(days=F.lit(1))))
    return reviews.forecast_progress(points, ladder.prices(spark, sf_dir), ["region", "ts"], ["region", "origin"], "rrp")


@query(f"SELECT model, region, origin, round(mae, 7) AS mae, round(1 - mae / nullif(max(CASE WHEN model = 'naive' THEN mae END) OVER (PARTITION BY region, origin), 0), 7) + 0.0 AS skill FROM ({summaries.RUNS})")
def p22_skill_by_origin(spark, sf_dir):
    p, both = summaries.points(spark, sf_dir)
    scores = price.score_runs(both, p, ["model", "region", "origin"], ["region", "day"], "rrp")
    return rounded(price.skill(scores, ["region", "origin"], "model", "naive").select("model", "region", "origin", "mae", "skill"), 7)


@query(f"""SELECT g.region, g.origin, g.ts, greatest(-1000.0, p.rrp) AS seasonal_naive, a.rrp AS actual, false AS context FROM ({ladder.GRID}) g JOIN ({ladder.PRICES}) p ON p.region = g.region AND p.ts = g.ts - INTERVAL 7 DAY LEFT JOIN ({ladder.PRICES}) a ON a.region = g.region AND a.ts = g.ts
UNION ALL SELECT o.region, o.origin, p.ts, NULL, p.rrp, true FROM (SELECT DISTINCT g.region, g.origin FROM ({ladder.GRID}) g JOIN ({ladder.PRICES}) p ON p.region = g.region AND p.ts = g.ts - INTERVAL 7 DAY) o JOIN ({ladder.PRICES}) p USING (region) WHERE p.ts <= o.origin AND p.ts > o.origin - INTERVAL 7 DAY""")
def p28_forecast_axis(spark, sf_dir):
    p, g = ladder.prices(spark, sf_dir), ladder.grid(spark, sf_dir)
    points = ladder.forecast.naive_intervals(p, g).withColumn("model", F.lit("seasonal_naive"))
    return reviews.forecast_axis(points, p, ["region"], "ts", "origin", "rrp", "model", ["seasonal_naive"])


# Documents

_BOARD = "(['Ideas', 'This Week', 'Complete', 'Other'])[event_id % 4 + 1]"


def boards(spark, sf_dir):
    """A document per user: its events as cards, put away or on the board, and as tasks of days and weeks."""
    e = frames.table(spark, sf_dir, "events")
    k = F.col("event_id")
    column = F.get(F.array(*map(F.lit, ("Ideas", "This Week", "Complete", "Other"))), (k % 4).cast("int"))
    item = F.struct((k % 50).cast("string").alias("id"), k.cast("string").alias("title"), F.col("event_type").alias("priority"), F.when(k % 2 == 0, column).alias("archivedFromColumn"))
    parts = lambda rule, x: F.sort_array(F.collect_list(F.when(rule, F.struct(k.alias("o"), x.alias("x")))))
    plain = lambda xs: F.transform(xs, lambda y: y["x"])
    one = e.groupBy("user_id").agg(*[parts((k % 10 != 0) & (column == c), item).alias(f"c{i}") for i, c in enumerate(("Ideas", "This Week", "Complete", "Other"))], parts(k % 10 == 0, item).alias("put"), F.max("event_id").alias("top"))
    board = F.create_map(*[v for i, c in enumerate(("Ideas", "This Week", "Complete", "Other")) for v in (F.lit(c), plain(f"c{i}"))])
    days = e.groupBy("user_id", F.date_format("ts", "yyyy-MM-dd").alias("d")).agg(F.to_json(F.transform(F.sort_array(F.collect_list("event_id")), lambda x: F.struct(x.cast("string").alias("text"), (x % 2 == 0).alias("done")))).alias("tasks"))
    more = days.groupBy("user_id").agg(F.map_from_entries(F.collect_list(F.struct(F.concat(F.lit("app.dailyTasks."), F.col("d")), "tasks"))).alias("more"))
    fixed = F.create_map(F.lit("app.kanban"), F.to_json(board), F.lit("app.archive"), F.to_json(plain("put")), F.lit("app.weeklyFocus.2024-05"), F.to_json(F.struct(F.col("top").cast("string").alias("main"))), F.lit("other.kanban"), F.lit("{}"))
    return one.join(more, "user_id").select("user_id", F.to_json(F.map_concat(fixed, "more")).alias("document"))


@query(f"""SELECT user_id, (event_id % 50)::VARCHAR AS card, event_id::VARCHAR AS title, event_type AS priority, CASE WHEN event_id % 10 = 0 THEN CASE WHEN event_id % 2 = 0 THEN {_BOARD} ELSE 'Parking Lot' END ELSE {_BOARD} END AS board_column, event_id % 10 = 0 AS archived
FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_id % 50 ORDER BY event_id % 10 = 0 DESC, CASE WHEN event_id % 10 = 0 THEN 0 ELSE event_id % 4 END DESC, event_id DESC) AS r FROM events WHERE event_id % 10 = 0 OR event_id % 4 <> 3) WHERE r = 1""")
def s1_cards(spark, sf_dir):
    return documents.document_tables(boards(spark, sf_dir), "user_id", "document", "app.")["cards"]


@query("SELECT user_id, strftime(ts, '%Y-%m-%d') AS day, (row_number() OVER (PARTITION BY user_id, strftime(ts, '%Y-%m-%d') ORDER BY event_id) - 1)::INT AS place, event_id::VARCHAR AS text, event_id % 2 = 0 AS done FROM events")
def s1_daily_tasks(spark, sf_dir):
    return documents.document_tables(boards(spark, sf_dir), "user_id", "document", "app.")["daily_tasks"]


@query("SELECT user_id, '2024-05' AS week, max(event_id)::VARCHAR AS main, '' AS secondary, '' AS health FROM events GROUP BY 1")
def s1_weekly_focus(spark, sf_dir):
    return documents.document_tables(boards(spark, sf_dir), "user_id", "document", "app.")["weekly_focus"]


# Accounts and countries


@query(f"""WITH c AS (SELECT account_id, max_by(arr, month) - min_by(arr, month) AS d FROM (SELECT *, row_number() OVER (PARTITION BY account_id ORDER BY month DESC) AS k FROM ({frames.TIMELINE})) WHERE k <= 13 GROUP BY 1)
SELECT account_id, side FROM ((SELECT account_id, 'decliner' AS side FROM c ORDER BY d, account_id LIMIT 5) UNION ALL (SELECT account_id, 'grower' FROM c ORDER BY d DESC, account_id LIMIT 5))""")
def a27_growers_decliners(spark, sf_dir):
    return accounts.growers_decliners(accounts.arr_change(frames.timeline(spark, sf_dir))).select("account_id", "side")


@query(f"SELECT n_nationkey AS country, round(coalesce(e, 0), 4) AS effective_count FROM nation LEFT JOIN (SELECT country, 1 / sum(s * s) AS e FROM (SELECT country, value / sum(value) OVER (PARTITION BY country) AS s FROM ({frames.EXPORTS}) WHERE value > 0 AND country % 4 <> 1) GROUP BY 1) ON country = n_nationkey")
def w4_effective_count_of_all(spark, sf_dir):
    sold = frames.exports(spark, sf_dir).where("country % 4 <> 1")
    return rounded(world.effective_count(sold, "country", "value", frames.table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("country"))), 4)


_RULE = "(indicator <> 'balance' OR raw > 0) AND (indicator <> 'orders' OR country % 5 = 0 OR coalesce(year, 0) >= 2020)"


@query(f"SELECT country, indicator, coalesce({_RULE}, false) AS valid FROM ({intake.PREPARED})")
def w8_valid_value(spark, sf_dir):
    p, i = intake.prepared(spark, sf_dir), F.col("indicator")
    valid = cohorts.valid_value(F.col("raw"), F.col("year"), F.when(i == "balance", "log10").otherwise("none"), F.when(i == "orders", "latest").otherwise("average"), F.col("country") % 5 == 0)
    return p.select("country", "indicator", valid.alias("valid"))


@query(f"WITH w AS (SELECT country FROM ({intake.PREPARED}) GROUP BY 1 HAVING count(*) = 3) SELECT country, row_number() OVER (ORDER BY score DESC, country)::INT AS place FROM (SELECT country, round(avg(pillar_score), 4) AS score FROM ({intake.PILLARS}) GROUP BY 1) WHERE country IN (SELECT country FROM w) QUALIFY place <= 3")
def w10_whole_cohort(spark, sf_dir):
    scores = world.model_scores(intake.pillars(spark, sf_dir), "country").select("country", "score")
    cohort = cohorts.complete_cohort(intake.prepared(spark, sf_dir), "country", "indicator", ["balance", "orders", "suppliers"], scores, 3)
    return estimates.whole_cohort(cohort, "country", min(3, cohort.count())).select("country", "place")


for _name, _columns in {"g8_utilisation_summary": ("gas_date",), "g22_demand_matrix": ("gas_date",), "g23_constraint_grid": ("gas_date",), "g23_constraint_totals": ("gas_date",), "p28_forecast_progress": ("origin",), "p22_skill_by_origin": ("origin",), "p28_forecast_axis": ("origin", "ts"), "s1_daily_tasks": ("day",)}.items():
    as_text(_name, _columns)
