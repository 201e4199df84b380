"""One query per job over the driver's tables, with the SQL that must give the same rows.

Sums of doubles depend on their order, so doubles are rounded at the very end on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.calendar import operating_day
from ..operators import accounts, battery, documents, fuel, gas, keys, price, world
from . import frames

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    # a negative zero becomes zero
    return df.select(*[(F.round(c, places) + F.lit(0.0)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


# Keys and coverage


@query("""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber
    ORDER BY l_shipdate DESC, l_partkey DESC, l_suppkey DESC, l_extendedprice DESC, l_quantity DESC, l_discount DESC, l_tax DESC, l_returnflag DESC, l_linestatus DESC) AS k FROM lineitem) WHERE k = 1""")
def d1_dedupe_last(spark, sf_dir):
    order = [F.col(c) for c in ("l_shipdate", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_discount", "l_tax", "l_returnflag", "l_linestatus")]
    return keys.dedupe_last(frames.table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"], order).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")


LATEST = "SELECT o_custkey AS k, max(o_orderdate) AS updated_at, round(sum(o_totalprice), 2) AS v FROM orders WHERE o_orderstatus {} GROUP BY 1"


@query(f"""WITH s AS ({LATEST.format("= 'F'")}), i AS ({LATEST.format("<> 'F'")})
SELECT coalesce(s.k, i.k) AS k, CASE WHEN i.k IS NULL OR i.updated_at < s.updated_at THEN s.updated_at ELSE i.updated_at END AS updated_at, CASE WHEN i.k IS NULL OR i.updated_at < s.updated_at THEN s.v ELSE i.v END AS v FROM s FULL JOIN i ON s.k = i.k""")
def d2_newest_wins_merge(spark, sf_dir):
    o = frames.table(spark, sf_dir, "orders")
    latest = lambda df: df.groupBy(F.col("o_custkey").alias("k")).agg(F.max("o_orderdate").alias("updated_at"), F.round(F.sum("o_totalprice"), 2).alias("v"))
    return keys.newest_wins_merge(latest(o.where("o_orderstatus = 'F'")), latest(o.where("o_orderstatus <> 'F'")), ["k"], "updated_at")


@query("SELECT event_type AS source, min(CAST(ts AS DATE)) AS earliest, max(CAST(ts AS DATE)) AS latest, count(*) AS rows_stored FROM events GROUP BY 1")
def d8_source_coverage(spark, sf_dir):
    return keys.source_coverage(frames.table(spark, sf_dir, "events").select(F.col("event_type").alias("source"), F.to_date("ts").alias("day")), "source", "day")


@query("""WITH h AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS day FROM orders WHERE o_totalprice > 400000)
SELECT CAST(d AS DATE) AS day FROM (SELECT unnest(generate_series((SELECT min(day) FROM h)::TIMESTAMP, (SELECT max(day) FROM h)::TIMESTAMP, INTERVAL 1 DAY)) AS d) WHERE CAST(d AS DATE) NOT IN (SELECT day FROM h)""")
def d10_missing_days(spark, sf_dir):
    return keys.missing_days(frames.table(spark, sf_dir, "orders").where("o_totalprice > 400000"), "o_orderdate")


@query(f"""WITH c AS (SELECT asset, day, count(*) AS n FROM ({frames.DISPATCH}) GROUP BY 1, 2), g AS (SELECT * FROM (SELECT DISTINCT asset FROM c), (SELECT DISTINCT day FROM c))
SELECT asset, day, coalesce(n, 0) AS n FROM g LEFT JOIN c USING (asset, day) WHERE coalesce(n, 0) <> 16""")
def d11_completeness_gate(spark, sf_dir):
    return keys.completeness_gate(frames.dispatch(spark, sf_dir), "asset", F.col("day"), 16)


RANGES = "SELECT o_orderkey, o_custkey, CAST(o_orderdate AS DATE) AS a, CASE WHEN o_orderstatus = 'P' THEN NULL ELSE CAST(o_orderdate AS DATE) + 30 END AS b FROM orders"


@query(f"""SELECT DISTINCT o_custkey, a FROM (SELECT *, max(coalesce(b, DATE '9999-12-31')) OVER (PARTITION BY o_custkey ORDER BY a, coalesce(b, DATE '9999-12-31') ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS r FROM ({RANGES})) WHERE r >= a""")
def d12_overlap_check(spark, sf_dir):
    o = frames.table(spark, sf_dir, "orders").select("o_custkey", F.to_date("o_orderdate").alias("a"), F.when(F.col("o_orderstatus") != "P", F.date_add(F.to_date("o_orderdate"), 30)).alias("b"))
    return keys.overlap_check(o, "o_custkey", "a", "b").select("o_custkey", "a").distinct()


# Prices


@query("""SELECT region, interval_end, round(avg(rrp), 6) AS rrp, round(avg(demand), 6) AS demand FROM (SELECT event_type AS region, TIMESTAMP '1970-01-01' + to_minutes(-CAST(floor(-epoch_us(ts) / 1.8e9) AS BIGINT) * 30) AS interval_end,
    value - 20 AS rrp, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS demand FROM events) GROUP BY 1, 2""")
def p1_half_hour_rollup(spark, sf_dir):
    ticks = frames.table(spark, sf_dir, "events").select(F.col("event_type").alias("region"), "ts", (F.col("value") - 20).alias("rrp"), F.get_json_object("props", "$.k").cast("double").alias("demand"))
    return rounded(price.half_hour_rollup(ticks, ["region"], "ts", ["rrp", "demand"]))


@query(f"SELECT region, round(sum(demand) / (SELECT sum(demand) FROM ({frames.PRICES})), 4) AS share FROM ({frames.PRICES}) GROUP BY 1")
def p6_demand_shares(spark, sf_dir):
    return rounded(price.demand_shares(frames.prices(spark, sf_dir), "region", "demand"), 4)


@query(f"SELECT 'ALL' AS region, day, round(sum(rrp * demand) / sum(demand), 5) AS rrp, sum(demand) AS demand FROM ({frames.PRICES}) GROUP BY 2")
def p7_market_aggregate(spark, sf_dir):
    return rounded(price.market_aggregate(frames.prices(spark, sf_dir), "region", "day", "rrp", "demand"), 5)


NAIVE = f"SELECT p.region, p.day, greatest(-1000.0, q.rrp) AS predicted FROM ({frames.PRICES}) p JOIN ({frames.PRICES}) q ON p.region = q.region AND p.day = q.day + 7"
MEDIAN = f"SELECT p.region, p.day, greatest(-1000.0, median(q.rrp)) AS predicted FROM ({frames.PRICES}) p JOIN ({frames.PRICES}) q ON p.region = q.region AND p.day - q.day IN (7, 14, 21, 28) GROUP BY 1, 2"


@query(f"SELECT region, day, predicted FROM ({NAIVE})")
def p12_seasonal_naive(spark, sf_dir):
    p = frames.prices(spark, sf_dir)
    return price.seasonal_naive(p, p.select("region", "day"), ["region"], "day", "rrp")


@query(f"SELECT region, day, predicted FROM ({MEDIAN})")
def p13_rolling_median(spark, sf_dir):
    p = frames.prices(spark, sf_dir)
    return price.rolling_median(p, p.select("region", "day"), ["region"], "day", "rrp")


PAIRS = f"""SELECT p.region, p.day, greatest(0.0, p.demand / 10 - 18) - greatest(0.0, q.demand / 10 - 18) AS c, greatest(0.0, 18 - p.demand / 10) - greatest(0.0, 18 - q.demand / 10) AS h, p.rrp - q.rrp AS p
    FROM ({frames.PRICES}) p JOIN ({frames.PRICES}) q ON p.region = q.region AND p.day = q.day + 7"""


@query(f"""WITH pairs AS ({PAIRS}), b AS (SELECT region, count(*) AS n, quantile_cont(p, 0.02) AS lo, quantile_cont(p, 0.98) AS hi FROM pairs GROUP BY 1),
s AS (SELECT region, max(n) AS n_pairs, sum(c * c) AS cc, sum(h * h) AS hh, sum(c * h) AS ch, sum(c * p) AS cp, sum(h * p) AS hp FROM pairs JOIN b USING (region) WHERE p BETWEEN lo AND hi GROUP BY 1)
SELECT region, n_pairs, round(CASE WHEN n_pairs < 40 THEN 0 WHEN cc * hh - ch * ch <> 0 THEN (cp * hh - hp * ch) / (cc * hh - ch * ch) WHEN cc <> 0 THEN cp / cc ELSE 0 END, 4) AS beta_cool,
    round(CASE WHEN n_pairs < 40 THEN 0 WHEN cc * hh - ch * ch <> 0 THEN (hp * cc - cp * ch) / (cc * hh - ch * ch) WHEN cc = 0 AND hh <> 0 THEN hp / hh ELSE 0 END, 4) AS beta_heat, CASE WHEN n_pairs < 40 THEN 'too few pairs' END AS reason FROM s""")
def p15_fit_betas(spark, sf_dir):
    p = frames.prices(spark, sf_dir).withColumn("t", F.col("demand") / 10)
    return rounded(price.fit_betas(price.temperature_pairs(p, ["region"], "day", "rrp", "t"), ["region"]), 4)


SCORES = f"""SELECT model, region, count(*) AS n, avg(abs(predicted - rrp)) AS mae, median(abs(predicted - rrp)) AS median_ae, max(abs(predicted - rrp)) AS max_ae FROM
    (SELECT 'naive' AS model, * FROM ({NAIVE}) UNION ALL SELECT 'median' AS model, * FROM ({MEDIAN})) JOIN ({frames.PRICES}) USING (region, day) GROUP BY 1, 2"""


@query(f"""SELECT model, region, n, round(mae, 6) AS mae, round(median_ae, 6) AS median_ae, round(max_ae, 6) AS max_ae, round(1 - mae / max(CASE WHEN model = 'naive' THEN mae END) OVER (PARTITION BY region), 6) AS skill FROM ({SCORES})""")
def p22_forecast_scores(spark, sf_dir):
    p = frames.prices(spark, sf_dir)
    grid = p.select("region", "day")
    points = price.seasonal_naive(p, grid, ["region"], "day", "rrp").withColumn("model", F.lit("naive")).unionByName(price.rolling_median(p, grid, ["region"], "day", "rrp").withColumn("model", F.lit("median")))
    return rounded(price.skill(price.score_runs(points, p, ["model", "region"], ["region", "day"], "rrp"), ["region"], "model", "naive"))


@query(f"""SELECT region, round(avg(rrp), 6) AS avg_price, round(min(rrp), 6) AS min_price, round(max(rrp), 6) AS max_price, count(*) AS n, round(100 * avg(CASE WHEN rrp < 0 THEN 1 ELSE 0 END), 6) AS pct_negative, round(max(demand), 6) AS peak_demand
FROM ({frames.PRICES}) JOIN (SELECT region, max(day) AS last FROM ({frames.PRICES}) GROUP BY 1) USING (region) WHERE day > last - 7 GROUP BY 1""")
def p26_headline_stats(spark, sf_dir):
    return rounded(price.headline_stats(frames.prices(spark, sf_dir), "region", "day", "rrp", "demand"))


# Network


@query(f"""WITH f AS ({frames.FLOWS}), s AS (SELECT gas_date, kind, sum(demand) AS demand, count(DISTINCT facility) AS n_facilities FROM f WHERE kind IN ('DISTR', 'POWER', 'INDUS', 'LNG') GROUP BY 1, 2)
SELECT gas_date, kind, round(demand, 6) AS demand, n_facilities, round(100 * demand / nullif(sum(demand) OVER (PARTITION BY gas_date), 0), 6) AS share_pct FROM s""")
def g4_day_picture(spark, sf_dir):
    return rounded(gas.day_picture(frames.flows(spark, sf_dir), "gas_date", "kind", "facility"))


IN_FORCE = f"""SELECT d.facility, d.gas_date, r.effective_date, r.capacity FROM (SELECT DISTINCT facility, gas_date FROM ({frames.FLOWS})) d ASOF JOIN
    (SELECT facility, effective_date, max(capacity) AS capacity FROM ({frames.RATINGS}) GROUP BY 1, 2) r ON d.facility = r.facility AND d.gas_date >= r.effective_date"""


def in_force(spark, sf_dir, flows):
    return gas.capacity_in_force(frames.ratings(spark, sf_dir), flows.select("facility", "gas_date"), "facility", "effective_date", "capacity", "gas_date")


@query(f"SELECT facility, gas_date, effective_date, round(capacity, 6) AS capacity FROM ({IN_FORCE})")
def g6_capacity_in_force(spark, sf_dir):
    return rounded(in_force(spark, sf_dir, frames.flows(spark, sf_dir)))


@query(f"""WITH s AS (SELECT facility, gas_date, sum(supply + transfer_in) AS received, sum(demand + transfer_out) AS delivered FROM ({frames.FLOWS}) GROUP BY 1, 2),
j AS (SELECT s.*, CASE WHEN c.capacity >= 1 THEN c.capacity END AS cap FROM s LEFT JOIN ({IN_FORCE}) c ON s.facility = c.facility AND s.gas_date = c.gas_date)
SELECT facility, gas_date, round(received, 6) AS received, round(delivered, 6) AS delivered, round(cap, 6) AS capacity, round(100 * received / cap, 6) AS utilisation_pct, coalesce(100 * received / cap > 100, false) AS denominator_suspect FROM j""")
def g8_pipeline_utilisation(spark, sf_dir):
    flows = frames.flows(spark, sf_dir)
    return rounded(gas.pipeline_utilisation(flows, in_force(spark, sf_dir, flows), "facility", "gas_date"))


HELD = f"SELECT facility, gas_date, sum(supply + demand) AS held FROM ({frames.FLOWS}) WHERE kind = 'STOR' GROUP BY 1, 2"


def held(spark, sf_dir):
    return frames.flows(spark, sf_dir).where("kind = 'STOR'").groupBy("facility", "gas_date").agg(F.sum(F.col("supply") + F.col("demand")).alias("held"))


@query(f"""WITH h AS ({HELD}), m AS (SELECT a.facility, a.gas_date, a.held, median(b.held) AS m FROM h a LEFT JOIN h b ON a.facility = b.facility AND month(a.gas_date) = month(b.gas_date) AND day(a.gas_date) = day(b.gas_date) AND year(a.gas_date) <> year(b.gas_date) GROUP BY 1, 2, 3)
SELECT gas_date, round(sum(held), 6) AS held, round(CASE WHEN count(m) = count(*) THEN sum(m) END, 6) AS reference FROM m GROUP BY 1""")
def g10_seasonal_reference(spark, sf_dir):
    return rounded(gas.seasonal_reference(held(spark, sf_dir), "facility", "gas_date", "held"))


@query(f"""WITH RECURSIVE h AS MATERIALIZED (SELECT facility, gas_date, held, row_number() OVER (PARTITION BY facility ORDER BY gas_date) AS i, greatest(median(held) OVER (PARTITION BY facility) * 0.5, 20) AS reach FROM ({HELD}) WHERE held IS NOT NULL),
w AS (SELECT facility, i, held AS last, true AS kept FROM h WHERE i = 1 UNION ALL SELECT h.facility, h.i, CASE WHEN abs(h.held - w.last) <= reach THEN h.held ELSE w.last END, abs(h.held - w.last) <= reach FROM w JOIN h ON h.facility = w.facility AND h.i = w.i + 1)
SELECT facility, gas_date, held, kept FROM h JOIN w USING (facility, i)""")
def g12_drop_implausible(spark, sf_dir):
    return gas.drop_implausible(held(spark, sf_dir), "facility", "gas_date", "held", share=0.5, floor=20.0)


EDGES = f"""WITH places AS (SELECT gas_date, facility, place, sum(supply + transfer_in) AS r, sum(demand + transfer_out) AS d FROM ({frames.FLOWS}) WHERE kind = 'PIPE' GROUP BY 1, 2, 3),
rs AS (SELECT gas_date, facility, place AS src, r, count(*) OVER (PARTITION BY gas_date, facility) AS n_r FROM places WHERE r > 0),
ds AS (SELECT gas_date, facility, place AS dst, d, count(*) OVER (PARTITION BY gas_date, facility) AS n_d, sum(d) OVER (PARTITION BY gas_date, facility) AS all_d FROM places WHERE d > 0)
SELECT gas_date, src, dst, sum(r * d / all_d) AS volume, count(DISTINCT facility) AS n_pipelines, list_sort(list(DISTINCT facility)) AS pipelines, bool_or(n_r > 1 AND n_d > 1) AS inferred FROM rs JOIN ds USING (gas_date, facility) WHERE src <> dst AND r * d / all_d >= 5 GROUP BY 1, 2, 3"""


def edges(spark, sf_dir):
    return gas.flow_edges(frames.flows(spark, sf_dir).where("kind = 'PIPE'"), "facility", "gas_date", "place")


@query(f"SELECT gas_date, src, dst, round(volume, 6) AS volume, n_pipelines, array_to_string(pipelines, ',') AS pipelines, inferred FROM ({EDGES})")
def g13_flow_edges(spark, sf_dir):
    return rounded(edges(spark, sf_dir)).withColumn("pipelines", F.array_join("pipelines", ","))


@query(f"""WITH b AS (SELECT least(src, dst) AS a, greatest(src, dst) AS b, sum(CASE WHEN src <= dst THEN volume ELSE 0 END) AS ab, sum(CASE WHEN src > dst THEN volume ELSE 0 END) AS ba, bool_or(inferred) AS inferred, list_sort(list_distinct(flatten(list(pipelines)))) AS pipelines FROM ({EDGES}) GROUP BY 1, 2)
SELECT CASE WHEN ab >= ba THEN a ELSE b END AS src, CASE WHEN ab >= ba THEN b ELSE a END AS dst, round(abs(ab - ba), 6) AS net, round(greatest(ab, ba), 6) AS gross, round(least(ab, ba), 6) AS counterflow, inferred, array_to_string(pipelines, ',') AS pipelines FROM b""")
def g14_net_opposing_edges(spark, sf_dir):
    return rounded(gas.net_opposing_edges(edges(spark, sf_dir), [])).withColumn("pipelines", F.array_join("pipelines", ","))


TOTAL = f"SELECT gas_date, sum(supply) AS v FROM ({frames.FLOWS}) GROUP BY 1"


@query(f"""WITH s AS ({TOTAL}), y AS (SELECT DISTINCT year(gas_date) AS y FROM s),
an AS (SELECT gas_date, v AS x, try_cast(y || '-' || lpad(month(gas_date)::VARCHAR, 2, '0') || '-' || lpad(day(gas_date)::VARCHAR, 2, '0') AS DATE) AS a FROM s, y WHERE y <> year(gas_date)),
f AS (SELECT an.gas_date, 100 * sum(CASE WHEN s.v < x THEN 1.0 WHEN s.v = x THEN 0.5 ELSE 0 END) / count(*) AS p, count(*) AS n FROM an JOIN s ON s.gas_date BETWEEN a - 7 AND a + 7 GROUP BY 1)
SELECT s.gas_date, round(v, 6) AS v, round(CAST(p AS DOUBLE), 6) AS percentile, coalesce(n, 0) AS n_compared FROM s LEFT JOIN f USING (gas_date)""")
def g18_seasonal_percentile(spark, sf_dir):
    total = frames.flows(spark, sf_dir).groupBy("gas_date").agg(F.sum("supply").alias("v"))
    return rounded(gas.seasonal_percentile(total, "gas_date", "v"))


@query(f"""SELECT coalesce(s, 'ALL') AS state, round(sum(CASE WHEN kind IN ('PROD', 'STOR') THEN supply ELSE 0 END), 6) AS supply, round(sum(CASE WHEN kind IN ('DISTR', 'POWER', 'INDUS', 'LNG') THEN demand ELSE 0 END), 6) AS end_use,
    round(sum(CASE WHEN kind = 'PIPE' THEN demand ELSE 0 END), 6) AS pipeline_delivered FROM (SELECT *, CASE WHEN trim(state) = '' THEN 'Unknown' ELSE state END AS s FROM ({frames.FLOWS})) GROUP BY ROLLUP (s)""")
def g20_state_balance(spark, sf_dir):
    return rounded(gas.state_balance(frames.flows(spark, sf_dir), "state", "kind"))


@query(f"""SELECT gas_date, {", ".join(f"round(sum(CASE WHEN kind = '{k}' THEN demand ELSE 0 END), 6) AS {k.lower()}" for k in gas.END_USE)} FROM ({frames.FLOWS}) WHERE kind IN ('DISTR', 'POWER', 'INDUS', 'LNG') GROUP BY 1""")
def g22_demand_composition(spark, sf_dir):
    return rounded(gas.demand_composition(frames.flows(spark, sf_dir), "gas_date", "kind"))


@query(f"""SELECT *, round(constrained_days / assessed_days, 4) AS share, constrained_days / assessed_days >= 2 / 3 AS chronic FROM
    (SELECT facility, count(DISTINCT CASE WHEN flag IN ('AMBER', 'RED') THEN gas_date END) AS constrained_days, count(DISTINCT gas_date) AS assessed_days FROM ({frames.FLAGS}) GROUP BY 1) WHERE constrained_days > 0""")
def g23_constraint_history(spark, sf_dir):
    return rounded(gas.constraint_history(frames.flags(spark, sf_dir), "facility", "gas_date", "flag"), 4)


@query(f"""WITH d AS (SELECT gas_date, count(DISTINCT facility) AS assessed, count_if(flag = 'GREEN')::BIGINT AS green, count_if(flag = 'AMBER')::BIGINT AS amber, count_if(flag = 'RED')::BIGINT AS red, coalesce(string_agg(DISTINCT facility::VARCHAR, ',' ORDER BY facility::VARCHAR) FILTER (flag IN ('AMBER', 'RED')), '') AS constrained, gas_date < DATE '2000-06-30' AS observed FROM ({frames.FLAGS}) GROUP BY 1),
stop AS (SELECT min(gas_date) AS s FROM d WHERE NOT observed AND assessed < (SELECT max(assessed) FROM d WHERE NOT observed) / 2)
SELECT d.* FROM d, stop WHERE s IS NULL OR gas_date < s""")
def g24_constraint_outlook(spark, sf_dir):
    df = gas.constraint_outlook(frames.flags(spark, sf_dir), "facility", "gas_date", "flag", "2000-06-30")
    return df.withColumn("constrained", F.array_join(F.array_sort(F.transform("constrained", lambda x: x.cast("string"))), ","))


# Batteries


def valued(spark, sf_dir):
    return battery.interval_value(frames.dispatch(spark, sf_dir), "mw", "rrp")


@query(f"SELECT event_id, round(energy_mwh, 6) + 0.0 AS energy_mwh, round(charge_mwh, 6) + 0.0 AS charge_mwh, round(discharge_mwh, 6) + 0.0 AS discharge_mwh, round(energy_value, 6) + 0.0 AS energy_value FROM ({frames.VALUED})")
def b4_interval_value(spark, sf_dir):
    return rounded(valued(spark, sf_dir).select("event_id", "energy_mwh", "charge_mwh", "discharge_mwh", "energy_value"))


@query(f"""SELECT asset, day, count(*) AS n, round(sum(charge_mwh), 6) AS charge_mwh, round(sum(discharge_mwh), 6) AS discharge_mwh, round(sum(charging_cost), 6) AS charging_cost, round(sum(discharge_value), 6) AS discharge_value, round(sum(energy_value), 6) AS energy_value,
    round(max(mw), 6) AS peak_mw, round(min(mw), 6) AS least_mw, round(sum(charge_mwh) + sum(discharge_mwh), 6) AS throughput_mwh, round(sum(energy_value) / nullif(sum(discharge_mwh), 0), 6) AS value_per_mwh, round(sum(discharge_value) / nullif(sum(discharge_mwh), 0), 6) AS capture_price,
    CASE WHEN count(*) = 16 THEN 'complete' ELSE 'partial' END AS status FROM ({frames.VALUED}) GROUP BY 1, 2""")
def b6_daily_summary(spark, sf_dir):
    return rounded(battery.daily_summary(valued(spark, sf_dir), "asset", "day", "mw", expected=16))


@query(f"""SELECT asset, day, round(CASE WHEN sum(energy_value) > 0 THEN sum(CASE WHEN k <= 5 THEN energy_value END) / sum(energy_value) END, 6) AS top_share
FROM (SELECT *, row_number() OVER (PARTITION BY asset, day ORDER BY energy_value DESC, ts, event_id) AS k FROM ({frames.VALUED})) GROUP BY 1, 2""")
def b7_top_value_share(spark, sf_dir):
    return rounded(battery.top_value_share(valued(spark, sf_dir), "asset", "day", ["ts", "event_id"]))


# Generation

GENERATION = """SELECT CAST(ts - INTERVAL 1 MICROSECOND AS DATE) AS day, event_type AS state, (['Solar', 'Wind', 'Black coal', 'Gas', 'Liquid Fuel', 'Battery', 'Biomass', 'Other'])[user_id % 8 + 1] AS fuel, sum(greatest(value - 10, 0) / 12) AS mwh
    FROM (SELECT *, row_number() OVER (PARTITION BY user_id, ts ORDER BY event_id DESC) AS k FROM events) WHERE k = 1 GROUP BY 1, 2, 3"""
#: Technology, detail and gas turbine fuel of a unit by its number.
UNITS = (("Solar PV", "Fixed", ""), (" wind ", "Onshore", None), ("Coal", "Black", ""), ("Gas turbine", "CCGT", "Natural gas pipeline"), ("Gas Turbine", "", "Diesel"), ("Battery Storage", "", ""), ("Steam", "", "Landfill methane"), ("Run of river", None, ""))


def generation(spark, sf_dir):
    unit = lambda k: F.get(F.array(*[F.lit(u[k]) for u in UNITS]), (F.col("user_id") % 8).cast("int"))
    label = fuel.classify_fuel(unit(0), unit(1), unit(2))
    e = frames.table(spark, sf_dir, "events").select("event_id", "user_id", "ts", (F.col("value") - 10).alias("mw"), F.col("event_type").alias("state"), label.alias("fuel"))
    return fuel.daily_generation(e, "user_id", "ts", "mw", operating_day(F.col("ts")), ["state", "fuel"], "event_id")


@query(f"SELECT day, state, fuel, round(mwh, 6) AS mwh FROM ({GENERATION})")
def f3_daily_generation(spark, sf_dir):
    return rounded(generation(spark, sf_dir))


@query(f"""WITH g AS ({GENERATION}), r AS (SELECT * FROM g WHERE day > (SELECT max(day) FROM g) - 7 AND mwh > 0), b AS (SELECT state, fuel, sum(mwh) AS mwh FROM r GROUP BY 1, 2 UNION ALL SELECT 'ALL', fuel, sum(mwh) FROM r GROUP BY 2)
SELECT state, fuel, round(mwh, 6) AS mwh, round(100 * mwh / sum(mwh) OVER (PARTITION BY state), 6) AS pct FROM b""")
def f5_fuel_mix(spark, sf_dir):
    return rounded(fuel.fuel_mix(generation(spark, sf_dir), "day", "state", "fuel"))


@query(f"""WITH g AS (SELECT day, state, sum(CASE WHEN fuel IN ('Solar', 'Wind', 'Biomass') THEN mwh ELSE 0 END) AS renewable, sum(CASE WHEN fuel IN ('Black coal', 'Gas', 'Liquid Fuel', 'Other') THEN mwh ELSE 0 END) AS fossil FROM ({GENERATION}) WHERE fuel <> 'Battery' AND day > (SELECT max(day) FROM ({GENERATION})) - 92 GROUP BY 1, 2)
SELECT day, state, round(renewable, 6) AS renewable, round(fossil, 6) AS fossil FROM (SELECT * FROM g UNION ALL SELECT day, 'ALL', sum(renewable), sum(fossil) FROM g GROUP BY 1)""")
def f6_renewable_trend(spark, sf_dir):
    return rounded(fuel.renewable_trend(generation(spark, sf_dir), "day", "state", "fuel"))


# Accounts


@query(f"""SELECT month, round(100 * sum(CASE WHEN k <= 1 THEN arr ELSE 0 END) / sum(arr), 6) AS top1_pct, round(100 * sum(CASE WHEN k <= 5 THEN arr ELSE 0 END) / sum(arr), 6) AS top5_pct, round(100 * sum(CASE WHEN k <= 10 THEN arr ELSE 0 END) / sum(arr), 6) AS top10_pct, count(*) AS active
FROM (SELECT *, row_number() OVER (PARTITION BY month ORDER BY arr DESC, account_id) AS k FROM ({frames.TIMELINE}) WHERE arr > 0) GROUP BY 1""")
def a10_concentration_series(spark, sf_dir):
    return rounded(accounts.concentration_series(frames.timeline(spark, sf_dir)))


CHANGE = f"""SELECT account_id, max_by(arr, month) AS end_arr, min_by(arr, month) AS start_arr FROM (SELECT *, row_number() OVER (PARTITION BY account_id ORDER BY month DESC) AS k FROM ({frames.TIMELINE})) WHERE k <= 13 GROUP BY 1"""


@query(f"SELECT account_id, round(end_arr, 6) AS end_arr, round(start_arr, 6) AS start_arr, round(end_arr - start_arr, 6) AS change, round(CASE WHEN start_arr > 0 THEN 100 * (end_arr - start_arr) / start_arr END, 6) AS change_pct FROM ({CHANGE})")
def a4_arr_change(spark, sf_dir):
    return rounded(accounts.arr_change(frames.timeline(spark, sf_dir)))


@query(f"""WITH t AS ({frames.TIMELINE}), m AS (SELECT month, lead(month) OVER (ORDER BY month) AS after FROM (SELECT DISTINCT month FROM t)),
o AS (SELECT account_id, after AS month, arr AS old FROM t JOIN m USING (month) WHERE after IS NOT NULL), n AS (SELECT account_id, month, arr AS new FROM t WHERE month > (SELECT min(month) FROM t)),
j AS (SELECT month, old, new, coalesce(new, 0) - coalesce(old, 0) AS d FROM o FULL JOIN n USING (account_id, month))
SELECT month, round(sum(CASE WHEN old IS NULL THEN d ELSE 0 END), 2) AS new_arr, round(sum(CASE WHEN old IS NOT NULL AND d > 0 THEN d ELSE 0 END), 2) AS expansion, round(sum(CASE WHEN old IS NOT NULL AND d < 0 AND coalesce(new, 0) <> 0 THEN d ELSE 0 END), 2) AS contraction,
    round(sum(CASE WHEN old IS NOT NULL AND d < 0 AND coalesce(new, 0) = 0 THEN d ELSE 0 END), 2) AS churn, round(sum(d), 2) AS net FROM j GROUP BY 1""")
def a12_arr_movement(spark, sf_dir):
    return rounded(accounts.arr_movement(frames.timeline(spark, sf_dir)), 2)


# Countries


@query(f"SELECT country, round(1 / sum(s * s), 4) AS effective_count FROM (SELECT country, value / sum(value) OVER (PARTITION BY country) AS s FROM ({frames.EXPORTS}) WHERE value > 0) GROUP BY 1")
def w4_effective_count(spark, sf_dir):
    return rounded(world.effective_count(frames.exports(spark, sf_dir), "country", "value"), 4)


@query(f"""SELECT country, partner, round(value, 2) AS value, round(share, 5) AS share, rank FROM (SELECT *, value / sum(value) OVER (PARTITION BY country) AS share, row_number() OVER (PARTITION BY country ORDER BY value DESC, partner)::INT AS rank FROM ({frames.EXPORTS})) WHERE rank <= 6""")
def w14_trade_links(spark, sf_dir):
    return world.trade_links(frames.exports(spark, sf_dir), "country", "partner", "value").withColumns({"value": F.round("value", 2), "share": F.round("share", 5)})


INDICATORS = """SELECT c_nationkey AS country, 'balance' AS indicator, 1 AS direction, avg(c_acctbal) AS value FROM customer GROUP BY 1 UNION ALL SELECT s_nationkey, 'suppliers', -1, count(*) FROM supplier GROUP BY 1"""


@query(f"""SELECT country, indicator, round(value, 3) AS value, round(CASE WHEN sp > 1e-12 THEN (value - m) / sp * direction ELSE 0 END, 4) + 0.0 AS z FROM (SELECT *, stddev_pop(value) OVER (PARTITION BY indicator) AS sp, avg(value) OVER (PARTITION BY indicator) AS m FROM ({INDICATORS}))""")
def w11_zscores(spark, sf_dir):
    a = frames.table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("country")).agg(F.avg("c_acctbal").alias("value")).select("country", F.lit("balance").alias("indicator"), F.lit(1).alias("direction"), "value")
    b = frames.table(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("country")).agg(F.count("*").cast("double").alias("value")).select("country", F.lit("suppliers").alias("indicator"), F.lit(-1).alias("direction"), "value")
    z = world.zscores(a.unionByName(b), "indicator", "value", "direction").select("country", "indicator", "value", "z")
    return z.withColumns({"value": F.round("value", 3), "z": F.col("z") + F.lit(0.0)})


# Documents


@query("""SELECT user_id, event_id, place FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC)::INT AS place FROM events WHERE value >= 0 AND event_type IN ('click', 'view', 'purchase', 'error')) WHERE place <= 5""")
def s6_recent_sessions(spark, sf_dir):
    return documents.recent_sessions(frames.table(spark, sf_dir, "events"), "user_id", "ts", "value", "event_type", ["click", "view", "purchase", "error"], "event_id", k=5).select("user_id", "event_id", "place")


@query(r"""SELECT conv_id, turn, n_prose_words, greatest(1, ceil((n_prose_words * 60.0 / 200 + len(regexp_extract_all(t, '!\[|<img')) * 12) / 60))::BIGINT AS minutes FROM (SELECT conv_id, turn, coalesce(text, '') AS t,
    len(regexp_extract_all(array_to_string(list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: NOT starts_with(ltrim(x), '|')), chr(10)), '[^\x20\x09-\x0D]+'))::BIGINT AS n_prose_words FROM conversations)""")
def s7_reading_time(spark, sf_dir):
    return documents.reading_time(frames.table(spark, sf_dir, "conversations"), "text").select("conv_id", "turn", "n_prose_words", "minutes")


#: Columns that queries hand over as text, as readers differ in how they show dates and times.
AS_TEXT = {
    "d2_newest_wins_merge": ("updated_at",), "d8_source_coverage": ("earliest", "latest"), "d10_missing_days": ("day",), "d11_completeness_gate": ("day",), "d12_overlap_check": ("a",),
    "p1_half_hour_rollup": ("interval_end",), "p7_market_aggregate": ("day",), "p12_seasonal_naive": ("day",), "p13_rolling_median": ("day",),
    "g4_day_picture": ("gas_date",), "g6_capacity_in_force": ("gas_date", "effective_date"), "g8_pipeline_utilisation": ("gas_date",), "g10_seasonal_reference": ("gas_date",), "g12_drop_implausible": ("gas_date",),
    "g13_flow_edges": ("gas_date",), "g18_seasonal_percentile": ("gas_date",), "g22_demand_composition": ("gas_date",), "g24_constraint_outlook": ("gas_date",),
    "b6_daily_summary": ("day",), "b7_top_value_share": ("day",), "f3_daily_generation": ("day",), "f6_renewable_trend": ("day",),
    "a10_concentration_series": ("month",), "a12_arr_movement": ("month",),
}


def as_text(name: str, columns: tuple[str, ...]) -> None:
    run = QUERIES[name]
    QUERIES[name] = lambda spark, sf_dir: (df := run(spark, sf_dir)).withColumns({c: df[c].cast("string") for c in columns})
    if name in SQL:
        SQL[name] = f"SELECT * REPLACE ({', '.join(f'CAST({c} AS VARCHAR) AS {c}' for c in columns)}) FROM ({SQL[name]})"


for _name, _columns in AS_TEXT.items():
    as_text(_name, _columns)
