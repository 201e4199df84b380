"""More queries with their SQL: registers, supplements, evidence of trends."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import accounts, registers, supplements
from . import frames
from .queries import query, rounded


@query("SELECT (s_nationkey % 8) AS kind, count(*) AS total, count_if(s_acctbal >= 0)::BIGINT AS active FROM supplier GROUP BY 1")
def g1_system_summary(spark, sf_dir):
    s = frames.table(spark, sf_dir, "supplier").withColumn("kind", F.col("s_nationkey") % 8)
    return registers.system_summary(s, "kind", F.col("s_acctbal") >= 0)


URGENT = "SELECT o_custkey AS c_custkey, max(o_orderpriority) AS zone FROM orders WHERE o_orderstatus = 'P' GROUP BY 1"


@query(f"SELECT c_custkey, coalesce(n.zone, c_mktsegment) AS zone, n.zone IS NOT NULL AS updated FROM customer LEFT JOIN ({URGENT}) n USING (c_custkey)")
def d5_annotate_existing(spark, sf_dir):
    points = frames.table(spark, sf_dir, "customer").select("c_custkey", F.col("c_mktsegment").alias("zone"))
    notes = frames.table(spark, sf_dir, "orders").where("o_orderstatus = 'P'").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_orderpriority").alias("zone"))
    return registers.annotate(points, notes, ["c_custkey"], "zone")


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderdate = (SELECT max(o_orderdate) FROM orders))")
def d13_missing_runs(spark, sf_dir):
    runs = frames.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderdate")
    return registers.missing_runs(frames.table(spark, sf_dir, "customer").select("c_custkey"), runs, "c_custkey", "o_orderdate")


REGISTRY = "SELECT 'U' || s_suppkey AS asset, min(s_nationkey) AS label FROM supplier GROUP BY 1 HAVING min(s_acctbal) > -700"
MAPPED = f"SELECT asset, day, mw / 12 AS energy, label FROM ({frames.DISPATCH}) LEFT JOIN ({REGISTRY}) USING (asset) WHERE mw > 0"


def mapped(spark, sf_dir):
    s = frames.table(spark, sf_dir, "supplier")
    registry = s.groupBy(F.concat(F.lit("U"), F.col("s_suppkey").cast("string")).alias("asset")).agg(F.min("s_nationkey").alias("label"), F.min("s_acctbal").alias("_b")).where("_b > -700")
    return registers.mapped_energy(frames.dispatch(spark, sf_dir), registry, "asset", "mw", "label")


@query(f"""SELECT day, round(m, 6) AS mapped_mwh, round(u, 6) AS unknown_mwh, round(m / (m + u), 6) AS coverage, m > 0 AND m / (m + u) >= 0.95 AS passed
FROM (SELECT day, coalesce(sum(energy) FILTER (label IS NOT NULL), 0) AS m, coalesce(sum(energy) FILTER (label IS NULL), 0) AS u FROM ({MAPPED}) GROUP BY 1)""")
def f4_mapping_coverage(spark, sf_dir):
    return rounded(registers.mapping_coverage(mapped(spark, sf_dir), "day", "label"))


@query(f"SELECT asset, round(sum(energy), 6) AS unknown_mwh FROM ({MAPPED}) WHERE label IS NULL GROUP BY 1")
def f4_unknown_units(spark, sf_dir):
    return rounded(registers.unknown_units(mapped(spark, sf_dir), "asset", "label"))


@query("""SELECT c_nationkey AS region, round(t, 4) AS total, n AS assets, round(c, 4) AS covered, round(CASE WHEN t > 0 THEN 100 * c / t END, 4) AS covered_pct FROM (SELECT c_nationkey, sum(abs(c_acctbal)) AS t,
    count_if(c_mktsegment = 'BUILDING')::BIGINT AS n, coalesce(sum(abs(c_acctbal)) FILTER (c_mktsegment = 'BUILDING'), 0) AS c FROM customer GROUP BY 1)""")
def b17_fleet_coverage(spark, sf_dir):
    c = frames.table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("region"), F.abs("c_acctbal").alias("mw"), "c_mktsegment")
    return rounded(registers.fleet_coverage(c.where("c_mktsegment = 'BUILDING'"), c.groupBy("region").agg(F.sum("mw").alias("total")), "region", "mw", "total"), 4)


# Countries: an indicator per market segment of a nation; settled orders are prepared, the others supplement them

SEGMENT_ORDERS = "SELECT c_nationkey AS country, c_mktsegment AS key, o_totalprice AS v, year(o_orderdate) AS y, month(o_orderdate) AS m, o_orderstatus AS status FROM orders JOIN customer ON o_custkey = c_custkey"
PREPARED = f"SELECT country, key, avg(v) AS raw, count(*) AS observations, max(y) AS year FROM ({SEGMENT_ORDERS}) WHERE status = 'F' GROUP BY 1, 2"
LATEST = f"""SELECT country, key, arg_max(v, y * 100 + m) AS raw, 1::BIGINT AS observations, max(y) AS year FROM (SELECT country, key, y, m, avg(v) AS v FROM ({SEGMENT_ORDERS}) WHERE status <> 'F' GROUP BY ALL) GROUP BY 1, 2"""
FILLED = """SELECT coalesce(p.country, s.country) AS country, coalesce(p.key, s.key) AS key, round(CASE WHEN keep THEN p.raw ELSE s.raw END, 3) AS raw, CASE WHEN keep THEN p.observations ELSE s.observations END AS observations, CASE WHEN keep THEN p.year ELSE s.year END AS year, NOT keep AS filled
FROM (SELECT p, s, s.key IS NULL OR (p.key IS NOT NULL AND {stays}) AS keep FROM ({prepared}) p FULL JOIN ({latest}) s ON p.country = s.country AND p.key = s.key)"""


def prepared(spark, sf_dir):
    o, c = frames.table(spark, sf_dir, "orders"), frames.table(spark, sf_dir, "customer")
    both = o.join(c, F.col("o_custkey") == F.col("c_custkey")).select(F.col("c_nationkey").alias("country"), F.col("c_mktsegment").alias("key"), F.col("o_totalprice").alias("v"), F.year("o_orderdate").alias("y"), F.month("o_orderdate").alias("m"), "o_orderstatus")
    settled = both.where("o_orderstatus = 'F'").groupBy("country", "key").agg(F.avg("v").alias("raw"), F.count("*").alias("observations"), F.max("y").alias("year"))
    later = both.where("o_orderstatus <> 'F'").groupBy("country", "key", "y", "m").agg(F.avg("v").alias("v"))
    return settled, supplements.latest_value(later, "y", "m", "v")


BUILDING, MACHINERY = ("(SELECT country, raw, year FROM ({}) WHERE key = '{}')".format(PREPARED, k) for k in ("BUILDING", "MACHINERY"))


@query(f"SELECT country, 'working_age' AS key, round(a.raw * b.raw / 100, 2) AS raw, 1::BIGINT AS observations, least(a.year, b.year) AS year FROM {BUILDING} a JOIN {MACHINERY} b USING (country)")
def w3_working_age(spark, sf_dir):
    return rounded(supplements.working_age(prepared(spark, sf_dir)[0], "BUILDING", "MACHINERY", "working_age"), 2)


@query(f"SELECT country, 'cover' AS key, round(a.raw / b.raw, 6) AS raw, 1::BIGINT AS observations, least(a.year, b.year) AS year FROM {BUILDING} a JOIN {MACHINERY} b USING (country) WHERE b.raw <> 0")
def w5_reserve_cover(spark, sf_dir):
    return rounded(supplements.reserve_cover(prepared(spark, sf_dir)[0], "BUILDING", "MACHINERY", "cover"))


@query(FILLED.format(stays="p.raw > 150000", prepared=PREPARED, latest=LATEST))
def w6_supplement_latest(spark, sf_dir):
    return rounded(supplements.supplement_latest(*prepared(spark, sf_dir), F.col("p.raw") > 150000), 3)


@query(FILLED.format(stays="p.raw > 150000 AND p.year >= s.year", prepared=PREPARED, latest=f"SELECT * FROM ({LATEST}) WHERE year >= 1996"))
def w7_supplement_newer(spark, sf_dir):
    return rounded(supplements.supplement_newer(*prepared(spark, sf_dir), F.col("p.raw") > 150000, 1996), 3)


# Accounts

USED = "SELECT o_custkey AS account_id, CAST(date_trunc('month', o_orderdate) AS DATE) AS month, sum(o_totalprice) AS arr, CASE WHEN count(*) > 1 THEN 100.0 * count_if(o_orderpriority < '3') / count(*) END AS usage FROM orders GROUP BY 1, 2"


@query(f"""WITH r AS (SELECT *, row_number() OVER (PARTITION BY account_id ORDER BY month DESC) AS k FROM ({USED})),
x AS (SELECT *, row_number() OVER (PARTITION BY account_id ORDER BY month) AS a, k AS z, row_number() OVER (PARTITION BY account_id, usage IS NULL ORDER BY month) AS ua, row_number() OVER (PARTITION BY account_id, usage IS NULL ORDER BY month DESC) AS uz FROM r WHERE k <= 13),
e AS (SELECT account_id, count(*) AS n, count(usage) AS usage_n, min(month) AS start_month, max(month) AS end_month, datediff('month', min(month), max(month))::INT AS span_months,
    max(arr) FILTER (a = 1) AS a1, median(arr) FILTER (a <= 3) AS a3, max(arr) FILTER (z = 1) AS z1, median(arr) FILTER (z <= 3) AS z3, max(usage) FILTER (ua = 1) AS ua1, median(usage) FILTER (ua <= 3) AS ua3, max(usage) FILTER (uz = 1) AS uz1, median(usage) FILTER (uz <= 3) AS uz3 FROM x GROUP BY 1),
f AS (SELECT *, span_months >= 12 AND n >= 10 AND usage_n >= 8 AS eligible FROM e WHERE n >= 2 AND usage_n >= 2)
SELECT account_id, n, usage_n, start_month, end_month, span_months, eligible, round(CASE WHEN eligible THEN 100 * (z3 - a3) / a3 ELSE 100 * (z1 - a1) / a1 END, 1) + 0.0 AS arr_change_pct, round(CASE WHEN eligible THEN uz3 - ua3 ELSE uz1 - ua1 END, 1) + 0.0 AS usage_change_pp FROM f""")
def a7_trend_evidence(spark, sf_dir):
    o = frames.table(spark, sf_dir, "orders")
    share = 100.0 * F.count_if(F.col("o_orderpriority") < "3") / F.count("*")
    used = o.groupBy(F.col("o_custkey").alias("account_id"), F.trunc(F.to_date("o_orderdate"), "month").alias("month")).agg(F.sum("o_totalprice").alias("arr"), F.when(F.count("*") > 1, share).alias("usage"))
    return rounded(accounts.trend_evidence(used, "usage"), 1)


@query(f"""WITH a AS (SELECT c_custkey AS account_id, min(c_mktsegment) AS segment, min(c_nationkey)::VARCHAR AS industry FROM customer GROUP BY 1), t AS (SELECT * FROM ({frames.TIMELINE}) JOIN a USING (account_id)),
l AS (SELECT month, 'segment' AS dimension, segment AS g, sum(arr) AS arr FROM t GROUP BY ALL UNION ALL SELECT month, 'industry', industry, sum(arr) FROM t GROUP BY ALL),
k AS (SELECT dimension, g, row_number() OVER (PARTITION BY dimension ORDER BY coalesce(sum(arr) FILTER (month = (SELECT max(month) FROM l)), 0) DESC, g) AS k FROM l GROUP BY 1, 2)
SELECT month, dimension, CASE WHEN k <= 5 THEN g ELSE 'Other' END AS shown, round(sum(arr), 2) AS arr FROM l JOIN k USING (dimension, g) GROUP BY 1, 2, 3""")
def a13_revenue_by_group(spark, sf_dir):
    c = frames.table(spark, sf_dir, "customer")
    book = c.groupBy(F.col("c_custkey").alias("account_id")).agg(F.min("c_mktsegment").alias("segment"), F.min("c_nationkey").alias("industry"))
    return rounded(accounts.revenue_by_group(frames.timeline(spark, sf_dir), book, ["segment", "industry"]), 2)
