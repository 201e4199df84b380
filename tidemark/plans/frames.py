"""Domain frames made from the driver's tables, once as DataFrames and once as SQL for the comparison."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed value: kinds of facilities by number.
KINDS = ("PROD", "STOR", "PIPE", "DISTR", "POWER", "INDUS", "LNG", "PIPE")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily series: a region per return flag and line status. Prices are summed in whole cents, so that the mean is the
    same double in whatever order rows come."""
    line = table(spark, sf_dir, "lineitem")
    return line.groupBy(F.concat("l_returnflag", "l_linestatus").alias("region"), F.to_date("l_shipdate").alias("day")).agg((F.sum(F.round(F.col("l_extendedprice") * 100).cast("long")).cast("double") / F.count("l_extendedprice") / 10000 - 300).alias("rrp"), F.sum("l_quantity").alias("demand"))


PRICES = "SELECT l_returnflag || l_linestatus AS region, CAST(l_shipdate AS DATE) AS day, sum(round(l_extendedprice * 100)::BIGINT)::DOUBLE / count(l_extendedprice) / 10000 - 300 AS rrp, sum(l_quantity) AS demand FROM lineitem GROUP BY 1, 2"


def flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flows of a facility (supplier) at a place (part modulo 25), one part per measure by the return flag."""
    line = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    kind = F.array(*[F.lit(k) for k in KINDS])
    q, flag, status = F.col("l_quantity"), F.col("l_returnflag"), F.col("l_linestatus")
    zero = F.lit(0.0)
    return line.select(
        F.to_date("l_shipdate").alias("gas_date"), F.col("l_suppkey").alias("facility"), (F.col("l_partkey") % 25).alias("place"), F.get(kind, (F.col("l_suppkey") % 8).cast("int")).alias("kind"),
        F.when(F.col("s_nationkey") % 6 == 5, "").otherwise(F.concat(F.lit("S"), (F.col("s_nationkey") % 6).cast("string"))).alias("state"),
        F.when(flag == "R", q).otherwise(zero).alias("demand"), F.when(flag == "A", q).otherwise(zero).alias("supply"),
        F.when((flag == "N") & (status == "O"), q).otherwise(zero).alias("transfer_in"), F.when((flag == "N") & (status == "F"), q).otherwise(zero).alias("transfer_out"),
    )


FLOWS = f"""SELECT CAST(l_shipdate AS DATE) AS gas_date, l_suppkey AS facility, l_partkey % 25 AS place, (['{"','".join(KINDS)}'])[(l_suppkey % 8)::INT + 1] AS kind,
    CASE WHEN s_nationkey % 6 = 5 THEN '' ELSE 'S' || (s_nationkey % 6) END AS state,
    CASE WHEN l_returnflag = 'R' THEN l_quantity ELSE 0.0 END AS demand, CASE WHEN l_returnflag = 'A' THEN l_quantity ELSE 0.0 END AS supply,
    CASE WHEN l_returnflag = 'N' AND l_linestatus = 'O' THEN l_quantity ELSE 0.0 END AS transfer_in, CASE WHEN l_returnflag = 'N' AND l_linestatus = 'F' THEN l_quantity ELSE 0.0 END AS transfer_out
    FROM lineitem JOIN supplier ON l_suppkey = s_suppkey"""


def ratings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("facility"), F.to_date("o_orderdate").alias("effective_date"), (F.col("o_totalprice") / 1000).alias("capacity"))


RATINGS = "SELECT o_custkey AS facility, CAST(o_orderdate AS DATE) AS effective_date, o_totalprice / 1000 AS capacity FROM orders"


def flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    flag = F.when(F.col("o_orderstatus") == "F", "GREEN").when(F.col("o_orderstatus") == "O", "AMBER").otherwise("RED")
    return table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("facility"), F.to_date("o_orderdate").alias("gas_date"), flag.alias("flag"))


FLAGS = "SELECT o_custkey AS facility, CAST(o_orderdate AS DATE) AS gas_date, CASE o_orderstatus WHEN 'F' THEN 'GREEN' WHEN 'O' THEN 'AMBER' ELSE 'RED' END AS flag FROM orders"


def dispatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Readings of a unit (user), with the price of its region (event type) taken from the reading itself."""
    e = table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("double")
    return e.select("event_id", F.concat(F.lit("U"), F.col("user_id").cast("string")).alias("asset"), F.col("event_type").alias("region"), "ts", F.to_date(F.col("ts") - F.expr("interval 1 microsecond")).alias("day"), (F.col("value") - 50).alias("mw"), (k - 20).alias("rrp"), k.alias("storage"))


DISPATCH = """SELECT event_id, 'U' || user_id AS asset, event_type AS region, ts, CAST(ts - INTERVAL 1 MICROSECOND AS DATE) AS day, value - 50 AS mw,
    CAST(json_extract_string(props, '$.k') AS DOUBLE) - 20 AS rrp, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS storage FROM events"""
VALUED = f"""SELECT *, mw / 12 AS energy_mwh, greatest(0.0, -mw / 12) AS charge_mwh, greatest(0.0, mw / 12) AS discharge_mwh, coalesce(greatest(0.0, -mw / 12) * rrp, 0.0) AS charging_cost,
    coalesce(greatest(0.0, mw / 12) * rrp, 0.0) AS discharge_value, coalesce(mw / 12 * rrp, 0.0) AS energy_value FROM ({DISPATCH})"""


def timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Monthly revenue of an account (customer)."""
    o = table(spark, sf_dir, "orders")
    return o.groupBy(F.col("o_custkey").alias("account_id"), F.trunc(F.to_date("o_orderdate"), "month").alias("month")).agg(F.sum("o_totalprice").alias("arr"))


TIMELINE = "SELECT o_custkey AS account_id, CAST(date_trunc('month', o_orderdate) AS DATE) AS month, sum(o_totalprice) AS arr FROM orders GROUP BY 1, 2"


def exports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Value from a customer's nation to a supplier's nation."""
    line, o, c, s = (table(spark, sf_dir, n) for n in ("lineitem", "orders", "customer", "supplier"))
    joined = line.join(o, F.col("l_orderkey") == F.col("o_orderkey")).join(c, F.col("o_custkey") == F.col("c_custkey")).join(s, F.col("l_suppkey") == F.col("s_suppkey"))
    return joined.groupBy(F.col("c_nationkey").alias("country"), F.col("s_nationkey").alias("partner")).agg(F.sum("l_extendedprice").alias("value"))


EXPORTS = """SELECT c_nationkey AS country, s_nationkey AS partner, sum(l_extendedprice) AS value FROM lineitem JOIN orders ON l_orderkey = o_orderkey
    JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2"""
