"""Ingest, overviews and country work over the driver's tables: text and documents are made from the tables' rows, good
and bad ones, and read back by the jobs; SQL says what must come out."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import parsing
from ..functions.storage import dealt, written
from ..operators import documents, estimates, gas, network, overview, world
from ..sources import ingest, reports
from . import frames
from .queries import as_text, query, rounded

# Scalars and reports


def amounts(spark, sf_dir):
    k, a = F.col("c_custkey"), F.col("c_acctbal").cast("decimal(12,2)").cast("string")
    raw = F.when(k % 6 == 0, F.concat(F.lit("$"), a)).when(k % 6 == 1, F.concat(F.lit(" "), a, F.lit(" "))).when(k % 6 == 2, "n/a").when(k % 6 == 3, "").when(k % 6 == 4, "1,234.5").otherwise(F.get(F.array(*map(F.lit, ("TRUE", "no", "1", "0", "maybe"))), (k % 5).cast("int")))
    return frames.table(spark, sf_dir, "customer").select(k, raw.alias("raw"))


@query("""SELECT c_custkey, n AS amount, greatest(0.0, least(100.0, n)) AS percent, CAST(trunc(n) AS BIGINT) AS whole, b AS flag FROM (SELECT c_custkey, CASE WHEN c_custkey % 6 IN (0, 1) THEN round(c_acctbal, 2) WHEN c_custkey % 6 = 4 THEN 1234.5 WHEN c_custkey % 6 = 5 AND c_custkey % 5 = 2 THEN 1 WHEN c_custkey % 6 = 5 AND c_custkey % 5 = 3 THEN 0 END AS n,
    CASE WHEN c_custkey % 6 = 5 THEN CASE c_custkey % 5 WHEN 0 THEN true WHEN 1 THEN false WHEN 2 THEN true WHEN 3 THEN false END END AS b FROM customer)""".replace("greatest(0.0, least(100.0, n))", "CASE WHEN n IS NOT NULL THEN greatest(0.0, least(100.0, n)) END"))
def i3_lenient_scalars(spark, sf_dir):
    raw = F.col("raw")
    return amounts(spark, sf_dir).select("c_custkey", parsing.safe_float(raw).alias("amount"), parsing.safe_float(raw, 0, 100).alias("percent"), parsing.safe_int(raw).alias("whole"), parsing.safe_bool(raw).alias("flag"))


@query("SELECT o_orderkey, CASE o_orderkey % 8 WHEN 7 THEN NULL ELSE strftime(o_orderdate + CASE WHEN o_orderkey % 8 IN (0, 1, 3) THEN to_minutes((o_custkey % 1440)::BIGINT) ELSE INTERVAL 0 MINUTE END, '%Y-%m-%d %H:%M:%S') END AS at FROM orders")
def i2_timestamps_of_many_forms(spark, sf_dir):
    at, day = F.col("at"), F.date_trunc("day", "o_orderdate")
    form = lambda t, f: F.date_format(t, f)
    forms = (form(at, "yyyy/MM/dd HH:mm:ss"), form(at, "yyyy/MM/dd HH:mm"), form(day, "yyyy/MM/dd"), form(at, "dd MMM yyyy HH:mm:ss"), form(day, "dd MMM yyyy"), form(day, "dd-MM-yyyy"), form(day, "yyyy-MM-dd"), F.lit("2001/13/45"))
    o = frames.table(spark, sf_dir, "orders").withColumn("at", F.col("o_orderdate").cast("timestamp_ntz") + F.make_dt_interval(mins=(F.col("o_custkey") % 1440).cast("int")))
    raw = F.get(F.array(*forms), (F.col("o_orderkey") % 8).cast("int"))
    return o.select("o_orderkey", F.date_format(parsing.multi_format_timestamp(F.concat(F.lit(" "), raw), parsing.DAILY_FORMATS), "yyyy-MM-dd HH:mm:ss").alias("at"))


def facilities(spark, sf_dir):
    k = F.col("s_suppkey")
    text = lambda c: c.cast("string")
    return frames.table(spark, sf_dir, "supplier").select(
        (k + 2).alias("line"), F.when(k % 10 == 7, "x1").otherwise(F.concat(text(k), F.lit(".0"))).alias("facilityid"), F.when(k % 11 == 3, " ").otherwise(F.concat(F.lit(" "), F.col("s_name"))).alias("facilityname"), F.when(k % 2 == 0, "PIPE").otherwise("STOR ").alias("facilitytype"),
        F.when(k % 3 == 0, "ACTIVE").alias("operatingstate"), F.when(k % 4 == 0, "01-02-2020").when(k % 4 == 1, "2020/02/01 10:30").otherwise("?").alias("operatingstatedate"), F.lit("ignored").alias("extra"),
    )


_BAD = "s_suppkey % 10 = 7 OR s_suppkey % 11 = 3"


@query(f"""SELECT s_suppkey AS facility_id, trim(s_name) AS name, CASE WHEN s_suppkey % 2 = 0 THEN 'PIPE' ELSE 'STOR' END AS facility_type, CASE WHEN s_suppkey % 3 = 0 THEN 'ACTIVE' ELSE '' END AS operating_state, CASE WHEN s_suppkey % 4 IN (0, 1) THEN '2020-02-01' END AS operating_state_date FROM supplier WHERE NOT ({_BAD})""")
def i5_parse_reference(spark, sf_dir):
    return reports.parse_reference(facilities(spark, sf_dir), "facilities")[0].select("facility_id", "name", "facility_type", "operating_state", F.col("operating_state_date").cast("string").alias("operating_state_date"))


@query(f"""SELECT count_if(NOT ({_BAD}))::BIGINT AS parsed, count_if({_BAD})::BIGINT AS skipped, (SELECT string_agg('line ' || l || CASE WHEN (l - 2) % 10 = 7 THEN ': no facility_id' ELSE ': no name' END, ';' ORDER BY l) FROM (SELECT s_suppkey + 2 AS l FROM supplier WHERE {_BAD} ORDER BY 1 LIMIT 10)) AS issues FROM supplier""")
def i4_import_summary(spark, sf_dir):
    return ingest.import_summary(*reports.parse_reference(facilities(spark, sf_dir), "facilities")).withColumn("issues", F.array_join("issues", ";"))


def flow_text(spark, sf_dir):
    q, k = F.col("l_quantity").cast("string"), F.col("l_partkey")
    return frames.table(spark, sf_dir, "lineitem").select(
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("line"), F.when(k % 13 == 0, "soon").otherwise(F.date_format("l_shipdate", "yyyy/MM/dd")).alias("gasdate"), F.col("l_suppkey").cast("string").alias("facilityid"), F.when(k % 17 == 0, "").otherwise(k.cast("string")).alias("locationid"),
        F.when(k % 2 == 0, q).otherwise("").alias("demand"), F.when(k % 3 == 0, q).otherwise("-").alias("supply"), F.when(k % 5 == 0, q).alias("heldinstorage"), F.concat(F.col("l_linestatus"), F.lit(" ")).alias("state"),
    )


@query("""SELECT l_orderkey * 8 + l_linenumber AS line, strftime(l_shipdate, '%Y-%m-%d') AS gas_date, l_suppkey AS facility_id, l_partkey AS location_id, CASE WHEN l_partkey % 2 = 0 THEN l_quantity ELSE 0 END AS demand_tj, CASE WHEN l_partkey % 3 = 0 THEN l_quantity ELSE 0 END AS supply_tj, CASE WHEN l_partkey % 5 = 0 THEN l_quantity END AS held_in_storage_tj, l_linestatus AS state
FROM lineitem WHERE l_partkey % 13 <> 0 AND l_partkey % 17 <> 0""")
def i6_parse_flows(spark, sf_dir):
    df = reports.parse_flows(flow_text(spark, sf_dir))[0]
    return df.select("line", F.col("gas_date").cast("string").alias("gas_date"), "facility_id", "location_id", "demand_tj", "supply_tj", "held_in_storage_tj", "state")


@query("SELECT o_orderkey AS line, CASE WHEN o_orderkey % 9 = 0 THEN 'no gas_date' ELSE 'no flag' END AS reject_reason FROM orders WHERE o_orderkey % 9 = 0 OR o_orderkey % 7 = 0")
def i6_adequacy_rejects(spark, sf_dir):
    k = F.col("o_orderkey")
    raw = frames.table(spark, sf_dir, "orders").select(k.alias("line"), F.when(k % 9 == 0, "").otherwise(F.concat(F.date_format("o_orderdate", "yyyy/MM/dd"), F.lit(" 15:15"))).alias("gasdate"), F.col("o_custkey").cast("string").alias("facilityid"), F.when(k % 7 != 0, F.lit("amber")).alias("flag"))
    return reports.parse_adequacy(raw)[1]


# Files of tagged records: a file per order, with a second header in some

_SHORT, _LONG = "SETTLEMENTDATE,DUID,INTERVENTION,INITIALMW,TOTALCLEARED,RAISE6SEC", "DUID,INTERVENTION,SETTLEMENTDATE,TOTALCLEARED,INITIALMW"


def tagged(spark, sf_dir):
    line = frames.table(spark, sf_dir, "lineitem")
    file, k = F.concat(F.lit("o"), F.lpad(F.col("l_orderkey").cast("string"), 12, "0")), F.col("l_partkey")
    at = F.date_format(F.date_trunc("day", "l_shipdate").cast("timestamp_ntz") + F.make_dt_interval(mins=(k % 288 * 5).cast("int")), "yyyy/MM/dd HH:mm:ss")
    unit, held, mw, target = F.concat(F.lit("U"), F.col("l_suppkey").cast("string")), F.when(k % 11 == 0, "1").otherwise("0"), F.col("l_quantity").cast("string"), F.when(k % 7 != 0, k.cast("string")).otherwise("")
    second = (F.col("l_orderkey") % 3 == 0) & (F.col("l_linenumber") >= 3)
    body = F.when(second, F.concat_ws(",", F.lit("D,DISPATCH,UNIT_SOLUTION,2"), unit, held, F.concat(F.lit('"'), at, F.lit('"')), target, mw)).otherwise(F.concat_ws(",", F.lit("D,DISPATCH,UNIT_SOLUTION,1"), at, unit, held, mw, target))
    data = line.select(file.alias("file"), (F.col("l_linenumber") * 10).alias("line"), body.alias("value"))
    other = line.where("l_linenumber = 1").select(file.alias("file"), F.lit(15).alias("line"), F.lit("D,DISPATCH,PRICE,1,x,y").alias("value"))
    heads = line.select("l_orderkey").distinct().select(file.alias("file"), (F.col("l_orderkey") % 3 == 0).alias("_two")).select("file", F.explode(F.when(F.col("_two"), F.array(F.struct(F.lit(1).alias("line"), F.lit(f"I,DISPATCH,UNIT_SOLUTION,1,{_SHORT}").alias("value")), F.struct(F.lit(25).alias("line"), F.lit(f"I,DISPATCH,UNIT_SOLUTION,2,{_LONG}").alias("value")))).otherwise(F.array(F.struct(F.lit(1).alias("line"), F.lit(f"I,DISPATCH,UNIT_SOLUTION,1,{_SHORT}").alias("value"))))).alias("h")).select("file", "h.*")
    return data.unionByName(other).unionByName(heads)


@query("SELECT 'o' || lpad(l_orderkey::VARCHAR, 12, '0') AS file, l_linenumber * 10 AS line, 'U' || l_suppkey AS unit, CASE WHEN l_partkey % 7 <> 0 THEN l_partkey::VARCHAR ELSE '' END AS target, CASE WHEN l_orderkey % 3 = 0 AND l_linenumber >= 3 THEN NULL ELSE '' END AS raise FROM lineitem")
def i7_read_record_tagged(spark, sf_dir):
    rows = reports.read_record_tagged(tagged(spark, sf_dir), "DISPATCH", "UNIT_SOLUTION")
    of = lambda c: F.try_element_at("fields", F.lit(c))
    return rows.select("file", "line", of("DUID").alias("unit"), of("TOTALCLEARED").alias("target"), of("RAISE6SEC").alias("raise"))


_LASTS = """SELECT *, row_number() OVER (PARTITION BY l_suppkey, moment ORDER BY lpad(l_orderkey::VARCHAR, 12, '0') DESC, l_linenumber DESC) AS k FROM (SELECT *, date_trunc('day', l_shipdate)::TIMESTAMP + to_minutes((l_partkey % 288 * 5)::BIGINT) AS moment FROM lineitem)"""


@query(f"SELECT 'U' || l_suppkey AS id, moment AS ts, l_quantity AS initial_mw, CASE WHEN l_partkey % 7 <> 0 THEN l_partkey END::DOUBLE AS dispatch_target_mw, 0.0::DOUBLE AS raise_6s FROM ({_LASTS.replace('FROM lineitem', 'FROM lineitem WHERE l_partkey % 11 <> 0')}) WHERE k = 1")
def i8_dispatch_records(spark, sf_dir):
    rows = reports.read_record_tagged(tagged(spark, sf_dir), "DISPATCH", "UNIT_SOLUTION")
    return reports.dispatch_records(rows).select("id", "ts", "initial_mw", "dispatch_target_mw", F.element_at("fcas_enablement_mw", "raise_6s").alias("raise_6s"))


# Documents of services


@query("SELECT event_type AS region, date_trunc('hour', ts)::TIMESTAMP AS time, max(value) AS temperature_c FROM events WHERE event_id % 10 <> 0 GROUP BY 1, 2")
def i9_flatten_hourly_json(spark, sf_dir):
    hourly = frames.table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("region"), F.date_trunc("hour", "ts").alias("t")).agg(F.max(F.when(F.col("event_id") % 10 != 0, F.col("value"))).alias("v"))
    lists = hourly.groupBy("region", F.to_date("t").alias("_d")).agg(F.collect_list(F.struct(F.date_format("t", "yyyy-MM-dd'T'HH:mm").alias("t"), "v")).alias("x"))
    number = lambda x: F.coalesce(x["v"].cast("string"), F.lit("null"))
    payload = F.concat(F.lit('{"hourly": {"time": ["'), F.array_join(F.transform("x", lambda x: x["t"]), '","'), F.lit('"], "temperature_2m": ['), F.array_join(F.transform("x", number), ","), F.lit("]}}"))
    return ingest.flatten_hourly_json(lists.select("region", payload.alias("payload")), "payload", ["region"])


def indicator_pages(spark, sf_dir):
    n = frames.table(spark, sf_dir, "nation")
    code = lambda c: F.concat(F.lit("N"), F.lpad(c.cast("string"), 2, "0"))
    page = lambda rows: F.concat(F.lit('[{"page": 1, "note": "[x]"}, '), F.to_json(rows), F.lit("]"))
    region = F.struct(F.when(F.col("n_nationkey") % 10 == 9, "NA").otherwise("R").alias("id"), F.concat(F.lit("Region "), F.col("n_regionkey").cast("string")).alias("value"))
    countries = n.groupBy().agg(page(F.collect_list(F.struct(code(F.col("n_nationkey")).alias("id"), F.col("n_name").alias("name"), region.alias("region")))).alias("payload"))
    sums = frames.table(spark, sf_dir, "orders").join(frames.table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey")).groupBy("c_nationkey", F.year("o_orderdate").alias("y")).agg(F.count("*").cast("double").alias("n"))
    rows = F.struct(F.struct(F.lit("orders").alias("id")).alias("indicator"), code(F.col("c_nationkey")).alias("countryiso3code"), F.col("y").cast("string").alias("date"), F.when(F.col("c_nationkey") % 7 != F.col("y") % 7, F.col("n")).alias("value"))
    return countries, sums.groupBy("c_nationkey").agg(page(F.collect_list(rows)).alias("payload"))


@query("SELECT 'N' || lpad(c_nationkey::VARCHAR, 2, '0') AS country, 'orders' AS indicator, year(o_orderdate)::INT AS year, count(*)::DOUBLE AS value FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_nationkey % 10 <> 9 AND c_nationkey % 7 <> year(o_orderdate) % 7 GROUP BY 1, 3")
def i10_flatten_indicator_json(spark, sf_dir):
    return ingest.flatten_indicator_json(*indicator_pages(spark, sf_dir))[1]


def trade_document(spark, sf_dir):
    n, x = frames.table(spark, sf_dir, "nation"), frames.exports(spark, sf_dir)
    places = n.groupBy().agg(F.collect_list(F.struct(F.concat(F.lit("c"), F.col("n_nationkey")).alias("countryId"), F.when(F.col("n_nationkey") % 8 != 5, F.concat(F.lit("N"), F.col("n_nationkey"))).alias("iso3Code"), (F.col("n_nationkey") == 3).alias("formerCountry"))).alias("locationCountry"))
    sold = x.groupBy().agg(F.collect_list(F.struct(F.concat(F.lit("c"), F.col("country")).alias("countryId"), F.concat(F.lit("c"), F.col("partner")).alias("partnerCountryId"), F.when(F.col("partner") != 1, F.round("value", 2)).otherwise(0.0).alias("exportValue"))).alias("countryCountryYear"))
    goods = n.groupBy().agg(F.collect_list(F.struct(F.concat(F.lit("p"), F.col("n_nationkey")).alias("productId"), (F.col("n_nationkey") + 20).cast("string").alias("code"))).alias("productHs92"), F.collect_list(F.struct(F.concat(F.lit("c"), F.col("n_nationkey")).alias("countryId"), F.concat(F.lit("p"), F.col("n_nationkey")).alias("productId"), (F.col("n_nationkey") * 10.0).alias("exportValue"))).alias("countryProductYear"))
    return places.crossJoin(sold).crossJoin(goods).select(F.to_json(F.struct(F.struct("locationCountry", "countryCountryYear", "productHs92", "countryProductYear").alias("data"))).alias("payload"))


@query(f"SELECT 'N' || country AS country, CASE WHEN partner % 8 <> 5 THEN 'N' || partner END AS partner, round(value, 2) AS value, partner = 3 AS former FROM ({frames.EXPORTS}) WHERE country % 8 <> 5 AND partner <> 1")
def i11_flatten_trade_json(spark, sf_dir):
    return ingest.flatten_trade_json(trade_document(spark, sf_dir))[0]


@query("SELECT 'N' || n_nationkey AS country, 'p' || n_nationkey AS product, n_nationkey * 10.0::DOUBLE AS value, (n_nationkey + 20) IN (25, 26, 27, 44, 71) AS resource FROM nation WHERE n_nationkey > 0 AND n_nationkey % 8 <> 5")
def i11_flatten_trade_products(spark, sf_dir):
    return ingest.flatten_trade_json(trade_document(spark, sf_dir))[1]


def register_document(spark, sf_dir):
    k = F.col("s_suppkey")
    filled = lambda names: [F.lit("x").alias(c) for c in names]
    unit = F.struct(
        F.concat(F.lit("D"), k.cast("string")).alias("duid"), *filled(("direction_model", "aemo_generation_info_unit_id", "connection_point_id", "notes")), F.when(k % 13 != 1, F.lit("unit")).alias("unit_name"), F.when(k % 11 == 2, "2024-13-01").otherwise("2024-02-01").alias("effective_from"), F.when(k % 7 == 3, "2023-01-01").when(k % 2 == 0, "2025-01-01").alias("effective_to"),
        F.when(k % 5 == 4, F.lit("-1")).otherwise((k % 50 + 1).cast("string")).alias("power_capacity_mw"), (k % 9 + 1).cast("string").alias("storage_capacity_mwh"),
    )
    # documents of up to forty registrations, four to an asset
    asset = frames.table(spark, sf_dir, "supplier").groupBy(F.floor(k / 40).alias("doc"), F.floor(k / 4).alias("a")).agg(F.collect_list(unit).alias("registrations"))
    one = F.struct(F.concat(F.lit("a"), F.col("a").cast("string")).alias("slug"), *filled(("name", "region", "owner", "custodian", "aemo_survey_id", "commitment_status")), F.lit("true").alias("is_spike_cohort"), "registrations")
    return asset.groupBy("doc").agg(F.to_json(F.struct(F.collect_list(one).alias("assets"))).alias("payload"))


_PROBLEM = "CASE WHEN s_suppkey % 13 = 1 THEN 'unit_name is missing' WHEN s_suppkey % 11 = 2 THEN 'effective_from is no date' WHEN s_suppkey % 7 = 3 THEN 'effective_to is before effective_from' WHEN s_suppkey % 5 = 4 THEN 'power_capacity_mw is no number above zero' END"


@query(f"SELECT 'a' || s_suppkey // 4 AS slug, 'D' || s_suppkey AS duid, {_PROBLEM} AS problem FROM supplier WHERE {_PROBLEM} IS NOT NULL")
def i12_registry_problems(spark, sf_dir):
    return ingest.registry_flatten(register_document(spark, sf_dir))[1].select("slug", "duid", "problem")


@query(f"SELECT 'a' || s_suppkey // 4 AS slug, 'D' || s_suppkey AS duid, '2024-02-01' AS effective_from, CASE WHEN s_suppkey % 2 = 0 THEN '2025-01-01' END AS effective_to, (s_suppkey % 50 + 1)::DOUBLE AS power_capacity_mw, (s_suppkey % 9 + 1)::DOUBLE AS storage_capacity_mwh FROM supplier WHERE {_PROBLEM} IS NULL")
def i12_registry_flatten(spark, sf_dir):
    return ingest.registry_flatten(register_document(spark, sf_dir))[0].select("slug", "duid", *[F.col(c).cast("string").alias(c) for c in ("effective_from", "effective_to")], *[F.col(c).cast("double").alias(c) for c in ("power_capacity_mw", "storage_capacity_mwh")])


# Accounts from text


def snapshot_text(spark, sf_dir):
    k = F.col("c_custkey")
    return frames.table(spark, sf_dir, "customer").select(
        (k + 2).alias("line"), F.when(k % 19 == 0, "").otherwise(F.concat(F.lit("A"), (k - k % 2).cast("string"))).alias("account_id"), F.col("c_name").alias("account_name"), F.when(k % 3 == 0, "SMB").when(k % 3 == 1, "Enterprise ").otherwise("Tiny").alias("segment"), F.when(k % 4 == 0, "Healthcare").otherwise("Mining").alias("industry"), F.lit(None).cast("string").alias("csm_owner"),
        F.lit("2019-05-06").alias("customer_since"), F.when(k % 23 == 5, "06/05/2019").otherwise("2019-05-06").alias("contract_start"), F.lit("2026-01-01").alias("renewal_date"), F.when(k % 2 == 0, "yes").otherwise("FALSE").alias("auto_renew"), F.when(k % 5 == 1, "").otherwise(F.concat(F.lit("$"), F.col("c_acctbal").cast("decimal(12,2)").cast("string"))).alias("current_arr"),
        F.when(k % 10 != 1, "1,000.5").alias("avg_monthly_revenue_6mo"), F.lit("140").alias("seat_utilisation_pct"), F.lit("12.9").alias("tickets_12mo"),
    )


_KEPT = "c_custkey % 19 <> 0 AND c_custkey % 23 <> 5 AND NOT (c_custkey % 5 = 1 AND c_custkey % 10 = 1)"


@query(f"""SELECT account_id, segment, industry, auto_renew, current_arr, 100.0::DOUBLE AS seat_utilisation_pct, 12::BIGINT AS tickets_12mo, line FROM (SELECT c_custkey + 2 AS line, 'A' || (c_custkey - c_custkey % 2) AS account_id, CASE c_custkey % 3 WHEN 0 THEN 'SMB' WHEN 1 THEN 'Enterprise' ELSE 'Mid-Market' END AS segment, CASE WHEN c_custkey % 4 = 0 THEN 'Healthcare' ELSE 'Other' END AS industry, c_custkey % 2 = 0 AS auto_renew,
    CASE WHEN c_custkey % 5 = 1 THEN 12006.0::DOUBLE ELSE greatest(0.0::DOUBLE, round(c_acctbal, 2)) END AS current_arr, row_number() OVER (PARTITION BY c_custkey - c_custkey % 2 ORDER BY c_custkey DESC) AS k FROM customer WHERE {_KEPT}) WHERE k = 1""")
def a1_parse_snapshot(spark, sf_dir):
    return reports.parse_snapshot(snapshot_text(spark, sf_dir))[0].select("account_id", "segment", "industry", "auto_renew", "current_arr", "seat_utilisation_pct", "tickets_12mo", "line")


@query("""SELECT o_orderkey AS line, CASE WHEN o_orderkey % 10 = 3 THEN 'no month' WHEN o_custkey % 4 = 0 THEN 'orphan' ELSE 'kept' END AS kind, CASE WHEN o_orderkey % 10 <> 3 THEN o_custkey::VARCHAR END AS account_id,
    CASE WHEN o_orderkey % 10 <> 3 THEN strftime(o_orderdate, '%Y-%m-01') END AS month, CASE WHEN o_orderkey % 10 <> 3 THEN round(CASE WHEN o_orderkey % 2 = 0 THEN o_totalprice ELSE o_totalprice * 12 END, 2) END AS arr FROM orders""")
def a2_parse_timeline(spark, sf_dir):
    k, money = F.col("o_orderkey"), F.col("o_totalprice").cast("decimal(14,2)").cast("string")
    raw = frames.table(spark, sf_dir, "orders").select(k.alias("line"), F.col("o_custkey").cast("string").alias("account_id"), F.when(k % 10 == 3, "2019-13").otherwise(F.date_format("o_orderdate", "yyyy-MM")).alias("month"), F.when(k % 2 == 0, money).alias("arr"), F.when(k % 2 == 1, money).alias("mrr"))
    accounts = frames.table(spark, sf_dir, "customer").where("c_custkey % 4 <> 0").select(F.col("c_custkey").cast("string").alias("account_id"))
    kept, bad, orphans = reports.parse_timeline(raw, accounts)
    rows = lambda df, kind: df.select("line", F.lit(kind).alias("kind"), "account_id", F.col("month").cast("string").alias("month"), F.round("arr", 2).alias("arr"))
    none = F.lit(None).cast("string")
    lost = bad.select("line", F.col("reject_reason").alias("kind"), none.alias("account_id"), none.alias("month"), F.lit(None).cast("double").alias("arr"))
    return rows(kept, "kept").unionByName(rows(orphans, "orphan")).unionByName(lost)


# The network at a glance

HELD = f"SELECT facility, gas_date, sum(supply) AS held FROM ({frames.FLOWS}) WHERE kind = 'STOR' GROUP BY 1, 2"


def held(spark, sf_dir):
    return frames.flows(spark, sf_dir).where("kind = 'STOR'").groupBy("facility", "gas_date").agg(F.sum("supply").alias("held"))


@query("SELECT (SELECT count(*) FROM supplier) AS facilities, (SELECT count(*) FROM supplier WHERE s_acctbal >= 0) AS active, (SELECT count(*) FROM nation) AS locations, (SELECT count(*) FROM nation WHERE n_regionkey = 1) AS hubs, (SELECT count(*) FROM customer WHERE c_mktsegment <> 'BUILDING') AS mapped_zones")
def g1_system_counts(spark, sf_dir):
    s, n, c = (frames.table(spark, sf_dir, t) for t in ("supplier", "nation", "customer"))
    return overview.system_counts({"facilities": (s, None), "active": (s, F.col("s_acctbal") >= 0), "locations": (n, None), "hubs": (n, F.col("n_regionkey") == 1), "mapped_zones": (c, F.col("c_mktsegment") != "BUILDING")})


@query(f"""WITH f AS (SELECT facility, max(effective_date) AS d FROM ({frames.RATINGS}) WHERE effective_date <= DATE '1996-06-30' GROUP BY 1), l AS (SELECT facility, count(*) AS legs, max(capacity) AS c, max(effective_date) AS e FROM ({frames.RATINGS}) JOIN f USING (facility) WHERE effective_date = d GROUP BY 1)
SELECT s_suppkey AS facility, coalesce(legs, 0) AS legs, c AS max_capacity, e AS effective_date, coalesce(n, 0) AS connection_points, coalesce(legs, 0) > 1 AS reverse_haul FROM supplier LEFT JOIN l ON s_suppkey = l.facility LEFT JOIN (SELECT l_suppkey, count(DISTINCT l_partkey) AS n FROM lineitem GROUP BY 1) p USING (l_suppkey)""".replace("LEFT JOIN (SELECT l_suppkey, count(DISTINCT l_partkey) AS n FROM lineitem GROUP BY 1) p USING (l_suppkey)", "LEFT JOIN (SELECT l_suppkey, count(DISTINCT l_partkey) AS n FROM lineitem GROUP BY 1) p ON s_suppkey = p.l_suppkey"))
def g2_pipeline_registry(spark, sf_dir):
    pipes = frames.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("facility"))
    at = pipes.withColumn("gas_date", F.lit("1996-06-30").cast("date"))
    rated = frames.ratings(spark, sf_dir)
    in_force = gas.capacity_in_force(rated, at, "facility", "effective_date", "capacity", "gas_date")
    legs = network.legs_in_force(rated, in_force, "facility", "gas_date", "effective_date", "capacity").withColumnRenamed("leg_capacity", "capacity")
    points = frames.table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("facility"), "l_partkey").distinct()
    return overview.pipeline_registry(pipes, legs, points)


@query(f"SELECT facility, gas_date, coalesce(sum(supply), 0) AS held, sum(demand) AS injected, sum(supply) AS withdrawn, sum(demand) - sum(supply) AS net FROM ({frames.FLOWS}) WHERE kind = 'STOR' GROUP BY 1, 2")
def g4_storage_rows(spark, sf_dir):
    return overview.storage_rows(frames.flows(spark, sf_dir), "facility", "gas_date", "kind", "supply").select("facility", "gas_date", "held", "injected", "withdrawn", "net")


@query(f"SELECT gas_date, count(*) AS rows, count(DISTINCT facility) AS reporting_facilities, coalesce(sum(demand) FILTER (kind IN ('DISTR', 'POWER', 'INDUS', 'LNG')), 0) AS end_use_total, coalesce(sum(demand) FILTER (kind = 'PIPE'), 0) AS pipeline_receipts, coalesce(sum(supply) FILTER (kind IN ('PROD', 'STOR')), 0) AS supply_total FROM ({frames.FLOWS}) GROUP BY 1")
def g4_day_totals(spark, sf_dir):
    return overview.day_totals(frames.flows(spark, sf_dir), "gas_date", "kind", "facility")


@query(f"SELECT gas_date, sum(held) AS held, count(DISTINCT facility) AS n_reporting FROM ({HELD}) GROUP BY 1")
def g9_storage_totals(spark, sf_dir):
    return gas.storage_totals(held(spark, sf_dir), "gas_date", "held", "facility")


@query(f"""WITH h AS ({HELD}), z AS (SELECT max(gas_date) AS z FROM h) SELECT facility, min(gas_date) AS first_day, max(gas_date) AS last_day, max(held) FILTER (gas_date = z) AS latest, median(held) FILTER (month(gas_date) = month(z) AND day(gas_date) = day(z) AND year(gas_date) <> year(z)) AS reference_latest, max(held) FILTER (gas_date = z) IS NULL AS absent FROM h, z GROUP BY 1""")
def g11_facility_storage_latest(spark, sf_dir):
    return overview.facility_storage_latest(held(spark, sf_dir), "facility", "gas_date", "held")


@query(f"SELECT max(gas_date) AS day FROM ({frames.FLOWS})")
def g3_latest_day(spark, sf_dir):
    return network.latest_day(frames.flows(spark, sf_dir), "gas_date").toDF("day")


_AT = "DATE '1998-03-10'"
_SERIES = {"lng": f"SELECT gas_date AS day, sum(demand) AS value FROM ({frames.FLOWS}) WHERE kind = 'LNG' GROUP BY 1", "power": f"SELECT gas_date AS day, sum(demand) AS value FROM ({frames.FLOWS}) WHERE kind = 'POWER' GROUP BY 1", "storage": f"SELECT gas_date AS day, sum(held) AS value FROM ({HELD}) WHERE facility IN (SELECT facility FROM ({HELD}) WHERE gas_date = {_AT}) GROUP BY 1 HAVING count(*) = (SELECT count(*) FROM ({HELD}) WHERE gas_date = {_AT})"}
_TILES = " UNION ALL ".join(f"""SELECT '{name}' AS tile, n.value, n.value - b.value AS change, CASE WHEN b.value <> 0 THEN 100 * (n.value - b.value) / b.value END AS change_pct, (SELECT 100 * sum(CASE WHEN s.value < n.value THEN 1.0 WHEN s.value = n.value THEN 0.5 ELSE 0 END)::DOUBLE / nullif(count(*), 0) FROM ({sql}) s
    WHERE EXISTS (SELECT 1 FROM range(1990, 2010) y(y) WHERE y <> 1998 AND s.day BETWEEN make_date(y::INT, 3, 10) - 7 AND make_date(y::INT, 3, 10) + 7)) AS percentile FROM ({sql}) n LEFT JOIN ({sql}) b ON b.day = {_AT} - 7 WHERE n.day = {_AT}""" for name, sql in _SERIES.items())


@query(f"SELECT tile, round(value, 6) AS value, round(change, 6) + 0.0 AS change, round(change_pct, 4) + 0.0 AS change_pct, CASE WHEN change > 0 THEN 'up' WHEN change < 0 THEN 'down' ELSE 'flat' END AS direction, round(percentile, 4) AS percentile FROM ({_TILES})")
def g19_headline_tiles(spark, sf_dir):
    at, f = F.lit("1998-03-10").cast("date"), frames.flows(spark, sf_dir)
    of = lambda kind: f.where(F.col("kind") == kind).groupBy(F.col("gas_date").alias("day")).agg(F.sum("demand").alias("value"))
    tiles = overview.headline_tiles({"lng": of("LNG"), "power": of("POWER"), "storage": overview.steady_storage(held(spark, sf_dir), "facility", "gas_date", "held", at)}, at)
    return tiles.select("tile", F.round("value", 6).alias("value"), (F.round("change", 6) + F.lit(0.0)).alias("change"), (F.round("change_pct", 4) + F.lit(0.0)).alias("change_pct"), "direction", F.round("percentile", 4).alias("percentile"))


# Countries

INDICATORS = ("balance", "orders", "suppliers", "spend")
OBS = """SELECT c_nationkey AS country, 'balance' AS indicator, 2010 + c_custkey % 15 AS year, sum(round(c_acctbal * 100)::BIGINT)::DOUBLE / 100 AS value FROM customer WHERE c_nationkey % 6 <> 1 GROUP BY 1, 3 UNION ALL SELECT c_nationkey, 'orders', year(o_orderdate) + 22, count(*)::DOUBLE FROM orders JOIN customer ON o_custkey = c_custkey WHERE NOT (c_nationkey % 5 = 2 AND year(o_orderdate) + 22 >= 2015) GROUP BY 1, 3
    UNION ALL SELECT s_nationkey, 'suppliers', 2014 + s_suppkey % 9, count(*)::DOUBLE FROM supplier GROUP BY 1, 3"""
RULES = (("balance", "average"), ("orders", "latest"), ("suppliers", "average"))


def observations(spark, sf_dir):
    c, o, s = (frames.table(spark, sf_dir, t) for t in ("customer", "orders", "supplier"))
    a = c.where("c_nationkey % 6 <> 1").groupBy(F.col("c_nationkey").alias("country"), (2010 + F.col("c_custkey") % 15).cast("int").alias("year")).agg((F.sum(F.round(F.col("c_acctbal") * 100).cast("long")).cast("double") / 100).alias("value")).withColumn("indicator", F.lit("balance"))
    b = o.join(c, F.col("o_custkey") == F.col("c_custkey")).withColumn("year", (F.year("o_orderdate") + 22).cast("int")).where(~((F.col("c_nationkey") % 5 == 2) & (F.col("year") >= 2015))).groupBy(F.col("c_nationkey").alias("country"), "year").agg(F.count("*").cast("double").alias("value")).withColumn("indicator", F.lit("orders"))
    d = s.groupBy(F.col("s_nationkey").alias("country"), (2014 + F.col("s_suppkey") % 9).cast("int").alias("year")).agg(F.count("*").cast("double").alias("value")).withColumn("indicator", F.lit("suppliers"))
    return a.unionByName(b).unionByName(d).select("country", "indicator", "year", "value")


PREPARED = f"""SELECT country, indicator, CASE WHEN aggregation = 'average' THEN m ELSE l END AS raw, CASE WHEN aggregation = 'average' THEN n ELSE 1 END AS observations, CASE WHEN aggregation = 'latest' THEN b END AS year, CASE WHEN aggregation = 'average' THEN a END AS start_year, CASE WHEN aggregation = 'average' THEN b END AS end_year
    FROM (SELECT country, indicator, avg(value) AS m, count(*) AS n, min(year) AS a, max(year) AS b, arg_max(value, year) AS l FROM ({OBS}) WHERE year >= 2015 GROUP BY 1, 2) JOIN (VALUES {", ".join(map(str, RULES))}) r(indicator, aggregation) USING (indicator) WHERE aggregation = 'latest' OR n >= 5"""


def prepared(spark, sf_dir):
    return estimates.prepare_by_rule(observations(spark, sf_dir), spark.createDataFrame(list(RULES), "indicator string, aggregation string"))


@query(f"SELECT * REPLACE (round(raw, 6) AS raw) FROM ({PREPARED})")
def w1_prepare_indicators(spark, sf_dir):
    return rounded(prepared(spark, sf_dir))


_HEADS = "SELECT n_nationkey AS country, n_regionkey AS region, n_nationkey AS place, CASE WHEN n_nationkey % 4 <> 3 THEN (n_nationkey * 17 % 23)::DOUBLE END AS per_head FROM nation"
ESTIMATES = f"""WITH n AS ({_HEADS}), v AS (SELECT country, indicator, raw FROM ({PREPARED})), o AS ({OBS}), lack AS (SELECT n.*, i.indicator FROM n, (VALUES ('balance'), ('orders'), ('suppliers')) i(indicator) WHERE NOT EXISTS (SELECT 1 FROM v WHERE v.country = n.country AND v.indicator = i.indicator)),
near AS (SELECT *, count(*) OVER (PARTITION BY country, indicator) AS c, row_number() OVER (PARTITION BY country, indicator ORDER BY far, peer_place) AS k FROM (SELECT l.country, l.indicator, p.country AS peer, v.raw AS peer_raw, p.place AS peer_place, CASE WHEN l.per_head IS NOT NULL THEN abs(coalesce(p.per_head, l.per_head) - l.per_head) ELSE 0 END AS far FROM lack l JOIN n p ON p.region = l.region JOIN v ON v.country = p.country AND v.indicator = l.indicator)),
used AS (SELECT * FROM near WHERE c >= 3 AND k <= 5), old AS (SELECT country, indicator, max(year) AS y, arg_max(value, year) AS base FROM o GROUP BY 1, 2),
j AS (SELECT u.country, u.indicator, avg(peer_raw) AS now, avg(t.value) AS was, max(base) AS base, max(y) AS y, string_agg(peer::VARCHAR, ',' ORDER BY k) AS basis FROM used u LEFT JOIN old USING (country, indicator) LEFT JOIN o t ON t.country = u.peer AND t.indicator = u.indicator AND t.year = old.y GROUP BY 1, 2)
SELECT country, indicator, round(CASE WHEN base IS NOT NULL AND was <> 0 THEN base * now / was ELSE now END, 4) AS raw, basis, y AS baseline_year, coalesce(base IS NOT NULL AND was <> 0, false) AS projected FROM j"""


@query(ESTIMATES)
def w9_estimate_missing(spark, sf_dir):
    n = frames.table(spark, sf_dir, "nation")
    k = F.col("n_nationkey")
    countries = n.select(k.alias("country"), F.col("n_regionkey").alias("region"), k.alias("place"))
    sizes = n.select(k.alias("country"), F.when(k % 4 != 3, (k * 17 % 23).cast("double")).alias("per_head"))
    df = estimates.estimate_missing(prepared(spark, sf_dir).select("country", "indicator", "raw"), countries, observations(spark, sf_dir), sizes, ["balance", "orders", "suppliers"])
    return df.withColumns({"raw": F.round("raw", 4), "basis": F.array_join(F.transform("basis", lambda x: x.cast("string")), ",")})


@query(f"""WITH l AS (SELECT country, round(arg_max(value, year) FILTER (indicator = 'orders'), 3) AS orders, max(year) FILTER (indicator = 'orders') AS orders_year FROM ({OBS}) GROUP BY 1), a AS (SELECT n_nationkey AS country, max(v) AS v FROM nation JOIN (SELECT s_nationkey, count(*)::DOUBLE AS v FROM supplier WHERE s_nationkey % 9 <> 4 GROUP BY 1) ON s_nationkey = n_nationkey GROUP BY 1)
SELECT n_nationkey AS country, orders, orders_year, v AS arms_export FROM nation LEFT JOIN l ON l.country = n_nationkey LEFT JOIN a ON a.country = n_nationkey""")
def w15_military_panel(spark, sf_dir):
    n, k = frames.table(spark, sf_dir, "nation"), F.col("n_nationkey")
    countries = n.select(k.alias("country"), F.col("n_name").alias("name"))
    sold = frames.table(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(F.count("*").cast("double").alias("value")).join(n, "n_nationkey")
    # a third by their own names with stars, a third by aliases, some unknown
    supplier = F.when(k % 9 == 4, F.concat(F.lit("Old "), F.col("n_name"))).when(k % 3 == 0, F.concat(F.lower("n_name"), F.lit("** "))).when(k % 3 == 1, F.concat(F.lit("The "), F.col("n_name"))).otherwise(F.col("n_name"))
    aliases = n.where("n_nationkey % 3 = 1").select(F.lower(F.concat(F.lit("the "), F.col("n_name"))).alias("name"), k.alias("country"))
    return estimates.military_panel(observations(spark, sf_dir), countries, sold.select(supplier.alias("supplier"), "value"), aliases, ["orders"])[0]


PILLARS = f"SELECT country, indicator AS pillar, round((raw - avg(raw) OVER w) / nullif(stddev_pop(raw) OVER w, 0), 4) AS pillar_score FROM ({PREPARED}) WINDOW w AS (PARTITION BY indicator)"
BRIDGES = (("balance", "assets"), ("suppliers", "assets"), ("orders", "conversion"))


def pillars(spark, sf_dir):
    z = world.zscores(prepared(spark, sf_dir).withColumn("direction", F.lit(1)), "indicator", "raw", "direction")
    return world.pillar_scores(z.withColumnRenamed("indicator", "pillar"), "country", "pillar")


@query(f"SELECT country, round(avg(pillar_score) FILTER (g = 'assets'), 4) + 0.0 AS assets, round(avg(pillar_score) FILTER (g = 'conversion'), 4) + 0.0 AS conversion FROM ({PILLARS}) JOIN (VALUES {', '.join(map(str, BRIDGES))}) b(pillar, g) USING (pillar) GROUP BY 1")
def w18_bridge_groups(spark, sf_dir):
    return rounded(estimates.bridge_groups(pillars(spark, sf_dir), spark.createDataFrame(list(BRIDGES), "pillar string, bridge_group string")), 4)


@query(f"SELECT country, round(score, 3) + 0.0 AS score, row_number() OVER (ORDER BY score DESC, country)::INT AS rank FROM (SELECT country, round(avg(pillar_score), 4) AS score FROM ({PILLARS}) GROUP BY 1)")
def w12_model_scores(spark, sf_dir):
    df = world.model_scores(pillars(spark, sf_dir), "country")
    return df.withColumn("score", F.round("score", 3) + F.lit(0.0))


_LOGGED = f"SELECT country, indicator, country % 4 = 0 AS estimated, CASE WHEN indicator = 'suppliers' THEN log10(raw) WHEN indicator = 'orders' THEN ln(1 + raw) ELSE raw END AS x, CASE WHEN indicator = 'orders' THEN -1 ELSE 1 END AS direction FROM ({PREPARED})"


@query(f"SELECT country, indicator, round(round(CASE WHEN s > 1e-12 THEN (x - m) / s * direction ELSE 0 END, 4), 3) + 0.0 AS z FROM (SELECT *, CASE WHEN n >= 2 THEN m1 ELSE m0 END AS m, CASE WHEN n >= 2 THEN s1 ELSE s0 END AS s FROM (SELECT *, count(x) FILTER (NOT estimated) OVER w AS n, avg(x) FILTER (NOT estimated) OVER w AS m1, stddev_pop(x) FILTER (NOT estimated) OVER w AS s1, avg(x) OVER w AS m0, stddev_pop(x) OVER w AS s0 FROM ({_LOGGED}) WINDOW w AS (PARTITION BY indicator)))")
def w11_zscores_of_real_values(spark, sf_dir):
    i = F.col("indicator")
    df = prepared(spark, sf_dir).withColumns({"estimated": F.col("country") % 4 == 0, "direction": F.when(i == "orders", -1).otherwise(1), "transform": F.when(i == "suppliers", "log10").when(i == "orders", "log1p")})
    return world.zscores(df, "indicator", "raw", "direction", "transform", "estimated").select("country", "indicator", (F.round("z", 3) + F.lit(0.0)).alias("z"))


@query(f"""WITH s AS (SELECT country, round(avg(pillar_score), 4) + 0.0 AS score FROM ({PILLARS}) GROUP BY 1), l AS (SELECT country, count(*) AS links, arg_max(partner, value) AS first FROM (SELECT *, row_number() OVER (PARTITION BY country ORDER BY value DESC, partner) AS k FROM ({frames.EXPORTS}) WHERE value > 0) WHERE k <= 6 GROUP BY 1)
SELECT s.country, round(s.score, 3) + 0.0 AS score, coalesce(p.n, 0) AS pillars, coalesce(l.links, 0) AS links, first FROM s LEFT JOIN (SELECT country, count(*) AS n FROM ({PILLARS}) GROUP BY 1) p USING (country) LEFT JOIN l USING (country)""")
def i14_country_documents(spark, sf_dir):
    p = pillars(spark, sf_dir)
    docs = estimates.country_documents(world.model_scores(p, "country"), p, world.trade_links(frames.exports(spark, sf_dir), "country", "partner", "value"))
    d = F.from_json("document", "score double, components array<struct<pillar:string>>, trade_links array<struct<partner:int>>")
    return docs.select("country", d.alias("d")).select("country", (F.round("d.score", 3) + F.lit(0.0)).alias("score"), F.size("d.components").cast("long").alias("pillars"), F.size("d.trade_links").cast("long").alias("links"), F.get("d.trade_links.partner", 0).alias("first"))


# Documents of users


def user_documents(spark, sf_dir):
    events = frames.table(spark, sf_dir, "events")
    e = dealt(events, events.count(), "user_id").select("user_id", F.concat(F.col("event_type"), F.lit("."), F.date_format("ts", "yyyy-MM-dd")).alias("key"), F.col("event_id").cast("string").alias("v"))
    one = e.groupBy("user_id", "key").agg(F.max(F.col("v").cast("long")).cast("string").alias("v"))
    return one.groupBy("user_id").agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("key", "v")))).alias("document"))


@query("SELECT user_id, event_type AS namespace, strftime(ts, '%Y-%m-%d') AS item, max(event_id)::VARCHAR AS value FROM events GROUP BY 1, 2, 3")
def s1_decompose_documents(spark, sf_dir):
    return documents.decompose_documents(user_documents(spark, sf_dir), "user_id", "document")


@query("""WITH i AS (SELECT user_id, event_type AS ns, strftime(ts, '%Y-%m-%d') AS item, max(event_id) AS v FROM events GROUP BY 1, 2, 3),
n AS (SELECT user_id, ns, '{' || string_agg('"' || item || '":"' || v || '"', ',' ORDER BY item) || '}' AS items FROM i GROUP BY 1, 2)
SELECT user_id, '{' || string_agg('"' || ns || '":' || items, ',' ORDER BY ns) || '}' AS document FROM n GROUP BY 1""")
def s5_rebuild_documents(spark, sf_dir):
    flat = written(documents.decompose_documents(user_documents(spark, sf_dir), "user_id", "document"))
    kinds = ("click", "error", "purchase", "signup", "view")
    return documents.rebuild_documents({k: (flat.where(F.col("namespace") == k), "item", "value") for k in kinds}, "user_id")


def _halves(spark, sf_dir):
    e = frames.table(spark, sf_dir, "events").select("user_id", F.date_format("ts", "yyyy-MM-dd").alias("day"), "event_id", "event_type")
    return e.where("event_id % 3 <> 0"), e.where("event_id % 3 <> 1")


@query("""WITH s AS (SELECT user_id, strftime(ts, '%Y-%m-%d') AS day, event_id FROM events WHERE event_id % 3 <> 0), i AS (SELECT user_id, strftime(ts, '%Y-%m-%d') AS day, event_id FROM events WHERE event_id % 3 <> 1), d AS (SELECT DISTINCT user_id, day FROM i WHERE user_id % 2 = 0)
SELECT * FROM s WHERE (user_id, day) NOT IN (SELECT user_id, day FROM d) UNION ALL SELECT * FROM i WHERE (user_id, day) IN (SELECT user_id, day FROM d)""")
def s3_replace_day(spark, sf_dir):
    stored, incoming = _halves(spark, sf_dir)
    return documents.replace_day(stored, incoming, incoming.where("user_id % 2 = 0"), "user_id", "day").select("user_id", "day", "event_id")


@query("""SELECT user_id, day, event_type, n FROM (SELECT user_id, strftime(ts, '%Y-%m-%d') AS day, event_type, CASE WHEN count(*) FILTER (event_id % 3 <> 0) > 0 THEN count(*) FILTER (event_id % 3 <> 0) ELSE 1 END AS n FROM events GROUP BY 1, 2, 3)""")
def s4_append_new(spark, sf_dir):
    stored, incoming = _halves(spark, sf_dir)
    return documents.append_new(stored, incoming, ["user_id", "day", "event_type"]).groupBy("user_id", "day", "event_type").agg(F.count("*").alias("n"))


@query("""SELECT coalesce(a.user_id, b.user_id) AS user_id, coalesce(a.day, b.day) AS day, CASE WHEN a.v IS NULL THEN 'insert' WHEN b.v IS NULL THEN 'delete' WHEN a.v = b.v THEN 'keep' ELSE 'update' END AS action FROM (SELECT user_id, strftime(ts, '%Y-%m-%d') AS day, max(event_id) AS v FROM events WHERE event_id % 3 <> 0 GROUP BY 1, 2) a
FULL JOIN (SELECT user_id, strftime(ts, '%Y-%m-%d') AS day, max(event_id) AS v FROM events WHERE event_id % 3 <> 1 GROUP BY 1, 2) b ON a.user_id = b.user_id AND a.day = b.day WHERE coalesce(a.user_id, b.user_id) IN (SELECT user_id FROM events WHERE event_id % 3 <> 1)""")
def s2_snapshot_sync(spark, sf_dir):
    newest = lambda df: df.groupBy("user_id", "day").agg(F.max("event_id").alias("v"))
    stored, incoming = map(newest, _halves(spark, sf_dir))
    return documents.snapshot_sync(stored, incoming, ["user_id", "day"], "v").select("user_id", "day", "action")


for _name, _columns in {"g2_pipeline_registry": ("effective_date",), "g4_storage_rows": ("gas_date",), "g4_day_totals": ("gas_date",), "g9_storage_totals": ("gas_date",), "g11_facility_storage_latest": ("first_day", "last_day"), "g3_latest_day": ("day",), "i8_dispatch_records": ("ts",), "i9_flatten_hourly_json": ("time",)}.items():
    as_text(_name, _columns)
