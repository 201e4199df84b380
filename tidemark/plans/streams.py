"""Streams and incremental merges over the driver's tables.

Events arrive in three slots, a third of the month each; every seventh comes a slot late. SQL says what the watermark
drops: a row of a slot whose interval had ended `late` before the newest row of the slots before it.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.calendar import interval_end
from ..functions.storage import new_path
from ..operators import merging
from ..streaming import jobs, runs
from . import frames
from .queries import as_text, query, rounded

SLOTS = 3


def arrivals(spark, sf_dir):
    """Events with the slot in which they come, from 0."""
    e = frames.table(spark, sf_dir, "events")
    third = F.least(F.floor((F.dayofmonth("ts") - 1) / 10), F.lit(2))
    slot = F.least(third + F.when(F.col("event_id") % 7 == 0, 1).otherwise(0), F.lit(SLOTS - 1))
    return e.select("event_id", "ts", "user_id", "event_type", "value", F.get_json_object("props", "$.k").cast("double").alias("k"), slot.cast("int").alias("slot"))


ARRIVALS = """SELECT event_id, ts, user_id, event_type, value, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k,
    least(least((day(ts) - 1) // 10, 2) + CASE WHEN event_id % 7 = 0 THEN 1 ELSE 0 END, 2) AS slot FROM events"""
#: The watermark that a slot's rows are held against: milliseconds, from the newest row of the slots before.
MARKS = "SELECT a.slot, (SELECT max({of}) FROM ({rows}) b WHERE b.slot < a.slot) - {late} AS mark FROM (SELECT DISTINCT slot FROM ({rows})) a"
_HALF = "TIMESTAMP '1970-01-01' + to_minutes(-CAST(floor(-epoch_us(ts) / 1.8e9) AS BIGINT) * 30)"
_FIVE = "TIMESTAMP '1970-01-01' + to_minutes(-CAST(floor(-epoch_us(ts) / 3e8) AS BIGINT) * 5)"
_AT = "(epoch_us(ts) - 1) // 1000"


@query(f"""WITH a AS ({ARRIVALS}), m AS ({MARKS.format(of=_AT, rows="SELECT * FROM a", late=600_000)}), h AS (SELECT a.*, {_HALF} AS interval_end, mark FROM a JOIN m USING (slot)),
kept AS (SELECT * FROM h WHERE mark IS NULL OR epoch_ms(interval_end) > mark)
SELECT event_type, interval_end, round(avg(value), 6) + 0.0 AS value, round(avg(k), 6) + 0.0 AS k FROM kept WHERE epoch_ms(interval_end) <= (SELECT max({_AT}) FROM a) - 600000 GROUP BY 1, 2""")
def t1_stream_half_hour_rollup(spark, sf_dir):
    rows = arrivals(spark, sf_dir)
    path = new_path(spark, "tables")
    slots = [[rows.where(F.col("slot") == s).drop("slot")] for s in range(SLOTS)]
    runs.arriving(spark, slots, lambda sources: jobs.stream_half_hour_rollup(sources[0], ["event_type"], "ts", ["value", "k"]), runs.once_per_batch(path))
    schema = "event_type string, interval_end timestamp, value double, k double"
    return rounded(spark.read.schema(schema).parquet(path).select("event_type", F.col("interval_end").cast("timestamp_ntz"), "value", "k"))


@query(f"""SELECT user_id, event_type, CAST(ts AS DATE) AS day, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type, CAST(ts AS DATE) ORDER BY ts DESC, slot DESC, event_id DESC) AS n FROM ({ARRIVALS})) WHERE n = 1""")
def t2_stream_newest_revision(spark, sf_dir):
    rows = arrivals(spark, sf_dir).select("user_id", "event_type", F.to_date("ts").alias("day"), "ts", "event_id", "value", "slot")
    path = new_path(spark, "tables")
    sink = jobs.newest_revision_sink(path, new_path(spark, "staging"), ["user_id", "event_type", "day"], "ts", "day", ["event_id"])
    slots = [[rows.where(F.col("slot") == s).drop("slot")] for s in range(SLOTS)]
    runs.arriving(spark, slots, lambda sources: sources[0], sink)
    return merging.read_table(spark, path, rows.drop("slot").schema).select("user_id", "event_type", "day", "event_id", "value")


_DISPATCH = f"SELECT event_id, event_type, {_FIVE} AS ts, value - 50 AS mw, slot FROM ({ARRIVALS}) WHERE event_id % 2 = 0"
_PRICES = f"SELECT event_type, {_FIVE} AS ts, slot, max(k) - 20 AS rrp FROM ({ARRIVALS}) WHERE event_id % 2 = 1 GROUP BY 1, 2, 3"
_MS = "epoch_ms(ts)"


@query(f"""WITH d AS ({_DISPATCH}), p AS ({_PRICES}), md AS ({MARKS.format(of=_MS, rows="SELECT * FROM d", late=1_800_000)}), mp AS ({MARKS.format(of=_MS, rows="SELECT * FROM p", late=1_800_000)}),
m AS (SELECT slot, least(md.mark, mp.mark) AS mark FROM md JOIN mp USING (slot)), kd AS (SELECT d.* FROM d JOIN m USING (slot) WHERE mark IS NULL OR {_MS} > mark), kp AS (SELECT p.* FROM p JOIN m USING (slot) WHERE mark IS NULL OR {_MS} > mark)
SELECT event_id, kd.event_type AS region, kd.ts, kd.mw, kp.rrp, round(kd.mw / 12 * kp.rrp, 6) + 0.0 AS energy_value FROM kd JOIN kp ON kd.event_type = kp.event_type AND kd.ts = kp.ts
    LEFT JOIN m ON m.slot = greatest(kd.slot, kp.slot) WHERE kd.slot = kp.slot OR epoch_ms(kd.ts) > m.mark""")
def t3_stream_interval_value(spark, sf_dir):
    """A pair that comes in different slots meets only while the first one is still held."""
    rows = arrivals(spark, sf_dir).withColumns({"region": F.col("event_type"), "ts": interval_end(F.col("ts"), 5).cast("timestamp")})
    dispatch = rows.where("event_id % 2 = 0").select("event_id", "region", "ts", (F.col("value") - 50).alias("mw"), "slot")
    prices = rows.where("event_id % 2 = 1").groupBy("region", "ts", "slot").agg((F.max("k") - 20).alias("rrp"))
    path = new_path(spark, "tables")
    slots = [[df.where(F.col("slot") == s).drop("slot") for df in (dispatch, prices)] for s in range(SLOTS)]
    runs.arriving(spark, slots, lambda sources: jobs.stream_interval_value(*sources, "region", "ts", "mw", "rrp"), runs.once_per_batch(path))
    made = spark.read.schema("event_id long, region string, ts timestamp, mw double, rrp double, energy_value double").parquet(path).drop("batch")
    return rounded(made.withColumn("ts", F.col("ts").cast("timestamp_ntz")))


# Merges into a table by month


def halves(spark, sf_dir):
    """Orders by customer and month: those that are stored, and a batch of the last twelve months."""
    o = frames.table(spark, sf_dir, "orders").select("o_custkey", F.trunc(F.to_date("o_orderdate"), "month").alias("month"), "o_orderkey", "o_totalprice", "o_orderstatus")
    last = o.agg(F.max("month").alias("last"))
    recent = o.join(F.broadcast(last), F.col("month") > F.add_months("last", -12)).drop("last")  # one row
    return o.where("o_orderstatus = 'F' OR o_orderkey % 3 = 0"), recent.where("o_orderstatus <> 'F'")


_BASE = "SELECT o_custkey, CAST(date_trunc('month', o_orderdate) AS DATE) AS month, o_orderkey, o_totalprice, o_orderstatus FROM orders"
_STORED = f"SELECT * FROM ({_BASE}) WHERE o_orderstatus = 'F' OR o_orderkey % 3 = 0"
_BATCH = f"SELECT * FROM ({_BASE}) WHERE o_orderstatus <> 'F' AND month > (SELECT max(month) FROM ({_BASE})) - INTERVAL 12 MONTH"


def merged(spark, stored, batch, merge):
    """stored as a table by month, then batch merged into it."""
    path = new_path(spark, "tables")
    merging.write_days(stored, path, "month")
    merging.merge_into(spark, path, batch, "month", merge, new_path(spark, "staging"))
    return merging.read_table(spark, path, batch.schema)


_NEWEST = "SELECT o_custkey, month, max(o_orderkey) AS revision, round(sum(o_totalprice), 2) AS total FROM ({}) GROUP BY 1, 2"


def newest(df):
    return df.groupBy("o_custkey", "month").agg(F.max("o_orderkey").alias("revision"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query(f"""WITH s AS ({_NEWEST.format(_STORED)}), b AS ({_NEWEST.format(_BATCH)})
SELECT o_custkey, month, CASE WHEN b.revision IS NULL OR b.revision < s.revision THEN s.revision ELSE b.revision END AS revision, CASE WHEN b.revision IS NULL OR b.revision < s.revision THEN s.total ELSE b.total END AS total FROM s FULL JOIN b USING (o_custkey, month)""")
def d2_merge_by_month(spark, sf_dir):
    stored, batch = map(newest, halves(spark, sf_dir))
    return merged(spark, stored, batch, merging.newest_wins(["o_custkey", "month"], "revision"))


@query(f"""WITH s AS ({_NEWEST.format(_STORED)}), b AS ({_NEWEST.format(_BATCH)})
SELECT o_custkey, month, coalesce(b.revision, s.revision) AS revision, coalesce(b.total, s.total) AS total FROM s FULL JOIN b USING (o_custkey, month)""")
def d6_upsert_by_month(spark, sf_dir):
    stored, batch = map(newest, halves(spark, sf_dir))
    return merged(spark, stored, batch, merging.upsert(["o_custkey", "month"]))


@query(f"""SELECT o_orderkey, o_custkey, month FROM ({_STORED}) WHERE (o_orderstatus, month) NOT IN (SELECT o_orderstatus, month FROM ({_BATCH})) UNION ALL SELECT o_orderkey, o_custkey, month FROM ({_BATCH})""")
def d7_replace_by_month(spark, sf_dir):
    stored, batch = halves(spark, sf_dir)
    return merged(spark, stored, batch, merging.replace(["o_orderstatus", "month"])).select("o_orderkey", "o_custkey", "month")


for _name, _columns in {"t1_stream_half_hour_rollup": ("interval_end",), "t2_stream_newest_revision": ("day",), "t3_stream_interval_value": ("ts",), "d2_merge_by_month": ("month",), "d6_upsert_by_month": ("month",), "d7_replace_by_month": ("month",)}.items():
    as_text(_name, _columns)
