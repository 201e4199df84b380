"""Battery fleet and generation register over the driver's tables.

A unit is a user of the events, two units make an asset; intervals are the events' five minutes. Prices come from the
region's own events, so that a unit's interval has a price only where its region has one.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.calendar import interval_end, operating_day
from ..operators import battery, fuel, keys
from . import frames
from .queries import GENERATION, as_text, generation, query, rounded

REGIONS = ("click", "error", "purchase", "signup", "view")


def intervals_of(spark, sf_dir):
    e = frames.table(spark, sf_dir, "events")
    return e.select("event_id", "user_id", "event_type", "value", F.get_json_object("props", "$.k").cast("double").alias("k"), interval_end(F.col("ts"), 5).alias("ts"))


FIVE = "SELECT event_id, user_id, event_type, value, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k, TIMESTAMP '1970-01-01' + to_minutes(-CAST(floor(-epoch_us(ts) / 3e8) AS BIGINT) * 5) AS ts FROM events"


def prices(spark, sf_dir):
    return intervals_of(spark, sf_dir).groupBy(F.col("event_type").alias("region"), "ts").agg((F.max("k") - 20).alias("rrp"), F.create_map(F.lit("raise"), F.max("k"), F.lit("lower"), F.min("k")).alias("fcas_prices"))


def dispatch(spark, sf_dir):
    d = intervals_of(spark, sf_dir).groupBy(F.col("user_id").alias("unit"), "ts").agg((F.max("value") - 40).alias("target_mw"), F.max(F.when(F.col("event_id") % 9 != 0, F.col("k"))).alias("storage_mwh"), F.create_map(F.lit("raise"), F.max("value") - 30, F.lit("spare"), F.min("value")).alias("enablement"))
    return d.withColumn("day", operating_day(F.col("ts")))


def scada(spark, sf_dir):
    return intervals_of(spark, sf_dir).where("event_id % 7 <> 0").groupBy(F.col("user_id").alias("unit"), "ts").agg((F.max("value") - 50).alias("scada_mw"))


def registrations(spark, sf_dir):
    """One row per unit and day of effect: half of the units end on the 20th, some are of no capacity."""
    u = F.col("user_id")
    regs = frames.table(spark, sf_dir, "events").select("user_id").distinct().select(
        F.concat(F.lit("A"), F.floor(u / 2).cast("string")).alias("asset"), u.alias("unit"), F.get(F.array(*map(F.lit, REGIONS)), (F.floor(u / 2) % 5).cast("int")).alias("region"), F.lit("2024-01-03").cast("date").alias("effective_from"), F.when(u % 2 == 1, F.lit("2024-01-20").cast("date")).alias("effective_to"),
        F.when(u % 10 == 4, 0.0).otherwise(20.0 + u % 7).alias("power_mw"), F.when(u % 10 == 4, 0.0).otherwise(40.0 + u % 9).alias("capacity_mwh"),
    )
    days = dispatch(spark, sf_dir).select("day").distinct()
    return battery.effective_registrations(regs, days, "day", "effective_from", "effective_to").drop("effective_from", "effective_to")


REGS = """SELECT 'A' || (user_id // 2) AS asset, user_id AS unit, (['click', 'error', 'purchase', 'signup', 'view'])[(user_id // 2) % 5 + 1] AS region, CASE WHEN user_id % 10 = 4 THEN 0.0 ELSE 20.0 + user_id % 7 END::DOUBLE AS power_mw,
    CASE WHEN user_id % 10 = 4 THEN 0.0 ELSE 40.0 + user_id % 9 END::DOUBLE AS capacity_mwh, DATE '2024-01-03' AS effective_from, CASE WHEN user_id % 2 = 1 THEN DATE '2024-01-20' END AS effective_to FROM (SELECT DISTINCT user_id FROM events)"""
DISPATCH = f"SELECT user_id AS unit, ts, max(value) - 40 AS target_mw, max(CASE WHEN event_id % 9 <> 0 THEN k END) AS storage_mwh, max(value) - 30 AS e_raise, min(value) AS e_spare, CAST(ts - INTERVAL 1 MICROSECOND AS DATE) AS day FROM ({FIVE}) GROUP BY 1, 2"
DAYWISE = f"SELECT r.* EXCLUDE (effective_from, effective_to), d.day FROM ({REGS}) r JOIN (SELECT DISTINCT day FROM ({DISPATCH})) d ON effective_from <= day AND (effective_to IS NULL OR day <= effective_to)"
PRICES = f"SELECT event_type AS region, ts, max(k) - 20 AS rrp, max(k) AS p_raise FROM ({FIVE}) GROUP BY 1, 2"
SCADA = f"SELECT user_id AS unit, ts, max(value) - 50 AS scada_mw FROM ({FIVE}) WHERE event_id % 7 <> 0 GROUP BY 1, 2"
JOINED = f"SELECT * FROM ({DISPATCH}) JOIN ({DAYWISE}) USING (unit, day) JOIN ({PRICES}) USING (region, ts) LEFT JOIN ({SCADA}) USING (unit, ts)"
VALUED = f"""SELECT *, energy_value + gross_fcas_value AS observable_gross_value, list_filter([CASE WHEN scada_mw IS NULL THEN 'missing_scada' END, CASE WHEN storage_mwh IS NULL THEN 'missing_storage' END, CASE WHEN storage_mwh < 0 THEN 'storage_below_zero' END,
    CASE WHEN capacity_mwh <> 0 AND storage_mwh > 1.02 * capacity_mwh THEN 'storage_above_public_capacity' END], lambda x: x IS NOT NULL) AS flags FROM (SELECT *, greatest(0, -coalesce(scada_mw, 0) / 12) AS charge_mwh, greatest(0, coalesce(scada_mw, 0) / 12) AS discharge_mwh, greatest(0, -coalesce(scada_mw, 0) / 12) * rrp AS charging_cost,
    greatest(0, coalesce(scada_mw, 0) / 12) * rrp AS discharge_value, coalesce(scada_mw, 0) / 12 * rrp AS energy_value, greatest(0, e_raise) * p_raise / 12 AS gross_fcas_value FROM ({JOINED}))"""


def joined(spark, sf_dir):
    return battery.join_dispatch(prices(spark, sf_dir), registrations(spark, sf_dir), dispatch(spark, sf_dir), scada(spark, sf_dir))


def valued(spark, sf_dir):
    df = battery.interval_value(joined(spark, sf_dir), "scada_mw", "rrp", "enablement", "fcas_prices")
    return df.withColumn("flags", battery.quality_flags(F.col("scada_mw"), F.col("storage_mwh"), F.col("capacity_mwh")))


def capacity(spark, sf_dir):
    return registrations(spark, sf_dir).groupBy("asset", "day").agg(F.count("*").alias("units"), F.sum("power_mw").alias("power_mw"), F.sum("capacity_mwh").alias("capacity_mwh"))


CAPACITY = f"SELECT asset, day, count(*) AS units, sum(power_mw) AS power_mw, sum(capacity_mwh) AS capacity_mwh FROM ({DAYWISE}) GROUP BY 1, 2"


@query(f"SELECT asset, unit, region, day, power_mw, capacity_mwh FROM ({DAYWISE})")
def b2_effective_registrations(spark, sf_dir):
    return registrations(spark, sf_dir).select("asset", "unit", "region", "day", "power_mw", "capacity_mwh")


@query(f"SELECT unit, ts, asset, region, rrp, target_mw, storage_mwh, scada_mw FROM ({JOINED})")
def b3_join_dispatch(spark, sf_dir):
    return joined(spark, sf_dir).select("unit", "ts", "asset", "region", "rrp", "target_mw", "storage_mwh", "scada_mw")


@query(f"SELECT unit, ts, round(energy_value, 6) + 0.0 AS energy_value, round(gross_fcas_value, 6) + 0.0 AS gross_fcas_value, round(observable_gross_value, 6) + 0.0 AS observable_gross_value FROM ({VALUED})")
def b4_observable_value(spark, sf_dir):
    return rounded(valued(spark, sf_dir).select("unit", "ts", "energy_value", "gross_fcas_value", "observable_gross_value"))


@query(f"SELECT unit, ts, array_to_string(list_sort(flags), ';') AS flags FROM ({VALUED})")
def b5_quality_flags(spark, sf_dir):
    return valued(spark, sf_dir).select("unit", "ts", F.array_join(F.array_sort("flags"), ";").alias("flags"))


_NOTE = lambda c, words: f"CASE WHEN {c} <> coalesce(units, 0) * 288 THEN '{words} ' || {c} || ' of ' || (coalesce(units, 0) * 288) END"
SUMMARY = f"""SELECT asset, day, interval_count, scada_interval_count, storage_interval_count, round(charge_mwh, 6) AS charge_mwh, round(discharge_mwh, 6) AS discharge_mwh, round(charging_cost, 6) + 0.0 AS charging_cost, round(discharge_value, 6) + 0.0 AS discharge_value, round(energy_value, 6) + 0.0 AS energy_value, round(gross_fcas_value, 6) AS gross_fcas_value,
    round(observable_gross_value, 6) + 0.0 AS observable_gross_value, min_storage_mwh, max_storage_mwh, round(charge_mwh + discharge_mwh, 6) AS throughput_mwh, round(coalesce(discharge_mwh / nullif(capacity_mwh, 0), 0), 6) AS equivalent_cycles, round(observable_gross_value / nullif(discharge_mwh, 0), 6) + 0.0 AS value_per_discharge_mwh, round(discharge_value / nullif(discharge_mwh, 0), 6) + 0.0 AS capture_price,
    CASE WHEN least_mw < 0 THEN abs(least_mw) ELSE 0.0 END AS peak_charge_mw, coalesce(most_mw, 0) AS peak_discharge_mw, round(100 * min_storage_mwh / nullif(capacity_mwh, 0), 6) AS min_soc_pct, round(100 * max_storage_mwh / nullif(capacity_mwh, 0), 6) AS max_soc_pct, round(CASE WHEN observable_gross_value > 0 THEN five / observable_gross_value END, 6) AS top_five_share,
    CASE WHEN interval_count = units * 288 AND scada_interval_count = units * 288 AND storage_interval_count = units * 288 THEN 'complete' ELSE 'partial' END AS status,
    array_to_string(list_concat(list_filter([{_NOTE("interval_count", "intervals")}, {_NOTE("scada_interval_count", "readings")}, {_NOTE("storage_interval_count", "storage values")}], lambda x: x IS NOT NULL), list_filter(list_sort(list_distinct(all_flags)), lambda x: x NOT IN ('missing_scada', 'missing_storage'))), ';') AS notes
    FROM (SELECT asset, day, count(*) AS interval_count, count(scada_mw) AS scada_interval_count, count(storage_mwh) AS storage_interval_count, sum(charge_mwh) AS charge_mwh, sum(discharge_mwh) AS discharge_mwh, sum(charging_cost) AS charging_cost, sum(discharge_value) AS discharge_value, sum(energy_value) AS energy_value,
    sum(gross_fcas_value) AS gross_fcas_value, sum(observable_gross_value) AS observable_gross_value, max(scada_mw) AS most_mw, min(scada_mw) AS least_mw, min(storage_mwh) AS min_storage_mwh, max(storage_mwh) AS max_storage_mwh, sum(observable_gross_value) FILTER (k <= 5) AS five, flatten(list(flags)) AS all_flags
    FROM (SELECT *, row_number() OVER (PARTITION BY asset, day ORDER BY observable_gross_value DESC, ts) AS k FROM ({VALUED})) GROUP BY 1, 2) LEFT JOIN ({CAPACITY}) USING (asset, day)"""


@query(SUMMARY)
def b6_operating_summary(spark, sf_dir):
    return rounded(battery.operating_summary(valued(spark, sf_dir), capacity(spark, sf_dir))).withColumn("notes", F.array_join("notes", ";"))


#: The benchmark in SQL: a recursion over a day's intervals that carries the values of all levels. A day without power or
#: capacity has none. Way back: of moves that are as good but for rounding, the one from the lowest level.
SERIES = f"SELECT asset, day, ts, sum(storage_mwh) AS storage_mwh, max(rrp) AS rrp, sum(energy_value) AS energy_value FROM ({VALUED}) GROUP BY 1, 2, 3"
_REWARD = "CASE WHEN {to} > {of} THEN -({to} - {of}) * step / eta * {price} ELSE ({of} - {to}) * step * eta * {price} END"
SOLVED = f"""series AS MATERIALIZED (SELECT s.*, row_number() OVER (PARTITION BY asset, day ORDER BY ts) AS i, power_mw, capacity_mwh FROM ({SERIES}) s LEFT JOIN ({CAPACITY}) USING (asset, day)),
days AS MATERIALIZED (SELECT *, round_even(greatest(0, least(capacity, coalesce(first_held, capacity / 2))) / step, 0)::INT AS start_level, round_even(greatest(0, least(capacity, coalesce(last_held, capacity / 2))) / step, 0)::INT AS end_level,
    least(floor(power / 12 * eta / step + 1e-9), 200)::INT AS up, least(floor(power / 12 / eta / step + 1e-9), 200)::INT AS down FROM (SELECT asset, day, count(*) AS n, sum(coalesce(energy_value, 0)) AS energy_value, max(power_mw) AS power, max(capacity_mwh) AS capacity, max(capacity_mwh) / 200 AS step, sqrt(0.9) AS eta,
    arg_min(storage_mwh, ts) FILTER (storage_mwh IS NOT NULL) AS first_held, arg_max(storage_mwh, ts) FILTER (storage_mwh IS NOT NULL) AS last_held, list(coalesce(rrp, 0) ORDER BY ts) AS prices FROM series GROUP BY 1, 2) WHERE power > 0 AND capacity > 0),
forward AS (SELECT asset, day, 0 AS i, list_transform(range(201), lambda k: CASE WHEN k = start_level THEN 0.0 ELSE '-infinity'::DOUBLE END) AS v FROM days UNION ALL
    SELECT f.asset, f.day, f.i + 1, list_transform(range(201), lambda k: list_max(list_transform(range(greatest(0, k - up), least(200, k + down) + 1), lambda j: f.v[j + 1] + {_REWARD.format(to="k", of="j", price="d.prices[f.i + 1]")}))) FROM forward f JOIN days d USING (asset, day) WHERE f.i < d.n),
ends AS (SELECT asset, day, n, list_sort(list_transform(list_filter(range(201), lambda k: v[k + 1] > '-infinity'::DOUBLE), lambda k: {{'a': abs(k - end_level), 'k': k}}))[1].k AS level, v FROM forward JOIN days USING (asset, day) WHERE i = n)"""
BENCHMARK = f"""SELECT asset, day, count(*) AS n, round(sum(coalesce(s.energy_value, 0)), 6) + 0.0 AS energy_value, round(any_value(e.v[e.level + 1]), 6) + 0.0 AS benchmark_value,
    round(CASE WHEN any_value(e.v[e.level + 1]) > 0 THEN sum(coalesce(s.energy_value, 0)) / any_value(e.v[e.level + 1]) END, 6) + 0.0 AS capture_ratio FROM series s LEFT JOIN ends e USING (asset, day) GROUP BY 1, 2"""


def series_of(spark, sf_dir):
    return valued(spark, sf_dir).groupBy("asset", "day", "ts").agg(F.sum("storage_mwh").alias("storage_mwh"), F.max("rrp").alias("rrp"), F.sum("energy_value").alias("energy_value"))


@query(f"WITH RECURSIVE {SOLVED} {BENCHMARK}")
def b9_opportunity_benchmark(spark, sf_dir):
    return rounded(battery.opportunity_benchmark(series_of(spark, sf_dir), capacity(spark, sf_dir)))


@query(f"""WITH RECURSIVE {SOLVED}, back AS (SELECT asset, day, n AS i, level, NULL::INT AS up_to FROM ends UNION ALL SELECT asset, day, i - 1, least_of(ways, list_max(ways)) AS level, b_level AS up_to FROM (
    SELECT b.asset, b.day, b.i, b.level AS b_level, list_transform(range(201), lambda j: CASE WHEN j >= b.level - up AND j <= b.level + down THEN f.v[j + 1] + {_REWARD.format(to="b.level", of="j", price="d.prices[b.i]")} ELSE '-infinity'::DOUBLE END) AS ways
    FROM back b JOIN days d USING (asset, day) JOIN forward f ON f.asset = b.asset AND f.day = b.day AND f.i = b.i - 1 WHERE b.i > 0)),
plan AS (SELECT b.asset, b.day, b.i + 1 AS i, CASE WHEN up_to > level THEN -(up_to - level) * step / eta ELSE (level - up_to) * step * eta END * 12 AS mw FROM back b JOIN days USING (asset, day) WHERE up_to IS NOT NULL)
SELECT s.asset, s.day, s.ts, s.rrp, round(p.mw, 6) + 0.0 AS benchmark_mw FROM series s LEFT JOIN plan p USING (asset, day, i)""".replace("least_of(ways, list_max(ways))", "list_filter(range(201), lambda j: ways[j + 1] >= list_max(ways) - 1e-9 * greatest(1, abs(list_max(ways))))[1]"))
def b9_benchmark_schedule(spark, sf_dir):
    return rounded(battery.benchmark_schedule(series_of(spark, sf_dir), capacity(spark, sf_dir)))


@query(f"""SELECT asset, day, strftime(ts, '%H:%M') AS clock, CASE WHEN strftime(ts, '%H:%M') = '00:00' THEN '24:00' ELSE strftime(ts, '%H:%M') END AS time, round(scada_mw, 6) AS scada_mw, round(target_mw, 6) AS target_mw, storage_mwh, rrp, round(energy_value, 6) + 0.0 AS energy_value, round(fcas_value, 6) AS fcas_value, round(observable_value, 6) + 0.0 AS observable_value,
    round(100 * storage_mwh / nullif(capacity_mwh, 0), 6) AS storage_pct, array_to_string(list_sort(list_distinct(f)), ';') AS flags FROM (SELECT asset, day, ts, sum(scada_mw) AS scada_mw, sum(target_mw) AS target_mw, sum(storage_mwh) AS storage_mwh, max(rrp) AS rrp, sum(energy_value) AS energy_value, sum(gross_fcas_value) AS fcas_value,
    sum(observable_gross_value) AS observable_value, flatten(list(flags)) AS f FROM ({VALUED}) GROUP BY 1, 2, 3) LEFT JOIN ({CAPACITY}) USING (asset, day)""")
def b15_interval_inspector(spark, sf_dir):
    df = battery.interval_inspector(valued(spark, sf_dir), capacity(spark, sf_dir))
    return rounded(df.withColumns({"clock": F.date_format("ts", "HH:mm"), "flags": F.array_join("flags", ";")}).drop("ts"))


@query(f"SELECT asset, 'raise' AS service, round(sum(gross_fcas_value), 6) AS value FROM ({VALUED}) GROUP BY 1 HAVING abs(sum(gross_fcas_value)) >= 0.005")
def b16_fcas_breakdown(spark, sf_dir):
    return rounded(battery.fcas_breakdown(valued(spark, sf_dir), ["asset"], "enablement", "fcas_prices"))


@query(f"WITH RECURSIVE {SOLVED} SELECT u.*, b.benchmark_value, b.capture_ratio FROM ({SUMMARY}) u LEFT JOIN ({BENCHMARK}) b USING (asset, day)")
def b18_recalculate_summaries(spark, sf_dir):
    """b6 and b9 over all that is held."""
    return rounded(battery.recalculate_summaries(valued(spark, sf_dir), capacity(spark, sf_dir))).withColumn("notes", F.array_join("notes", ";"))


TECHNOLOGY, DETAIL, GAS = ("Coal", "Battery Storage", "hydro", " Wind", "Solar PV", "Gas Turbine", "Steam", None), ("Brown coal", "", "Biomass boiler", None), ("Natural gas", "Diesel", "Landfill gas", "Fuel Oil", None)
_PICK = lambda values, by: "([" + ", ".join("NULL" if v is None else f"'{v}'" for v in values) + f"])[{by} % {len(values)} + 1]"
_T, _D, _G = (f"lower(trim(coalesce({_PICK(v, by)}, '')))" for v, by in ((TECHNOLOGY, "p_partkey"), (DETAIL, "p_size"), (GAS, "(p_partkey // 8)")))
LABELLED = f"""SELECT p_partkey, CASE WHEN t = 'coal' THEN CASE WHEN contains(d, 'brown') THEN 'Brown coal' ELSE 'Black coal' END WHEN t = 'battery storage' THEN 'Battery' WHEN t = 'hydro' THEN 'Hydro' WHEN t = 'wind' THEN 'Wind' WHEN t = 'solar pv' THEN 'Solar'
    WHEN contains(g, 'biofuel') OR contains(g, 'biomass') OR contains(g, 'landfill') THEN 'Biomass' WHEN t = 'gas turbine' THEN CASE WHEN contains(g, 'diesel') OR contains(g, 'fuel oil') THEN 'Liquid Fuel' ELSE 'Gas' END WHEN contains(d, 'biomass') THEN 'Biomass' ELSE 'Other' END AS fuel,
    'U' || p_partkey % 97 || CASE WHEN p_partkey % 3 = 0 THEN ', V' || p_size ELSE ' ; ' END AS units, ['NSW1', 'QLD1', 'VIC1 ', 'TAS'][p_size % 4 + 1] AS region, CASE WHEN p_partkey % 5 = 0 THEN 'Publicly Announced' ELSE 'In Service ' END AS status FROM (SELECT *, {_T} AS t, {_D} AS d, {_G} AS g FROM part)"""


def plants(spark, sf_dir):
    k, size = F.col("p_partkey"), F.col("p_size")
    pick = lambda values, by: F.get(F.array(*[F.lit(v).cast("string") for v in values]), (by % len(values)).cast("int"))
    return frames.table(spark, sf_dir, "part").select(
        "p_partkey", pick(TECHNOLOGY, k).alias("technology"), pick(DETAIL, size).alias("detail"), pick(GAS, F.floor(k / 8)).alias("gas_fuel"), F.concat(F.lit("U"), (k % 97).cast("string"), F.when(k % 3 == 0, F.concat(F.lit(", V"), size.cast("string"))).otherwise(" ; ")).alias("units"),
        pick(("NSW1", "QLD1", "VIC1 ", "TAS"), size).alias("region"), F.when(k % 5 == 0, "Publicly Announced").otherwise("In Service ").alias("status"),
    )


@query(f"SELECT p_partkey, fuel FROM ({LABELLED})")
def f1_classify_fuel(spark, sf_dir):
    return plants(spark, sf_dir).select("p_partkey", fuel.classify_fuel(F.col("technology"), F.col("detail"), F.col("gas_fuel")).alias("fuel"))


@query(f"""SELECT unit, state, fuel FROM (SELECT *, row_number() OVER (PARTITION BY unit ORDER BY (fuel = 'Other')::INT, p_partkey) AS k FROM (SELECT p_partkey, fuel, regexp_replace(trim(region), '1$', '') AS state, unnest(list_filter(regexp_split_to_array(trim(units), '[,;\\s]+'), lambda x: x <> '')) AS unit
    FROM ({LABELLED}) WHERE trim(status) IN ('In Service', 'In Commissioning', 'Announced Withdrawal'))) WHERE k = 1""")
def f2_unit_registry(spark, sf_dir):
    return fuel.unit_registry(plants(spark, sf_dir), units="units", region="region", technology="technology", detail="detail", gas_fuel="gas_fuel", status="status", line="p_partkey")


_GROUPS = " UNION ALL ".join(f"SELECT state, '{g}' AS fuel_group, sum(CASE WHEN fuel IN ({', '.join(repr(f) for f in fuels)}) THEN mwh ELSE 0 END) AS mwh, sum(mwh) AS total FROM b GROUP BY 1" for g, fuels in fuel.GROUPS.items())


@query(f"""WITH g AS ({GENERATION}), r AS (SELECT * FROM g WHERE day > (SELECT max(day) FROM g) - 7 AND mwh > 0), b AS (SELECT state, fuel, mwh FROM r UNION ALL SELECT 'ALL', fuel, mwh FROM r)
SELECT state, fuel_group, round(mwh, 6) AS mwh, round(100 * mwh / total, 6) AS pct FROM ({_GROUPS})""")
def f5_fuel_groups(spark, sf_dir):
    return rounded(fuel.fuel_groups(generation(spark, sf_dir), "day", "state", "fuel"))


WINDOWS = (("click", "backward", 31), ("view", "backward", None), ("error", "forward", None), ("signup", "backward", 8), ("nothing", "backward", 3))


@query(f"""WITH c AS (SELECT event_type AS source, min(CAST(ts AS DATE)) AS earliest, max(CAST(ts AS DATE)) AS latest, count(*) AS rows_stored FROM events GROUP BY 1), w AS (SELECT * FROM (VALUES {", ".join(f"('{a}', '{b}', {c if c is not None else 'NULL'})" for a, b, c in WINDOWS)}) AS v(source, direction, window_days)),
g AS (SELECT event_type AS source, (date_diff('day', min(ts)::DATE, max(ts)::DATE) + 1 - count(DISTINCT ts::DATE)) AS missing_days FROM events GROUP BY 1), j AS (SELECT w.*, c.* EXCLUDE (source), coalesce(g.missing_days, 0) AS missing_days FROM w LEFT JOIN c USING (source) LEFT JOIN g USING (source))
SELECT source, rows_stored, missing_days, CASE WHEN direction = 'backward' THEN DATE '2024-02-01' - latest END AS days_behind, CASE WHEN direction <> 'backward' THEN latest - DATE '2024-02-01' END AS days_ahead, CASE WHEN direction = 'backward' THEN window_days - (DATE '2024-02-01' - latest) END AS days_until_loss,
    coalesce(CASE WHEN direction = 'backward' THEN window_days - (DATE '2024-02-01' - latest) END <= 7, false) OR missing_days > 0 AS urgent FROM j""")
def d9_coverage_margin(spark, sf_dir):
    e = frames.table(spark, sf_dir, "events").select(F.col("event_type").alias("source"), F.to_date("ts").alias("day"))
    gaps = e.groupBy("source").agg((F.date_diff(F.max("day"), F.min("day")) + 1 - F.count_distinct("day")).alias("missing_days"))
    windows = spark.createDataFrame(list(WINDOWS), "source string, direction string, window_days int")
    df = keys.coverage_margin(keys.source_coverage(e, "source", "day"), windows, gaps, F.lit("2024-02-01").cast("date"))
    return df.select("source", "rows_stored", "missing_days", "days_behind", "days_ahead", "days_until_loss", "urgent")


for _name in ("b2_effective_registrations", "b6_operating_summary", "b9_opportunity_benchmark", "b15_interval_inspector", "b18_recalculate_summaries"):
    as_text(_name, ("day",))
for _name in ("b3_join_dispatch", "b4_observable_value", "b5_quality_flags"):
    as_text(_name, ("ts",))
as_text("b9_benchmark_schedule", ("day", "ts"))
