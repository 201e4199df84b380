"""Account health over the driver's tables: an account is a customer, its timeline the monthly sums of its orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.storage import written
from ..operators import accounts, archetypes, health
from ..operators.standing import BANDS, RUNWAY
from . import frames
from .queries import as_text, query, rounded

TODAY = "DATE '1999-01-01'"


def today():
    return F.lit("1999-01-01").cast("date")


def timeline(spark, sf_dir):
    t = frames.timeline(spark, sf_dir)
    k, m = F.col("account_id"), F.month("month")
    return t.select("account_id", "month", "arr", F.when((k + m) % 9 != 0, (k * 7 + m * 13) % 101 / 1.0).alias("seat_utilisation_pct"), F.when((k + m) % 7 != 0, (k * 5 + m * 11) % 97 / 1.0).alias("active_user_pct"), F.when((k + m) % 5 != 0, (k * 3 + m * m) % 12).alias("tickets_opened"))


def snapshot(spark, sf_dir):
    k, day = F.col("c_custkey"), lambda n: F.date_add(today(), n.cast("int"))
    since = day(-(k * 37 % 2900))
    segment = F.get(F.array(*map(F.lit, ("Enterprise", "Mid-Market", "SMB", "Public"))), (k % 4).cast("int"))
    return frames.table(spark, sf_dir, "customer").select(
        k.alias("account_id"), F.col("c_name").alias("account_name"), segment.alias("segment"), F.col("c_mktsegment").alias("industry"), since.alias("customer_since"), F.date_add(since, F.when(k % 3 == 0, (k % 60)).otherwise(400).cast("int")).alias("contract_start"),
        F.when(k % 17 != 0, day(k * 13 % 1300 - 100)).alias("renewal_date"), F.when(k % 5 != 0, day(-(k * 7 % 600))).alias("last_qbr_date"), F.when(k % 7 != 0, k % 6 == 1).alias("overdue_flag"), F.when(k % 11 != 0, k * 3 % 30).alias("tickets_12mo"), F.when(k % 4 != 0, k * 11 % 101 / 1.0).alias("pct_high_priority"),
        F.when(k % 9 != 0, k * 29 % 1000 / 10).alias("seat_utilisation_pct"), F.when(k % 8 != 0, k * 31 % 1000 / 10).alias("active_user_pct"), F.when(k % 13 != 0, F.get(F.array(*map(F.lit, (12, 24, 36, 10))), (k % 4).cast("int"))).alias("term_length_months"),
        F.lit(None).cast("double").alias("entry_arr"), F.when(k % 10 != 3, F.abs("c_acctbal")).alias("current_arr"), F.col("c_acctbal").alias("avg_monthly_revenue_6mo"), F.lit(None).cast("double").alias("total_revenue_36mo"),
    )


def _places(x, n):
    """Rounded as health.to_places does: a decimal of nine places, halves away from zero."""
    return f"round(({x})::DECIMAL(38, 9), {n})::DOUBLE"


TIMELINE = f"""SELECT account_id, month, arr, CASE WHEN (account_id + month(month)) % 9 <> 0 THEN ((account_id * 7 + month(month) * 13) % 101)::DOUBLE END AS seat_utilisation_pct,
    CASE WHEN (account_id + month(month)) % 7 <> 0 THEN ((account_id * 5 + month(month) * 11) % 97)::DOUBLE END AS active_user_pct, CASE WHEN (account_id + month(month)) % 5 <> 0 THEN (account_id * 3 + month(month) * month(month)) % 12 END AS tickets_opened FROM ({frames.TIMELINE})"""
SINCE = f"({TODAY} - (c_custkey * 37 % 2900)::INT)"
SNAPSHOT = f"""SELECT c_custkey AS account_id, c_name AS account_name, (['Enterprise', 'Mid-Market', 'SMB', 'Public'])[c_custkey % 4 + 1] AS segment, c_mktsegment AS industry, {SINCE} AS customer_since,
    {SINCE} + (CASE WHEN c_custkey % 3 = 0 THEN c_custkey % 60 ELSE 400 END)::INT AS contract_start, CASE WHEN c_custkey % 17 <> 0 THEN {TODAY} + (c_custkey * 13 % 1300 - 100)::INT END AS renewal_date,
    CASE WHEN c_custkey % 5 <> 0 THEN {TODAY} - (c_custkey * 7 % 600)::INT END AS last_qbr_date, CASE WHEN c_custkey % 7 <> 0 THEN c_custkey % 6 = 1 END AS overdue_flag, CASE WHEN c_custkey % 11 <> 0 THEN c_custkey * 3 % 30 END AS tickets_12mo,
    CASE WHEN c_custkey % 4 <> 0 THEN (c_custkey * 11 % 101)::DOUBLE END AS pct_high_priority, CASE WHEN c_custkey % 9 <> 0 THEN (c_custkey * 29 % 1000)::DOUBLE / 10 END AS seat_utilisation_pct, CASE WHEN c_custkey % 8 <> 0 THEN (c_custkey * 31 % 1000)::DOUBLE / 10 END AS active_user_pct,
    CASE WHEN c_custkey % 13 <> 0 THEN ([12, 24, 36, 10])[c_custkey % 4 + 1] END AS term_length_months, NULL::DOUBLE AS entry_arr, CASE WHEN c_custkey % 10 <> 3 THEN abs(c_acctbal) END AS current_arr, c_acctbal AS avg_monthly_revenue_6mo, NULL::DOUBLE AS total_revenue_36mo FROM customer"""
BACK = f"SELECT *, row_number() OVER (PARTITION BY account_id ORDER BY month DESC) AS k FROM ({TIMELINE})"
OVERRIDES = f"""SELECT s.* EXCLUDE (entry_arr, current_arr, avg_monthly_revenue_6mo, total_revenue_36mo), round(coalesce(h.l, s.current_arr, coalesce(s.avg_monthly_revenue_6mo, 0) * 12), 2) AS current_arr, coalesce(round(h.f, 2), s.entry_arr) AS entry_arr,
    CASE WHEN h.b > 0 AND h.n >= 2 THEN {_places('(h.l - h.b) / h.b * 100', 1)} END AS arr_trend_pct, CASE WHEN h.n >= 2 THEN round(h.l - h.b, 2) END AS arr_change_dollars, coalesce({_places('h.six / 12', 2)}, s.avg_monthly_revenue_6mo) AS avg_monthly_revenue_6mo, coalesce({_places('h.whole / 12', 2)}, s.total_revenue_36mo) AS total_revenue_36mo
    FROM ({SNAPSHOT}) s LEFT JOIN (SELECT account_id, count(*) AS n, arg_max(arr, month) AS l, arg_min(arr, month) AS f, arg_max(arr, k) FILTER (k <= 13) AS b, avg(arr) FILTER (k <= 6) AS six, sum(arr) FILTER (k <= 36) AS whole FROM ({BACK}) GROUP BY 1) h USING (account_id)"""


def book(spark, sf_dir, t=None):
    return health.timeline_overrides(snapshot(spark, sf_dir), t or timeline(spark, sf_dir))


@query(f"SELECT account_id, current_arr, entry_arr, arr_trend_pct, arr_change_dollars, {_places('avg_monthly_revenue_6mo', 1)} AS avg_monthly_revenue_6mo, {_places('total_revenue_36mo', 1)} AS total_revenue_36mo FROM ({OVERRIDES})")
def a3_timeline_overrides(spark, sf_dir):
    return book(spark, sf_dir).select("account_id", "current_arr", "entry_arr", "arr_trend_pct", "arr_change_dollars", health.to_places(F.col("avg_monthly_revenue_6mo"), 1).alias("avg_monthly_revenue_6mo"), health.to_places(F.col("total_revenue_36mo"), 1).alias("total_revenue_36mo"))


@query(f"""SELECT account_id, CASE WHEN n >= 2 AND a > 0 THEN {_places('(z - a) / a * 100', 1)} END AS usage_trend_pct FROM (SELECT account_id, count(seat_utilisation_pct) AS n, arg_min(seat_utilisation_pct, month) FILTER (seat_utilisation_pct IS NOT NULL) AS a,
    arg_max(seat_utilisation_pct, month) FILTER (seat_utilisation_pct IS NOT NULL) AS z FROM ({BACK}) WHERE k <= 13 GROUP BY 1)""")
def a4_usage_trend(spark, sf_dir):
    return health.usage_trend(timeline(spark, sf_dir))


FIELDS = {"arr": "arr", "utilisation": "seat_utilisation_pct", "active_users": "active_user_pct", "tickets": "tickets_opened"}
_FIT = ", ".join(f"count({c}) AS {f}_c, regr_slope({c}::DOUBLE, x) AS {f}_s, greatest(0.0, regr_r2({c}::DOUBLE, x)) AS {f}_q" for f, c in FIELDS.items())
_OK = {f: f"({f}_c >= 2 AND {f}_s IS NOT NULL AND NOT isnan({f}_s))" for f in FIELDS}
_YEARLY = {f: f"{f}_s * 12" for f in FIELDS} | {"arr": "CASE WHEN level IS NULL THEN 0.0 ELSE arr_s * 12 / level * 100 END"}
_OUT = ", ".join(f"CASE WHEN {_OK[f]} THEN {_places(_YEARLY[f], 2)} + 0.0::DOUBLE END AS {f}_change, CASE WHEN {_OK[f]} THEN {_places(f'{f}_q', 3)} END AS {f}_r2, CASE WHEN {_OK[f]} THEN {f}_c END AS {f}_n" for f in FIELDS)
_COVERED = " + ".join(f"(CASE WHEN {_OK[f]} THEN {f}_c ELSE 0 END)" for f in FIELDS)
TRAJECTORY = f"""SELECT *, CASE WHEN eligible THEN 1.0::DOUBLE ELSE {_places('least(0.5::DOUBLE, confidence / 100)', 3)} END AS strength FROM (SELECT account_id, n, span_months, {_OUT}, {_places(f'100 * (0.6::DOUBLE * least(span_months / 12, 1.0::DOUBLE) + 0.4::DOUBLE * (({_COVERED})::DOUBLE / n / 4))', 1)} AS confidence,
    span_months >= 12 AND n >= 10 AND ({" + ".join(f"{_OK[f]}::INT" for f in FIELDS)}) >= 2 AS eligible FROM (SELECT account_id, count(*) AS n, (max(x) - min(x))::INT AS span_months, median(arr) FILTER (arr > 0) AS level, {_FIT}
    FROM (SELECT *, (year(month) * 12 + month(month))::DOUBLE AS x FROM ({BACK}) WHERE k <= 13) GROUP BY 1) WHERE n >= 2)"""


@query(TRAJECTORY)
def a6_trajectory_evidence(spark, sf_dir):
    return health.trajectory(timeline(spark, sf_dir))


@query(f"SELECT account_id, utilisation_change AS annual_change, utilisation_r2 AS r_squared, utilisation_n AS observations FROM ({TRAJECTORY}) WHERE utilisation_n IS NOT NULL")
def a5_linear_trend(spark, sf_dir):
    return health.linear_trend(timeline(spark, sf_dir), "utilisation")


def _ramp(x, none, whole, most):
    return f"coalesce(CASE WHEN {x} <= {none} THEN 0.0::DOUBLE WHEN {x} >= {whole} THEN {most}::DOUBLE ELSE {most}::DOUBLE * ({x} - {none}) / ({whole} - {none}) END, 0)"


def _fall(x, whole, none, most):
    return f"coalesce(CASE WHEN {x} >= {none} THEN 0.0::DOUBLE WHEN {x} <= {whole} THEN {most}::DOUBLE ELSE {most}::DOUBLE * ({none} - {x}) / ({none} - {whole}) END, 0)"


def _limit(k):
    return "(CASE segment " + " ".join(f"WHEN '{s}' THEN {v[k]}" for s, v in health.LIMITS.items()) + f" ELSE {health.LIMITS[health.OTHER_SEGMENT][k]} END)"


def _listed(items):
    """Signals above zero, largest first, as text."""
    return "array_to_string(list_transform(list_sort(list_filter([" + ", ".join(f"{{'v': -({v})::DOUBLE, 'k': {k}, 's': {n}}}" for k, (n, v) in enumerate(items)) + "], lambda x: x.v < 0)), lambda x: x.s || ':' || (-x.v)::VARCHAR), ';')"


DAYS = f"""SELECT *, date_diff('day', {TODAY}, renewal_date) AS days_to_renewal, date_diff('day', customer_since, {TODAY}) AS tenure_days, last_qbr_date IS NULL AS qbr_inferred,
    greatest(0, coalesce(date_diff('day', last_qbr_date, {TODAY}), date_diff('day', customer_since, {TODAY}))) AS days_since_qbr FROM ({OVERRIDES})"""
_LONG = "(CASE WHEN tenure_days >= 1825 THEN 8.0 WHEN tenure_days >= 1095 THEN 5.0 WHEN tenure_days >= 365 THEN 2.0 ELSE 0.0 END)::DOUBLE"
_STRONG = [("'Strong seat utilisation'", "(CASE WHEN seat_utilisation_pct >= 80 THEN 2.0 ELSE 0.0 END)"), ("'Strong active-user rate'", "(CASE WHEN active_user_pct >= 70 THEN 2.0 ELSE 0.0 END)"), ("'Customer longevity'", _LONG)]
_DEDUCT = [("CASE WHEN qbr_inferred THEN 'No QBR recorded' ELSE 'QBR overdue' END", "d1"), ("'Payment overdue'", "d2"), ("'Support load'", "d3"), ("'Low seat utilisation'", "d4"), ("'Low active-user rate'", "d5"), ("term_length_months || '-month contract'", "d6")]
_GAIN = [("'Recent QBR'", "(CASE WHEN NOT qbr_inferred AND d1 = 0 THEN 2.0 ELSE 0.0 END)"), *_STRONG]
_SUM = lambda items: "(" + " + ".join(v for _, v in items) + ")"
BAND = "CASE WHEN score <= 50 THEN 'Critical' WHEN score <= 75 THEN 'Watch' ELSE 'Healthy' END"
_SCORED = f"""greatest(0.0::DOUBLE, least(100.0::DOUBLE, 100 - {_SUM(_DEDUCT)} * ((CASE WHEN days_to_renewal <= 183 THEN 1.25 WHEN days_to_renewal <= 548 THEN 1.10 ELSE 1.0 END)::DOUBLE
    * (CASE WHEN tenure_days < 180 THEN 1.15 ELSE 1.0 END)::DOUBLE * (CASE WHEN arr_trend_pct < -5 THEN 1.15 ELSE 1.0 END)::DOUBLE) + {_SUM(_GAIN)}))"""
_COMPLETE = "((last_qbr_date IS NOT NULL)::INT + (overdue_flag IS NOT NULL)::INT + (tickets_12mo IS NOT NULL)::INT + (seat_utilisation_pct IS NOT NULL)::INT + (active_user_pct IS NOT NULL)::INT + (term_length_months IS NOT NULL)::INT)::DOUBLE / 6 * 100"
COMPASS = f"""SELECT *, {BAND} AS band FROM (SELECT *, {_places(_SCORED, 1)} AS score, {_listed([(n, _places(v, 1)) for n, v in _DEDUCT])} AS drivers, {_listed(_GAIN)} AS strengths, {_SUM(_GAIN)}::DOUBLE AS positive_points,
    {_places(_COMPLETE, 1)} AS data_completeness
    FROM (SELECT *, {_ramp("days_since_qbr", _limit(0), _limit(1), 25)} AS d1, CASE WHEN overdue_flag THEN 20.0::DOUBLE ELSE 0.0::DOUBLE END AS d2, {_ramp("tickets_12mo", _limit(2), _limit(3), 15)} * coalesce(1 + pct_high_priority / 100 * 0.5::DOUBLE, 1.0::DOUBLE) AS d3,
        {_fall("seat_utilisation_pct", 20, 70, 15)} AS d4, {_fall("active_user_pct", 15, 60, 10)} AS d5,
        (CASE WHEN term_length_months <= 12 THEN 15.0 WHEN term_length_months <= 24 AND NOT abs(date_diff('day', customer_since, contract_start)) <= 45 THEN 6.0 ELSE 0.0 END)::DOUBLE AS d6 FROM ({DAYS})))"""
SCORE = "account_id, score, band, data_completeness, drivers, strengths, positive_points"


def shown(df):
    return df.select("account_id", "score", "band", "data_completeness", health.listed(F.col("drivers")).alias("drivers"), health.listed(F.col("strengths")).alias("strengths"), "positive_points")


@query(f"SELECT {SCORE} FROM ({COMPASS})")
def a14_score_signal_compass(spark, sf_dir):
    return shown(health.signal_compass(book(spark, sf_dir), today()))


_LATE = "(days_since_qbr > 180)"
_PLAIN = [("CASE WHEN qbr_inferred THEN 'No QBR recorded' ELSE 'QBR over 180 days ago' END", f"(CASE WHEN {_LATE} THEN 20.0 ELSE 0.0 END)"), ("'Payment overdue'", "(CASE WHEN overdue_flag THEN 20.0 ELSE 0.0 END)"), ("'Seat utilisation below 50%'", "(CASE WHEN seat_utilisation_pct < 50 THEN 10.0 ELSE 0.0 END)"), ("'Active-user rate below 40%'", "(CASE WHEN active_user_pct < 40 THEN 10.0 ELSE 0.0 END)"), ("'12-month contract'", "(CASE WHEN term_length_months <= 12 THEN 15.0 ELSE 0.0 END)"), ("'24-month contract'", "(CASE WHEN term_length_months > 12 AND term_length_months <= 24 THEN 5.0 ELSE 0.0 END)"), ("'Renewal within 6 months'", "(CASE WHEN days_to_renewal <= 183 THEN 10.0 ELSE 0.0 END)")]
_PLAIN_GAIN = [("'Recent QBR'", f"(CASE WHEN NOT {_LATE} AND NOT qbr_inferred THEN 2.0 ELSE 0.0 END)"), *_STRONG]


@query(f"""SELECT account_id, score, {BAND} AS band, raw_deduction, model_adjustment, drivers, strengths FROM (SELECT account_id, round(greatest(0.0::DOUBLE, least(100.0::DOUBLE, 100 - {_SUM(_PLAIN)} + {_SUM(_PLAIN_GAIN)})), 1) AS score, {_SUM(_PLAIN)}::DOUBLE AS raw_deduction, {_SUM(_PLAIN_GAIN)}::DOUBLE AS model_adjustment,
    {_listed(_PLAIN)} AS drivers, {_listed(_PLAIN_GAIN)} AS strengths FROM ({DAYS}))""")
def a15_score_plain_pulse(spark, sf_dir):
    return health.plain_pulse(book(spark, sf_dir), today()).select("account_id", "score", "band", "raw_deduction", "model_adjustment", health.listed(F.col("drivers")).alias("drivers"), health.listed(F.col("strengths")).alias("strengths"))


_PART = lambda x, w: f"greatest(0.0::DOUBLE, least(1.0::DOUBLE, abs({x}) / {w}))"
_PARTS = [
    f"CASE WHEN u < 0 THEN -8 * {_PART('u', 20)} END", f"CASE WHEN arr_change < 0 THEN -6 * {_PART('arr_change', 25)} END", f"CASE WHEN tickets_change > 0 THEN -3 * {_PART('tickets_change', 12)} END", f"CASE WHEN arr_change >= -2 AND u <= -8 THEN -4 * {_PART('u', 20)} END",
    f"CASE WHEN arr_change >= 10 AND u <= 2 AND NOT (arr_change >= -2 AND u <= -8) THEN -3 * {_PART('arr_change', 25)} END", f"CASE WHEN arr_change >= 10 AND u >= 8 THEN 4 * least({_PART('arr_change', 25)}, {_PART('u', 20)}) END",
]
_RAW = " + ".join(f"p{k}" for k in range(6))
_BOUNDED = f"greatest(-20.0::DOUBLE, least(8.0::DOUBLE, {_RAW}))"
HORIZON = f"""SELECT account_id, signal_compass_score, trajectory_adjustment, score, {BAND} AS band FROM (SELECT account_id, score AS signal_compass_score, {_places(_BOUNDED, 1)} AS trajectory_adjustment,
    {_places(f'greatest(0.0::DOUBLE, least(100.0::DOUBLE, score + {_BOUNDED}))', 1)} AS score FROM (SELECT account_id, score, {", ".join(f"coalesce({_places(f'({p}) * strength', 1)}, 0) AS p{k}" for k, p in enumerate(_PARTS))}
    FROM (SELECT c.account_id, c.score, t.arr_change, t.tickets_change, t.strength, CASE WHEN t.utilisation_change IS NOT NULL AND t.active_users_change IS NOT NULL THEN (t.utilisation_change + t.active_users_change) / 2 ELSE coalesce(t.utilisation_change, t.active_users_change) END AS u
    FROM ({COMPASS}) c LEFT JOIN ({TRAJECTORY}) t USING (account_id))))"""


@query(HORIZON)
def a16_score_retention_horizon(spark, sf_dir):
    t = timeline(spark, sf_dir)
    return health.retention_horizon(book(spark, sf_dir), health.trajectory(t), today()).select("account_id", "signal_compass_score", "trajectory_adjustment", "score", "band")


EVIDENCE = f"""SELECT account_id, n, usage_n, span_months, eligible, CASE WHEN a0 > 0 THEN round(100 * (a1 - a0) / a0, 1) END AS arr_change_pct, round(u1 - u0, 1) AS usage_change_pp FROM (SELECT account_id, n, usage_n, span_months, eligible, CASE WHEN eligible THEN list_aggregate(a[1:3], 'median') ELSE a[1] END AS a0,
    CASE WHEN eligible THEN list_aggregate(a[-3:], 'median') ELSE a[-1] END AS a1, CASE WHEN eligible THEN list_aggregate(u[1:3], 'median') ELSE u[1] END AS u0, CASE WHEN eligible THEN list_aggregate(u[-3:], 'median') ELSE u[-1] END AS u1
    FROM (SELECT *, span_months >= 12 AND n >= 10 AND usage_n >= 8 AS eligible FROM (SELECT account_id, count(*) AS n, count(seat_utilisation_pct) AS usage_n, date_diff('month', min(month), max(month))::INT AS span_months, list(arr ORDER BY month) AS a,
    list(seat_utilisation_pct ORDER BY month) FILTER (seat_utilisation_pct IS NOT NULL) AS u FROM ({BACK}) WHERE k <= 13 GROUP BY 1) WHERE n >= 2 AND usage_n >= 2))"""
_RULES = [("arr_change_pct IS NULL", "standard", "ARR baseline cannot support a percentage comparison"), ("eligible AND arr_change_pct >= -2 AND usage_change_pp <= -10", "attention", "Silent usage decline while ARR is holding"), ("eligible AND arr_change_pct >= 20 AND usage_change_pp <= 2", "attention", "ARR expansion without matching adoption"), ("eligible AND arr_change_pct <= -10 AND usage_change_pp <= -5", "attention", "ARR and usage are both materially declining"), ("eligible AND arr_change_pct >= 10 AND usage_change_pp >= 10", "acceleration", "Twelve-month ARR and usage acceleration"), ("NOT eligible AND n >= 4 AND arr_change_pct >= 10 AND usage_change_pp >= 10", "acceleration", "Early acceleration; twelve-month eligibility not yet reached")]
_CASE = lambda i, other: "CASE " + " ".join(f"WHEN {r[0]} THEN '{r[i]}'" for r in _RULES) + f" ELSE '{other}' END"
ATTENTION = f"SELECT *, {_CASE(1, 'standard')} AS attention_state, {_CASE(2, 'Movement remains within the material attention thresholds')} AS attention_reason FROM ({EVIDENCE})"


def evidence(spark, sf_dir):
    return accounts.trend_evidence(timeline(spark, sf_dir), "seat_utilisation_pct")


@query(f"SELECT account_id, arr_change_pct, usage_change_pp, eligible, attention_state, attention_reason FROM ({ATTENTION})")
def a8_attention_signal(spark, sf_dir):
    return health.attention(evidence(spark, sf_dir)).select("account_id", "arr_change_pct", "usage_change_pp", "eligible", "attention_state", "attention_reason")


@query(f"SELECT account_id, account_name, arr_change_pct AS arr_trend, usage_change_pp AS usage_trend, attention_state, attention_reason, current_arr AS arr, eligible, n AS observation_count, span_months FROM ({ATTENTION}) JOIN ({OVERRIDES}) USING (account_id) WHERE arr_change_pct IS NOT NULL")
def a28_usage_arr_divergence(spark, sf_dir):
    return health.usage_arr_divergence(book(spark, sf_dir), evidence(spark, sf_dir))


@query(f"""SELECT account_id, attention_state, current_arr, array_to_string(months, ',') AS months, array_to_string(usage, ',') AS usage, row_number() OVER (ORDER BY CASE attention_state WHEN 'attention' THEN 0 WHEN 'acceleration' THEN 1 ELSE 2 END, current_arr DESC, account_name, account_id) AS place
FROM (SELECT o.account_id, o.account_name, o.current_arr, coalesce(a.attention_state, 'standard') AS attention_state, t.months, t.usage FROM ({OVERRIDES}) o JOIN (SELECT account_id, list(strftime(month, '%Y-%m') ORDER BY month) AS months, list(coalesce(seat_utilisation_pct::INT::VARCHAR, '-') ORDER BY month) AS usage FROM ({TIMELINE}) GROUP BY 1) t USING (account_id) LEFT JOIN ({ATTENTION}) a USING (account_id))""")
def a29_account_journeys(spark, sf_dir):
    t = timeline(spark, sf_dir)
    df = health.account_journeys(book(spark, sf_dir), t, evidence(spark, sf_dir))
    return df.select("account_id", "attention_state", "current_arr", F.array_join("months", ",").alias("months"), F.array_join(F.transform("usage", lambda x: F.coalesce(x.cast("int").cast("string"), F.lit("-"))), ",").alias("usage"), "place")


@query(f"""SELECT month, round(sum(s * greatest(arr, 0.01)) / sum(greatest(arr, 0.01)), 4) AS health FROM (SELECT month, arr, greatest(0.0, least(100.0, 100 - (CASE WHEN b <= 0 THEN 0 WHEN arr / b < 1 THEN {_fall("(arr / b)", 0.7, 1.0, 20)} WHEN arr / b > 1.08 THEN -least(5.0, (arr / b - 1.08) * 20) ELSE 0 END
    + {_fall("seat_utilisation_pct", 30, 85, 25)} + {_fall("active_user_pct", 20, 75, 20)} + {_ramp("tickets_opened", 1, 8, 15)}))) AS s
    FROM (SELECT *, coalesce(avg(arr) OVER (PARTITION BY account_id ORDER BY month ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING), arr) AS b FROM ({TIMELINE}))) GROUP BY 1""")
def a11_health_trend(spark, sf_dir):
    return rounded(health.health_trend(timeline(spark, sf_dir)), 4)


@query(f"SELECT month, round(sum(arr), 2) AS arr, count_if(arr > 0)::BIGINT AS active FROM ({TIMELINE}) GROUP BY 1")
def a9_arr_series(spark, sf_dir):
    return rounded(accounts.arr_series(timeline(spark, sf_dir)), 2)


SERIES = f"SELECT month, sum(arr) AS arr FROM ({TIMELINE}) GROUP BY 1"
_PER_BAND = ", ".join(f"count_if(band = '{b}')::BIGINT AS {b.lower()}_count, round(coalesce(sum(current_arr) FILTER (band = '{b}'), 0), 1) AS {b.lower()}_arr" for _, b in BANDS)


@query(f"""WITH b AS ({COMPASS}), s AS (SELECT * FROM ({SERIES}) ORDER BY month DESC LIMIT 13)
SELECT round(avg(score), 4) AS health_unweighted, round(sum(score * current_arr) / sum(current_arr), 4) AS health_weighted, round(avg(data_completeness), 4) AS data_completeness, round(sum(current_arr), 1) AS total_arr, count(*) AS account_count, round(avg(current_arr), 3) AS avg_arr,
    round(sum(current_arr) FILTER (days_to_renewal <= 183), 1) AS immediate_arr, count_if(days_to_renewal <= 183)::BIGINT AS immediate_count, round(sum(current_arr) FILTER (days_to_renewal <= 548), 1) AS planning_arr, round(sum(current_arr) FILTER (coalesce(term_length_months, 0) <= 12), 1) AS one_year_arr,
    round(sum(current_arr) FILTER (tenure_days >= 1825), 1) AS established_arr, count_if(tenure_days >= 1825)::BIGINT AS established_count, {_PER_BAND}, round(sum(current_arr) FILTER (band <> 'Healthy'), 1) AS critical_watch_arr, round(100 * sum(current_arr) FILTER (days_to_renewal <= 548) / sum(current_arr), 4) AS planning_pct,
    round(100 * (SELECT sum(current_arr) FROM (SELECT current_arr FROM b ORDER BY current_arr DESC LIMIT 5)) / sum(current_arr), 4) AS top5_share, round((SELECT arg_max(arr, month) - arg_min(arr, month) FROM s), 1) AS arr_change, round((SELECT 100 * (arg_max(arr, month) - arg_min(arr, month)) / arg_min(arr, month) FROM s), 4) AS arr_change_pct,
    round(100 * sum(current_arr) FILTER (band <> 'Healthy') / sum(current_arr), 4) AS critical_watch_pct FROM b""")
def a18_kpi(spark, sf_dir):
    t = timeline(spark, sf_dir)
    one = health.kpi(health.signal_compass(book(spark, sf_dir), today()), accounts.arr_series(t))
    places = {c: 1 for c in one.columns if c.endswith("_arr") or c == "arr_change"} | {"avg_arr": 3}
    return one.select(*[F.round(c, places.get(c, 4)).alias(c) if kind == "double" else F.col(c) for c, kind in one.dtypes])


@query(f"""SELECT (['Gold', 'Silver', 'Bronze'])[t] AS tier, count(*) AS accounts, round(avg(current_arr), 2) AS average_arr, round(sum(current_arr), 1) AS total_arr, max(current_arr) AS highest_arr, min(current_arr) AS lowest_arr
FROM (SELECT current_arr, ntile(3) OVER (ORDER BY current_arr DESC, account_id) AS t FROM ({OVERRIDES})) GROUP BY 1""")
def a20_value_tiers(spark, sf_dir):
    return health.value_tiers(book(spark, sf_dir)).select("tier", "accounts", F.round("average_arr", 2).alias("average_arr"), F.round("total_arr", 1).alias("total_arr"), "highest_arr", "lowest_arr")


_RUN = "CASE WHEN days_to_renewal IS NULL THEN NULL " + " ".join(f"WHEN days_to_renewal <= {s[0]} THEN '{s[1]}'" for s in RUNWAY[:-1]) + f" ELSE '{RUNWAY[-1][1]}' END"


@query(f"SELECT account_id, account_name, days_since_qbr::INT AS days_since_qbr, round(current_arr, 2) AS arr, {_RUN} AS runway, days_to_renewal::INT AS days_to_renewal, score, qbr_inferred FROM ({COMPASS}) WHERE days_since_qbr IS NOT NULL")
def a25_qbr_coverage(spark, sf_dir):
    return health.qbr_coverage(health.signal_compass(book(spark, sf_dir), today()))


_MEAN2 = lambda a, b: f"CASE WHEN {a} IS NOT NULL AND {b} IS NOT NULL THEN ({a} + {b}) / 2 ELSE coalesce({a}, {b}) END"
FEATURES = f"""SELECT account_id, {_MEAN2("d.seat_utilisation_pct", "d.active_user_pct")} AS adoption_level, {_MEAN2("t.utilisation_change", "t.active_users_change")} AS adoption_momentum, t.arr_change AS arr_momentum, -(r.tickets + greatest(coalesce(t.tickets_change, 0), 0) / 6) AS support_position,
    CASE WHEN d.days_since_qbr IS NOT NULL THEN -least(d.days_since_qbr, 730)::DOUBLE END AS engagement_position FROM ({DAYS}) d JOIN (SELECT account_id, avg(tickets_opened) FILTER (k <= 3) AS tickets FROM ({BACK}) GROUP BY 1 HAVING count(*) >= 4) r USING (account_id) JOIN ({TRAJECTORY}) t USING (account_id)"""


def features(spark, sf_dir):
    t = written(timeline(spark, sf_dir))
    return archetypes.behaviour_features(health.with_days(book(spark, sf_dir, t), today()), t, health.trajectory(t))


@query(f"SELECT account_id, {', '.join(f'round({c}, 4) + 0.0 AS {c}' for c in archetypes.FEATURES)} FROM ({FEATURES})")
def a30_behaviour_features(spark, sf_dir):
    return rounded(features(spark, sf_dir), 4)


_STATS = ", ".join(f"median({c}) AS {c}_m, list_sort(list({c}) FILTER ({c} IS NOT NULL)) AS {c}_l, stddev_pop({c}) AS {c}_d" for c in archetypes.FEATURES)
_HALF = lambda c: f"(list_aggregate({c}_l[(len({c}_l) + 1) // 2 + 1:], 'median') - list_aggregate({c}_l[1:len({c}_l) // 2], 'median'))"
_SCALED = ", ".join(f"round(greatest(-3.0, least(3.0, (coalesce({c}, {c}_m) - {c}_m) / CASE WHEN {_HALF(c)} > 0 THEN {_HALF(c)} WHEN {c}_d > 0 THEN {c}_d ELSE 1 END)), 4) AS {c}" for c in archetypes.FEATURES)


@query(f"WITH f AS ({FEATURES}), s AS (SELECT {_STATS} FROM f) SELECT account_id, {_SCALED} FROM f, s")
def a31_robust_scale(spark, sf_dir):
    return rounded(archetypes.robust_scale(features(spark, sf_dir)), 4)


@query(None)
def a32_cluster_accounts(spark, sf_dir):
    """Iterative: no SQL. The tests compare it with plain Python."""
    return archetypes.cluster_accounts(archetypes.robust_scale(features(spark, sf_dir)))[0].select("account_id", "cluster")


@query(None)
def a33_archetype_profiles(spark, sf_dir):
    clusters, centres = archetypes.cluster_accounts(archetypes.robust_scale(features(spark, sf_dir)))
    return archetypes.archetype_profiles(clusters, centres, health.signal_compass(book(spark, sf_dir), today()).select("account_id", "current_arr", "score", "band"))


for _name in ("a9_arr_series", "a11_health_trend"):
    as_text(_name, ("month",))
