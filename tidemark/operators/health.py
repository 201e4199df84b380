"""Health of accounts: three scores with their reasons, evidence of direction, attention, and what is read off them.

An account row has account_id, segment, customer_since, contract_start, renewal_date, last_qbr_date, overdue_flag,
tickets_12mo, pct_high_priority, seat_utilisation_pct, active_user_pct, term_length_months and arr_trend_pct; a timeline
row has account_id, month, arr, seat_utilisation_pct, active_user_pct and tickets_opened. Any of them but the keys may be
null: a null input adds nothing to a score, and completeness says how many were there. `today` is a parameter throughout.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranking import positions, tile
from .standing import BANDS, RUNWAY, labelled

#: Days since a review and tickets a year at which deductions begin and are whole, by segment; others are as Mid-Market.
LIMITS = {"Enterprise": (90, 365, 4, 25), "Mid-Market": (120, 365, 2, 18), "SMB": (180, 540, 1, 12)}
OTHER_SEGMENT = "Mid-Market"
#: Whole deductions; ramps of usage (whole, none) and what a strong value gives; multipliers and their limits.
REVIEW, OVERDUE, SUPPORT, PRIORITY, SEATS, ACTIVE, ONE_YEAR, TWO_YEARS, SIGNALS = 25, 20, 15, 0.5, 15, 10, 15, 6, 6
SEAT_RAMP, ACTIVE_RAMP, SEAT_STRONG, ACTIVE_STRONG, STRENGTH = (20, 70), (15, 60), 80, 70, 2
SOON, PLANNED, NEW_DAYS, NEW_TERM_DAYS, DECLINE_PCT = 183, 548, 180, 45, -5.0
SOON_TIMES, PLANNED_TIMES, NEW_TIMES, DECLINE_TIMES = 1.25, 1.10, 1.15, 1.15
LONGEVITY = ((365 * 5, 8), (365 * 3, 5), (365, 2))
#: Fixed values of the adjustment by direction: largest parts, the changes at which they are whole, bounds of the sum.
ADJUST_LOW, ADJUST_HIGH = -20, 8
#: Fixed values of attention: percent of revenue and points of usage.
HOLDING, USAGE_DROP, EXPANDING, USAGE_CEILING, FALLING, USAGE_FALL, RISING, USAGE_RISE, EARLY_ROWS = -2.0, -10.0, 20.0, 2.0, -10.0, -5.0, 10.0, 10.0, 4
#: Fixed values of the monthly health: ramps and largest deductions of usage, activity and tickets; momentum.
SEATS_BY_MONTH, ACTIVE_BY_MONTH, TICKETS_BY_MONTH, MOMENTUM, LIFT_FROM, MOST_LIFT = (30, 85, 25), (20, 75, 20), (1, 8, 15), (0.70, 20), 1.08, 5.0


def to_places(value: Column, places: int) -> Column:
    """Rounded, halves away from zero. Nine places are taken first, so that a half which doubles miss by a hair is one."""
    return F.round(F.round(value, 9), places)


def rising(value: Column, none: Column | float, whole: Column | float, most: float) -> Column:
    """0 up to `none`, `most` from `whole` on, in proportion between."""
    lit = lambda x: x if isinstance(x, Column) else F.lit(x)
    part = F.lit(float(most)) * (value - lit(none)) / (lit(whole) - lit(none))
    return F.when(value <= lit(none), 0.0).when(value >= lit(whole), float(most)).when(value.isNotNull(), part)


def falling(value: Column, whole: float, none: float, most: float) -> Column:
    """`most` up to `whole`, 0 from `none` on, in proportion between."""
    return F.when(value >= none, 0.0).when(value <= whole, float(most)).when(value.isNotNull(), F.lit(float(most)) * (F.lit(none) - value) / (none - whole))


def clamp(value: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(float(low)), F.least(F.lit(float(high)), value))


def reasons(items: list[tuple[Column | str, Column]]) -> Column:
    """(signal, value) of the values above zero, largest first, equal ones in the order given."""
    lit = lambda x: x if isinstance(x, Column) else F.lit(x)
    all_of = F.array(*[F.struct((-v).cast("double").alias("_v"), F.lit(k).alias("_k"), lit(name).alias("signal"), v.cast("double").alias("value")) for k, (name, v) in enumerate(items)])
    return F.transform(F.array_sort(F.filter(all_of, lambda x: x["value"] > 0)), lambda x: F.struct(x["signal"].alias("signal"), x["value"].alias("value")))


def with_days(accounts: DataFrame, today: Column) -> DataFrame:
    """Adds days_to_renewal, tenure_days, qbr_inferred and days_since_qbr; a review that never was is as old as the account."""
    tenure, since = F.date_diff(today, "customer_since"), F.date_diff(today, "last_qbr_date")
    return accounts.withColumns({"days_to_renewal": F.date_diff("renewal_date", today), "tenure_days": tenure, "qbr_inferred": F.col("last_qbr_date").isNull(), "days_since_qbr": F.when(F.coalesce(since, tenure) > 0, F.coalesce(since, tenure)).when(F.coalesce(since, tenure).isNotNull(), 0)})


def longevity() -> Column:
    points = F.lit(0.0)
    for days, given in reversed(LONGEVITY):
        points = F.when(F.col("tenure_days") >= days, float(given)).otherwise(points)
    return points


def scored(df: DataFrame, score: Column, deductions: list, strengths: list) -> DataFrame:
    """Adds score (0 to 100, one place), band, drivers, strengths and positive_points."""
    out = df.withColumns({"score": to_places(clamp(score, 0, 100), 1), "drivers": reasons([(n, to_places(v, 1)) for n, v in deductions]), "strengths": reasons(strengths)})
    return out.withColumns({"band": labelled(F.col("score"), BANDS), "positive_points": F.round(F.aggregate("strengths", F.lit(0.0), lambda a, x: a + x["value"]), 1)})


def _zero(x: Column) -> Column:
    return F.coalesce(x, F.lit(0.0))


def signal_compass(accounts: DataFrame, today: Column) -> DataFrame:
    """Gradual deductions, times renewal, newness and decline, plus strengths. One row per row of accounts, with
    data_completeness (percent of six inputs present). Narrow."""
    df = with_days(accounts, today)
    segment = F.when(F.col("segment").isin(*LIMITS), F.col("segment")).otherwise(OTHER_SEGMENT)
    limit = lambda k: F.element_at(F.create_map(*[F.lit(x) for name, v in LIMITS.items() for x in (name, v[k])]), segment)
    df = df.withColumns({
        "_review": _zero(rising(F.col("days_since_qbr"), limit(0), limit(1), REVIEW)), "_overdue": F.when(F.col("overdue_flag"), float(OVERDUE)).otherwise(0.0),
        "_support": _zero(rising(F.col("tickets_12mo"), limit(2), limit(3), SUPPORT)) * F.coalesce(1 + F.col("pct_high_priority") / 100 * PRIORITY, F.lit(1.0)),
        "_seats": _zero(falling(F.col("seat_utilisation_pct"), *SEAT_RAMP, SEATS)), "_active": _zero(falling(F.col("active_user_pct"), *ACTIVE_RAMP, ACTIVE)),
        "_term": F.when(F.col("term_length_months") <= 12, float(ONE_YEAR)).when((F.col("term_length_months") <= 24) & ~F.coalesce(F.abs(F.date_diff("contract_start", "customer_since")) <= NEW_TERM_DAYS, F.lit(False)), float(TWO_YEARS)).otherwise(0.0),
    })
    given = lambda rule: F.when(rule, float(STRENGTH)).otherwise(0.0)
    strengths = [("Recent QBR", given(~F.col("qbr_inferred") & (F.col("_review") == 0) & F.col("days_since_qbr").isNotNull())), ("Strong seat utilisation", given(F.col("seat_utilisation_pct") >= SEAT_STRONG)), ("Strong active-user rate", given(F.col("active_user_pct") >= ACTIVE_STRONG)), ("Customer longevity", longevity())]
    deductions = [(F.when(F.col("qbr_inferred"), "No QBR recorded").otherwise("QBR overdue"), F.col("_review")), ("Payment overdue", F.col("_overdue")), ("Support load", F.col("_support")), ("Low seat utilisation", F.col("_seats")), ("Low active-user rate", F.col("_active")), (F.concat(F.col("term_length_months").cast("string"), F.lit("-month contract")), F.col("_term"))]
    deduction, positive = (sum(v for _, v in part[1:]) + part[0][1] for part in (deductions, strengths))
    renewal = F.when(F.col("days_to_renewal") <= SOON, SOON_TIMES).when(F.col("days_to_renewal") <= PLANNED, PLANNED_TIMES).otherwise(1.0)
    times = renewal * F.when(F.col("tenure_days") < NEW_DAYS, NEW_TIMES).otherwise(1.0) * F.when(F.col("arr_trend_pct") < DECLINE_PCT, DECLINE_TIMES).otherwise(1.0)
    inputs = ("last_qbr_date", "overdue_flag", "tickets_12mo", "seat_utilisation_pct", "active_user_pct", "term_length_months")
    df = df.withColumn("data_completeness", to_places(sum(F.col(c).isNotNull().cast("int") for c in inputs) / F.lit(SIGNALS) * 100, 1))
    return scored(df, 100 - deduction * times + positive, deductions, strengths).drop("_review", "_overdue", "_support", "_seats", "_active", "_term")


def plain_pulse(accounts: DataFrame, today: Column) -> DataFrame:
    """Fixed points at fixed limits. One row per row of accounts. Narrow."""
    df = with_days(accounts, today)
    points = lambda rule, n: F.when(rule, float(n)).otherwise(0.0)
    late = F.coalesce(F.col("days_since_qbr") > 180, F.lit(False))
    deductions = [
        (F.when(F.col("qbr_inferred"), "No QBR recorded").otherwise("QBR over 180 days ago"), points(late, 20)), ("Payment overdue", points(F.col("overdue_flag"), 20)), ("Seat utilisation below 50%", points(F.col("seat_utilisation_pct") < 50, 10)),
        ("Active-user rate below 40%", points(F.col("active_user_pct") < 40, 10)), ("12-month contract", points(F.col("term_length_months") <= 12, 15)), ("24-month contract", points((F.col("term_length_months") > 12) & (F.col("term_length_months") <= 24), 5)),
        ("Renewal within 6 months", points(F.col("days_to_renewal") <= SOON, 10)),
    ]
    strengths = [("Recent QBR", points(F.col("days_since_qbr").isNotNull() & ~late & ~F.col("qbr_inferred"), STRENGTH)), ("Strong seat utilisation", points(F.col("seat_utilisation_pct") >= SEAT_STRONG, STRENGTH)), ("Strong active-user rate", points(F.col("active_user_pct") >= ACTIVE_STRONG, STRENGTH)), ("Customer longevity", longevity())]
    deduction, positive = (sum(v for _, v in part[1:]) + part[0][1] for part in (deductions, strengths))
    df = df.withColumns({"raw_deduction": F.round(deduction, 1), "model_adjustment": F.round(positive, 1)})
    return scored(df, 100 - deduction + positive, deductions, strengths)


def trajectory(timeline: DataFrame, rows: int = 13) -> DataFrame:
    """Direction of revenue (percent of its median positive level a year), seats, active users and tickets (units a year)
    over the last `rows` rows of each account: straight lines through what is not null, in one grouping.

    Columns per field f: f_change, f_r2, f_n (nulls under two points or one month); n, span_months, confidence, eligible,
    strength. Accounts of one row are left out. Months are distinct per account.
    """
    back = F.row_number().over(Window.partitionBy("account_id").orderBy(F.col("month").desc()))
    window = timeline.withColumn("_k", back).where(F.col("_k") <= rows).withColumn("_x", (F.year("month") * 12 + F.month("month")).cast("double"))
    fields = {"arr": "arr", "utilisation": "seat_utilisation_pct", "active_users": "active_user_pct", "tickets": "tickets_opened"}
    found = [F.count("*").alias("n"), (F.max("_x") - F.min("_x")).cast("int").alias("span_months"), F.median(F.when(F.col("arr") > 0, F.col("arr"))).alias("_level")]
    for name, c in fields.items():
        y = F.col(c).cast("double")
        found += [F.count(c).alias(f"_{name}_n"), F.regr_slope(y, "_x").alias(f"_{name}_s"), F.regr_r2(y, "_x").alias(f"_{name}_r")]
    fit = window.groupBy("account_id").agg(*found).where("n >= 2")
    whole = lambda name: (F.col(f"_{name}_n") >= 2) & F.col(f"_{name}_s").isNotNull()
    yearly = {name: F.col(f"_{name}_s") * 12 for name in fields}
    yearly["arr"] = F.when(F.col("_level").isNotNull(), yearly["arr"] / F.col("_level") * 100).otherwise(0.0)
    out = []
    for name in fields:
        out += [F.when(whole(name), to_places(yearly[name], 2) + F.lit(0.0)).alias(f"{name}_change"), F.when(whole(name), to_places(F.greatest(F.lit(0.0), F.col(f"_{name}_r")), 3)).alias(f"{name}_r2"), F.when(whole(name), F.col(f"_{name}_n")).alias(f"{name}_n")]
    covered = sum(F.coalesce(F.when(whole(name), F.col(f"_{name}_n")), F.lit(0)) for name in fields) / F.col("n") / 4
    confidence = to_places(100 * (0.6 * F.least(F.col("span_months") / 12, F.lit(1.0)) + 0.4 * covered), 1)
    eligible = (F.col("span_months") >= 12) & (F.col("n") >= 10) & (sum(whole(name).cast("int") for name in fields) >= 2)
    made = fit.select("account_id", "n", "span_months", *out, confidence.alias("confidence"), eligible.alias("eligible"))
    return made.withColumn("strength", F.when(F.col("eligible"), 1.0).otherwise(to_places(F.least(F.lit(0.5), F.col("confidence") / 100), 3)))


def linear_trend(timeline: DataFrame, field: str, rows: int = 13) -> DataFrame:
    """account_id and of one field (arr, utilisation, active_users or tickets) the change a year, r2 and observations:
    the last `rows` rows are taken first, then their nulls are left out."""
    return trajectory(timeline, rows).select("account_id", F.col(f"{field}_change").alias("annual_change"), F.col(f"{field}_r2").alias("r_squared"), F.col(f"{field}_n").alias("observations")).where("observations IS NOT NULL")


def retention_horizon(accounts: DataFrame, evidence: DataFrame, today: Column) -> DataFrame:
    """signal_compass, adjusted by direction (rows of trajectory): parts times the evidence's strength, their sum bounded
    and the parts scaled to it. An account without evidence keeps its score."""
    base = signal_compass(accounts, today)
    e = evidence.select("account_id", F.col("arr_change").alias("_arr"), F.col("utilisation_change").alias("_u"), F.col("active_users_change").alias("_a"), F.col("tickets_change").alias("_t"), F.col("strength").alias("_strength"), F.col("confidence").alias("trajectory_confidence"))
    df = base.join(e, "account_id", "left").withColumn("_use", F.when(F.col("_u").isNotNull() & F.col("_a").isNotNull(), (F.col("_u") + F.col("_a")) / 2).otherwise(F.coalesce("_u", "_a")))
    arr, use, tickets = F.col("_arr"), F.col("_use"), F.col("_t")
    part = lambda x, whole: clamp(F.abs(x) / whole, 0, 1)
    diverging, unmatched = (arr >= -2) & (use <= -8), (arr >= 10) & (use <= 2)
    parts = [
        ("Falling adoption trajectory", F.when(use < 0, -8 * part(use, 20))), ("Declining ARR trajectory", F.when(arr < 0, -6 * part(arr, 25))), ("Rising support pressure", F.when(tickets > 0, -3 * part(tickets, 12))),
        ("ARR and adoption divergence", F.when(diverging, -4 * part(use, 20))), ("Expansion without adoption momentum", F.when(unmatched & ~diverging, -3 * part(arr, 25))),
        ("Confirmed ARR and adoption acceleration", F.when((arr >= 10) & (use >= 8), 4 * F.least(part(arr, 25), part(use, 20)))),
    ]
    df = df.withColumns({f"_p{k}": F.coalesce(to_places(v * F.col("_strength"), 1), F.lit(0.0)) for k, (_, v) in enumerate(parts)})
    total = sum((F.col(f"_p{k}") for k in range(1, len(parts))), F.col("_p0"))
    df = df.withColumn("_raw", total).withColumn("_bounded", clamp(F.col("_raw"), ADJUST_LOW, ADJUST_HIGH))
    scale = F.when((F.col("_raw") != 0) & (F.col("_bounded") != F.col("_raw")), F.col("_bounded") / F.col("_raw"))
    df = df.withColumns({f"_p{k}": F.when(scale.isNotNull(), to_places(F.col(f"_p{k}") * scale, 1)).otherwise(F.col(f"_p{k}")) for k in range(len(parts))})
    more = lambda sign: reasons([(name, F.greatest(F.lit(0.0), sign * F.col(f"_p{k}"))) for k, (name, _) in enumerate(parts)])
    ranked = lambda xs: F.transform(F.array_sort(F.transform(xs, lambda x, i: F.struct((-x["value"]).alias("v"), i.alias("i"), x.alias("x")))), lambda y: y["x"])
    df = df.withColumns({"signal_compass_score": F.col("score"), "trajectory_adjustment": to_places(F.col("_bounded"), 1), "trajectory_confidence": F.coalesce("trajectory_confidence", F.lit(0.0)), "score": to_places(clamp(F.col("score") + F.col("_bounded"), 0, 100), 1), "drivers": ranked(F.concat("drivers", more(-1))), "strengths": ranked(F.concat("strengths", more(1)))})
    df = df.withColumns({"band": labelled(F.col("score"), BANDS), "positive_points": F.round(F.aggregate("strengths", F.lit(0.0), lambda a, x: a + x["value"]), 1)})
    return df.drop("_arr", "_u", "_a", "_t", "_strength", "_use", "_raw", "_bounded", *[f"_p{k}" for k in range(len(parts))])


def listed(xs: Column) -> Column:
    """signal:value, semicolon-joined."""
    return F.array_join(F.transform(xs, lambda x: F.concat(x["signal"], F.lit(":"), x["value"].cast("string"))), ";")


def attention(evidence: DataFrame) -> DataFrame:
    """Adds attention_state and attention_reason to rows of accounts.trend_evidence."""
    arr, use, n = F.col("arr_change_pct"), F.col("usage_change_pp"), F.col("n")
    rules = [
        (arr.isNull(), "standard", "ARR baseline cannot support a percentage comparison"),
        (F.col("eligible") & (arr >= HOLDING) & (use <= USAGE_DROP), "attention", "Silent usage decline while ARR is holding"),
        (F.col("eligible") & (arr >= EXPANDING) & (use <= USAGE_CEILING), "attention", "ARR expansion without matching adoption"),
        (F.col("eligible") & (arr <= FALLING) & (use <= USAGE_FALL), "attention", "ARR and usage are both materially declining"),
        (F.col("eligible") & (arr >= RISING) & (use >= USAGE_RISE), "acceleration", "Twelve-month ARR and usage acceleration"),
        (~F.col("eligible") & (n >= EARLY_ROWS) & (arr >= RISING) & (use >= USAGE_RISE), "acceleration", "Early acceleration; twelve-month eligibility not yet reached"),
    ]
    state, reason = F.lit("standard"), F.lit("Movement remains within the material attention thresholds")
    for rule, s, r in reversed(rules):
        state, reason = F.when(rule, s).otherwise(state), F.when(rule, r).otherwise(reason)
    return evidence.withColumns({"attention_state": state, "attention_reason": reason})


def usage_arr_divergence(accounts: DataFrame, evidence: DataFrame) -> DataFrame:
    """Accounts with both changes of their evidence, and the attention that these ask for."""
    found = attention(evidence).where("arr_change_pct IS NOT NULL AND usage_change_pp IS NOT NULL")
    return accounts.select("account_id", "account_name", F.round("current_arr", 2).alias("arr")).join(found, "account_id").select("account_id", "account_name", F.col("arr_change_pct").alias("arr_trend"), F.col("usage_change_pp").alias("usage_trend"), "attention_state", "attention_reason", "arr", "eligible", F.col("n").alias("observation_count"), "span_months")


def account_journeys(accounts: DataFrame, timeline: DataFrame, evidence: DataFrame) -> DataFrame:
    """Per account with a timeline: its months, revenue and usage as arrays in order, and a place by attention, revenue
    and name. Arrays hold an account's months; the place is a global order, dealt by ranges, see ranking."""
    state = attention(evidence).select("account_id", "attention_state", "attention_reason")
    rows = timeline.groupBy("account_id").agg(F.array_sort(F.collect_list(F.struct("month", F.round("arr", 2).alias("arr"), F.col("seat_utilisation_pct").alias("usage")))).alias("_rows"))
    df = accounts.select("account_id", "account_name", F.round("current_arr", 2).alias("current_arr")).join(rows, "account_id").join(state, "account_id", "left").withColumns({"attention_state": F.coalesce("attention_state", F.lit("standard")), "attention_reason": F.coalesce("attention_reason", F.lit("Insufficient timeline evidence"))})
    rank = F.when(F.col("attention_state") == "attention", 0).when(F.col("attention_state") == "acceleration", 1).otherwise(2)
    order = [F.col("_rank").asc(), F.col("current_arr").desc(), F.col("account_name").asc(), F.col("account_id").asc()]
    place = positions(df.select("account_id", "account_name", "attention_state", "current_arr", rank.alias("_rank")), order, "_place")
    placed = df.join(place.select("account_id", (F.col("_place") + 1).cast("int").alias("place")), "account_id")
    series = {"months": F.transform("_rows", lambda x: F.date_format(x["month"], "yyyy-MM")), "arr": F.transform("_rows", lambda x: x["arr"]), "usage": F.transform("_rows", lambda x: x["usage"])}
    return placed.select("account_id", "account_name", "attention_state", "attention_reason", "current_arr", *[c.alias(n) for n, c in series.items()], "place")


def usage_trend(timeline: DataFrame, rows: int = 13) -> DataFrame:
    """Percent from the first to the last known usage among the last rows of each account; null under two or from zero."""
    back = F.row_number().over(Window.partitionBy("account_id").orderBy(F.col("month").desc()))
    held = timeline.withColumn("_k", back).where(F.col("_k") <= rows).groupBy("account_id").agg(F.count("seat_utilisation_pct").alias("n"), F.min_by("seat_utilisation_pct", F.when(F.col("seat_utilisation_pct").isNotNull(), F.col("month"))).alias("a"), F.max_by("seat_utilisation_pct", F.when(F.col("seat_utilisation_pct").isNotNull(), F.col("month"))).alias("z"))
    return held.select("account_id", F.when((F.col("n") >= 2) & (F.col("a") > 0), to_places((F.col("z") - F.col("a")) / F.col("a") * 100, 1)).alias("usage_trend_pct"))


def timeline_overrides(accounts: DataFrame, timeline: DataFrame) -> DataFrame:
    """Accounts whose money comes from their timeline where they have one: current_arr (last row), entry_arr (first),
    arr_trend_pct and arr_change_dollars (last against 12 rows before, or the first), avg_monthly_revenue_6mo and
    total_revenue_36mo. Others keep their own, current_arr by way of the legacy monthly value; null money is zero."""
    back = F.row_number().over(Window.partitionBy("account_id").orderBy(F.col("month").desc()))
    t = timeline.withColumn("_k", back)
    last = lambda n, f: f(F.when(F.col("_k") <= n, F.col("arr")))
    held = t.groupBy("account_id").agg(F.count("*").alias("_n"), F.max_by("arr", "month").alias("_last"), F.min_by("arr", "month").alias("_first"), F.max_by("arr", F.when(F.col("_k") <= 13, F.col("_k"))).alias("_before"), last(6, F.avg).alias("_six"), last(36, F.sum).alias("_all"))
    df = accounts.join(held, "account_id", "left")
    has = F.col("_n").isNotNull()
    change = F.when(F.col("_n") >= 2, F.col("_last") - F.col("_before"))
    own = F.coalesce(F.col("current_arr"), F.coalesce("avg_monthly_revenue_6mo", F.lit(0.0)) * 12)
    return df.withColumns({
        "current_arr": F.round(F.when(has, F.col("_last")).otherwise(own), 2), "entry_arr": F.when(has, F.round("_first", 2)).otherwise(F.col("entry_arr")), "arr_trend_pct": F.when(F.col("_before") > 0, to_places(change / F.col("_before") * 100, 1)), "arr_change_dollars": F.round(change, 2),
        "avg_monthly_revenue_6mo": F.when(has, to_places(F.col("_six") / 12, 2)).otherwise(F.col("avg_monthly_revenue_6mo")), "total_revenue_36mo": F.when(has, to_places(F.col("_all") / 12, 2)).otherwise(F.col("total_revenue_36mo")),
    }).drop("_n", "_last", "_first", "_before", "_six", "_all")


def health_trend(timeline: DataFrame) -> DataFrame:
    """Per month the health that revenue, usage, activity and tickets show, weighted by revenue. Momentum compares a row
    with the mean of the account's three rows before it. A null usage, activity or ticket count deducts nothing."""
    before = F.avg("arr").over(Window.partitionBy("account_id").orderBy("month").rowsBetween(-3, -1))
    df = timeline.withColumn("_before", F.coalesce(before, F.col("arr")))
    ratio = F.when(F.col("_before") > 0, F.col("arr") / F.col("_before"))
    momentum = F.when(ratio < 1, falling(ratio, MOMENTUM[0], 1.0, MOMENTUM[1])).when(ratio > LIFT_FROM, -F.least(F.lit(MOST_LIFT), (ratio - LIFT_FROM) * 20)).otherwise(0.0)
    used = _zero(falling(F.col("seat_utilisation_pct"), *SEATS_BY_MONTH)) + _zero(falling(F.col("active_user_pct"), *ACTIVE_BY_MONTH)) + _zero(rising(F.col("tickets_opened"), *TICKETS_BY_MONTH))
    weight = F.greatest(F.col("arr"), F.lit(0.01))
    return df.groupBy("month").agg((F.sum(clamp(100 - (momentum + used), 0, 100) * weight) / F.sum(weight)).alias("health"))


def kpi(book: DataFrame, series: DataFrame) -> DataFrame:
    """One row of the book's figures. book: scored accounts with current_arr; series: month and arr of the whole book.
    The largest five accounts come from a top-k, all else from one aggregate; an empty book has zeros and nulls."""
    arr = F.coalesce(F.col("current_arr"), F.lit(0.0))
    when = lambda rule, v: F.coalesce(F.sum(F.when(rule, v)), F.lit(0.0))
    found = [F.avg("score").alias("health_unweighted"), F.try_divide(F.sum(F.col("score") * arr), F.sum(arr)).alias("health_weighted"), F.avg("data_completeness").alias("data_completeness"), F.coalesce(F.sum(arr), F.lit(0.0)).alias("total_arr"), F.count("*").alias("account_count"), F.avg(arr).alias("avg_arr")]
    found += [when(F.col("days_to_renewal") <= SOON, arr).alias("immediate_arr"), F.count_if(F.col("days_to_renewal") <= SOON).alias("immediate_count"), when(F.col("days_to_renewal") <= PLANNED, arr).alias("planning_arr"), when(F.coalesce("term_length_months", F.lit(0)) <= 12, arr).alias("one_year_arr"), when(F.col("tenure_days") >= 365 * 5, arr).alias("established_arr"), F.count_if(F.col("tenure_days") >= 365 * 5).alias("established_count")]
    for _, band in BANDS:
        found += [F.count_if(F.col("band") == band).alias(f"{band.lower()}_count"), when(F.col("band") == band, arr).alias(f"{band.lower()}_arr")]
    top = book.select(arr.alias("_arr")).orderBy(F.col("_arr").desc()).limit(5).agg(F.sum("_arr").alias("_top"))
    recent = series.orderBy(F.col("month").desc()).limit(13).agg(F.count("*").alias("_months"), F.max_by("arr", "month").alias("_end"), F.min_by("arr", "month").alias("_start"))
    one = book.agg(*found).crossJoin(top).crossJoin(recent)  # one row each
    change = F.when(F.col("_months") >= 2, F.col("_end") - F.col("_start"))
    share = lambda c: F.coalesce(F.try_divide(100 * F.col(c), F.col("total_arr")), F.lit(0.0))
    one = one.withColumns({"critical_watch_arr": F.col("critical_arr") + F.col("watch_arr"), "planning_pct": share("planning_arr"), "top5_share": share("_top"), "arr_change": change, "arr_change_pct": F.when(F.col("_start") != 0, 100 * change / F.col("_start"))})
    return one.withColumn("critical_watch_pct", share("critical_watch_arr")).drop("_top", "_months", "_end", "_start")


def value_tiers(book: DataFrame, tiers: tuple[str, ...] = ("Gold", "Silver", "Bronze")) -> DataFrame:
    """Cohorts of equal size by revenue, larger ones first where the number does not divide: accounts, mean, sum, most and
    least. The order is global and dealt by ranges, see ranking; ties go by id."""
    rows = book.select("account_id", F.coalesce("current_arr", F.lit(0.0)).alias("arr"))
    placed = positions(rows, [F.col("arr").desc(), F.col("account_id").asc()], "_place", total="_total")
    placed = placed.select("arr", tile(F.col("_place"), F.col("_total"), len(tiers)).alias("_tier"))
    label = F.get(F.array(*map(F.lit, tiers)), F.col("_tier") - 1)
    return placed.groupBy(label.alias("tier")).agg(F.count("*").alias("accounts"), F.avg("arr").alias("average_arr"), F.sum("arr").alias("total_arr"), F.max("arr").alias("highest_arr"), F.min("arr").alias("lowest_arr"))


def qbr_coverage(book: DataFrame) -> DataFrame:
    """Accounts whose review has an age, with what hangs on it."""
    return book.where("days_since_qbr IS NOT NULL").select("account_id", "account_name", "days_since_qbr", F.round("current_arr", 2).alias("arr"), labelled(F.col("days_to_renewal"), RUNWAY).alias("runway"), "days_to_renewal", "score", "qbr_inferred")
