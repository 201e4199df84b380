"""A book of scored accounts: bands, contract runway, tenure, concentration, industries, priorities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bands by their largest score; runway by its last day, with what to do; tenure by its last day.
BANDS = ((50, "Critical"), (75, "Watch"), (100, "Healthy"))
RUNWAY = ((183, "0-6 months", "Immediate"), (548, "6-18 months", "Plan now"), (1095, "18-36 months", "Monitor"), (None, "36+ months", "Low timing pressure"))
TENURE = ((364, "<1 year"), (1094, "1-3 years"), (1824, "3-5 years"), (3649, "5-10 years"), (None, "10+ years"))
#: Days to renewal and the factor that they give a priority, the factor beyond, and years of a new term.
RENEWAL, LATER, NEW_TERM_YEARS = ((183, 2.0), (548, 1.5), (1095, 1.15)), 1.0, 3


def labelled(value: Column, steps: tuple) -> Column:
    """Label of the first step whose end the value does not pass; the last step is open; null stays null."""
    label = F.lit(steps[-1][1])
    for end, name, *_ in reversed(steps[:-1]):
        label = F.when(value <= end, name).otherwise(label)
    return F.when(value.isNotNull(), label)


def contract_value(arr: Column, term_months: Column) -> Column:
    return F.round(arr * F.coalesce(term_months, F.lit(0)) / 12, 2)


def with_all(found: DataFrame, label: str, steps: tuple, numbers: list[str]) -> DataFrame:
    """found with zero rows for the labels that it lacks."""
    dim = found.sparkSession.createDataFrame([(s[1],) for s in steps], f"{label} string")
    return dim.join(found, label, "left").select(label, *[F.coalesce(F.col(c), F.lit(0)).alias(c) for c in numbers])


def portfolio_health(book: DataFrame) -> DataFrame:
    """Mean score, weighted by revenue and plain; the weighted one is null without revenue."""
    return book.agg(F.try_divide(F.sum(F.col("score") * F.col("arr")), F.sum("arr")).alias("weighted_health"), F.avg("score").alias("plain_health"), F.count("*").alias("accounts"))


def health_distribution(book: DataFrame) -> DataFrame:
    """Accounts and revenue per band; every band has a row, accounts without a score have none."""
    found = book.groupBy(labelled(F.col("score"), BANDS).alias("band")).agg(F.count("*").alias("accounts"), F.sum("arr").alias("arr"))
    return with_all(found, "band", BANDS, ["accounts", "arr"])


def contract_runway(book: DataFrame) -> DataFrame:
    """Per time to renewal: accounts, revenue, its value over a new term, what is secured, and revenue on terms of a year
    or less. Accounts without a renewal day count nowhere; every step has a row."""
    arr = F.col("arr")
    found = book.where("days_to_renewal IS NOT NULL").groupBy(labelled(F.col("days_to_renewal"), RUNWAY).alias("runway")).agg(
        F.count("*").alias("accounts"), F.sum("arr").alias("arr"), (NEW_TERM_YEARS * F.sum("arr")).alias("resign_value"), F.sum(contract_value(arr, F.col("term_months"))).alias("secured_value"),
        F.sum(F.when(F.coalesce("term_months", F.lit(0)) <= 12, arr).otherwise(0.0)).alias("one_year_arr"),
    )
    return with_all(found, "runway", RUNWAY, ["accounts", "arr", "resign_value", "secured_value", "one_year_arr"])


def customer_tenure(book: DataFrame) -> DataFrame:
    """Accounts, revenue and contract value per tenure; every step has a row. Negative and null tenures count nowhere."""
    found = book.where("tenure_days >= 0").groupBy(labelled(F.col("tenure_days"), TENURE).alias("tenure")).agg(F.count("*").alias("accounts"), F.sum("arr").alias("arr"), F.sum(contract_value(F.col("arr"), F.col("term_months"))).alias("contract_value"))
    return with_all(found, "tenure", TENURE, ["accounts", "arr", "contract_value"])


def industry_portfolio(book: DataFrame, industry: str) -> DataFrame:
    """Accounts, revenue in all and by band, weighted health and the largest account's share, per industry."""
    band = labelled(F.col("score"), BANDS)
    of = lambda name: F.sum(F.when(band == name, F.col("arr")).otherwise(0.0)).alias(f"{name.lower()}_arr")
    health = F.coalesce(F.try_divide(F.sum(F.col("score") * F.col("arr")), F.sum("arr")), F.lit(0.0))
    largest = F.coalesce(F.try_divide(100 * F.max("arr"), F.sum("arr")), F.lit(0.0))
    return book.groupBy(industry).agg(F.count("*").alias("accounts"), F.sum("arr").alias("total_arr"), *[of(name) for _, name in BANDS], health.alias("health"), largest.alias("largest_share_pct"))


def customer_concentration(book: DataFrame, k: int = 50) -> DataFrame:
    """The k largest accounts with their contract value, their share and the share up to them. Spark takes the k by
    partial sorts; the running sum sees those only."""
    total = book.agg(F.sum("arr").alias("_all"))
    top = book.orderBy(F.col("arr").desc(), "account_id").limit(k).crossJoin(F.broadcast(total))
    return top.select(
        "account_id", "arr", contract_value(F.col("arr"), F.col("term_months")).alias("contract_value"), (100 * F.try_divide("arr", "_all")).alias("share_pct"),
        F.expr("100 * try_divide(sum(arr) OVER (ORDER BY arr DESC, account_id ROWS UNBOUNDED PRECEDING), _all)").alias("running_share_pct"))


def priority_accounts(book: DataFrame, k: int = 6) -> DataFrame:
    """The k accounts of highest revenue x missing health x nearness of renewal."""
    near = F.lit(LATER)
    for end, factor in reversed(RENEWAL):
        near = F.when(F.col("days_to_renewal") <= end, factor).otherwise(near)
    priority = F.col("arr") * F.greatest(F.lit(1.0), 100 - F.col("score")) * near
    return book.withColumns({"runway": F.coalesce(labelled(F.col("days_to_renewal"), RUNWAY), F.lit("Unknown")), "priority": priority}).orderBy(F.col("priority").desc(), "account_id").limit(k)
