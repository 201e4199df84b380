"""The audit exports of a price market: what was known, what was predicted from it, and how it turned out, as text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.forecast import FEATURES
from ..operators.price import score_runs, skill
from ..operators.reviews import completed_origins

#: The market's zone, labels of the models, and the baseline of the skill.
ZONE = "+10:00"
LABELS = {"seasonal_naive": "Same as last week", "rolling_median": "Median of last 4 weeks", "temperature_adjusted": "Last week + temperature", "random_forest": "Random forest", "gradient_boosting": "Gradient boosting", "neural_network": "Neural network"}
BASELINE = "seasonal_naive"


def stamp(ts: Column) -> Column:
    return F.concat(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss"), F.lit(ZONE))


def fixed(value: Column, places: int = 2) -> Column:
    """A number with so many decimals, halves away from zero; null stays null, which is an empty field."""
    return F.round(value.cast("decimal(24,10)"), places).cast("string")


def significant(value: Column, digits: int = 6) -> Column:
    """A number rounded to so many digits, without zeros at its end or an exponent between 1e-4 and 1e15; null
    stays null."""
    size = F.floor(F.log10(F.abs(value))).cast("int")
    scale = F.pow(F.lit(10.0), digits - 1 - size)
    return F.when(value == 0, "0").when(value.isNotNull(), F.regexp_replace(F.format_string("%.9f", F.round(value * scale) / scale), r"\.?0+$", ""))


def in_order(df: DataFrame, *columns: str) -> DataFrame:
    """Files hold ranges of a region's rows, in order within and from one to the next."""
    return df.repartitionByRange("region", *columns).sortWithinPartitions("region", *columns)


def price_export(prices: DataFrame) -> DataFrame:
    """prices: region, ts, rrp, demand."""
    return in_order(prices.select(stamp(F.col("ts")).alias("interval_end_nem"), "region", fixed(F.col("rrp")).alias("rrp_aud_per_mwh"), fixed(F.col("demand")).alias("total_demand_mw")), "interval_end_nem")


def weather_export(weather: DataFrame) -> DataFrame:
    """weather: region, ts, kind, temperature. Observed and forecast side by side, and the error where there are both."""
    of = lambda kind: F.max(F.when(F.col("kind") == kind, F.col("temperature"))).alias(kind)
    wide = weather.groupBy("region", "ts").agg(of("observed"), of("forecast"))
    return in_order(wide.select(stamp(F.col("ts")).alias("interval_end_nem"), "region", fixed(F.col("observed")).alias("observed_c"), fixed(F.col("forecast")).alias("forecast_c"), fixed(F.col("forecast") - F.col("observed")).alias("forecast_minus_observed_c")), "interval_end_nem")


def feature_export(train: DataFrame) -> DataFrame:
    """train: the training matrix of one origin per region, as the learned models saw it."""
    return in_order(train.select(stamp(F.col("ts")).alias("interval_end_nem"), "region", *[significant(F.col(c)).alias(c) for c in FEATURES], fixed(F.col("rrp")).alias("target_rrp")), "interval_end_nem")


def label(model: Column) -> Column:
    names = F.create_map(*[F.lit(x) for pair in LABELS.items() for x in pair])
    return F.coalesce(F.try_element_at(names, model), model)


def forecast_export(runs: DataFrame, prices: DataFrame) -> DataFrame:
    """runs: region, model, origin, ts, predicted, temperature_source; each with its settled price, if there is one."""
    df = runs.join(prices.select("region", "ts", F.col("rrp").alias("_actual")), ["region", "ts"], "left")
    horizon = F.timestamp_diff("SECOND", F.col("origin"), F.col("ts")) / F.lit(86400.0)
    made = df.select(
        stamp(F.col("origin")).alias("issued_at_nem"), "region", F.col("model").alias("model_key"), label(F.col("model")).alias("model_label"), stamp(F.col("ts")).alias("target_interval_end_nem"), fixed(horizon, 4).alias("horizon_days"),
        fixed(F.col("predicted")).alias("predicted_rrp"), fixed(F.col("_actual")).alias("actual_rrp"), fixed(F.col("predicted") - F.col("_actual")).alias("predicted_minus_actual"), "temperature_source",
    )
    return in_order(made, "issued_at_nem", "model_key", "target_interval_end_nem")


def score_export(runs: DataFrame, prices: DataFrame) -> DataFrame:
    """Errors of each run whose horizon is over, and its skill against the baseline of the same origin."""
    settled = prices.where("rrp IS NOT NULL")
    done = completed_origins(runs, settled, "region", "origin", "ts").select("region", "origin")
    scored = score_runs(runs, settled, ["region", "model", "origin"], ["region", "ts"], "rrp").join(done, ["region", "origin"])
    safe = runs.groupBy("region", "model", "origin").agg(F.bool_and("leakage_safe").alias("_safe"))
    df = skill(scored, ["region", "origin"], "model", BASELINE).join(safe, ["region", "model", "origin"])
    made = df.select(
        stamp(F.col("origin")).alias("issued_at_nem"), "region", F.col("model").alias("model_key"), label(F.col("model")).alias("model_label"), F.col("n").cast("string").alias("intervals_scored"), fixed(F.col("mae")).alias("mae"), fixed(F.col("median_ae")).alias("median_ae"), fixed(F.col("max_ae")).alias("worst_interval"),
        fixed(F.col("skill") * 100).alias("skill_pct_vs_baseline"), F.when(F.col("_safe"), "yes").otherwise("no").alias("leakage_safe"),
    )
    return in_order(made, "issued_at_nem", "model_key")


def audit_exports(prices: DataFrame, weather: DataFrame, train: DataFrame, runs: DataFrame) -> dict[str, DataFrame]:
    """The five exports by name, for ingest.write_csv_exports. runs: the rows of a forecast ladder."""
    return {"prices": price_export(prices), "weather": weather_export(weather), "features": feature_export(train), "forecasts": forecast_export(runs, prices), "scores": score_export(runs, prices)}
