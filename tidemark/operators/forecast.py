"""Week-ahead price forecasts over intervals stamped by their end: temperatures, pairs, features and models.

Frames: prices (region, ts, rrp, demand), weather (region, ts, kind, temperature), grid (region, origin, ts) of intervals
to be forecast, ts in (origin, origin + horizon]. Keys are unique in each. All origins run at once: nothing after an origin
enters its forecasts but temperatures that were forecast, or observed ones that are labelled so. Nulls in a key join
nothing; a null value counts as absent.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import trees
from ..functions.calendar import BANDS, time_band
from ..functions.storage import written
from .price import FLOOR, fit_betas

#: Comfort base of heating and cooling, weeks of history, lags in weeks, least rows to train on.
COMFORT, TRAINING_WEEKS, LAG_WEEKS, LEAST_TRAINING = 18.0, 52, (1, 2, 3, 4), 500
#: Sources of the temperatures of a forecast.
FORECAST, FALLBACK, NONE = "forecast", "observed-fallback", "none"
BAND_NAMES = tuple(name for name, _ in BANDS)
FEATURES = (
    "hour_sin", "hour_cos", "dow_sin", "dow_cos", "is_weekend", "month_sin", "month_cos", "horizon_days", *(f"band_{b}" for b in BAND_NAMES), *(f"price_lag_{w}w" for w in LAG_WEEKS), "price_lag_mean_4w", "price_lag_median_4w", "price_lag_spread_4w", "demand_lag_1w",
    "temp_forecast", "cooling_degrees", "heating_degrees", "temp_lag_1w", "temp_delta_1w", "cooling_delta_1w", "heating_delta_1w",
)


def cooling(t: Column) -> Column:
    return F.when(t.isNotNull(), F.greatest(t - COMFORT, F.lit(0.0)))


def heating(t: Column) -> Column:
    return F.when(t.isNotNull(), F.greatest(F.lit(COMFORT) - t, F.lit(0.0)))


def days(n: int) -> Column:
    return F.make_dt_interval(days=F.lit(n))


def reference_temperature(weather: DataFrame) -> DataFrame:
    """(region, ts, temperature): the observed one, else the forecast one. What lies after an origin is left out where
    the joins use it, as these ask for times at or before it."""
    of = lambda k: F.max(F.when(F.col("kind") == k, F.col("temperature")))
    return weather.groupBy("region", "ts").agg(F.coalesce(of("observed"), of("forecast")).alias("temperature")).where("temperature IS NOT NULL")


def target_temperature(weather: DataFrame, origins: DataFrame, horizon: int = 7) -> DataFrame:
    """(region, origin, ts, temperature, source) of the horizon: the forecast readings if the region has any there, else
    the observed ones, labelled so; an origin without either has no row. origins (region, origin) is a list of runs, which
    Spark broadcasts only under its own threshold."""
    o = origins.select("region", "origin").distinct()
    near = weather.where(F.col("temperature").isNotNull()).join(o, "region").where((F.col("ts") > F.col("origin")) & (F.col("ts") <= F.col("origin") + days(horizon)))
    any_forecast = F.max((F.col("kind") == "forecast").cast("int")).over(Window.partitionBy("region", "origin")) == 1
    held = near.withColumn("_f", any_forecast).where(F.col("kind") == F.when(F.col("_f"), "forecast").otherwise("observed"))
    return held.select("region", "origin", "ts", "temperature", F.when(F.col("_f"), FORECAST).otherwise(FALLBACK).alias("source"))


def market_temperature(weather: DataFrame, prices: DataFrame, shares: DataFrame, market: str = "ALL") -> DataFrame:
    """(region = market, ts, kind, temperature): each interval's temperatures weighted by the demand of their region then,
    or by its long-run share where no demand is settled; zero weights and the market itself are left out."""
    rows = weather.where((F.col("region") != market) & F.col("temperature").isNotNull())
    w = rows.join(prices.select("region", "ts", "demand"), ["region", "ts"], "left").join(shares.select("region", "share"), "region", "left").withColumn("_w", F.coalesce("demand", "share", F.lit(0.0))).where("_w <> 0")
    return w.groupBy("ts", "kind").agg(F.sum(F.col("temperature") * F.col("_w")).alias("_t"), F.sum("_w").alias("_all")).where("_all <> 0").select(F.lit(market).alias("region"), "ts", "kind", (F.col("_t") / F.col("_all")).alias("temperature"))


def interval_pairs(prices: DataFrame, temperatures: DataFrame) -> DataFrame:
    """(region, ts, band, d_cool, d_heat, d_price): changes against the interval a week before, where both have a price and
    a temperature."""
    both = prices.select("region", "ts", "rrp").where("rrp IS NOT NULL").join(temperatures.select("region", "ts", "temperature"), ["region", "ts"])
    before = both.select("region", (F.col("ts") + days(7)).alias("ts"), F.col("rrp").alias("_p"), F.col("temperature").alias("_t"))
    t, u = F.col("temperature"), F.col("_t")
    return both.join(before, ["region", "ts"]).select("region", "ts", time_band(F.col("ts")).alias("band"), (cooling(t) - cooling(u)).alias("d_cool"), (heating(t) - heating(u)).alias("d_heat"), (F.col("rrp") - F.col("_p")).alias("d_price"))


def origin_betas(pairs: DataFrame, origins: DataFrame, weeks: int = TRAINING_WEEKS) -> DataFrame:
    """fit_betas per region, origin and band, on the pairs whose both ends lie in (origin - weeks, origin]."""
    o = origins.select("region", "origin").distinct()
    held = pairs.join(o, "region").where((F.col("ts") <= F.col("origin")) & (F.col("ts") - days(7) > F.col("origin") - days(7 * weeks)))
    return fit_betas(held, ["region", "origin", "band"])


def beta_table(betas: DataFrame) -> DataFrame:
    """All bands of each region and origin: unfitted ones have zeros and the reason; of a band without pairs, that there
    were none. The bands are six rows."""
    bands = betas.sparkSession.createDataFrame([(k, b) for k, b in enumerate(BAND_NAMES)], "place int, band string")
    grid = betas.select("region", "origin").distinct().crossJoin(F.broadcast(bands))
    return grid.join(betas, ["region", "origin", "band"], "left").select("region", "origin", "place", "band", F.coalesce("beta_cool", F.lit(0.0)).alias("beta_cool"), F.coalesce("beta_heat", F.lit(0.0)).alias("beta_heat"), F.coalesce("n_pairs", F.lit(0)).alias("n_pairs"), F.when(F.col("n_pairs").isNull(), "no pairs").otherwise(F.col("reason")).alias("reason"))


def week_before(prices: DataFrame, weeks: tuple[int, ...], value: str = "rrp") -> DataFrame:
    """(region, ts, week, lag_value): each value moved forward by each number of weeks, so one join serves all."""
    return prices.where(F.col(value).isNotNull()).select("region", F.col("ts").alias("_ts"), F.col(value).alias("lag_value"), F.explode(F.array(*map(F.lit, weeks))).alias("week")).select("region", (F.col("_ts") + F.make_dt_interval(days=F.col("week") * 7)).alias("ts"), "week", "lag_value")


def naive_intervals(prices: DataFrame, grid: DataFrame) -> DataFrame:
    """The price a week before, not under the floor; intervals without one have no row."""
    return grid.join(week_before(prices, (1,)), ["region", "ts"]).select("region", "origin", "ts", F.greatest(F.lit(FLOOR), "lag_value").alias("predicted"))


def median_intervals(prices: DataFrame, grid: DataFrame, weeks: tuple[int, ...] = LAG_WEEKS) -> DataFrame:
    """The median of the prices one to four weeks before that there are."""
    return grid.join(week_before(prices, weeks), ["region", "ts"]).groupBy("region", "origin", "ts").agg(F.greatest(F.lit(FLOOR), F.median("lag_value")).alias("predicted"))


def temperature_adjusted(prices: DataFrame, grid: DataFrame, reference: DataFrame, target: DataFrame, betas: DataFrame) -> DataFrame:
    """The price a week before plus what the change of degrees costs in the interval's band, not under the floor. Without
    either temperature or a coefficient the price stays as it is."""
    then = reference.select("region", (F.col("ts") + days(7)).alias("ts"), F.col("temperature").alias("_then"))
    ahead = target.select("region", "origin", "ts", F.col("temperature").alias("_ahead"))
    df = grid.join(week_before(prices, (1,)), ["region", "ts"]).join(then, ["region", "ts"], "left").join(ahead, ["region", "origin", "ts"], "left")
    df = df.withColumn("band", time_band(F.col("ts"))).join(betas.select("region", "origin", "band", "beta_cool", "beta_heat"), ["region", "origin", "band"], "left")
    a, b = F.col("_ahead"), F.col("_then")
    change = F.col("beta_cool") * (cooling(a) - cooling(b)) + F.col("beta_heat") * (heating(a) - heating(b))
    return df.select("region", "origin", "ts", F.greatest(F.lit(FLOOR), F.col("lag_value") + F.coalesce(change, F.lit(0.0))).alias("predicted"))


def circle(value: Column, period: int) -> tuple[Column, Column]:
    angle = 2 * np.pi * (value / period)
    return F.sin(angle), F.cos(angle)


def feature_matrix(points: DataFrame, prices: DataFrame, reference: DataFrame, target: DataFrame) -> DataFrame:
    """region, origin, ts and FEATURES of the points (region, origin, ts) that lack no input: four weekly price lags, the
    demand and temperature a week before, and the target temperature (region, origin, ts). One join serves all lags."""
    lags = points.join(week_before(prices, LAG_WEEKS), ["region", "ts"]).groupBy("region", "origin", "ts").agg(*[F.max(F.when(F.col("week") == w, F.col("lag_value"))).alias(f"price_lag_{w}w") for w in LAG_WEEKS], F.count("*").alias("_n")).where(F.col("_n") == len(LAG_WEEKS))
    before = prices.select("region", "ts", "demand").where("demand IS NOT NULL").join(reference.select("region", "ts", F.col("temperature").alias("temp_lag_1w")), ["region", "ts"]).select("region", (F.col("ts") + days(7)).alias("ts"), F.col("demand").alias("demand_lag_1w"), "temp_lag_1w")
    df = lags.join(before, ["region", "ts"]).join(target.select("region", "origin", "ts", F.col("temperature").alias("temp_forecast")), ["region", "origin", "ts"])
    start = F.col("ts") - F.make_dt_interval(mins=F.lit(30))
    hour, dow, month = circle(F.hour(start) * 2 + F.floor(F.minute(start) / 30), 48), circle(F.weekday(start), 7), circle(F.month(start) - 1, 12)
    four = F.array_sort(F.array(*[f"price_lag_{w}w" for w in LAG_WEEKS]))
    a, b, band = F.col("temp_forecast"), F.col("temp_lag_1w"), time_band(F.col("ts"))
    made = {
        "hour_sin": hour[0], "hour_cos": hour[1], "dow_sin": dow[0], "dow_cos": dow[1], "is_weekend": (F.weekday(start) >= 5).cast("double"), "month_sin": month[0], "month_cos": month[1], "horizon_days": F.timestamp_diff("SECOND", F.col("origin"), F.col("ts")) / 86400,
        **{f"band_{name}": (band == name).cast("double") for name in BAND_NAMES}, "price_lag_mean_4w": sum((F.col(f"price_lag_{w}w") for w in LAG_WEEKS[1:]), F.col(f"price_lag_{LAG_WEEKS[0]}w")) / len(LAG_WEEKS), "price_lag_median_4w": (F.get(four, 1) + F.get(four, 2)) / 2, "price_lag_spread_4w": F.get(four, 3) - F.get(four, 0),
        "cooling_degrees": cooling(a), "heating_degrees": heating(a), "temp_delta_1w": a - b, "cooling_delta_1w": cooling(a) - cooling(b), "heating_delta_1w": heating(a) - heating(b),
    }
    return df.withColumns(made).select("region", "origin", "ts", *FEATURES)


def training_matrix(prices: DataFrame, reference: DataFrame, origins: DataFrame, weeks: int = TRAINING_WEEKS) -> DataFrame:
    """Features and rrp of the settled intervals of (origin - weeks, origin], by the run's origin (column run). Each is
    taken as a target with an origin of its own a week earlier, and the reference temperature stands for its forecast."""
    settled = prices.where("rrp IS NOT NULL").select("region", (F.col("ts") - days(7)).alias("origin"), "ts", "rrp")
    rows = feature_matrix(settled.drop("rrp"), prices, reference, reference.select("region", (F.col("ts") - days(7)).alias("origin"), "ts", "temperature"))
    o = origins.select("region", F.col("origin").alias("run")).distinct()
    return rows.join(settled.select("region", "ts", "rrp"), ["region", "ts"]).join(o, "region").where((F.col("ts") <= F.col("run")) & (F.col("ts") > F.col("run") - days(7 * weeks)))


def bounded(raw: np.ndarray, y: np.ndarray, price: np.ndarray) -> np.ndarray:
    """Predictions of asinh(price) within what training saw (y, price), as prices not under the floor nor over the dearest."""
    return np.minimum(np.maximum(np.sinh(np.clip(raw, y.min(), y.max())), FLOOR), price.max())


def runs_of(train: DataFrame, predict: DataFrame) -> DataFrame:
    """Training rows and those to predict (rrp null) of all runs, a run's rows in one partition. They are dealt over all
    shuffle partitions, which Spark does not join again."""
    both = train.select("region", F.col("run").alias("origin"), "ts", *FEATURES, "rrp").unionByName(predict.select("region", "origin", "ts", *FEATURES, F.lit(None).cast("double").alias("rrp")))
    return both.repartition(int(both.sparkSession.conf.get("spark.sql.shuffle.partitions")), "region", "origin")


def fit_predict_trees(train: DataFrame, predict: DataFrame, kind: str = "forest", seed: int = 20260806, **params) -> tuple[DataFrame, DataFrame]:
    """Predictions (region, origin, ts, predicted) of a random forest or of boosted trees per region and origin, and what
    each fit says of itself (region, origin, training_rows, trained, clipped, top_features: the ten that weigh most).
    train: training_matrix; predict: feature_matrix of the grid. Under LEAST_TRAINING rows none is trained; a run without
    rows to predict says so by its count alone. params: those of trees.forest or trees.boosting.

    All runs are fitted at once, each in a task of its own: a run holds its training window, whose length is bounded. The
    result is not that of another library to the digit. It is written, so that a fit is not repeated.
    """
    both = runs_of(train, predict)
    kinds = dict(both.dtypes)
    fit = {"forest": trees.forest, "boosting": trees.boosting}[kind]

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        known, ask = rows[rows["rrp"].notna()].sort_values("ts"), rows[rows["rrp"].isna()].sort_values("ts")
        facts = {"training_rows": len(known), "trained": len(known) >= LEAST_TRAINING and len(ask) > 0, "clipped": 0, "top_features": None}
        if not facts["trained"]:
            return rows.head(1)[["region", "origin"]].assign(ts=pd.NaT, predicted=np.nan, **facts)
        price = known["rrp"].to_numpy(float)
        y = np.arcsinh(price)
        raw, shares = fit(known[list(FEATURES)].to_numpy(float), y, ask[list(FEATURES)].to_numpy(float), seed, **params)
        facts["clipped"] = int(((raw < y.min()) | (raw > y.max())).sum())
        top = [{"feature": FEATURES[i], "importance": float(shares[i])} for i in np.argsort(-shares, kind="stable")[:10]]
        made = ask[["region", "origin", "ts"]].assign(predicted=bounded(raw, y, price), **facts)
        made["top_features"] = [top] * len(made)
        return made

    schema = f"region {kinds['region']}, origin {kinds['origin']}, ts {kinds['ts']}, predicted double, training_rows long, trained boolean, clipped long, top_features array<struct<feature: string, importance: double>>"
    made = written(both.groupBy("region", "origin").applyInPandas(run, schema))
    told = made.groupBy("region", "origin").agg(*[F.first(c).alias(c) for c in ("training_rows", "trained", "clipped", "top_features")])
    return made.where("trained").select("region", "origin", "ts", "predicted"), told


def fit_predict_forest(train: DataFrame, predict: DataFrame, **params) -> tuple[DataFrame, DataFrame]:
    return fit_predict_trees(train, predict, "forest", **params)


def fit_predict_boosting(train: DataFrame, predict: DataFrame, **params) -> tuple[DataFrame, DataFrame]:
    return fit_predict_trees(train, predict, "boosting", **params)


def _network(x: np.ndarray, y: np.ndarray, ask: np.ndarray, hidden: tuple[int, ...], seed: int, rounds: int = 600, rate: float = 0.003, decay: float = 0.001, patience: int = 20) -> np.ndarray:
    """Predictions of a small network: inputs to mean 0 and deviation 1, rectified layers, Adam on squared error with
    decay, batches of 200, the weights of the best error on a held-out 15 percent."""
    rnd = np.random.default_rng(seed)
    mean, spread = x.mean(axis=0), x.std(axis=0)
    spread[spread == 0] = 1.0
    x, ask = (x - mean) / spread, (ask - mean) / spread
    order = rnd.permutation(len(x))
    held, kept = order[: max(1, len(x) * 15 // 100)], order[max(1, len(x) * 15 // 100) :]
    sizes = (x.shape[1], *hidden, 1)
    w = [rnd.uniform(-1, 1, (a, b)) * np.sqrt(6 / (a + b)) for a, b in zip(sizes, sizes[1:], strict=False)] + [np.zeros(b) for b in sizes[1:]]
    n, first, second, step = len(hidden) + 1, [np.zeros_like(p) for p in w], [np.zeros_like(p) for p in w], 0

    def forward(v: np.ndarray) -> list[np.ndarray]:
        acts = [v]
        for k in range(n):
            v = acts[-1] @ w[k] + w[n + k]
            acts.append(np.maximum(v, 0) if k < n - 1 else v)
        return acts

    best, stay, since = np.inf, [p.copy() for p in w], 0
    for _ in range(rounds):
        for part in np.array_split(rnd.permutation(kept), max(1, len(kept) // 200)):
            acts = forward(x[part])
            back = (acts[-1][:, 0] - y[part])[:, None] / len(part)
            grads = [None] * (2 * n)
            for k in range(n - 1, -1, -1):
                grads[k], grads[n + k] = acts[k].T @ back + decay * w[k] / len(part), back.sum(axis=0)
                back = (back @ w[k].T) * (acts[k] > 0)
            step += 1
            for k, g in enumerate(grads):
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.999 * second[k] + 0.001 * g * g
                w[k] -= rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
        error = float(((forward(x[held])[-1][:, 0] - y[held]) ** 2).mean())
        if error < best - 1e-4:
            best, stay, since = error, [p.copy() for p in w], 0
        elif (since := since + 1) >= patience:
            break
    w[:] = stay
    return forward(ask)[-1][:, 0]


def fit_predict_network(train: DataFrame, predict: DataFrame, hidden: tuple[int, ...] = (64, 32), seed: int = 20260806) -> DataFrame:
    """Predictions (region, origin, ts, predicted) of a network per region and origin, bounded like those of the trees.
    A group holds a run's training window and horizon, whose length the window bounds; runs are dealt like those of trees."""
    both = runs_of(train, predict)
    kinds = dict(both.dtypes)

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        known, ask = rows[rows["rrp"].notna()].sort_values("ts"), rows[rows["rrp"].isna()].sort_values("ts")
        if len(known) < LEAST_TRAINING or not len(ask):
            return ask.head(0)[["region", "origin", "ts"]].assign(predicted=np.zeros(0))
        price = known["rrp"].to_numpy(float)
        y = np.arcsinh(price)
        raw = _network(known[list(FEATURES)].to_numpy(float), y, ask[list(FEATURES)].to_numpy(float), hidden, seed)
        return ask[["region", "origin", "ts"]].assign(predicted=bounded(raw, y, price))

    return both.groupBy("region", "origin").applyInPandas(run, f"region {kinds['region']}, origin {kinds['origin']}, ts {kinds['ts']}, predicted double")


def learned_models(train: DataFrame, predict: DataFrame) -> dict[str, DataFrame]:
    """The three learned models of the ladder by name, each as (region, origin, ts, predicted)."""
    return {"random_forest": fit_predict_forest(train, predict)[0], "gradient_boosting": fit_predict_boosting(train, predict)[0], "neural_network": fit_predict_network(train, predict)}


def forecast_ladder(prices: DataFrame, weather: DataFrame, grid: DataFrame, learned: dict[str, DataFrame] | None = None, weeks: int = TRAINING_WEEKS) -> DataFrame:
    """One long table of all models and origins: region, model, origin, ts, predicted, temperature_source, leakage_safe.
    learned: predictions of further models by name. Models that use no temperature have the source none; only observed
    temperatures of the horizon make a run unsafe."""
    origins = grid.select("region", "origin").distinct()
    reference, target = reference_temperature(weather), target_temperature(weather, origins)
    betas = origin_betas(interval_pairs(prices, reference), origins, weeks)
    source = target.groupBy("region", "origin").agg(F.max("source").alias("temperature_source"))
    plain = {"seasonal_naive": naive_intervals(prices, grid), "rolling_median": median_intervals(prices, grid)}
    warm = {"temperature_adjusted": temperature_adjusted(prices, grid, reference, target, betas)} | (learned or {})
    out = None
    for name, df in (plain | warm).items():
        part = df.withColumn("model", F.lit(name))
        part = part.join(source, ["region", "origin"], "left").withColumn("temperature_source", F.coalesce("temperature_source", F.lit(NONE))) if name in warm else part.withColumn("temperature_source", F.lit(NONE))
        part = part.select("region", "model", "origin", "ts", "predicted", "temperature_source")
        out = part if out is None else out.unionByName(part)
    return out.withColumn("leakage_safe", F.col("temperature_source") != FALLBACK)
