"""Groups of accounts that behave alike: features, robust scale, seeded k-means, names.

The driver holds centres and sums of at most five groups; accounts stay in Spark. A pass over the accounts is one job.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.storage import written
from .order_stats import order_statistics, quantile

#: Features in order, the bounds of a scaled one, and the limits of the fit.
FEATURES = ("adoption_level", "adoption_momentum", "arr_momentum", "support_position", "engagement_position")
BOUND, LEAST_ROWS, LEAST_ACCOUNTS, LEAST_MEMBERS, ROUNDS, EXTRA_CLUSTER, OLDEST_REVIEW = 3.0, 4, 15, 2, 60, 0.005, 730
#: What each name scores by features (weights, weights of absolute values, weight of a positive momentum).
STABLE = "Stable Core"
NAMES = {
    "Established Compounders": {"arr_momentum": 1.0, "adoption_momentum": 1.0, "adoption_level": 0.35},
    "Under-Adopted Expansion": {"arr_momentum": 1.0, "adoption_level": -1.0, "positive adoption_momentum": -1.0},
    "Silent Erosion": {"arr_momentum": 1.0, "adoption_momentum": -1.5},
    "Active Decliners": {"arr_momentum": -1.0, "adoption_momentum": -1.0},
    "Operationally Strained": {"support_position": -1.0, "engagement_position": -1.0, "adoption_level": -0.25},
}
STILLNESS = {"arr_momentum": 1.0, "adoption_momentum": 1.0, "support_position": 0.25, "engagement_position": 0.25}


def mean_of(*values: Column) -> Column:
    """Mean of those that are not null."""
    held = F.array_compact(F.array(*values))
    return F.when(F.size(held) > 0, F.aggregate(held, F.lit(0.0), lambda a, x: a + x) / F.size(held))


def behaviour_features(accounts: DataFrame, timeline: DataFrame, evidence: DataFrame) -> DataFrame:
    """account_id and FEATURES of accounts with LEAST_ROWS months or more and evidence (rows of health.trajectory); higher
    is stronger throughout, and what is not known is null. accounts: seat_utilisation_pct, active_user_pct, days_since_qbr."""
    back = F.row_number().over(Window.partitionBy("account_id").orderBy(F.col("month").desc()))
    recent = timeline.withColumn("_k", back).groupBy("account_id").agg(F.count("*").alias("_rows"), F.avg(F.when(F.col("_k") <= 3, F.col("tickets_opened"))).alias("_tickets"))
    df = accounts.join(recent.where(F.col("_rows") >= LEAST_ROWS), "account_id").join(evidence.select("account_id", "arr_change", "utilisation_change", "active_users_change", "tickets_change"), "account_id")
    number = lambda c: F.col(c).cast("double")
    support = -(F.col("_tickets") + F.greatest(F.coalesce("tickets_change", F.lit(0.0)), F.lit(0.0)) / 6)
    values = (mean_of(number("seat_utilisation_pct"), number("active_user_pct")), mean_of(F.col("utilisation_change"), F.col("active_users_change")), F.col("arr_change"), support, F.when(F.col("days_since_qbr").isNotNull(), -F.least(number("days_since_qbr"), F.lit(float(OLDEST_REVIEW)))))
    return df.select("account_id", *[v.alias(name) for v, name in zip(values, FEATURES, strict=True)])


def robust_scale(features: DataFrame, columns: tuple[str, ...] = FEATURES) -> DataFrame:
    """Each column as (x - median) / spread, within BOUND; null is the median. The spread is the distance between the
    medians of the lower and the upper half, else the population's deviation, else 1. Medians are exact and found by
    refined histograms, all columns in the same passes; the driver gets one row per column. Features are written once, as every pass reads
    them."""
    features = written(features)
    long = features.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("value")) for c in columns])).alias("x")).select("x.*")
    half = lambda n: (F.floor(n / 2) - 1) / 2
    places = {"middle": quantile(0.5), "a": half, "b": lambda n: (n - 1) - half(n)}
    found = {r["column"]: r for r in order_statistics(long, ["column"], "value", places).collect()}
    deviation = features.agg(*[F.stddev_pop(c).alias(c) for c in columns]).first()
    kept, scaled = [c for c in features.columns if c not in columns], []
    for c in columns:
        r = found.get(c)
        middle, spread = (r["middle"], r["b"] - r["a"] if r["n"] >= 4 else 0.0) if r else (0.0, 0.0)
        spread = spread if spread > 0 else deviation[c] if deviation[c] and deviation[c] > 0 else 1.0
        x = (F.coalesce(F.col(c), F.lit(middle)) - F.lit(middle)) / F.lit(spread)
        scaled.append(F.greatest(F.lit(-BOUND), F.least(F.lit(BOUND), x)).alias(c))
    return features.select(*kept, *scaled)


def _apart(columns: tuple[str, ...], centre: Column) -> Column:
    """Squared distance of a row from a centre, an array in the columns' order."""
    return F.aggregate(F.zip_with(F.array(*columns), centre, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda a, x: a + x)


def _nearest(columns: tuple[str, ...], centres: Column) -> Column:
    """Number of the nearest centre, the first of equal ones."""
    return F.array_min(F.transform(centres, lambda c, k: F.struct(F.sqrt(_apart(columns, c)).alias("d"), k.alias("k"))))["k"]


def _given(spark: SparkSession, centres: dict[int, list[list[float]]]) -> DataFrame:
    """A row per k with its centres: three at most, which are broadcast."""
    return F.broadcast(spark.createDataFrame([(k, c) for k, c in sorted(centres.items())], "k int, centres array<array<double>>"))


def seeds(vectors: DataFrame, k: int, columns: tuple[str, ...] = FEATURES, id_col: str = "account_id") -> list[list[float]]:
    """First centres: the vector nearest to the mean, then each time the farthest from those before, ties by id. Those of a
    smaller k are the first of them. One pass over the vectors for each."""
    spark = vectors.sparkSession
    best = lambda order, held: list(vectors.crossJoin(_given(spark, {0: held})).orderBy(order, id_col).select(F.array(*columns)).first()[0])
    mean = [float(x) for x in vectors.agg(*[F.avg(c) for c in columns]).first()]
    found = [best(F.sqrt(_apart(columns, F.get("centres", 0))), [mean])]
    while len(found) < k:
        found.append(best(F.array_min(F.transform("centres", lambda c: F.sqrt(_apart(columns, c)))).desc(), found))
    return found


def seeded_kmeans(vectors: DataFrame, ks: list[int], columns: tuple[str, ...] = FEATURES, id_col: str = "account_id") -> dict[int, list[list[float]]]:
    """Centres for every k at once: from the seeds, means of members until no member moves, at most ROUNDS times. A round
    is one aggregate over the vectors, stacked for those k that still move; the driver gets k rows for each."""
    if not ks:
        return {}
    first = seeds(vectors, max(ks), columns, id_col)
    centres = {k: [list(c) for c in first[:k]] for k in ks}
    moving, before = set(ks), {}
    for _ in range(ROUNDS):
        stacked = vectors.crossJoin(_given(vectors.sparkSession, {k: centres[k] for k in moving}))
        rows = stacked.groupBy("k", _nearest(columns, F.col("centres")).alias("at")).agg(F.count("*").alias("n"), F.sum(F.xxhash64(id_col).cast("decimal(38,0)")).alias("who"), *[F.avg(c).alias(c) for c in columns]).collect()
        now = {k: sorted((r["at"], r["n"], r["who"]) for r in rows if r["k"] == k) for k in moving}
        moving = {k for k in moving if now[k] != before.get(k)}
        before |= now
        for r in rows:
            if r["k"] in moving:
                centres[r["k"]][r["at"]] = [float(r[c]) for c in columns]
        if not moving:
            break
    return centres


def silhouettes(vectors: DataFrame, centres: dict[int, list[list[float]]], columns: tuple[str, ...] = FEATURES) -> dict[int, tuple[float, int]]:
    """For each k the mean silhouette by squared distances, which needs only the sums of each group, and the smallest
    group's size; -1 and 0 where a group has no members. Two passes for all k."""
    if not centres:
        return {}
    spark = vectors.sparkSession
    square = sum((F.col(c) * F.col(c) for c in columns), F.lit(0.0))
    marked = vectors.crossJoin(_given(spark, centres)).withColumn("_at", _nearest(columns, F.col("centres"))).drop("centres")
    groups = marked.groupBy("k", "_at").agg(F.count("*").alias("n"), F.avg(square).alias("q"), *[F.avg(c).alias(c) for c in columns]).collect()  # k rows for each k
    whole = {k for k, c in centres.items() if sum(g["k"] == k for g in groups) == len(c)}
    table = [(k, sorted((g["_at"], g["n"], g["q"], [float(g[c]) for c in columns]) for g in groups if g["k"] == k)) for k in sorted(whole)]
    found = dict.fromkeys(centres, (-1.0, 0))
    if not table:
        return found
    known = F.broadcast(spark.createDataFrame(table, "k int, _groups array<struct<at: int, n: long, q: double, mean: array<double>>>"))
    to = lambda g: square + g["q"] - 2 * F.aggregate(F.zip_with(F.array(*columns), g["mean"], lambda x, y: x * y), F.lit(0.0), lambda a, x: a + x)
    mine = F.get(F.filter("_groups", lambda g: g["at"] == F.col("_at")), 0)
    df = marked.join(known, "k").withColumns({"_mine": mine, "_other": F.array_min(F.transform(F.filter("_groups", lambda g: g["at"] != F.col("_at")), to))})
    own = F.when(F.col("_mine.n") > 1, to(F.col("_mine")) * F.col("_mine.n") / (F.col("_mine.n") - 1))
    value = F.when(own.isNull(), 0.0).otherwise(F.coalesce(F.try_divide(F.col("_other") - own, F.greatest(F.col("_other"), own)), F.lit(0.0)))
    for r in df.groupBy("k").agg(F.avg(value).alias("score")).collect():
        found[r["k"]] = float(r["score"]), min(g["n"] for g in groups if g["k"] == r["k"])
    return found


def cluster_accounts(vectors: DataFrame, columns: tuple[str, ...] = FEATURES) -> tuple[DataFrame, list[list[float]]]:
    """vectors with the number of each row's group, and the centres: of three groups to five (a fifth of the accounts at
    most), those of the best silhouette, less a little for each further group. Without LEAST_ACCOUNTS accounts, or groups of
    LEAST_MEMBERS, no rows and no centres. Null vectors are not allowed; robust_scale leaves none. All three fits share
    their passes over the vectors, which are written once."""
    held = written(vectors)
    n = held.count()
    centres = seeded_kmeans(held, list(range(3, min(5, n // 5) + 1)) if n >= LEAST_ACCOUNTS else [], columns)
    best = None
    for k, (score, least) in sorted(silhouettes(held, centres, columns).items()):
        if least >= LEAST_MEMBERS and (best is None or score - EXTRA_CLUSTER * (k - 3) > best[0]):
            best = score - EXTRA_CLUSTER * (k - 3), centres[k]
    if best is None:
        return vectors.withColumn("cluster", F.lit(0)).where("false"), []
    chosen = _given(vectors.sparkSession, {0: best[1]}).withColumnRenamed("centres", "_centres").drop("k")
    return held.crossJoin(chosen).withColumn("cluster", _nearest(columns, F.col("_centres"))).drop("_centres"), best[1]


def named(centres: list[list[float]], columns: tuple[str, ...] = FEATURES) -> list[str]:
    """A name per centre: the one that moves least is STABLE, the others take the names that score highest together."""
    profiles = [dict(zip(columns, c, strict=True)) for c in centres]
    move = [sum(w * abs(p[c]) for c, w in STILLNESS.items()) for p in profiles]
    still = min(range(len(profiles)), key=move.__getitem__)
    others = [k for k in range(len(profiles)) if k != still]
    value = lambda name, p: sum(w * (max(p[c.split()[-1]], 0) if c.startswith("positive") else p[c]) for c, w in NAMES[name].items())
    chosen = max(permutations(NAMES, len(others)), key=lambda names: sum(value(name, profiles[k]) for name, k in zip(names, others, strict=True)))
    out = [STABLE] * len(profiles)
    for name, k in zip(chosen, others, strict=True):
        out[k] = name
    return out


def archetype_profiles(clusters: DataFrame, centres: list[list[float]], book: DataFrame) -> DataFrame:
    """Per group: name, accounts, revenue and its share of the whole book, median score, accounts by band, and the centre.
    book: account_id, current_arr, score, band."""
    label = F.get(F.array(*map(F.lit, named(centres) or [""])), F.col("cluster"))
    total = book.agg(F.sum("current_arr").alias("_total"))
    found = clusters.select("account_id", "cluster").join(book, "account_id").groupBy("cluster").agg(F.count("*").alias("accounts"), F.sum("current_arr").alias("arr"), F.median("score").alias("median_health"), *[F.count_if(F.col("band") == b).alias(b.lower()) for b in ("Critical", "Watch", "Healthy")])
    at = lambda i: F.get(F.array(*[F.lit(round(c[i], 2)) for c in centres] or [F.lit(0.0)]), F.col("cluster"))
    df = found.crossJoin(F.broadcast(total))  # one row
    return df.select(label.alias("name"), "accounts", F.round("arr", 2).alias("arr"), F.round(F.coalesce(F.try_divide(100 * F.col("arr"), F.col("_total")), F.lit(0.0)), 1).alias("arr_share"), F.round("median_health", 1).alias("median_health"), "critical", "watch", "healthy", *[at(i).alias(c) for i, c in enumerate(FEATURES)])
