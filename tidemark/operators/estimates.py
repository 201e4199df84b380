"""Country indicators: preparation by rule, estimates from like countries, the military panel, documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: First year, least observations of a mean, least peers, peers that are used.
FIRST_YEAR, LEAST_OBSERVATIONS, LEAST_PEERS, PEERS = 2015, 5, 3, 5


def prepare_by_rule(obs: DataFrame, rules: DataFrame, first: int = FIRST_YEAR, least: int = LEAST_OBSERVATIONS) -> DataFrame:
    """(country, indicator, raw, observations, year, start_year, end_year) of the years from `first` on. rules (indicator,
    aggregation) say 'average', the mean of `least` observations or more with its span, or 'latest', the value of the last
    year, which alone has a year. Null values and indicators without a rule are left out; ties of a year go to the
    greater value."""
    held = obs.where((F.col("year") >= first) & F.col("value").isNotNull()).groupBy("country", "indicator").agg(F.avg("value").alias("_mean"), F.count("*").alias("_n"), F.min("year").alias("_a"), F.max("year").alias("_b"), F.max_by("value", F.struct("year", "value")).alias("_last"))
    df = held.join(rules.select("indicator", "aggregation"), "indicator")
    mean = F.col("aggregation") == "average"
    df = df.where(~mean | (F.col("_n") >= least))
    return df.select("country", "indicator", F.when(mean, F.col("_mean")).otherwise(F.col("_last")).alias("raw"), F.when(mean, F.col("_n")).otherwise(F.lit(1)).cast("long").alias("observations"), F.when(~mean, F.col("_b")).alias("year"), F.when(mean, F.col("_a")).alias("start_year"), F.when(mean, F.col("_b")).alias("end_year"))


def estimate_missing(values: DataFrame, countries: DataFrame, history: DataFrame, sizes: DataFrame, indicators: list[str], least: int = LEAST_PEERS, k: int = PEERS) -> DataFrame:
    """(country, indicator, raw, basis, baseline_year, projected) for the countries that lack a value.

    values: country, indicator, raw of valid, reported values; countries: country, region, place (their order); history:
    country, indicator, year, value, however old; sizes: country, per_head (income), null where unknown. A country's peers
    are those of its region with a value, `least` at least; the k nearest by income are used, ties and unknown incomes by
    place: a peer without one counts as near, and for a country without one the places decide. The estimate is the peers'
    mean; if the country has an old value and peers have values of that year whose mean is not zero, it is the old value
    times the peers' change since. One join of regions' countries with each other, per indicator; regions are groups of
    some dozen countries.
    """
    wanted = countries.crossJoin(values.sparkSession.createDataFrame([(i,) for i in indicators], "indicator string"))
    lacking = wanted.join(values.select("country", "indicator"), ["country", "indicator"], "left_anti").join(sizes.select("country", "per_head"), "country", "left")
    peers = values.where(F.col("indicator").isin(*indicators)).join(countries, "country").join(sizes.select("country", "per_head"), "country", "left").select("indicator", "region", F.col("country").alias("peer"), F.col("raw").alias("peer_raw"), F.col("per_head").alias("peer_head"), F.col("place").alias("peer_place"))
    both = lacking.join(peers, ["indicator", "region"])
    far = F.when(F.col("per_head").isNotNull(), F.abs(F.coalesce("peer_head", "per_head") - F.col("per_head"))).otherwise(0.0)
    w = Window.partitionBy("country", "indicator")
    near = both.withColumns({"_n": F.count("*").over(w), "_k": F.row_number().over(w.orderBy(far, "peer_place"))}).where((F.col("_n") >= least) & (F.col("_k") <= k))
    old = history.where(F.col("value").isNotNull()).groupBy("country", "indicator").agg(F.max_by(F.struct("year", "value"), F.struct("year", "value")).alias("_b")).select("country", "indicator", F.col("_b.year").alias("baseline_year"), F.col("_b.value").alias("_base"))
    then = history.where(F.col("value").isNotNull()).groupBy("country", "indicator", "year").agg(F.max("value").alias("_then")).select(F.col("country").alias("peer"), "indicator", F.col("year").alias("baseline_year"), "_then")
    df = near.join(old, ["country", "indicator"], "left").join(then, ["peer", "indicator", "baseline_year"], "left")
    one = df.groupBy("country", "indicator").agg(F.avg("peer_raw").alias("_now"), F.avg("_then").alias("_then"), F.max("_base").alias("_base"), F.max("baseline_year").alias("baseline_year"), F.transform(F.array_sort(F.collect_list(F.struct("_k", "peer"))), lambda x: x["peer"]).alias("basis"))
    projected = F.coalesce(F.col("_base").isNotNull() & (F.col("_then") != 0), F.lit(False))
    return one.select("country", "indicator", F.when(projected, F.col("_base") * F.col("_now") / F.col("_then")).otherwise(F.col("_now")).alias("raw"), "basis", "baseline_year", projected.alias("projected"))


def military_panel(obs: DataFrame, countries: DataFrame, arms: DataFrame, aliases: DataFrame, indicators: list[str]) -> tuple[DataFrame, DataFrame]:
    """Per country the last value and year of each indicator and arms_export, and the suppliers that no country is named
    like. obs: country, indicator, year, value; countries: country, name; arms: supplier, value; aliases: name (lower
    case), country. A supplier's name is compared without stars at its end, trimmed, in lower case; countries' own names
    win over aliases. Countries without anything keep a row of nulls; of suppliers that are one country the greater value
    stays; sums and remainders (Total, Others) are not reported."""
    last = obs.where(F.col("indicator").isin(*indicators) & F.col("value").isNotNull()).groupBy("country", "indicator").agg(F.max_by(F.struct("value", "year"), F.struct("year", "value")).alias("_l"))
    wide = last.groupBy("country").agg(*[F.max(F.when(F.col("indicator") == i, F.round(F.col("_l.value"), 3))).alias(i) for i in indicators], *[F.max(F.when(F.col("indicator") == i, F.col("_l.year"))).alias(f"{i}_year") for i in indicators])
    name = F.lower(F.trim(F.regexp_replace(F.trim("supplier"), r"\*+$", "")))
    own = countries.select(F.lower(F.trim("name")).alias("_name"), F.col("country").alias("_own")).dropDuplicates(["_name"])
    other = aliases.join(countries.select("country"), "country", "left_semi").select(F.col("name").alias("_name"), F.col("country").alias("_alias")).dropDuplicates(["_name"])
    found = arms.withColumn("_name", name).join(own, "_name", "left").join(other, "_name", "left").withColumn("country", F.coalesce("_own", "_alias"))
    sold = found.where("country IS NOT NULL").groupBy("country").agg(F.max("value").alias("arms_export"))
    lost = found.where(F.col("country").isNull() & F.col("supplier").isNotNull() & (F.col("supplier") != "") & ~F.trim("supplier").isin("Others", "Total")).select("supplier").distinct()
    return countries.select("country").join(wide, "country", "left").join(sold, "country", "left"), lost


def bridge_groups(pillars: DataFrame, groups: DataFrame) -> DataFrame:
    """country and the mean pillar score of each bridge group, assets and conversion; groups: pillar, bridge_group. A group
    without pillars is null; pillars of no group are left out."""
    of = lambda g: F.avg(F.when(F.col("bridge_group") == g, F.col("pillar_score"))).alias(g)
    return pillars.join(groups, "pillar").groupBy("country").agg(of("assets"), of("conversion"))


def country_documents(scores: DataFrame, components: DataFrame, links: DataFrame, panel: DataFrame | None = None) -> DataFrame:
    """(country, document): one JSON object per scored country with its score and rank, its components by pillar in order,
    its trade links by rank and, if given, its military panel. scores: country, score, rank; components: country, pillar,
    pillar_score; links: country, partner, value, share, rank. A country without components or links has empty lists."""
    parts = components.groupBy("country").agg(F.array_sort(F.collect_list(F.struct("pillar", "pillar_score"))).alias("components"))
    ties = links.groupBy("country").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "partner", F.round("value", 2).alias("value"), F.round("share", 5).alias("share")))), lambda x: F.struct(x["partner"].alias("partner"), x["value"].alias("value"), x["share"].alias("share"))).alias("trade_links"))
    df = scores.select("country", "score", "rank").join(parts, "country", "left").join(ties, "country", "left")
    empty = lambda c: F.coalesce(F.col(c), F.array().cast(df.schema[c].dataType)).alias(c)
    fields = [F.col("country"), F.col("score"), F.col("rank"), empty("components"), empty("trade_links")]
    if panel is not None:
        df = df.join(panel.select("country", F.struct(*[c for c in panel.columns if c != "country"]).alias("military")), "country", "left")
        fields.append(F.col("military"))
    return df.select("country", F.to_json(F.struct(*fields)).alias("document"))


def whole_cohort(cohort: DataFrame, country: str, n: int, members: tuple[str, ...] = ()) -> DataFrame:
    """cohort itself, if it has n countries and these members; an error otherwise. It is counted: a job of n rows."""
    held = {r[0] for r in cohort.select(country).collect()}  # n rows
    if len(held) < n:
        raise ValueError(f"only {len(held)} countries are complete; {n} are required")
    if lost := sorted(set(members) - held):
        raise ValueError(f"the cohort lacks {', '.join(lost)}")
    return cohort

