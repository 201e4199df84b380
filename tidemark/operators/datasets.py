"""The published dataset of a cohort of countries: what it is made from, and each country's results under every model."""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .cohorts import complete_cohort
from .estimates import whole_cohort
from .world import pillar_scores, zscores


@dataclass(frozen=True)
class Plan:
    """A dataset: its label and number of countries, models as name -> pillars, pillars as name -> indicators, indicators as
    name -> (direction, transform or None), the model that chooses the cohort, countries that must be in it, and further
    facts for its description."""

    label: str
    size: int
    models: dict[str, tuple[str, ...]]
    pillars: dict[str, tuple[str, ...]]
    indicators: dict[str, tuple[int, str | None]]
    chooser: str
    members: tuple = ()
    facts: dict = field(default_factory=dict)

    def inputs(self) -> list[str]:
        return sorted({i for indicators in self.pillars.values() for i in indicators})


def scored_inputs(plan: Plan, values: DataFrame) -> DataFrame:
    """values of the plan's inputs with their z-scores among the countries that values has, by pillar."""
    spark = values.sparkSession
    known = spark.createDataFrame([(i, *plan.indicators[i]) for i in plan.inputs()], "indicator string, direction int, transform string")
    homes = spark.createDataFrame([(p, i) for p, held in sorted(plan.pillars.items()) for i in held], "pillar string, indicator string")
    z = zscores(values.join(F.broadcast(known), "indicator"), "indicator", "raw", "direction", "transform", "estimated")  # a row per indicator
    return z.join(F.broadcast(homes), "indicator")  # a row per pillar and input


def model_results(plan: Plan, pillars: DataFrame) -> DataFrame:
    """country, model, score (mean of the model's pillars, to four places) and rank within the model, ties by country."""
    homes = pillars.sparkSession.createDataFrame([(m, p) for m, held in sorted(plan.models.items()) for p in held], "model string, pillar string")
    scores = pillars.join(F.broadcast(homes), "pillar").groupBy("country", "model").agg(F.round(F.avg("pillar_score"), 4).alias("score"))  # a row per model and pillar
    # a cohort is some dozens of countries, which its size bounds
    place = F.row_number().over(Window.partitionBy("model").orderBy(F.col("score").desc(), "country"))
    return scores.withColumn("rank", place)


def by_key(entries: Column) -> Column:
    """A map of an array of (key, value) structs, in the order of its keys."""
    return F.map_from_entries(F.array_sort(entries, lambda a, b: F.when(a["key"] < b["key"], -1).when(a["key"] > b["key"], 1).otherwise(0)))


def cohort_of(plan: Plan, values: DataFrame) -> DataFrame:
    """The plan's countries: the best by the choosing model among those that have all inputs. Too few of them, or one of the
    members missing, is an error."""
    held = values.where(F.col("indicator").isin(*plan.inputs()) & F.col("raw").isNotNull())
    whole = held.groupBy("country").agg(F.count_distinct("indicator").alias("_n")).where(F.col("_n") == len(plan.inputs())).select("country")
    provisional = model_results(plan, pillar_scores(scored_inputs(plan, held.join(whole, "country", "left_semi")), "country", "pillar")).where(F.col("model") == plan.chooser)
    return whole_cohort(complete_cohort(held, "country", "indicator", plan.inputs(), provisional.select("country", "score"), plan.size), "country", plan.size, plan.members).select("country")


def build_dataset(plan: Plan, values: DataFrame, countries: DataFrame, links: DataFrame, panel: DataFrame | None = None) -> DataFrame:
    """(dataset, place, country, document): place 0 is the description (country null), then a JSON object per country of the
    cohort by name.

    values: country, indicator, raw, estimated and whatever else is published of a value; one row per country and
    indicator, those that do not count left out. countries: country, name, region. links: country, partner, value, share,
    rank. panel: country and its columns. A country's object has `models`, per model score, default_rank and components, and
    per component z and inputs with z; `trade_links` in order of rank, empty without any; and, with a panel, `military`.
    """
    cohort = cohort_of(plan, values)
    held = values.where(F.col("indicator").isin(*plan.inputs()) & F.col("raw").isNotNull()).join(cohort, "country", "left_semi")
    inputs = scored_inputs(plan, held)
    public = F.struct(*[c for c in values.columns if c not in ("country", "indicator")], "z")
    pillars = pillar_scores(inputs, "country", "pillar")
    parts = inputs.groupBy("country", "pillar").agg(by_key(F.collect_list(F.struct(F.col("indicator").alias("key"), public.alias("value")))).alias("inputs")).join(pillars, ["country", "pillar"])
    homes = values.sparkSession.createDataFrame([(m, p) for m, of in sorted(plan.models.items()) for p in of], "model string, pillar string")
    component = F.struct(F.col("pillar").alias("key"), F.struct(F.col("pillar_score").alias("z"), "inputs").alias("value"))
    components = parts.join(F.broadcast(homes), "pillar").groupBy("country", "model").agg(by_key(F.collect_list(component)).alias("components"))  # a row per model and pillar
    results = model_results(plan, pillars).join(components, ["country", "model"])
    models = results.groupBy("country").agg(by_key(F.collect_list(F.struct(F.col("model").alias("key"), F.struct("score", F.col("rank").alias("default_rank"), "components").alias("value")))).alias("models"))
    tie = F.struct("partner", F.round("value", 2).alias("value"), F.round("share", 5).alias("share"))
    ties = links.groupBy("country").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", tie.alias("x")))), lambda r: r["x"]).alias("trade_links"))
    df = countries.join(cohort, "country", "left_semi").join(models, "country").join(ties, "country", "left")
    fields = ["country", "name", "region", "models", F.coalesce("trade_links", F.array().cast(df.schema["trade_links"].dataType)).alias("trade_links")]
    if panel is not None:
        df = df.join(panel.select("country", F.struct(*[c for c in panel.columns if c != "country"]).alias("military")), "country", "left")
        fields.append(F.col("military"))
    rows = df.select("country", "name", F.to_json(F.struct(*fields)).alias("document"))
    placed = rows.withColumn("place", F.row_number().over(Window.partitionBy(F.lit(plan.label)).orderBy("name", "country")))  # plan.size rows
    about = {"dataset": plan.label, "cohort_count": plan.size, "models": plan.models, "pillars": plan.pillars, "indicators": {i: {"direction": d, "transform": t} for i, (d, t) in plan.indicators.items()}, **plan.facts}
    meta = values.sparkSession.createDataFrame([(0, json.dumps(about, sort_keys=True))], "place int, document string").withColumn("country", F.lit(None).cast(rows.schema["country"].dataType))
    return meta.unionByName(placed.select("place", "document", "country")).select(F.lit(plan.label).alias("dataset"), "place", "country", "document")
