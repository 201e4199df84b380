"""Two published datasets of countries (nations), with their models side by side."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import datasets, world
from . import frames
from .queries import query

PILLARS = {"wealth": ("balance", "orders"), "reach": ("exports",)}
INDICATORS = {"balance": (-1, None), "orders": (1, "log1p"), "exports": (1, "log10")}
MODELS = {"power": ("wealth", "reach"), "outward": ("reach",)}
PLANS = (
    datasets.Plan("small", 8, MODELS, PILLARS, INDICATORS, "power", facts={"start": 2015}),
    datasets.Plan("large", 14, {**MODELS, "inward": ("wealth",)}, PILLARS, INDICATORS, "outward"),
)


def values(spark, sf_dir):
    c, o = frames.table(spark, sf_dir, "customer"), frames.table(spark, sf_dir, "orders")
    cents = lambda x: (F.sum(F.round(F.col(x) * 100).cast("long")).cast("double") / 100).alias("raw")
    parts = {
        "balance": c.groupBy(F.col("c_nationkey").alias("country")).agg(cents("c_acctbal")),
        "orders": o.join(c, F.col("o_custkey") == F.col("c_custkey")).groupBy(F.col("c_nationkey").alias("country")).agg(F.count("*").cast("double").alias("raw")),
        "exports": frames.exports(spark, sf_dir).groupBy("country").agg(cents("value")),
    }
    long = reduce(DataFrame.unionByName, [df.withColumn("indicator", F.lit(i)) for i, df in parts.items()])
    return long.select("country", "indicator", "raw", ((F.col("country") % 4 == 0) & (F.col("indicator") == "orders")).alias("estimated"))


_CENTS = lambda x: f"sum(round({x} * 100)::BIGINT)::DOUBLE / 100"
_VALUES = f"""SELECT country, indicator, raw, country % 4 = 0 AND indicator = 'orders' AS estimated, CASE indicator WHEN 'orders' THEN ln(1 + raw) WHEN 'exports' THEN log10(raw) ELSE raw END AS x, CASE WHEN indicator = 'balance' THEN -1 ELSE 1 END AS direction, CASE WHEN indicator = 'exports' THEN 'reach' ELSE 'wealth' END AS pillar FROM (
    SELECT c_nationkey AS country, 'balance' AS indicator, {_CENTS("c_acctbal")} AS raw FROM customer GROUP BY 1 UNION ALL SELECT c_nationkey, 'orders', count(*)::DOUBLE FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1 UNION ALL SELECT country, 'exports', {_CENTS("value")} FROM ({frames.EXPORTS}) GROUP BY 1)"""


def _scored(members: str, models: dict) -> str:
    z = f"""SELECT country, pillar, indicator, round(CASE WHEN s > 1e-12 THEN (x - m) / s * direction ELSE 0 END, 4) AS z FROM (SELECT *, CASE WHEN n >= 2 THEN m1 ELSE m0 END AS m, CASE WHEN n >= 2 THEN s1 ELSE s0 END AS s FROM (SELECT *, count(x) FILTER (NOT estimated) OVER w AS n, avg(x) FILTER (NOT estimated) OVER w AS m1,
    stddev_pop(x) FILTER (NOT estimated) OVER w AS s1, avg(x) OVER w AS m0, stddev_pop(x) OVER w AS s0 FROM v WHERE country IN ({members}) WINDOW w AS (PARTITION BY indicator)))"""
    homes = ", ".join(f"('{m}', '{p}')" for m, held in models.items() for p in held)
    return f"SELECT country, model, round(avg(ps), 4) AS score, count(*) AS components, max(exports) AS exports_z FROM (SELECT country, pillar, round(avg(z), 4) AS ps, max(z) FILTER (indicator = 'exports') AS exports FROM ({z}) GROUP BY 1, 2) JOIN (VALUES {homes}) h(model, pillar) USING (pillar) GROUP BY 1, 2"


def _dataset(plan: datasets.Plan) -> str:
    whole = "SELECT country FROM v GROUP BY 1 HAVING count(*) = 3"
    cohort = f"SELECT country FROM ({_scored(whole, plan.models)}) WHERE model = '{plan.chooser}' ORDER BY score DESC, country LIMIT {plan.size}"
    return f"""SELECT '{plan.label}' AS dataset, (dense_rank() OVER (ORDER BY n_name))::INT AS place, country, model, round(score, 3) + 0.0 AS score, (row_number() OVER (PARTITION BY model ORDER BY score DESC, country))::INT AS default_rank, components, round(exports_z, 3) + 0.0 AS exports_z,
    coalesce(k, 0) AS trade_links FROM ({_scored(cohort, plan.models)}) JOIN nation ON country = n_nationkey LEFT JOIN (SELECT country, least(count(*), 6) AS k FROM ({frames.EXPORTS}) WHERE value > 0 GROUP BY 1) USING (country)"""


@query(f"WITH v AS MATERIALIZED ({_VALUES}) " + " UNION ALL ".join(_dataset(p) for p in PLANS))
def i14_datasets(spark, sf_dir):
    """Both datasets' country documents, read again: a row per country and model."""
    n = frames.table(spark, sf_dir, "nation")
    countries = n.select(F.col("n_nationkey").alias("country"), F.col("n_name").alias("name"), F.col("n_regionkey").alias("region"))
    links = world.trade_links(frames.exports(spark, sf_dir), "country", "partner", "value")
    held = values(spark, sf_dir)
    whole = reduce(DataFrame.unionByName, [datasets.build_dataset(plan, held, countries, links) for plan in PLANS])
    inputs = "map<string, struct<z: double>>"
    d = F.from_json("document", f"models map<string, struct<score: double, default_rank: int, components: map<string, struct<z: double, inputs: {inputs}>>>>, trade_links array<struct<partner: int>>")
    rows = whole.where("place > 0").select("dataset", "place", "country", d.alias("d")).select("dataset", "place", "country", F.explode("d.models").alias("model", "m"), F.size("d.trade_links").cast("long").alias("trade_links"))
    reach = F.try_element_at("m.components", F.lit("reach"))
    z = F.try_element_at(reach["inputs"], F.lit("exports"))["z"]
    return rows.select("dataset", "place", "country", "model", (F.round("m.score", 3) + F.lit(0.0)).alias("score"), F.col("m.default_rank").alias("default_rank"), F.size("m.components").cast("long").alias("components"), (F.round(z, 3) + F.lit(0.0)).alias("exports_z"), "trade_links")
