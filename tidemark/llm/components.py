"""Connected components as joins and groupings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, stored


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): for each node of a link, the least node that links reach from it.

    Alternates large and small stars: every node's larger, then its smaller neighbours are linked to the least one
    known. Each round halves the distances, so rounds grow with the logarithm of the longest path. A round never makes
    more links than it got (and one per node); it is written to the shared folder, which ends lineage, and the round
    before it is deleted there. Joins on a node with many links are left to Spark's adaptive splitting. A null end makes
    no link; self-links give their node as its own component; no links give no rows.
    """
    links = stored(links.select(F.least(a, b).alias("low"), F.greatest(a, b).alias("high")).where(F.col(a).isNotNull() & F.col(b).isNotNull()).distinct())
    selfs = links.where("low = high").select(F.col("low").alias("node"), F.col("low").alias("component"))
    links = links.where("low < high")
    before, last = None, None
    while True:
        both = links.select(F.col("low").alias("u"), F.col("high").alias("v")).unionAll(links.select(F.col("high").alias("u"), F.col("low").alias("v")))
        # written, so that the join reads tables on both sides and Spark can split a node that most links meet in
        least = stored(both.groupBy("u").agg(F.least("u", F.min("v")).alias("m")))
        large = both.join(least, "u").where("v > u").select(F.col("m").alias("low"), F.col("v").alias("high")).where("low < high").distinct()
        down = large.groupBy("high").agg(F.min("low").alias("m"))
        small = large.join(down, "high")
        made = small.select(F.col("m").alias("low"), F.col("high")).unionAll(small.where("low > m").select(F.col("m").alias("low"), F.col("low").alias("high"))).distinct()
        links = stored(made)
        discard(least)
        if last is not None:
            discard(last)
        last = links
        # a forest of stars no longer changes: neither its links nor the sum of their ends
        now = links.agg(F.count("*"), F.sum(F.xxhash64("low", "high").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    inner = links.select(F.col("high").alias("node"), F.col("low").alias("component"))
    roots = links.select(F.col("low").alias("node"), F.col("low").alias("component")).distinct()
    return inner.unionByName(roots).unionByName(selfs).groupBy("node").agg(F.min("component").alias("component"))
