"""From raw documents to packed training sequences: quality rules, near-duplicates, personal data, packing."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import near_copies, packing, pii, quality
from tidemark.llm.common import cleared, discard, documents, stored

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules keep, without their failing lines."""
    # the observed counts also keep Spark from moving the filter below the rules, which would evaluate them many times over
    judged = quality.quality(docs, keep=("lang", "source")).observe("quality rules", F.count("*").alias("documents"), F.count_if("kept").alias("kept"))
    return judged.where("kept").select("doc_id", F.col("clean_text").alias("text"), "lang", "source", F.length("clean_text").cast("long").alias("n_chars"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicates (five-word Jaccard similarity of 0.8 or more): the one with the least id, null ids last; of rows that share that id, the
    one with the least fingerprint. Rows are told apart by a key of their own, so texts that share an id, or have none,
    are judged one by one."""
    keyed = stored(docs.select(*COLUMNS).withColumn("_row", F.monotonically_increasing_id()))
    classes = near_copies.near_copies(keyed, id_col="_row")
    first = F.struct(F.col("doc_id").isNull(), "doc_id", "fingerprint", "_row")
    stay = classes.join(keyed.select("_row", "doc_id"), "_row").groupBy("component_id").agg(F.min(first).alias("_first"))
    return keyed.join(stay.select(F.col("_first._row").alias("_row")), "_row", "left_semi").select(*COLUMNS)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data replaced by its kind in angle brackets."""
    found = pii.find_pii(docs, keep=("lang", "source"))
    text = found.select("doc_id", pii.masked(F.col("text"), F.col("spans")).alias("text"), "lang", "source")
    return text.withColumn("n_chars", F.length("text").cast("long"))


def best_fit(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents with their places in sequences of 2048 tokens."""
    return packing.pack_best_fit(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("quality rules", quality_rules), ("SimHash near-dedup", near_dedup), ("personal data", personal_data), ("best-fit packing", best_fit)]

#: SQL has neither XXH64 fingerprints nor tokenizers; the tests compare run() with a brute-force version.
ORACLE_SQL = None


@cleared
def stage_result(stage, spark: SparkSession, docs: DataFrame, sf_dir: str) -> tuple[DataFrame]:
    """A stage's documents, written; what the stage stored on its way is deleted."""
    return (stored(stage(spark, docs, sf_dir)),)


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for i, (_, stage) in enumerate(STAGES[:-1]):
        (made,) = stage_result(stage, spark, docs, sf_dir)
        if i:
            discard(docs)
        docs = made
    return STAGES[-1][1](spark, docs, sf_dir)
