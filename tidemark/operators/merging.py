"""Merges into a table that is partitioned by day: only the days that a batch touches are read and written.

The stored side is read with the batch's days as a filter on the partition column, so Spark lists and scans those folders
alone, and what comes out replaces them by dynamic partition overwrite; files of other days stay as they are.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from .keys import newest_wins_merge, plain_upsert, replace_slice

#: Days that are written into the plan as a filter; beyond, they are joined, and Spark prunes by the join.
MOST_LITERAL_DAYS = 1_000
Merge = Callable[[DataFrame, DataFrame], DataFrame]


def exists(spark: SparkSession, path: str, name: str = "") -> bool:
    sc = spark.sparkContext
    at = sc._jvm.org.apache.hadoop.fs.Path(f"{path}/{name}" if name else path)
    return at.getFileSystem(sc._jsc.hadoopConfiguration()).exists(at)


def stored_days(spark: SparkSession, path: str, schema, day: str, days: list | DataFrame) -> DataFrame:
    """The rows of a partitioned table on the given days; none where the table is not there yet. A null day is a day."""
    if not exists(spark, path):
        return spark.createDataFrame([], schema)
    table = spark.read.schema(schema).parquet(path).select(*schema.names)
    if isinstance(days, DataFrame):
        return table.join(days, table[day].eqNullSafe(days[day]), "left_semi")
    known = [d for d in days if d is not None]
    return table.where(F.col(day).isin(known) | (F.col(day).isNull() if None in days else F.lit(False)))


def touched_days(batch: DataFrame, day: str, most: int = MOST_LITERAL_DAYS) -> list | DataFrame:
    """The distinct days of a batch: a list of up to `most`, else a table."""
    days = batch.select(day).distinct()
    few = [r[0] for r in days.limit(most + 1).collect()]
    return few if len(few) <= most else days


def merged_days(spark: SparkSession, path: str, batch: DataFrame, day: str, merge: Merge) -> DataFrame:
    """What the days of the batch hold once it is merged in: merge(stored rows of those days, batch)."""
    return merge(stored_days(spark, path, batch.schema, day, touched_days(batch, day)), batch)


def write_days(df: DataFrame, path: str, day: str) -> None:
    """Replaces the days that df holds. Rows are dealt by day, so a day is few files."""
    df.repartition(F.col(day)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(day).parquet(path)


def merge_into(spark: SparkSession, path: str, batch: DataFrame, day: str, merge: Merge, staging: str, batch_id: int | str = 0) -> None:
    """Merges a batch into the table at path, once and whole even if it comes again or the job dies on the way.

    What the touched days become is first written to staging/<batch_id>, which Spark marks when complete; only then are
    the days replaced, from there. A batch whose staged days are complete is not merged again but put in place again, so
    a crash before, amid or after the replacement ends in the same table. Staged days of other batches go once this one
    is staged: keep one staging folder per table and one writer. Readers may see some of the days replaced before others.
    """
    at = f"{staging}/{batch_id}"
    if not exists(spark, at, "_SUCCESS"):
        merged_days(spark, path, batch, day, merge).write.mode("overwrite").parquet(at)
        clear_other(spark, staging, str(batch_id))
    write_days(spark.read.schema(batch.schema).parquet(at), path, day)


def clear_other(spark: SparkSession, folder: str, keep: str) -> None:
    sc = spark.sparkContext
    at = sc._jvm.org.apache.hadoop.fs.Path(folder)
    fs = at.getFileSystem(sc._jsc.hadoopConfiguration())
    for status in fs.listStatus(at):
        if status.getPath().getName() != keep:
            fs.delete(status.getPath(), True)


def newest_wins(key: list[str], updated: str) -> Merge:
    """Rows of the batch give way only to newer stored ones of their key; the day is part of the key."""
    return lambda stored, batch: newest_wins_merge(stored, batch, key, updated)


def upsert(key: list[str]) -> Merge:
    """Rows of the batch take the place of stored ones of their key; the day is part of the key."""
    return lambda stored, batch: plain_upsert(stored, batch, key)


def replace(slice_cols: list[str]) -> Merge:
    """Slices that the batch touches are replaced whole; the day is one of the slice's columns."""
    return lambda stored, batch: replace_slice(stored, batch, slice_cols)


def read_table(spark: SparkSession, path: str, schema) -> DataFrame:
    """The whole table, columns in the schema's order; empty where nothing was merged yet."""
    try:
        return spark.read.schema(schema).parquet(path).select(*schema.names)
    except AnalysisException:
        if exists(spark, path):
            raise
        return spark.createDataFrame([], schema)
