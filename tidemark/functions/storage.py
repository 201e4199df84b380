"""Tables written on the way: they end lineage, and every later use sees the same rows."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir, which driver and executors share. Only a local session without it gets a folder of its own."""
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not folder:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="checkpoints-"))
        folder = sc.getCheckpointDir()
    return folder.rstrip("/")


def new_path(spark: SparkSession, kind: str = "stored") -> str:
    """A path that nothing lies at yet, beside the other tables of this application."""
    return f"{shared_folder(spark)}/{kind}-{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"


def dealt(df: DataFrame, rows: int, *keys: str, each: int = 100_000) -> DataFrame:
    """df by keys in parts of about `each` of its `rows` rows, so that a task gets no more of a larger table; at least as many
    parts as a shuffle has."""
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(max(least, -(-rows // each)), *keys)


def written(df: DataFrame) -> DataFrame:
    """df as a Parquet table in the shared folder."""
    path = new_path(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
