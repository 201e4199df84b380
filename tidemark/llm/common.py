"""What several corpus operators share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Java's and RE2's spelling of the white space that separates words.
SPACE = r"[\x20\x09-\x0D]+"


def documents(spark: SparkSession, sf_dir: str, name: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share. Where none is configured, a local session gets one of its own; a
    cluster, whose machines do not see each other's folders, is told to name one."""
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not folder:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="checkpoints-"))
        folder = sc.getCheckpointDir()
    return folder.rstrip("/")


def stored(df: DataFrame) -> DataFrame:
    """Writes df once as Parquet in the shared folder and reads it back: lineage ends there, a lost executor costs no
    recomputation, and every later use sees the same rows. Tables of one application lie together, for drop_stored."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/stored-{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    made = spark.read.schema(df.schema).parquet(path)
    made._stored_at = path
    if _open:
        _open[-1].append(made)
    return made


#: Tables stored by the calls of cleared functions that are under way, the innermost last.
_open: list[list[DataFrame]] = []


def cleared(make: Callable[..., tuple[DataFrame, ...]]) -> Callable[..., tuple[DataFrame, ...]]:
    """For a function that returns stored tables: all others that it stored on the way are deleted when it returns."""

    @wraps(make)
    def run(*args, **named):
        _open.append([])
        try:
            made = make(*args, **named)
        finally:
            held = _open.pop()
        kept = {df._stored_at for df in made}
        for df in held:
            if df._stored_at not in kept:
                discard(df)
            elif _open:
                _open[-1].append(df)
        return made

    return run


def deleted(spark: SparkSession, path: str) -> None:
    sc = spark.sparkContext
    target = sc._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(sc._jsc.hadoopConfiguration()).delete(target, True)


def discard(df: DataFrame) -> None:
    """Deletes the table of a result of stored() that nothing reads any more."""
    deleted(df.sparkSession, df._stored_at)


def drop_stored(spark: SparkSession) -> None:
    """Deletes all tables that this application has stored. Results of the operators read them, so write those first."""
    deleted(spark, f"{shared_folder(spark)}/stored-{spark.sparkContext.applicationId}")


def field(df: DataFrame, column: str, name: str | None = None) -> T.StructField:
    return T.StructField(name or column, df.schema[column].dataType, True)


def text_or_empty(column: str) -> F.Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def words(text: F.Column) -> F.Column:
    """Array of the maximal runs of characters that are not white space."""
    return F.filter(F.split(text, SPACE), lambda w: w != "")
