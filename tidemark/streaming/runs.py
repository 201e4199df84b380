"""Streaming runs that end: what has come so far is taken in, the sink is committed per batch, and the next run goes on
from the checkpoint."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..functions.storage import new_path

Sink = Callable[[DataFrame, int], None]


def once_per_batch(path: str) -> Sink:
    """For foreachBatch: each batch is a folder of its own under path, so a batch that comes again replaces itself."""

    def sink(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return sink


def run_available(stream: DataFrame, sink: Sink, checkpoint: str, output_mode: str = "append") -> None:
    """Takes in all that the sources hold now, then stops. A run after a crash starts with the batch that was not
    committed, under the same id."""
    query = stream.writeStream.foreachBatch(sink).outputMode(output_mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    if query.exception():
        raise query.exception()


def arriving(spark: SparkSession, slots: list[list[DataFrame]], make: Callable[[list[DataFrame]], DataFrame], sink: Sink, output_mode: str = "append") -> None:
    """Plays tables that arrive slot by slot: slots[i] holds what reaches each source in slot i. Each slot is written to the
    sources' folders and taken in by a run of its own, all runs over one checkpoint in the shared folder."""
    folders = [new_path(spark, "arrivals") for _ in slots[0]]
    checkpoint = new_path(spark, "streams")
    for parts in slots:
        for part, folder in zip(parts, folders, strict=True):
            part.write.mode("append").parquet(folder)
        sources = [spark.readStream.schema(part.schema).parquet(folder) for part, folder in zip(parts, folders, strict=True)]
        run_available(make(sources), sink, checkpoint, output_mode)
