"""Streams: half-hour roll-up with late ticks, newest revision, valuation of two joined streams."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.battery import interval_value
from ..operators.keys import dedupe_last
from ..operators.merging import merge_into, newest_wins


def stream_half_hour_rollup(ticks: DataFrame, key: list[str], ts: str, columns: list[str], late: str = "10 minutes") -> DataFrame:
    """Means per key and interval (start, end]; ticks later than `late` behind the newest are dropped by the watermark.
    A microsecond is taken off, as Spark's windows hold their start and not their end."""
    shifted = ticks.withColumn("_at", F.col(ts).cast("timestamp") - F.expr("interval 1 microsecond")).withWatermark("_at", late)
    return shifted.groupBy(*key, F.window("_at", "30 minutes").alias("_w")).agg(*[F.avg(c).alias(c) for c in columns]).select(*key, F.col("_w.end").alias("interval_end"), *columns)


def newest_revision_sink(path: str, staging: str, key: list[str], updated: str, day: str, ties: list[str] | None = None) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: merges a batch into the table at path, which is partitioned by day, a part of the key. Only the
    days of the batch are read and written. A batch that comes again under its id, after a crash at any point, changes
    nothing more, see merging.merge_into. Of a batch's rows of one key and stamp the greatest in `ties` counts."""

    def sink(batch: DataFrame, batch_id: int) -> None:
        newest = dedupe_last(batch, key, [F.col(updated), *map(F.col, ties or [])])
        merge_into(batch.sparkSession, path, newest, day, newest_wins(key, updated), staging, batch_id)

    return sink


def stream_interval_value(dispatch: DataFrame, prices: DataFrame, region: str, ts: str, mw: str, price: str, late: str = "30 minutes") -> DataFrame:
    """Dispatch valued at its region's price of the same interval; either side waits for the other within `late`."""
    a = dispatch.withWatermark(ts, late)
    b = prices.select(F.col(region).alias("_region"), F.col(ts).alias("_ts"), F.col(price)).withWatermark("_ts", late)
    joined = a.join(b, (F.col(region) == F.col("_region")) & (F.col(ts) == F.col("_ts"))).drop("_region", "_ts")
    return interval_value(joined, mw, price)
