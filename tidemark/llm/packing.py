"""Operator 8: best-fit packing, planned on the histogram of lengths."""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import field, stored, text_or_empty
from .tokenizing import worker_encoder


def plan_best_fit(histogram: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Best-fit decreasing over counts. Rows (length, first rank, ranks, first sequence, offset): the pieces of that
    length with these ranks (from 0) go at that offset of consecutive sequences. Sequences alike are handled together,
    so the work depends on the capacity and not on how many pieces there are."""
    room: dict[int, list[tuple[int, int]]] = {}  # free places -> runs (first sequence, sequences)
    free: list[int] = []  # keys of room, ascending
    plan, used = [], 0

    def put(left: int, run: tuple[int, int]) -> None:
        if left not in room:
            room[left] = []
            insort(free, left)
        room[left].append(run)

    for length in sorted(histogram, reverse=True):
        rank, todo = 0, histogram[length]
        while todo:
            at = bisect_left(free, length)
            if at < len(free):
                left = free[at]
                first, n = room[left].pop()
                if not room[left]:
                    del room[left], free[at]
                take = min(n, todo)
                if take < n:
                    put(left, (first + take, n - take))
            else:
                # as many new sequences as these pieces alone need
                left, first, take = capacity, used, -(-todo // (capacity // length))
                used += take
            plan.append((length, rank, take, first, capacity - left))
            if left > length:
                put(left - length, (first, take))
            rank, todo = rank + take, todo - take
    return plan


def encode_pieces(docs: DataFrame, tokenizer: str, *, id_col: str = "doc_id", text_col: str = "text", capacity: int = 2048, end_id: int = 0) -> DataFrame:
    """One row per piece: id, piece, start, length, ids_crc32. Each text is its ids and end_id; a longer one than
    capacity is cut into pieces of capacity, the first of which may be shorter. Narrow."""
    out = T.StructType([field(docs, id_col), T.StructField("piece", T.IntegerType()), T.StructField("start", T.LongType()), T.StructField("length", T.LongType()), T.StructField("ids_crc32", T.LongType())])
    end = end_id.to_bytes(4, "little")

    def run(batches):
        encoder = worker_encoder(tokenizer)
        for batch in batches:
            rows, columns = [], [[], [], [], []]
            for row, text in enumerate(batch.column(1).to_pylist()):
                ids = encoder.packed(text) + end
                n = len(ids) // 4
                starts = [0, *range(n % capacity or capacity, n, capacity)]
                for piece, (start, until) in enumerate(zip(starts, [*starts[1:], n], strict=True)):
                    rows.append(row)
                    for values, value in zip(columns, (piece, start, until - start, zlib.crc32(ids[4 * start : 4 * until])), strict=True):
                        values.append(value)
            kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), *(pa.array(v, k) for v, k in zip(columns, kinds, strict=True))], names=out.names)

    return docs.select(F.col(id_col), text_or_empty(text_col).alias("text")).mapInArrow(run, out)


def pack_best_fit(docs: DataFrame, tokenizer: str, *, id_col: str = "doc_id", text_col: str = "text", capacity: int = 2048, end_id: int = 0) -> DataFrame:
    """One row per piece: id, piece, start, length, ids_crc32, sequence_id, offset; sequences are filled without gaps
    from offset 0 and hold at most capacity tokens.

    The pieces are written once, so ranks stay the same whatever is computed again. The driver sees only the histogram
    of lengths, at most capacity rows, and plans runs of alike sequences; pieces find their place by joining on length
    and rank within length. Ranks are counted per length and salt, the salts' counts give the offsets between them, so
    a length that most rows have, or one row that is repeated, is spread over as many tasks as there are shuffle
    partitions (the salt is drawn per row and stored with it). The plan is broadcast:
    its size depends on capacity alone (1 MB at capacity 2048, for 0.1 and for 0.5 GB of documents).

    A null text is an empty one (end_id alone); repeated rows are packed as often as they occur; a null id is kept;
    an empty table gives no rows. Other columns of docs are not read.
    """
    spark = docs.sparkSession
    salts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    pieces = stored(encode_pieces(docs, tokenizer, id_col=id_col, text_col=text_col, capacity=capacity, end_id=end_id).withColumn("_salt", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(salts)).cast("int")))
    counts = pieces.groupBy("length", "_salt").agg(F.count("*").alias("n"))
    by_length = Window.partitionBy("length").orderBy("_salt")
    before = counts.select("length", "_salt", (F.sum("n").over(by_length) - F.col("n")).alias("_before"))
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most capacity rows
    plan = spark.createDataFrame(plan_best_fit(histogram, capacity), "length long, _rank long, _n long, _sequence long, offset long")
    within = Window.partitionBy("length", "_salt").orderBy(F.col(id_col), "piece", "ids_crc32")
    ranked = pieces.withColumn("_in", F.row_number().over(within).cast("long") - 1).join(before, ["length", "_salt"]).withColumn("_at", F.col("_before") + F.col("_in"))
    slot = (F.col("p.length") == F.col("r.length")) & (F.col("r._at") >= F.col("p._rank")) & (F.col("r._at") < F.col("p._rank") + F.col("p._n"))
    placed = ranked.alias("r").join(F.broadcast(plan.alias("p")), slot)
    sequence = F.col("p._sequence") + F.col("r._at") - F.col("p._rank")
    return placed.select(*[F.col(f"r.{c}").alias(c) for c in (id_col, "piece", "start", "length", "ids_crc32")], sequence.alias("sequence_id"), F.col("p.offset").alias("offset"))
