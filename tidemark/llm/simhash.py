"""Operator 2: SimHash near-duplicates by deletion-variant signatures."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cleared, field, stored, text_or_empty
from .components import components

#: Members from which a bucket of variants is cut by variants of the other segment too.
HOT = 2_000
#: Hashes whose bits are counted at once.
BLOCK = 1 << 16


def shingle_hashes(text: str, size: int = 3, seed: int = 42) -> np.ndarray:
    """XXH64 of each shingle in order, repeats included: one of all words if there are fewer than `size`, none of no words."""
    from xxhash import xxh64_intdigest

    found = text.encode().lower().split()  # bytes: A-Z and the six ASCII white-space characters only
    if not found:
        return np.zeros(0, "<u8")
    joined = b" ".join(found)
    if len(found) < size:
        hashes = [xxh64_intdigest(joined, seed)]
    else:
        ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1)
        starts = np.concatenate([[0], ends[: len(found) - size]])
        hashes = [xxh64_intdigest(joined[a:b], seed) for a, b in zip(starts.tolist(), (ends[size - 1 :] - 1).tolist(), strict=True)]
    return np.array(hashes, "<u8")


def print_of(hashes: np.ndarray) -> int:
    """Unsigned 64-bit fingerprint of hashes: a bit is set if it is set in over half of them."""
    if not len(hashes):
        return 0
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), BLOCK):
        counts += np.unpackbits(hashes[at : at + BLOCK].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    over = counts * 2 > len(hashes)
    return int(np.packbits(over, bitorder="little").view("<u8")[0])


def simhash(text: str, size: int = 3, seed: int = 42) -> int:
    """Unsigned 64-bit fingerprint: a bit is set if it is set in over half of the shingles' XXH64, repeats included."""
    return print_of(shingle_hashes(text, size, seed))


def fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", size: int = 3) -> DataFrame:
    """(id, print): print is the fingerprint as a signed long. A null text counts as one without words: print 0."""
    out = T.StructType([field(docs, id_col), T.StructField("print", T.LongType())])

    def run(batches):
        for batch in batches:
            made = np.array([simhash(x, size) for x in batch.column(1).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.int64())], names=out.names)

    return docs.select(F.col(id_col), text_or_empty(text_col).alias("text")).mapInArrow(run, out)


def low_half(x: F.Column) -> F.Column:
    return x.bitwiseAND(F.lit(0xFFFFFFFF))


def high_half(x: F.Column) -> F.Column:
    return low_half(F.shiftrightunsigned(x, 32))


def variants(segment: F.Column, bits: int, tag: int) -> F.Column:
    """Array of keys, one per bit of the segment: tag, the bit's number, and the segment with that bit cleared."""
    keep = (1 << bits) - 1
    return F.array(*[segment.bitwiseAND(F.lit(keep & ~(1 << i))) + F.lit(((tag << 5) | i) << bits) for i in range(bits)])


def only_bit(x: F.Column, at: F.Column) -> F.Column:
    """Whether x has no bit but the one at that place; with no bit at all, only the first place counts."""
    return F.when(x == 0, at == 0).otherwise(x == F.expr("1L") * F.call_function("shiftleft", F.lit(1).cast("long"), at.cast("int")))


def cut_further(key: F.Column, x: F.Column) -> F.Column:
    """Keys of the parts of a bucket of one-bit variants: there the other half differs by 3 bits at most, and so one of
    its quarters by one at most."""
    other = F.when(F.shiftrightunsigned(key, 37) == 1, high_half(x)).otherwise(low_half(x))
    return F.concat(variants(F.shiftrightunsigned(other, 16), 16, 0), variants(other.bitwiseAND(F.lit(0xFFFF)), 16, 1))


def keys_of(prints: DataFrame) -> DataFrame:
    """(print, key): the 64 one-wildcard variants of the two halves. Dealt out first, to a stated number of partitions that
    Spark does not join again, as there are 64 rows for each. Spark takes them for as large as the prints, so a join must
    not leave it to that size whether they are broadcast."""
    x, tasks = F.col("print"), int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return prints.repartition(tasks, "print").select(x, F.explode(F.concat(variants(high_half(x), 32, 0), variants(low_half(x), 32, 1))).alias("key"))


def linked_prints(prints: DataFrame, *, distance: int = 3, hot: int = HOT) -> DataFrame:
    """(a, b): all pairs of distinct prints that differ in at most `distance` (up to 3) bits, each once.

    Two halves of 32 bits: at 3 differing bits, one half differs by one bit at most, so the two prints share one of its
    32 keys that leave a bit out. Keys are joined by equality and the pairs verified; a pair counts only at the first
    key that it shares. In a bucket of more than `hot` prints, the keys are cut further by the one-bit variants of the
    other half's quarters, which loses no pair. prints must be distinct and not null. A dense group of m prints has up
    to m * m / 2 links; where only components are wanted, joining_links makes fewer.
    """
    if distance > 3:
        raise ValueError("two halves find prints that differ in 3 bits at most")
    keyed = keys_of(prints)
    crowded = keyed.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > hot).select("key", F.lit(True).alias("crowded"))
    second = F.shiftrightunsigned("key", 37) == 1
    at = F.shiftrightunsigned("key", 32).bitwiseAND(F.lit(31))
    cut = keyed.join(crowded, "key", "left").select("print", "key", F.explode(F.when(F.col("crowded"), cut_further(F.col("key"), F.col("print"))).otherwise(F.array(F.lit(-1).cast("long")))).alias("part"))
    left, right = cut.select(F.col("print").alias("a"), "key", "part"), cut.select(F.col("print").alias("b"), "key", "part")
    differ = F.col("a").bitwiseXOR(F.col("b"))
    high, low = high_half(differ), low_half(differ)
    first_key = F.when(second, (F.bit_count(high) > 1) & only_bit(low, at)).otherwise(only_bit(high, at))
    rest = F.when(second, high).otherwise(low)
    upper, lower = F.shiftrightunsigned(rest, 16), rest.bitwiseAND(F.lit(0xFFFF))
    part_at = F.shiftrightunsigned("part", 16).bitwiseAND(F.lit(31))
    first_part = F.when(F.col("part") < 0, True).when(F.shiftrightunsigned("part", 21) == 1, (F.bit_count(upper) > 1) & only_bit(lower, part_at)).otherwise(only_bit(upper, part_at))
    return left.join(right.hint("merge"), ["key", "part"]).where((F.col("a") < F.col("b")) & (F.bit_count(differ) <= distance) & first_key & first_part).select("a", "b")


def joining_links(prints: DataFrame, *, distance: int = 3, hot: int = HOT) -> DataFrame:
    """(a, b): links of distinct prints that differ in at most `distance` (up to 3) bits, enough to give the components
    that all such pairs give.

    Buckets as in linked_prints. In one of up to `hot` prints, all pairs are compared. In a larger one, each print is
    first compared with the least one; then only prints of different components are, in the bucket's parts, so a dense
    group costs a link for each print and key and not one for each pair.
    """
    if distance > 3:
        raise ValueError("two halves find prints that differ in 3 bits at most")
    near = lambda x, y: F.bit_count(x.bitwiseXOR(y)) <= distance
    keyed = keys_of(prints)
    crowded = stored(keyed.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > hot).select("key"))
    quiet = keyed.join(crowded, "key", "left_anti") if (busy := not crowded.isEmpty()) else keyed
    left, right = quiet.select(F.col("print").alias("a"), "key"), quiet.select(F.col("print").alias("b"), "key")
    links = left.join(right.hint("merge"), "key").where((F.col("a") < F.col("b")) & near(F.col("a"), F.col("b"))).select("a", "b").distinct()
    if not busy:
        return links
    full = stored(keyed.join(crowded, "key", "left_semi"))
    full = stored(full.join(stored(full.groupBy("key").agg(F.min("print").alias("first"))), "key"))
    stars = full.where((F.col("first") < F.col("print")) & near(F.col("first"), F.col("print"))).select(F.col("first").alias("a"), F.col("print").alias("b")).distinct()
    links = stored(links.unionAll(stars).distinct())
    grouped = stored(components(links))
    parts = full.join(grouped, F.col("print") == F.col("node"), "left").select("print", "key", F.coalesce("component", "print").alias("component"), F.explode(cut_further(F.col("key"), F.col("print"))).alias("part"))
    split = parts.groupBy("key", "part").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high").select("key", "part")
    rest = stored(parts.join(split, ["key", "part"], "left_semi"))
    left, right = (rest.select("key", "part", F.col("print").alias(name), F.col("component").alias(f"of_{name}")) for name in "ab")
    more = left.join(right.hint("merge"), ["key", "part"]).where((F.col("of_a") < F.col("of_b")) & near(F.col("a"), F.col("b"))).select("a", "b")
    return links.unionAll(more.distinct())


@cleared
def classes_of(docs: DataFrame, id_col: str, text_col: str, size: int, distance: int, hot: int, count_links: bool) -> tuple[DataFrame, DataFrame]:
    """The texts' fingerprints, and the component of each fingerprint; see near_duplicates."""
    printed = stored(fingerprints(docs, id_col=id_col, text_col=text_col, size=size))
    distinct = stored(printed.groupBy("print").agg(F.min(id_col).alias("least")))
    links = stored((linked_prints if count_links else joining_links)(distinct.select("print"), distance=distance, hot=hot))
    found = stored(components(links).withColumnRenamed("node", "print").join(distinct, "print"))
    least = stored(found.groupBy("component").agg(F.min("least").alias("component_id")))
    grouped = found.join(least, "component").select("print", "component_id")
    classes = distinct.join(grouped, "print", "left").select("print", F.coalesce("component_id", "least").alias("component_id"))
    if count_links:
        ends = links.select(F.col("a").alias("print")).unionAll(links.select(F.col("b").alias("print"))).groupBy("print").agg(F.count("*").alias("n_links"))
        classes = classes.join(ends, "print", "left").select("print", "component_id", F.coalesce("n_links", F.lit(0)).alias("n_links"))
    return printed, stored(classes)


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", size: int = 3, distance: int = 3, hot: int = HOT, count_links: bool = False) -> DataFrame:
    """One row per row of docs: id, fingerprint (16 lowercase hex digits), component_id and, with count_links, n_links.

    component_id is the least id reachable over links of fingerprints that differ in `distance` bits at most, the row's
    own included. Copies share a fingerprint, so a group of any size is one node. n_links counts the other distinct
    fingerprints linked to the row's own; it takes all links, of which a dense group has the square of its size. A null
    or empty text has fingerprint zero, linked like any other; a null id is kept, and is the component only where no
    other id is; repeated rows stay repeated; an empty table gives no rows. Other columns of docs are not read.

    What is joined on a hot key (a fingerprint of many copies, a giant component) is read from stored tables on both
    sides, so Spark's adaptive join can split it.
    """
    printed, classes = classes_of(docs, id_col, text_col, size, distance, hot, count_links)
    return printed.join(classes, "print").select(F.col(id_col), F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id", *(["n_links"] if count_links else []))
