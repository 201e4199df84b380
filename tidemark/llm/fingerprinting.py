"""Operator 6: document fingerprints by one-permutation MinHash. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import text_or_empty, words

#: Words of a shingle, bins as a power of two, bits kept of each bin.
SHINGLE, BIN_BITS, LOW_BITS = 5, 7, 8
#: Quantiles of numeric ids between which buckets of equal width are laid; buckets between ids of other kinds, which are
#: those of SAMPLE ids that the least hashes draw; rows that a bucket is meant to hold; most buckets, which bounds the
#: table of their first ids that is broadcast (some 20 MB).
KNOTS, OTHER_KNOTS, SAMPLE, BUCKET_ROWS, MOST_BUCKETS = 64, 256, 16_384, 4_096, 1 << 18


def with_prints(df: DataFrame, text: str, out: str) -> DataFrame:
    """Adds `out`: array of a short per bin, bin * 2**LOW_BITS + low bits, ascending.

    Each shingle is hashed once; the top bits of the hash choose the bin, the least hash of a bin stands for it. A bin
    left empty borrows from the bin in use that comes first in an order of bins drawn for it by hashing, which any two
    texts share (optimal densification). Texts of fewer words than a shingle have their whole sequence as the only one.
    """
    bins, low = 1 << BIN_BITS, (1 << LOW_BITS) - 1
    shingles = F.when(F.size("_w") < SHINGLE + 1, F.array(F.xxhash64(F.array_join("_w", " ")))).otherwise(F.transform(F.sequence(F.lit(1), F.size("_w") - (SHINGLE - 1)), lambda i: F.xxhash64(F.array_join(F.slice("_w", i, SHINGLE), " "))))
    bin_of = lambda h: F.shiftrightunsigned(h, 64 - BIN_BITS)
    step = df.withColumn("_w", words(F.col(text)))
    step = step.withColumn("_h", F.array_sort(shingles)).drop("_w")
    # hashes of one bin are neighbours once sorted, its least one first
    step = step.withColumn("_h", F.filter("_h", lambda h, i: F.coalesce(bin_of(h) != bin_of(F.get("_h", i - 1)), F.lit(True))))
    step = step.withColumn("_b", F.transform("_h", bin_of))
    empty = F.array_except(F.sequence(F.lit(0).cast("long"), F.lit(bins - 1).cast("long")), F.col("_b"))
    borrowed = lambda j: F.array_min(F.transform("_h", lambda h: F.xxhash64(bin_of(h), j).bitwiseAND(F.lit(~low)) + h.bitwiseAND(F.lit(low))))
    own = F.transform("_h", lambda h: (bin_of(h) * (low + 1) + h.bitwiseAND(F.lit(low))).cast("short"))
    lent = F.transform(empty, lambda j: (j * (low + 1) + borrowed(j).bitwiseAND(F.lit(low))).cast("short"))
    return step.withColumn(out, F.array_sort(F.concat(own, F.when(F.size("_b") < bins, lent).otherwise(F.array().cast("array<smallint>"))))).drop("_h", "_b")


def packed(prints: F.Column) -> F.Column:
    """The low bits of all bins in order, in lowercase hex."""
    low = 1 << LOW_BITS
    return F.lower(F.array_join(F.transform(prints, lambda e: F.substring(F.hex((e % low + low).cast("long")), 2, LOW_BITS // 4)), ""))


def likeness(a: F.Column, b: F.Column) -> F.Column:
    """Estimate of the Jaccard similarity of the shingles, from 0 to 1: the share of equal bins, without what low bits
    agree by chance."""
    chance = 2.0**-LOW_BITS
    return F.greatest(F.lit(0.0), (F.size(F.array_intersect(a, b)) / F.lit(float(1 << BIN_BITS)) - chance) / (1 - chance))


def fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id and fingerprint, 2**BIN_BITS * LOW_BITS bits in hex. Equal texts have equal ones; a
    null text is an empty one, whose only shingle is the empty string. Narrow."""
    return with_prints(docs.select(F.col(id_col), text_or_empty(text_col).alias("_text")), "_text", "_p").select(F.col(id_col), packed(F.col("_p")).alias("fingerprint"))


def bucket_of(ids: DataFrame, id_col: str) -> F.Column:
    """Number of the bucket of an id, growing with it; null ids are in bucket -1. The driver gets a bounded number of ids.

    Numeric ids: KNOTS quantiles, and buckets of equal width between two of them, so many that a bucket has about
    BUCKET_ROWS rows and each shuffle partition several buckets. Other ids: a bucket between each two of OTHER_KNOTS ids.
    """
    spark = ids.sparkSession
    x = F.col(id_col)
    if isinstance(ids.schema[id_col].dataType, T.NumericType):
        v = x.cast("double")
        row = ids.agg(F.count("*").alias("n"), F.percentile_approx(v, [k / KNOTS for k in range(KNOTS + 1)], 1000).alias("k")).first()
        knots = sorted(set(row["k"] or []))
        wanted = min(MOST_BUCKETS, max(row["n"] // BUCKET_ROWS, 8 * int(spark.conf.get("spark.sql.shuffle.partitions"))))
        width = -(-wanted // KNOTS)
    else:
        v = x.cast("string")
        drawn = sorted({r[0] for r in ids.select(v).where(x.isNotNull()).orderBy(F.xxhash64(v)).limit(SAMPLE).collect()})
        knots, width = drawn[:: -(-len(drawn) // OTHER_KNOTS) or 1], 1
    if not knots:
        return F.lit(-1).cast("long")
    laid = F.array(*map(F.lit, knots))
    at = F.size(F.filter(laid, lambda k: k <= v))
    part = F.lit(0).cast("long")
    if width > 1:
        lower, upper = F.coalesce(F.get(laid, at - 1), F.lit(0.0)), F.get(laid, at)
        part = F.greatest(F.lit(0), F.least(F.lit(width - 1), F.coalesce(F.floor((v - lower) / F.nullif(upper - lower, F.lit(0.0)) * width), F.lit(0)))).cast("long")
    return F.when(x.isNull(), -1).otherwise(at.cast("long") * width + part)


def next_in_line(docs: DataFrame, carried: list[str], *, id_col: str = "_id") -> DataFrame:
    """Adds `_next`: struct of `carried` of the row with the next smaller id; the last row gets the first one's.

    Ids are cut into buckets that grow with the ids. One shuffle brings a bucket together; the first rows of a bucket are
    copied to the bucket before it, and they are found by their ids, of which there are as many as buckets. Rows of one
    id are ordered by their text, and are in one bucket; null ids come last.
    """
    ids = docs.select(id_col)
    bucket = bucket_of(ids, id_col)
    firsts = ids.groupBy(bucket.alias("_bucket")).agg(F.max(id_col).alias("_first"))
    # at most MOST_BUCKETS rows and a few: what these windows and the broadcast see is bounded
    line = Window.orderBy("_bucket")
    everything = line.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    bottom, top, above = F.min("_bucket").over(everything), F.max("_bucket").over(everything), F.lead("_bucket").over(line)
    hosts = firsts.select("_first", F.when(F.col("_bucket") == top, bottom).otherwise(above).alias("_host"))
    rows = docs.withColumn("_bucket", bucket).join(F.broadcast(hosts), F.col(id_col).eqNullSafe(F.col("_first")), "left")
    place = lambda number, guest: F.struct(number.alias("bucket"), F.lit(guest).alias("guest"))
    copies = rows.withColumn("_place", F.explode(F.when(F.col("_host").isNotNull(), F.array(place(F.col("_bucket"), False), place(F.col("_host"), True))).otherwise(F.array(place(F.col("_bucket"), False)))))
    order = Window.partitionBy("_place.bucket").orderBy(F.col("_place.guest"), F.col(id_col).desc_nulls_last(), "_text")
    return copies.withColumn("_next", F.lead(F.struct(*carried)).over(order)).where(~F.col("_place.guest")).drop("_first", "_host", "_bucket", "_place")


def edited_fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text has its last floor(n_chars / 2) code points replaced by the first as many (or all) of the next
    document's, ids descending, the first document after the last. A null text is an empty one; a single row is its own
    next; an empty table gives no rows; repeated ids are ordered by their text (their rows meet in one task). Ids may be
    numbers, strings or dates, in their own order, nulls last. Other columns of docs are not read. One shuffle of the
    texts.
    """
    base = with_prints(docs.select(F.col(id_col).alias("_id"), text_or_empty(text_col).alias("_text")), "_text", "_p")
    n = F.length("_text")
    half = F.floor(n / 2).cast("int")
    step = next_in_line(base, ["_text", "_p"])
    step = step.withColumns({"_n": n.cast("long"), "_edited": F.concat(F.substring(F.col("_text"), F.lit(1), n - half), F.substring(F.col("_next._text"), F.lit(1), half)), "_next_p": F.col("_next._p")}).drop("_text", "_next")
    step = with_prints(step, "_edited", "_e")
    return step.select(F.col("_id").alias(id_col), F.col("_n").alias("n_chars"), F.sha2(F.col("_edited"), 256).alias("edited_sha256"), packed(F.col("_p")).alias("fingerprint"), packed(F.col("_e")).alias("edited_fingerprint"), likeness(F.col("_p"), F.col("_e")).alias("near_edited"), likeness(F.col("_p"), F.col("_next_p")).alias("near_next"))
