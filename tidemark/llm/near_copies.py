"""Near copies by the Jaccard similarity of word shingles: SimHash and MinHash propose pairs, the shingles decide.

Buckets of few texts are compared pair by pair. Texts of larger buckets are proposed by rare shingles instead: of two
similar texts, the shingles of each, put in one order, must agree within the first fifth or so. In the order of how many
of these texts hold a shingle, rarest first, a passage that many texts share comes last and proposes nothing.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cleared, discard, field, stored, text_or_empty
from .components import components
from .simhash import joining_links, print_of, shingle_hashes

#: Words of a shingle, least similarity, bands and the least hashes that make a band's key. A pair at the least
#: similarity shares no band with a probability of (1 - 0.8 ** 5) ** 32, about 3 in a million.
SHINGLE, LEAST, BANDS, ROWS = 5, 0.8, 32, 5
#: Members from which a bucket is left to rare shingles.
HOT = 32
#: Times that members of such buckets are compared with another centre, drawn for each bucket, before pairs are.
ROUNDS = 2
#: Bits of a text's parities. Two sets differ in as many elements at least as their parities differ in bits.
PARITIES = 1024

_draw = np.random.default_rng(42)
FACTORS, ADDED = _draw.integers(0, 1 << 64, BANDS * ROWS, np.uint64) | np.uint64(1), _draw.integers(0, 1 << 64, BANDS * ROWS, np.uint64)


def bands(hashes: np.ndarray) -> np.ndarray:
    """A key per band: mixes the least values that ROWS linear functions give over all hashes, and the band's number."""
    least = np.full(BANDS * ROWS, (1 << 64) - 1, np.uint64)
    for at in range(0, len(hashes), 2048):
        np.minimum(least, (hashes[at : at + 2048, None] * FACTORS + ADDED).min(axis=0), out=least)
    keys = np.arange(BANDS, dtype=np.uint64)
    for column in least.reshape(BANDS, ROWS).T:
        keys = (keys ^ column) * np.uint64(0x9E3779B97F4A7C15)
        keys ^= keys >> np.uint64(29)
    return keys


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of two arrays of distinct hashes."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both) if len(a) + len(b) else 1.0


def parities(hashes: np.ndarray) -> np.ndarray:
    """PARITIES bits as signed longs: of the hashes that each remainder has, whether their number is odd."""
    odd = np.bincount((hashes % np.uint64(PARITIES)).astype(np.int64), minlength=PARITIES) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def distinct_shingles(hashes: np.ndarray) -> tuple[np.ndarray, int]:
    """The distinct hashes, ascending, and a hash of them as a signed long."""
    from xxhash import xxh64_intdigest

    distinct = np.unique(hashes)
    return distinct, signed(xxh64_intdigest(distinct.tobytes()))


def sketches(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, set, n, print, bands): set is a hash of the distinct shingles, n their number."""
    out = T.StructType([field(docs, id_col), *(T.StructField(name, T.LongType()) for name in ("set", "n", "print")), T.StructField("bands", T.ArrayType(T.LongType()))])

    def run(batches):
        for batch in batches:
            sets, ns, prints, keys = [], [], [], []
            for text in batch.column(1).to_pylist():
                hashes = shingle_hashes(text, SHINGLE)
                distinct, key = distinct_shingles(hashes)
                sets.append(key)
                ns.append(len(distinct))
                prints.append(signed(print_of(hashes)))
                keys.append(bands(distinct).view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.int64()), pa.array(ns, pa.int64()), pa.array(prints, pa.int64()), pa.array(keys, pa.list_(pa.int64()))], names=out.names)

    return docs.select(F.col(id_col), text_or_empty(text_col).alias("text")).mapInArrow(run, out)


def shingles_of(docs: DataFrame, chosen: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(set, n, parities, shingles) of the sets of chosen (set, least: an id that has it); a set again for each row that has
    both, which changes no result."""
    def run(batches):
        for batch in batches:
            sets, ns, odd, held = [], [], [], []
            for text in batch.column(0).to_pylist():
                distinct, key = distinct_shingles(shingle_hashes(text, SHINGLE))
                sets.append(key)
                ns.append(len(distinct))
                odd.append(parities(distinct))
                held.append(distinct.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(sets, pa.int64()), pa.array(ns, pa.int64()), pa.array(odd, pa.list_(pa.int64())), pa.array(held, pa.binary())], names=["set", "n", "parities", "shingles"])

    texts = docs.select(F.col(id_col), text_or_empty(text_col).alias("text")).join(chosen, F.col(id_col).eqNullSafe(F.col("least")), "left_semi").select("text")
    # an id may stand for several texts
    return texts.mapInArrow(run, "set long, n long, parities array<long>, shingles binary").join(chosen, "set", "left_semi")


def few_differ(a: str, b: str, least: float) -> F.Column:
    """Whether the parities of two texts, structs of n and parities, allow a similarity of `least`."""
    differ = sum(F.bit_count(F.get(f"{a}.parities", i).bitwiseXOR(F.get(f"{b}.parities", i))) for i in range(PARITIES // 64))
    return differ * (1 + least) <= (F.col(f"{a}.n") + F.col(f"{b}.n")) * (1 - least) + 1e-6


def joined(pairs: DataFrame, table: DataFrame, columns: list[str]) -> DataFrame:
    """pairs (a, b) with structs x and y of the columns of either end in table (set, columns)."""
    end = lambda side, name: table.select(F.col("set").alias(side), F.struct(*columns).alias(name))
    return pairs.join(end("a", "x"), "a").join(end("b", "y"), "b")


def verified(pairs: DataFrame, shingles: DataFrame, least: float) -> DataFrame:
    """(a, b) of the pairs of sets that are similar enough, stored; a pair may come again. Their parities rule most others out before shingles are
    brought together; those in use are written first, so that a set in many pairs is joined from a table and can be split."""
    likely = stored(joined(pairs, shingles.hint("merge"), ["n", "parities"]).where(few_differ("x", "y", least)).select("a", "b"))
    ends = likely.select(F.col("a").alias("set")).unionAll(likely.select(F.col("b").alias("set"))).distinct()
    used = stored(shingles.select("set", "shingles").join(ends, "set", "left_semi"))

    def run(batches):
        for batch in batches:
            x, y = (pyarrow.compute.struct_field(batch.column(k), 0) for k in (2, 3))
            likes = [similarity(np.frombuffer(x[i].as_py(), np.uint64), np.frombuffer(y[i].as_py(), np.uint64)) >= least for i in range(batch.num_rows)]
            yield batch.select(["a", "b"]).filter(pa.array(likes, pa.bool_()))

    made = stored(joined(likely, used, ["shingles"]).select("a", "b", "x", "y").mapInArrow(run, "a long, b long"))
    discard(used)
    discard(likely)
    return made


def rare_shingles(texts: DataFrame, least: float) -> DataFrame:
    """(set, n, key, shared, mean) of texts (set, n, shingles): the shingles among which two texts of similarity `least`
    or more meet, as key.

    A text has n shingles; a similar one shares ceil(least * n) of them at least, and so one of any n - ceil(least * n) + 1.
    Those that fewest of the texts hold are taken; one that no other text holds is left out, as it meets nothing. shared:
    how many of its shingles are not before this one in that order, so two texts that meet here first have no more in
    common than either's; mean: by how many texts its shingles are held, on average.
    """
    def each(batches):
        for batch in batches:
            sizes = np.array([len(x.as_py()) // 8 for x in batch.column(2)], np.int64)
            at = pa.array(np.repeat(np.arange(batch.num_rows), sizes), pa.int64())
            keys = np.frombuffer(b"".join(x.as_py() for x in batch.column(2)), np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(keys, pa.int64())], names=["set", "n", "key"])

    spread = stored(texts.select("set", "n", "shingles").mapInArrow(each, "set long, n long, key long"))
    held = stored(spread.groupBy("key").agg(F.count("*").alias("texts")).where("texts > 1"))
    met = spread.join(held, "key").groupBy("set", "n").agg(F.sort_array(F.collect_list(F.struct("texts", "key"))).alias("met"), F.avg("texts").alias("mean"))
    first = F.size("met") - F.ceil(F.col("n") * least - 1e-9) + 1
    return met.where(first > 0).select("set", "n", "mean", F.size("met").alias("shared"), F.posexplode(F.slice("met", 1, first.cast("int"))).alias("at", "m")).select("set", "n", (F.col("shared") - F.col("at")).cast("long").alias("shared"), "mean", F.col("m.key").alias("key"))


@cleared
def classes_of(docs: DataFrame, id_col: str, text_col: str, least: float, hot: int) -> tuple[DataFrame, DataFrame]:
    """The texts' sketches, and the component of each set of shingles; see near_copies."""
    made = stored(sketches(docs, id_col, text_col))
    nodes = stored(made.groupBy("set").agg(F.min(id_col).alias("least"), F.first("n").alias("n"), F.first("print").alias("print"), F.first("bands").alias("bands")))
    pair = lambda x, y: (F.least(x, y).alias("a"), F.greatest(x, y).alias("b"))
    banded = nodes.select("set", "n", F.explode("bands").alias("key"))
    sizes = stored(banded.groupBy("key").agg(F.count("*").alias("m")).where("m > 1"))
    # most keys are of one text, so both sides grow alike: the same join at every size
    banded = stored(banded.join(sizes.hint("merge"), "key"))
    prints = stored(nodes.groupBy("print").agg(F.min("set").alias("one")))
    same = nodes.select("print", "set").join(prints, "print").where("set != one").select(*pair(F.col("set"), F.col("one")))
    close = joining_links(prints.select("print")).join(prints.select(F.col("print").alias("a"), F.col("one").alias("x")), "a").join(prints.select(F.col("print").alias("b"), F.col("one").alias("y")), "b").select(*pair(F.col("x"), F.col("y")))
    close = stored(same.unionAll(close).distinct())
    met = banded.select("set").unionAll(close.select(F.col("a").alias("set"))).unionAll(close.select(F.col("b").alias("set"))).distinct()
    chosen = stored(nodes.select("set", "least").join(met, "set"))
    shingles = stored(shingles_of(docs, chosen, id_col, text_col))
    busy = stored(banded.where(F.col("m") > hot).select("set").distinct())
    members = banded.where(F.col("m") <= hot).select("set", "n", "key", F.col("n").alias("shared"), F.col("n").cast("double").alias("mean"))
    if not busy.isEmpty():
        members = stored(members.unionByName(rare_shingles(shingles.join(busy, "set", "left_semi"), least)))
    # what two texts have in common is no more than either has left at the first bucket where they meet
    alike = lambda x, y: F.least(x["shared"], y["shared"]) * (1 + least) >= (x["n"] + y["n"]) * least - 1e-6
    centred = lambda rows, first: rows.groupBy("key").agg(F.count("*").alias("m"), F.max(F.struct(first, "n", "shared", "set")).alias("centre")).where("m > 1")
    to_centre = lambda rows, centres: rows.join(stored(centres.select("key", "centre")), "key").where((F.col("set") != F.col("centre.set")) & alike(F.struct("n", "shared"), F.col("centre"))).select(*pair(F.col("set"), F.col("centre.set")))
    near = to_centre(members, centred(members, F.col("mean")))
    links = verified(stored(near.unionAll(close).distinct()), shingles, least)
    rest = members
    for again in range(ROUNDS + 1):
        grouped = stored(components(links).select(F.col("node").alias("set"), "component"))
        rest = rest.select("set", "n", "key", "shared", "mean").join(grouped, "set", "left").withColumn("component", F.coalesce("component", "set"))
        # buckets whose members are all in one component have no pair left
        split = stored(rest.groupBy("key").agg(F.count("*").alias("m"), F.min("component").alias("low"), F.max("component").alias("high")).where("low < high").select("key", "m"))
        rest = stored(rest.join(split.select("key"), "key", "left_semi"))
        large = split.where(F.col("m") > hot).select("key")
        if again == ROUNDS or large.isEmpty():
            break
        rows = rest.join(large, "key", "left_semi")
        links = stored(links.unionAll(verified(stored(to_centre(rows, centred(rows, F.xxhash64("set", "key", F.lit(again)))).distinct()), shingles, least)).distinct())
    # parities repeat in every bucket of a set and take a fraction of their size as files: Spark would broadcast too much
    rest = stored(rest.join(shingles.select("set", "parities").distinct().hint("merge"), "set"))
    left, right = (rest.select("key", F.struct("set", "n", "shared", "component", "parities").alias(side)) for side in ("x", "y"))
    more = left.join(right.hint("merge"), "key").where((F.col("x.set") < F.col("y.set")) & (F.col("x.component") != F.col("y.component")) & alike(F.col("x"), F.col("y")) & few_differ("x", "y", least)).select(F.col("x.set").alias("a"), F.col("y.set").alias("b"))
    links = links.unionAll(verified(stored(more.distinct()), shingles, least))
    found = stored(components(links).select(F.col("node").alias("set"), "component").join(nodes.select("set", "least"), "set"))
    ids = stored(found.groupBy("component").agg(F.min("least").alias("component_id")))
    classes = stored(nodes.select("set", "least").join(found.join(ids, "component").select("set", "component_id"), "set", "left").select("set", F.coalesce("component_id", "least").alias("component_id")))
    return made, classes


def near_copies(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", least: float = LEAST, hot: int = HOT) -> DataFrame:
    """One row per row of docs: id, fingerprint (16 lowercase hex digits, equal for equal shingles), component_id.

    Texts with a Jaccard similarity of `least` or more of their SHINGLE-word shingles (A-Z as a-z) are linked;
    component_id is the least id that links reach. Pairs are proposed by fingerprints that differ in 3 bits at most and by
    MinHash bands, and counted by their shingles alone. Texts of the same shingles are one node. A pair of which all common
    buckets hold more than `hot` texts is proposed by rare shingles, which miss no pair. In all buckets, each member is
    first compared with one of them, the likeliest centre (in large buckets with others too); then all pairs not yet in
    one component are, where positions of common shingles and parities do not rule a similarity of `least` out.
    A text of fewer words has one shingle; a null text is an empty one, and empty texts are alike. A null id is kept and
    stands for a component only where no other id is; repeated rows stay repeated; an empty table gives no rows; other
    columns of docs are not read.
    """
    made, classes = classes_of(docs, id_col, text_col, least, hot)
    return made.select(id_col, "set").join(classes, "set").select(F.col(id_col), F.lower(F.lpad(F.hex("set"), 16, "0")).alias("fingerprint"), "component_id")
