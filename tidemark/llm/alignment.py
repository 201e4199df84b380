"""Operator 13: alignment of two tokenizers' tokens by pointer jumping.

Tokens of a text are byte ranges of it, under either tokenizer. Every token points to the token of the other side that
overlaps it farthest to the right, a token that ends with its partner to itself; doubling all pointers at once leads each
token to the last one of its group, which labels the group.
"""

from __future__ import annotations

import hashlib
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import discard, field, stored, text_or_empty
from .tokenizing import Memo, TextEncoder, White

#: Counts of id pairs are broadcast up to this many rows (24 bytes each), and joined by a shuffle beyond.
BROADCAST_PAIRS = 1_000_000
#: Pairs of a text that are handled at once, rows that a task hands on at a time, and the bits of a B id within a pair.
PAIRS, ROWS, BITS = 1 << 20, 256, 32
#: What a piece uses for a space (fixed value).
SPACE_MARK = "▁"


class PlainEncoder(TextEncoder):
    """ids of space and text; special strings inside a text are plain text."""

    def __init__(self, path: str):
        import public_tokenizers
        import tiktoken

        super().__init__(path)
        own = tiktoken.Encoding("plain", pat_str=public_tokenizers.PATTERN, mergeable_ranks=self.ranks, special_tokens={})
        self.special = {}
        self.encode = lambda text: array("I", own.encode_ordinary(text)).tobytes()
        self.tokens = [b""] * len(self.n_bytes)
        for token, i in self.ranks.items():
            self.tokens[i] = token


class PieceEncoder:
    """ids of a sentencepiece model, which puts a space before the text.

    Where no piece has a space behind another character, as is checked, merges never cross from one into a following
    space, and a text can be encoded word by word with a memo of words.
    """

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        self.tokens = [bytes([int(p[3:-1], 16)]) if self.model.is_byte(i) else p.replace(SPACE_MARK, " ").encode() for i, p in enumerate(pieces)]
        self.n_bytes = np.array([len(t) for t in self.tokens], np.int64)
        self.by_word = not any(SPACE_MARK in p.lstrip(SPACE_MARK) for p in pieces)
        self.memo = Memo(self.word)

    def encode(self, text: str) -> bytes:
        return array("I", self.model.encode(text, num_threads=1)).tobytes()

    def word(self, word: str) -> bytes:
        ids = self.encode(word)
        if joined(self.tokens, ids) != b" " + word.encode():
            raise White  # left to the whole text
        return ids


def joined(tokens: list[bytes], ids: bytes) -> bytes:
    return b"".join(map(tokens.__getitem__, array("I", ids)))


class Spelling:
    """Decimal spellings of ids behind each sign that may stand before them."""

    def __init__(self, n_a: int, n_b: int):
        n = max(n_a, n_b)
        self.n = n
        self.table = [f"{sign}{i}".encode() for sign in ("", ";", ",", "|") for i in range(n)]

    def groups(self, a: np.ndarray, b: np.ndarray, group_a: np.ndarray, group_b: np.ndarray) -> bytes:
        """`a1,a2|b1;a3|b2,b3`: ids of each group, groups in order."""
        n_groups = int(group_a[-1]) + 1 if len(a) else 0
        sizes_a, sizes_b = np.bincount(group_a, minlength=n_groups), np.bincount(group_b, minlength=n_groups)
        codes = np.empty(len(a) + len(b), np.int64)
        first_a, first_b = np.diff(group_a, prepend=-1) > 0, np.diff(group_b, prepend=-1) > 0
        at_a = np.arange(len(a)) + (np.cumsum(sizes_b) - sizes_b)[group_a]
        at_b = np.arange(len(b)) + np.cumsum(sizes_a)[group_b]
        codes[at_a] = a + self.n * np.where(first_a, 1, 2)
        codes[at_b] = b + self.n * np.where(first_b, 3, 2)
        if len(codes):
            codes[0] -= self.n  # nothing before the first id
        return b"".join(map(self.table.__getitem__, codes.tolist()))


def groups_of(end_a: np.ndarray, end_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Group numbers (from 0, in order) of the tokens of either side, by their end offsets; both sides cover the same
    bytes without empty tokens.

    Tokens overlap a partner that reaches past their last byte's place or to it: an A token points to the B token with its
    last byte, a B token to the A token with its own, but to itself where both end together. So pointers only go right,
    and the token at a pointer's end closes the group.
    """
    n = len(end_a)
    to_b = np.searchsorted(end_b, end_a) + n  # the first token that ends at or after that place holds the last byte
    to_a = np.searchsorted(end_a, end_b)
    close = end_a[to_a] == end_b
    successor = np.concatenate([to_b, np.where(close, np.arange(len(end_b)) + n, to_a)])
    while True:
        farther = successor[successor]
        if np.array_equal(farther, successor):
            break
        successor = farther
    rank = np.cumsum(close) - 1  # terminals from left to right
    label = rank[successor - n]
    return label[:n], label[n:]


def pair_counts(a: np.ndarray, b: np.ndarray, group_a: np.ndarray, group_b: np.ndarray, most: int = PAIRS) -> tuple[np.ndarray, np.ndarray]:
    """Linked id pairs (A id shifted, plus B id) and how often each is linked. Links of a group, which are as many as the
    product of its sides, are made in parts of `most`."""
    n_groups = int(group_a[-1]) + 1 if len(a) else 0
    sizes_b = np.bincount(group_b, minlength=n_groups)
    start_b = np.cumsum(sizes_b) - sizes_b
    each = sizes_b[group_a]  # links of every A token
    total = np.cumsum(each)
    found: list[tuple[np.ndarray, np.ndarray]] = []
    for low in range(0, int(total[-1]) if len(a) else 0, most):
        link = np.arange(low, min(low + most, int(total[-1])))
        token = np.searchsorted(total, link, side="right")
        other = start_b[group_a[token]] + link - (total[token] - each[token])
        found.append(np.unique((a[token] << BITS) + b[other], return_counts=True))
        if len(found) > 1 and sum(len(k) for k, _ in found) > 4 * most:
            found = [added(found)]
    return added(found) if len(found) != 1 else found[0]


def added(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    if not parts:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    keys, back = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
    counts = np.zeros(len(keys), np.int64)
    np.add.at(counts, back, np.concatenate([c for _, c in parts]))
    return keys, counts


class Aligner:
    def __init__(self, tokenizer_a: str, tokenizer_b: str):
        self.a, self.b = PlainEncoder(tokenizer_a), PieceEncoder(tokenizer_b)
        self.spelling = Spelling(len(self.a.tokens), len(self.b.tokens))

    def tokens(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """ids of both sides; none for an empty text and where either side's bytes are not those of space and text."""
        try:
            if not self.b.by_word:
                raise White
            words = text.split(" ")
            a, b = (b"".join(map(side.memo.__getitem__, words)) for side in (self.a, self.b))
        except White:
            a = b = b""
            if text:
                a, b, whole = self.a.direct(" " + text), self.b.encode(text), (" " + text).encode()
                if joined(self.b.tokens, b) != whole or joined(self.a.tokens, a) != whole:
                    a = b = b""
        return np.frombuffer(a, "<u4").astype(np.int64), np.frombuffer(b, "<u4").astype(np.int64)

    def align(self, text: str) -> tuple[int, int, int, int, str, np.ndarray, np.ndarray]:
        """n_a, n_b, n_groups, n_links, digest of the groups, linked pairs and their numbers."""
        a, b = self.tokens(text)
        if not len(a):
            return 0, 0, 0, 0, "", a, a
        group_a, group_b = groups_of(np.cumsum(self.a.n_bytes[a]), np.cumsum(self.b.n_bytes[b]))
        pairs, counts = pair_counts(a, b, group_a, group_b)
        digest = hashlib.sha256(self.spelling.groups(a, b, group_a, group_b)).hexdigest()
        return len(a), len(b), int(group_a[-1]) + 1, int(counts.sum()), digest, pairs, counts


@lru_cache(maxsize=1)
def worker_aligner(tokenizer_a: str, tokenizer_b: str) -> Aligner:
    """One per Python worker."""
    return Aligner(tokenizer_a, tokenizer_b)


def aligned(docs: DataFrame, tokenizer_a: str, tokenizer_b: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id, n_a, n_b, n_groups, n_links, groups_sha256, pairs (A id * 2^32 + B id, distinct, sorted)
    and counts (links of each pair). Narrow."""
    longs = ("n_a", "n_b", "n_groups", "n_links")
    out = T.StructType([field(docs, id_col), *[T.StructField(c, T.LongType()) for c in longs], T.StructField("groups_sha256", T.StringType()), T.StructField("pairs", T.ArrayType(T.LongType())), T.StructField("counts", T.ArrayType(T.LongType()))])

    def run(batches):
        own = worker_aligner(tokenizer_a, tokenizer_b)
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                rows = [own.align(text) for text in part.column(1).to_pylist()]
                ends = pa.array(np.cumsum([0, *(len(r[5]) for r in rows)]), pa.int32())
                lists = [pa.ListArray.from_arrays(ends, pa.array(np.concatenate([r[i] for r in rows]), pa.int64())) for i in (5, 6)]
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array([r[i] for r in rows], pa.int64()) for i in range(4)), pa.array([r[4] for r in rows], pa.string()), *lists], names=out.names)

    return docs.select(F.col(id_col), text_or_empty(text_col).alias("text")).mapInArrow(run, out)


def align_tokens(docs: DataFrame, tokenizer_a: str, tokenizer_b: str, *, id_col: str = "doc_id", text_col: str = "text", broadcast_pairs: int = BROADCAST_PAIRS) -> DataFrame:
    """One row per row of docs: id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    tokenizer_a: a byte-level vocabulary, which encodes space and text; tokenizer_b: a sentencepiece model, which encodes
    the text and adds the space itself; both paths on every executor. Special strings inside a text are plain text. A text
    that is null or empty, or whose bytes either side does not give back, has no tokens: zeros and an empty digest.
    Links are all pairs of tokens of a group. A pair's count is the number of rows of docs that hold it linked; n_best are
    the links whose count is the highest of their A id, ties included; count_sum adds counts over links. Repeated rows
    count as often as they occur; a null id stays null; an empty table gives no rows; other columns are not read.

    Texts are encoded once; their distinct pairs are written. Counting pairs combines before it shuffles, so a pair that
    all texts hold is one row per task. The counts meet the written pairs by a broadcast join up to broadcast_pairs rows,
    and by a shuffle beyond; sums are again combined per row before they shuffle.
    """
    done = stored(aligned(docs, tokenizer_a, tokenizer_b, id_col=id_col, text_col=text_col).withColumn("_row", F.monotonically_increasing_id()))
    counted = done.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count("*").alias("n"))
    counted = stored(counted)
    highest = counted.groupBy(F.shiftright("pair", BITS).alias("a")).agg(F.max("n").alias("most"))
    judged = stored(counted.withColumn("a", F.shiftright("pair", BITS)).join(highest, "a").select("pair", "n", (F.col("n") == F.col("most")).alias("best")))
    discard(counted)
    few = judged.limit(broadcast_pairs + 1).count() <= broadcast_pairs
    links = done.select("_row", F.explode(F.arrays_zip("pairs", "counts")).alias("x")).select("_row", F.col("x.pairs").alias("pair"), F.col("x.counts").alias("k"))
    met = links.join(F.broadcast(judged), "pair") if few else links.hint("shuffle_merge").join(judged, "pair")
    sums = met.groupBy("_row").agg(F.sum(F.when(F.col("best"), F.col("k")).otherwise(0)).alias("n_best"), F.sum(F.col("k") * F.col("n")).alias("count_sum"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return done.join(sums, "_row", "left").select(F.col(id_col), "n_a", "n_b", "n_groups", "n_links", zero("n_best"), zero("count_sum"), "groups_sha256")
