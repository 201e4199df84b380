"""Operator 5: byte-level BPE encoding and decoding with a rank queue of hierarchical bitmaps."""

from __future__ import annotations

import hashlib
from array import array
from functools import lru_cache
from heapq import heappop, heappush

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import field, text_or_empty
from .tokenizing import MEMO_CHARS, Memo, White, read_ranks

#: Ranks of one word of the lower bitmap, as a power of two; the upper bitmap has a bit for each of these words.
WORD_BITS = 8
#: Pieces and matches that a worker remembers before it forgets all: of either, at some 200 bytes each (240 MB in all).
REMEMBERED = 600_000
#: Marks that a word of letters often ends in; a run of them is one match.
MARKS = ".,;:!?"


class ByteBpe:
    """Encodes and decodes by a table of ranks; each match of the pattern is merged separately."""

    def __init__(self, path: str, pattern: str):
        import regex

        self.ranks, _ = read_ranks(path)
        self.tokens = [b""] * (max(self.ranks.values(), default=0) + 1)
        for token, i in self.ranks.items():
            self.tokens[i] = token
        self.find = regex.compile(pattern).findall
        self.low = [0] * ((len(self.tokens) >> WORD_BITS) + 1)
        self.matches: dict[str, bytes] = {}
        self.memo = Memo(self.piece, REMEMBERED)

    def merged(self, match: bytes) -> list[int]:
        """ids of one match: the adjacent pair of least rank is merged, the leftmost of them first, until none is left.

        Tokens are a linked list by the place where they start. Buckets hold the places of the pairs of one rank, as a
        heap; bitmaps say which buckets there are: a bit for each rank, and above them a bit for each word that is not
        zero, so two find-first-sets give the least rank. A bucket's entry whose pair has changed is stale and skipped.
        """
        rank_of = self.ranks.get
        if (whole := rank_of(match)) is not None:
            return [whole]
        n = len(match)
        ends, before = list(range(1, n + 1)), list(range(-1, n - 1))
        pair = [rank_of(match[i : i + 2]) for i in range(n - 1)]
        pair.append(None)
        low, high, mask = self.low, 0, (1 << WORD_BITS) - 1  # low is all zero between calls
        buckets: dict[int, list[int]] = {}
        for i, rank in enumerate(pair):
            if rank is not None:
                if rank in buckets:
                    buckets[rank].append(i)
                else:
                    buckets[rank] = [i]
                    low[rank >> WORD_BITS] |= 1 << (rank & mask)
                    high |= 1 << (rank >> WORD_BITS)
        while high:
            word = (high & -high).bit_length() - 1
            bits = low[word]
            rank = (word << WORD_BITS) + (bits & -bits).bit_length() - 1
            bucket = buckets[rank]
            if len(bucket) > 1:
                i = heappop(bucket)
            else:
                i = bucket[0]
                del buckets[rank]
                low[word] = bits & (bits - 1)
                if not low[word]:
                    high &= high - 1
            if pair[i] != rank:
                continue
            gone = ends[i]
            end = ends[i] = ends[gone]
            pair[gone] = None
            left = before[i]
            if end < n:
                before[end] = i
            for at, start, stop in ((i, i, ends[end] if end < n else 0), (left, left, end)):
                if at < 0:
                    continue
                new = rank_of(match[start:stop]) if stop else None
                pair[at] = new
                if new is None:
                    continue
                if new in buckets:
                    heappush(buckets[new], at)
                else:
                    buckets[new] = [at]
                    low[new >> WORD_BITS] |= 1 << (new & mask)
                    high |= 1 << (new >> WORD_BITS)
        ids, i = [], 0
        while i < n:
            ids.append(rank_of(match[i : ends[i]]))
            i = ends[i]
        return ids

    def match(self, match: str) -> bytes:
        known = self.matches.get(match)
        if known is None:
            known = array("I", self.merged(match.encode())).tobytes()
            if len(match) <= MEMO_CHARS:
                if len(self.matches) >= REMEMBERED:
                    self.matches.clear()
                self.matches[match] = known
        return known

    def cut(self, text: str) -> bytes:
        return b"".join(map(self.match, self.find(text)))

    def piece(self, piece: str) -> bytes:
        """ids of a space and a piece. Letters and marks after them are two matches, which needs no search."""
        core = piece.rstrip(MARKS)
        if core.isalpha():
            return self.match(" " + core) + self.match(piece[len(core) :]) if len(core) < len(piece) else self.match(" " + core)
        return self.cut(" " + piece)

    def packed(self, text: str) -> bytes:
        """ids as little-endian unsigned 32-bit integers; pieces between single spaces are remembered."""
        first, *rest = text.split(" ")
        try:
            if rest and (not first or first[-1].isspace()):
                raise White
            return b"".join([self.cut(first), *map(self.memo.__getitem__, rest)])
        except White:
            return self.cut(text)

    def decode(self, packed: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, array("I", packed).tolist()))


@lru_cache(maxsize=2)
def worker_bpe(ranks: str, pattern: str) -> ByteBpe:
    """One per Python worker, whose tasks share what it remembers."""
    return ByteBpe(ranks, pattern)


def encode_decode(docs: DataFrame, ranks: str, pattern: str, *, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False) -> DataFrame:
    """One row per row of docs: id, n_tokens, ids_sha256 (of the ids as little-endian unsigned 32-bit integers),
    decoded_sha256 (of the bytes that the ids decode to), round_trip (whether those are the text's), and, with keep_ids,
    ids (array of int).

    ranks: path of the rank file on every executor. No special tokens: their strings are ordinary text. A null text is
    an empty one; repeated rows stay repeated; a null id is kept; an empty table gives no rows. Texts are encoded whole,
    in time n log n even for one long match. Other columns of docs are not read. Narrow: no shuffle.
    """
    out = T.StructType([field(docs, id_col), T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType()), T.StructField("round_trip", T.BooleanType()), *([T.StructField("ids", T.ArrayType(T.IntegerType()))] if keep_ids else [])])

    def run(batches):
        bpe = worker_bpe(ranks, pattern)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            packed = [bpe.packed(x) for x in texts]
            decoded = [bpe.decode(x) for x in packed]
            columns = [
                pa.array([len(x) // 4 for x in packed], pa.int64()),
                pa.array([hashlib.sha256(x).hexdigest() for x in packed], pa.string()),
                pa.array([hashlib.sha256(x).hexdigest() for x in decoded], pa.string()),
                pa.array([x == t.encode() for x, t in zip(decoded, texts, strict=True)], pa.bool_()),
                *([pa.array([list(array("i", x)) for x in packed], pa.list_(pa.int32()))] if keep_ids else []),
            ]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=out.names)

    return docs.select(F.col(id_col), text_or_empty(text_col).alias("text")).mapInArrow(run, out)
