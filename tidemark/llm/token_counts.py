"""Operator 1: token counts by overlap resynchronisation."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import field, text_or_empty
from .tokenizing import worker_encoder

#: Characters of a chunk of a huge document, and of the overlap that is tried first.
CHUNK, OVERLAP = 65_536, 1_024
#: Between these two characters every match of the cutting pattern ends, whatever stands around them.
STABLE = re.compile(r"(?<=[^\s])(?=[ \n\t])")


def starts_by_byte(ids: np.ndarray, n_bytes: np.ndarray) -> np.ndarray:
    """Byte offset at which each token starts, and the end."""
    return np.concatenate([[0], np.cumsum(n_bytes[ids])])


def splice(text: str, a: int, left: np.ndarray, left_at: np.ndarray, b: int, right: np.ndarray, right_at: np.ndarray, e: int) -> tuple[int, int, int] | None:
    """A place in the overlap [b, e) of chunks from a and from b at which both have a token start, which is stable, and
    from which both go on with the same token. Returns the place and the tokens before it in either chunk."""
    before, seen, at = len(text[a:b].encode()), 0, b
    for m in STABLE.finditer(text, b + 1, e):
        seen, at = seen + len(text[at : m.start()].encode()), m.start()
        i = int(np.searchsorted(left_at, before + seen))
        j = int(np.searchsorted(right_at, seen))
        if left_at[i] == before + seen and right_at[j] == seen and i < len(left) and j < len(right) and left[i] == right[j]:
            return at, i, j
    return None


def chunked(text: str, encode: Callable[[str], np.ndarray], n_bytes: np.ndarray, chunk: int = CHUNK, overlap: int = OVERLAP) -> Iterator[np.ndarray]:
    """ids of text in parts, from chunks that overlap. An overlap without a common stable boundary is doubled; when it
    has reached back to the last splice, the chunk itself grows, to twice its size once it is longer than one. An overlap
    without any stable place is widened before it is encoded, so each character is encoded a bounded number of times even
    in one long run; such a run is a single match, and is held whole."""
    a, e, n = 0, min(chunk, len(text)), len(text)
    left = encode(text[a:e])
    while e < n:
        left_at, wide, found = starts_by_byte(left, n_bytes), overlap, None
        until = min(n, e + max(chunk, e - a - chunk))
        while True:
            b = max(a, e - wide)
            wide *= 2
            if b > a and not STABLE.search(text, b + 1, e):
                continue
            right = encode(text[b:until])
            found = b > a and splice(text, a, left, left_at, b, right, starts_by_byte(right, n_bytes), e)
            if found or b == a:
                break
        if found:
            p, i, j = found
            yield left[:i]
            # the part of the right chunk after the splice is the next left chunk
            left, a = right[j:], p
        else:
            left = right
        e = until
    yield left


def count_tokens(docs: DataFrame, tokenizer: str, *, id_col: str = "doc_id", text_col: str = "text", limit: int = 512, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """One row per row of docs: id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit), n_chunks.

    tokenizer: path of a byte-level vocabulary on every executor. A null text counts as empty (0 tokens); repeated rows
    stay repeated; a null id stays null; other columns of docs are not read; an empty table gives no rows. A text of any
    length is encoded whole; beside the text, memory holds the ids of one chunk, or of the longest run without a stable
    place (one word, or white space in a row) where that is longer. Narrow: no shuffle.
    """
    out = T.StructType([field(docs, id_col), T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("over_limit", T.BooleanType()), T.StructField("n_chunks", T.IntegerType())])

    def run(batches):
        encoder = worker_encoder(tokenizer)
        for batch in batches:
            tokens, chunks = [], []
            for text in batch.column(1).to_pylist():
                sizes = [len(encoder.packed(text)) // 4] if len(text) <= chunk else [len(x) for x in chunked(text, encoder.ids, encoder.n_bytes, chunk, overlap)]
                tokens.append(sum(sizes))
                chunks.append(len(sizes))
            counts = pa.array(tokens, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), counts, pa.array([x > limit for x in tokens], pa.bool_()), pa.array(chunks, pa.int32())], names=out.names)

    text = text_or_empty(text_col)
    return docs.select(F.col(id_col), text.alias("text"), F.octet_length(text).cast("long").alias("n")).mapInArrow(run, out)
