"""Operator 3: secrets, also inside nested encodings, by a worklist of decoded layers."""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from bisect import bisect_right
from collections import deque
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import field, text_or_empty

#: The kinds in the order in which spans of one start are listed.
KINDS = {
    "assign": re.compile(r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""),
    "access": re.compile(r"AKIA[A-Z0-9]+"),
    "hex": re.compile(r"[0-9a-f]+"),
}
RANK = {kind: i for i, kind in enumerate(KINDS)}
LEAST_VALUE, LEAST_ACCESS = 6, 20
#: A run of 24 or more is what is left of all runs once short ones are dropped, and is found faster.
LONG_HEX = re.compile(r"[0-9a-f]{24,}")

PERCENT = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
ESCAPE = re.compile(r"\\u([Dd][89ABab][0-9A-Fa-f]{2})\\u([Dd][C-Fc-f][0-9A-Fa-f]{2})|\\(?:u([0-9A-Fa-f]{4})|x([0-9A-Fa-f]{2})|U([0-9A-Fa-f]{8}))")
#: A run of base64, which goes on over line breaks (also written \\n) up to its padding.
BASE64 = re.compile(r"[A-Za-z0-9+/_-]{16,}(?:[\x20\t]*(?:\r?\n|(?:\\r)?\\n)[\x20\t>]*[A-Za-z0-9+/_-]+)*={0,2}")
BREAK = re.compile(r"[\x20\t]*(?:\r?\n|(?:\\r)?\\n)[\x20\t>]*")
#: Where gzip or zlib data may start.
PACKED = re.compile(rb"\x1f\x8b\x08|\x78[\x01\x5e\x9c\xda]")
#: Readable characters in a row that a decoded run must have somewhere.
STRETCH = re.compile(r"[^\x00-\x08\x0e-\x1f\x7f-\x9f\udc80-\udcff]{12,}")
#: Bytes of a piece in which such a stretch may begin that ends in the next one.
SEEN = 48
#: Bytes of compressed content scanned at once; more is scanned block by block, each with the end of the one before it.
BLOCK, OVERLAP, PIECE = 1 << 26, 1 << 20, 1 << 16


def scan(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the base kinds in one layer."""
    found = [(m.start(), m.end(), "assign") for m in KINDS["assign"].finditer(text) if len(m[2]) >= LEAST_VALUE]
    found += [(m.start(), m.end(), "access") for m in KINDS["access"].finditer(text) if m.end() - m.start() >= LEAST_ACCESS]
    return found + [(m.start(), m.end(), "hex") for m in LONG_HEX.finditer(text)]


@dataclass
class Layer:
    """Decoded text; where in the document what its character k was decoded from starts and ends. Both grow with k."""

    text: str
    start: Callable[[int], int]
    end: Callable[[int], int]


def unescaped(layer: Layer, pattern: re.Pattern, decode) -> Layer | None:
    """The whole layer with what the pattern matches decoded in place; None if nothing was. Places are kept by piece, not
    by character."""
    text, cuts, olds, size, at = [], [0], [(0, None)], 0, 0

    def put(piece: str, old: int, until: int | None) -> None:
        nonlocal size
        if piece:
            if size:
                cuts.append(size)
                olds.append((old, until))
            else:
                olds[0] = (old, until)
            text.append(piece)
            size += len(piece)

    for m in pattern.finditer(layer.text):
        if (new := decode(m)) is not None:
            put(layer.text[at : m.start()], at, None)
            put(new, *m.span())
            at = m.end()
    if not at:
        return None
    put(layer.text[at:], at, None)

    def place(k: int, last: bool) -> int:
        i = bisect_right(cuts, k) - 1
        old, until = olds[i]
        if until is None:
            old += k - cuts[i]
            return layer.end(old) if last else layer.start(old)
        return layer.end(until - 1) if last else layer.start(old)

    return Layer("".join(text), lambda k: place(k, False), lambda k: place(k, True))


def from_percent(m: re.Match) -> str:
    return bytes.fromhex(m[0].replace("%", "")).decode(errors="replace")


def from_escape(m: re.Match) -> str | None:
    if m[1]:
        return chr(0x10000 + ((int(m[1], 16) - 0xD800) << 10) + int(m[2], 16) - 0xDC00)
    code = int(m[3] or m[4] or m[5], 16)
    return chr(code) if code < 0x110000 and not 0xD800 <= code < 0xE000 else None


def same(place: int) -> Callable[[int], int]:
    """A place that all characters of a layer share."""
    return lambda k: place


def raw_pieces(data: bytes) -> Iterator[bytes]:
    """What a deflate stream without a header holds, in pieces of bounded size; an error of zlib where it is none, and
    EOFError where it breaks off or other bytes follow it."""
    unzip = zlib.decompressobj(-15)
    while not unzip.eof:
        out = unzip.decompress(data, PIECE)
        data = unzip.unconsumed_tail
        if not out and not data and not unzip.eof:
            raise EOFError
        yield out
    if unzip.unused_data:
        raise EOFError


def raw_inflated(data: bytes) -> Iterator[bytes] | None:
    """The pieces of data that are one whole deflate stream without a header, if any of it is readable. The stream is read
    once to find that out, as most data are none, and once more for its pieces, so its size does not matter."""
    readable, before = False, b""
    try:
        for piece in raw_pieces(data):
            readable = readable or bool(STRETCH.search((before + piece).decode(errors="surrogateescape")))
            before = piece[-SEEN:]
    except (zlib.error, EOFError):
        return None
    return raw_pieces(data) if readable else None


def inflate(pieces: Iterable[bytes], ended: list[int]) -> Iterator[bytes]:
    """What gzip or zlib data hold, all their members one after the other, in pieces of bounded size. Data that break off
    or are damaged give what comes before; ended gets the number of bytes read up to the end of the last whole member."""
    unzip, at_start, taken, short = zlib.decompressobj(47), False, 0, b""
    for piece in pieces:
        taken += len(piece)
        data, full = short + bytes(piece), False
        short = b""
        while data or full:
            if at_start:
                data = data.lstrip(b"\0")
                if len(data) < 3:
                    short = data
                    break
                if not PACKED.match(data):
                    return
                unzip, at_start = zlib.decompressobj(47), False
            try:
                out = unzip.decompress(data, PIECE)
            except zlib.error:
                return
            if out:
                yield out
            full = len(out) == PIECE and not unzip.eof
            data = unzip.unused_data if unzip.eof else unzip.unconsumed_tail
            if unzip.eof:
                at_start, ended[:] = True, [taken - len(data)]


def unpacked(data: memoryview) -> tuple[Iterator[bytes], list[int]]:
    """The content of data that start like gzip or zlib, opened again as long as it starts so too, but for content that
    comes back to itself; and how many bytes it took, if it is whole."""
    ended: list[int] = []
    pieces = inflate((data[k : k + PIECE] for k in range(0, len(data), PIECE)), ended)
    seen = set()
    while True:
        first = next(pieces, b"")
        pieces = chain([first], pieces)
        key = hashlib.sha256(first).digest()
        if not PACKED.match(first) or key in seen:
            return pieces, ended
        seen.add(key)
        pieces = inflate(pieces, [])


def blocks(pieces: Iterator[bytes]) -> Iterator[bytes]:
    held: list[bytes] = []
    size = 0
    for piece in pieces:
        held.append(piece)
        size += len(piece)
        if size >= BLOCK:
            whole = b"".join(held)
            yield whole
            held, size = [whole[-OVERLAP:]], min(size, OVERLAP)
    if any(held):
        yield b"".join(held)


def shown(text: str) -> str:
    """With each byte that is no UTF-8 as a replacement character."""
    return text if text.isascii() else re.sub(r"[\udc80-\udcff]", "\ufffd", text)


def from_base64(layer: Layer, m: re.Match) -> tuple[list[Layer], int]:
    """The layers that a run of base64 holds, read from each of its first four characters: compressed content wherever it
    starts, and text between its first and last readable stretch; and how many contents were scanned in blocks."""
    s, e = m.span()
    at: list[int] | range = range(s, s + len(m[0].rstrip("=")))
    if BREAK.search(m[0]):
        breaks = {k for b in BREAK.finditer(layer.text, s, e) for k in range(*b.span())}
        at = [k for k in at if k not in breaks]
    chars = "".join(layer.text[k] for k in at) if isinstance(at, list) else layer.text[at.start : at.stop]
    chars = chars.replace("-", "+").replace("_", "/")
    out, large = [], 0
    for shift in range(4):
        body = chars[shift:]
        body = body[: len(body) - (len(body) % 4 == 1)]
        if not body:
            break
        data = base64.b64decode(body + "=" * (-len(body) % 4))
        first = lambda k, shift=shift: layer.start(at[shift + k * 8 // 6])
        last = lambda k, shift=shift, n=len(data): layer.end(e - 1 if k >= n else at[min(len(at) - 1, shift + (k * 8 - 1) // 6)])
        done = 0
        for magic in PACKED.finditer(data):
            if magic.start() < done:
                continue
            pieces, ended = unpacked(memoryview(data)[magic.start() :])
            n = 0
            made = []
            for block in blocks(pieces):
                n += 1
                made.append(block)
                if n > 1 or len(block) >= BLOCK:
                    out += [Layer(shown(x.decode(errors="surrogateescape")), same(first(magic.start())), same(last(len(data)))) for x in made]
                    made = []
            if made and (ended or magic[0][0] == 0x1F or n > 1):
                until = magic.start() + ended[0] if ended else len(data)
                out += [Layer(shown(x.decode(errors="surrogateescape")), same(first(magic.start())), same(last(until))) for x in made]
            large += n > 1
            if ended:
                done = magic.start() + ended[0]
        if done and done >= len(data):
            continue
        text = data.decode(errors="surrogateescape")
        if not (found := list(STRETCH.finditer(text))):
            if not done and (raw := raw_inflated(data)):
                made = list(blocks(raw))
                out += [Layer(shown(x.decode(errors="surrogateescape")), same(first(0)), same(last(len(data)))) for x in made]
                large += len(made) > 1
            continue
        a, b = found[0].start(), found[-1].end()
        k = len(text[:a].encode(errors="surrogateescape"))
        # byte i comes from the characters i * 8 // 6 to (i * 8 + 7) // 6
        if text[a:b].isascii():
            out.append(Layer(text[a:b], lambda i, k=k, first=first: first(k + i), lambda i, k=k, last=last: last(k + i + 1)))
        else:
            ends = k + np.cumsum([len(c.encode(errors="surrogateescape")) for c in text[a:b]])
            out.append(Layer(shown(text[a:b]), lambda i, k=k, ends=ends, first=first: first(int(ends[i - 1]) if i else k), lambda i, ends=ends, last=last: last(int(ends[i]))))
    return out, large


def layers_of(layer: Layer) -> tuple[list[Layer], int]:
    """What one step of decoding gives: the layer without its URL escapes, without its Unicode escapes, and its base64 runs
    that hold text or compressed text; and how many were scanned in blocks."""
    out, oversize = [], 0
    for pattern, decode, mark in ((PERCENT, from_percent, "%"), (ESCAPE, from_escape, "\\")):
        if mark in layer.text and (new := unescaped(layer, pattern, decode)):
            out.append(new)
    for m in BASE64.finditer(layer.text):
        made, large = from_base64(layer, m)
        out += made
        oversize += large
    return out, oversize


def find_secrets(text: str) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, str]], int, int]:
    """Base spans, all spans (start, end, kind), the layers opened and the contents scanned in blocks.

    Layers are taken from a worklist until none is left. A layer whose text was seen at the same place before is not
    opened again, so content that decodes to itself ends too."""
    base = sorted(scan(text), key=lambda x: (x[0], RANK[x[2]], x[1]))
    spans, opened, oversize = set(base), 0, 0
    work, seen = deque([Layer(text, lambda k: k, lambda k: k + 1)]), set()
    while work:
        layer = work.popleft()
        made, large = layers_of(layer)
        oversize += large
        for new in made:
            if not new.text or (key := (hashlib.sha256(new.text.encode(errors="surrogatepass")).digest(), new.start(0))) in seen:
                continue
            seen.add(key)
            opened += 1
            for s, e, kind in scan(new.text):
                spans.add((new.start(s), new.end(e - 1), kind))
            work.append(new)
    return base, sorted(spans, key=lambda x: (x[0], RANK[x[2]], x[1])), opened, oversize


def joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{s}:{e}" for s, e, kind in spans)


def scan_secrets(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id, n_assign, n_access, n_hex (base spans), base_spans and spans (kind:start:end by
    start, then kind, comma-joined; code points of the whole text, end exclusive), n_layers and n_oversize (contents of
    over BLOCK bytes, scanned in blocks).

    A null text counts as empty and has no spans; repeated rows stay repeated; a null id is kept; an empty table gives
    no rows. Other columns of docs are not read. Narrow: no shuffle.
    """
    kinds = [T.StructField(f"n_{k}", T.LongType()) for k in KINDS]
    out = T.StructType([field(docs, id_col), *kinds, T.StructField("base_spans", T.StringType()), T.StructField("spans", T.StringType()), T.StructField("n_layers", T.LongType()), T.StructField("n_oversize", T.LongType())])

    def run(batches):
        for batch in batches:
            found = [find_secrets(x) for x in batch.column(1).to_pylist()]
            counts = [pa.array([sum(s[2] == k for s in base) for base, *_ in found], pa.int64()) for k in KINDS]
            yield pa.RecordBatch.from_arrays([batch.column(0), *counts, pa.array([joined(x[0]) for x in found], pa.string()), pa.array([joined(x[1]) for x in found], pa.string()), pa.array([x[2] for x in found], pa.int64()), pa.array([x[3] for x in found], pa.int64())], names=out.names)

    return docs.select(F.col(id_col), text_or_empty(text_col).alias("text")).mapInArrow(run, out)
