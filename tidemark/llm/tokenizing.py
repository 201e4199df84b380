"""Byte-level BPE of whole texts, as the public tokenizer libraries give it.

The pattern that cuts text before merging never joins a character that is not white space with a white-space
character after it. So a space between two such characters always starts a new match, whatever surrounds it, and a
text can be encoded piece by piece between those spaces with a memo of pieces.
"""

from __future__ import annotations

import base64
import json
import re
from array import array
from functools import lru_cache

import numpy as np

#: Pieces that a worker remembers before it forgets all, and the longest that it remembers.
MEMO_PIECES, MEMO_CHARS = 300_000, 200
#: White space in a row (Unicode's, fixed values) from which it is cut out by hand: the library's matcher backtracks over
#: each such character and fails on some hundred thousand.
LONG_WHITE = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{4096,}")


def byte_of_char() -> dict[str, int]:
    """The printable stand-ins that vocabularies in JSON use for bytes."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def read_ranks(path: str) -> tuple[dict[bytes, int], dict[str, int]]:
    """Token bytes to rank, and special strings to id, of a .tiktoken or byte-level .json vocabulary."""
    if path.endswith(".tiktoken"):
        with open(path, "rb") as file:
            return {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}, {}
    with open(path, encoding="utf-8") as file:
        content = json.load(file)
    special = {x["content"]: x["id"] for x in content["added_tokens"]}
    back = byte_of_char()
    ranks = {bytes(back[c] for c in token): i for token, i in content["model"]["vocab"].items() if token not in special}
    merged = [ranks[bytes(back[c] for c in "".join(m.split(" ") if isinstance(m, str) else m))] for m in content["model"]["merges"]]
    if merged != sorted(merged):
        raise ValueError(f"{path}: merges are not in the order of ids")
    return ranks, special


class White(Exception):
    """A space beside other white space: the text is not cut there."""


class Memo(dict):
    """Piece after a space -> ids of the space and the piece, as little-endian unsigned 32-bit integers. encode: makes
    them of the piece. After `most` pieces it forgets all."""

    def __init__(self, encode, most: int = MEMO_PIECES):
        super().__init__()
        self.encode, self.most = encode, most

    def __missing__(self, piece: str) -> bytes:
        if not piece or piece[0].isspace() or piece[-1].isspace():
            raise White
        ids = self.encode(piece)
        if len(piece) <= MEMO_CHARS:
            if len(self) >= self.most:
                self.clear()
            self[piece] = ids
        return ids


class TextEncoder:
    """ids of whole texts, without begin, end or other added tokens. Special strings inside a text become their ids."""

    def __init__(self, path: str):
        import public_tokenizers
        import tiktoken

        self.ranks, self.special = read_ranks(path)
        own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=self.ranks, special_tokens=self.special)
        self.n_bytes = np.zeros(max([*self.ranks.values(), *self.special.values()]) + 1, np.int64)
        for token, i in self.ranks.items():
            self.n_bytes[i] = len(token)
        for token, i in self.special.items():
            self.n_bytes[i] = len(token.encode())
        whole = tiktoken.Encoding("whole", pat_str="(?s:.+)", mergeable_ranks=self.ranks, special_tokens={})
        self.encode = lambda text: array("I", own.encode(text, allowed_special="all")).tobytes()
        self.one_match = lambda text: array("I", whole.encode_ordinary(text)).tobytes()
        self.memo = Memo(lambda piece: self.direct(" " + piece))

    def direct(self, text: str) -> bytes:
        """Without the memo. A long run of white space is one match, less its last character where text follows that is no
        special string: that character starts the next match."""
        out, at = [], 0
        for m in LONG_WHITE.finditer(text) if len(text) >= 4096 else ():
            until = m.end() - (m.end() < len(text) and not text.startswith(tuple(self.special), m.end()))
            out += [self.encode(text[at : m.start()]), self.one_match(text[m.start() : until])]
            at = until
        return b"".join([*out, self.encode(text[at:])]) if out else self.encode(text)

    def packed(self, text: str) -> bytes:
        """ids as little-endian unsigned 32-bit integers."""
        first, *rest = text.split(" ")
        try:
            if rest and (not first or first[-1].isspace()):
                raise White
            return b"".join([self.direct(first), *map(self.memo.__getitem__, rest)])
        except White:
            return self.direct(text)

    def ids(self, text: str) -> np.ndarray:
        return np.frombuffer(self.packed(text), "<u4")


@lru_cache(maxsize=2)
def worker_encoder(path: str) -> TextEncoder:
    """One per Python worker: its tasks share the vocabulary and what was remembered (at most MEMO_PIECES pieces of
    MEMO_CHARS characters)."""
    return TextEncoder(path)
