"""Operator 13 against plain loops over the libraries' own tokens."""

import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tidemark.llm import alignment, queries

A, B = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")
TEXTS = [
    (1, "The quick brown fox jumps over the lazy dog. " * 7), (2, None), (3, ""), (3, "  two  spaces "), (4, " "), (5, "déjà vu 你好 🙂 <|endoftext|> <s> </s> <0x41>\n\n x\ty"), (6, "▁ is no space"), (7, "ﬁ ① é é ﻿ ​ \x00 \xa0"),
    (8, "Donaudampfschifffahrtsgesellschaftskapitän " * 3), (None, "no id here"), (9, "x" * 3000), (10, "The quick brown fox"), (10, "The quick brown fox"), (11, "word " * 4000), (12, "🙂" * 500), (13, "\n"), (14, "don't  can't\r\n12345 67.8"),
]


def frame(spark, texts):
    return spark.createDataFrame([(i, t, "x", 1) for i, t in texts], "doc_id long, text string, pairs string, n_a int").repartition(3)


@pytest.fixture(scope="module")
def libraries():
    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=B)


def byte_of_char():
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def plain_groups(libraries, text):
    """Groups as lists of A and B ids, by walking both lists of bytes."""
    if not text:
        return []
    a, b = libraries
    back, whole = byte_of_char(), (" " + text).encode()
    ids_a = a.encode(" " + text, add_special_tokens=False).ids
    ids_b = b.encode(text)
    bytes_a = [bytes(back[c] for c in a.id_to_token(i)) for i in ids_a]
    bytes_b = [bytes([int(b.id_to_piece(i)[3:-1], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ids_b]
    if b"".join(bytes_a) != whole or b"".join(bytes_b) != whole:
        return []
    ends = []
    for tokens in (bytes_a, bytes_b):
        at, own = 0, []
        for t in tokens:
            at += len(t)
            own.append(at)
        ends.append(own)
    groups, i, j = [], 0, 0
    for cut in sorted(set(ends[0]) & set(ends[1])):
        group = ([], [])
        while i < len(ids_a) and ends[0][i] <= cut:
            group[0].append(ids_a[i])
            i += 1
        while j < len(ids_b) and ends[1][j] <= cut:
            group[1].append(ids_b[j])
            j += 1
        groups.append(group)
    return groups


def brute(libraries, texts):
    all_groups = [plain_groups(libraries, t) for _, t in texts]
    links = [Counter((x, y) for xs, ys in groups for x in xs for y in ys) for groups in all_groups]
    held = Counter(p for each in links for p in each)
    most = {}
    for (x, _), n in held.items():
        most[x] = max(most.get(x, 0), n)
    out = []
    for (i, _), groups, each in zip(texts, all_groups, links, strict=True):
        spelt = ";".join(",".join(map(str, xs)) + "|" + ",".join(map(str, ys)) for xs, ys in groups)
        out.append((
            i, sum(len(x) for x, _ in groups), sum(len(y) for _, y in groups), len(groups), sum(each.values()),
            sum(k for p, k in each.items() if held[p] == most[p[0]]), sum(k * held[p] for p, k in each.items()), hashlib.sha256(spelt.encode()).hexdigest() if groups else "",
        ))
    return sorted(out, key=repr)


@pytest.mark.parametrize("few", [0, 10**6])
def test_rows_are_those_of_plain_loops(spark, libraries, few):
    got = alignment.align_tokens(frame(spark, TEXTS), A, B, broadcast_pairs=few)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert sorted((tuple(r) for r in got.collect()), key=repr) == brute(libraries, TEXTS)


def test_empty_table_and_clashing_columns(spark):
    df = frame(spark, TEXTS)
    assert alignment.align_tokens(df.where("false"), A, B).count() == 0
    assert alignment.align_tokens(df.drop("pairs", "n_a"), A, B).schema == alignment.align_tokens(df, A, B).schema


def test_a_very_long_text_and_a_long_word(spark, libraries):
    texts = [(1, "lorem ipsum dolor " * 40_000), (2, "ab" * 60_000)]
    assert sorted((tuple(r) for r in alignment.align_tokens(frame(spark, texts), A, B).collect()), key=repr) == brute(libraries, texts)


def test_one_text_in_most_rows(spark, libraries):
    texts = [(i, TEXTS[0][1]) for i in range(60)] + TEXTS[4:8]
    assert sorted((tuple(r) for r in alignment.align_tokens(frame(spark, texts), A, B).collect()), key=repr) == brute(libraries, texts)


ENDS = st.sets(st.integers(1, 60), min_size=1, max_size=40)


@settings(max_examples=300, deadline=None)
@given(ENDS, ENDS, st.integers(1, 7))
def test_groups_and_pairs_of_any_cuts(cuts_a, cuts_b, most):
    end_a, end_b = (np.array(sorted(c | {61})) for c in (cuts_a, cuts_b))
    group_a, group_b = alignment.groups_of(end_a, end_b)
    common = sorted(set(end_a.tolist()) & set(end_b.tolist()))
    where = lambda e: next(i for i, c in enumerate(common) if e <= c)
    assert group_a.tolist() == [where(e) for e in end_a] and group_b.tolist() == [where(e) for e in end_b]
    ids_a, ids_b = end_a % 5, end_b % 3
    keys, counts = alignment.pair_counts(ids_a, ids_b, group_a, group_b, most)
    want = Counter((int(x), int(y)) for x, g in zip(ids_a, group_a, strict=True) for y, h in zip(ids_b, group_b, strict=True) if g == h)
    assert {(int(k) >> 32, int(k) & 0xFFFFFFFF): int(c) for k, c in zip(keys, counts, strict=True)} == want


def test_words_are_encoded_as_in_the_whole_text(libraries):
    """Random mixtures of scripts, white space and marks, through the memo of words and as a whole."""
    own, rnd = alignment.Aligner(A, B), random.Random(6)
    parts = ["a", "Zug", " ", "  ", "\n", "é", "é", "中", "文", "🙂", "12", ".", ",", "'s", "\t", "ß", "ﬁ", "‍", "-", "_", "ing"]
    for _ in range(400):
        text = "".join(rnd.choice(parts) for _ in range(rnd.randint(1, 40)))
        a, b = own.tokens(text)
        assert a.tolist() == libraries[0].encode(" " + text, add_special_tokens=False).ids and b.tolist() == libraries[1].encode(text)


def test_query(spark, libraries, tmp_path):
    texts = [x for x in TEXTS if x[0] is not None]
    frame(spark, texts).write.parquet(str(tmp_path / "documents.parquet"))
    got = queries.queries()["op13_token_alignment"](spark, str(tmp_path))
    assert sorted((tuple(r) for r in got.collect()), key=repr) == brute(libraries, texts)
