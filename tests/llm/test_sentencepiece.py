"""Piece encoding and decoding against the library and against plain merging."""

import random

import public_tokenizers
import pytest

from fsweave.llm import op13_sentencepiece as op

from .conftest import make_docs, messy

MODEL = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def memory():
    return op.UnitIds(MODEL)


def hostile(n, seed=3):
    rng = random.Random(seed)
    signs = [" ", "  ", "     ", "\n", "\t", "▁", "a", "b", "th", "ing", "er", "é", "漢", "🙂", "́", "ﬁ", "<s>", "</s>", "<unk>", "<0x0A>", "10", "...", "==", "\x00", "\r", "İ", "​", "﻿", "\U0010ffff", "the", "."]
    return ["".join(rng.choice(signs) for _ in range(rng.randint(0, 40))) for _ in range(n)]


def ids_of(memory, texts):
    ids, counts = memory.encode(texts)
    out, at = [], 0
    for n in counts:
        out.append(ids[at : at + n].tolist())
        at += n
    return out


def test_ids_equal_the_library(memory, monkeypatch):
    library = memory.model.library
    rng = random.Random(5)
    pieces = list(memory.model.score)
    texts = hostile(5000) + ["".join(rng.choice(pieces).replace("▁", " ") for _ in range(rng.randint(1, 7))) for _ in range(5000)]
    texts += [None, "", "a" * 50_000, "ab" * 30_000, " " * 50_001, "漢" * 20_000, "xyz1" * 20_000]
    want = [library.encode(t or "", num_threads=1) + [2] for t in texts]
    assert ids_of(memory, texts) == want
    monkeypatch.setattr(op, "CACHE", 50)  # the memories overflow all the time
    monkeypatch.setattr(op, "PAIRS", 20)
    small = op.UnitIds(MODEL)
    for a in range(0, 3000, 100):
        assert ids_of(small, texts[a : a + 100]) == want[a : a + 100]


def test_backtracking_equals_plain_merging(memory):
    """The encoding of a text is what merging leaves, also where the longest match leads astray."""
    model, rng, astray = memory.model, random.Random(8), 0
    syllables = ["▁", "er", "ing", "tion", "th", "ou", "ch", "e", "a", "n", "s", "ss", "漢", "🙂", "▁▁"]
    texts = ["".join(rng.choice(syllables) for _ in range(rng.randint(0, 9))) for _ in range(4000)]
    codes, counts = model.pieces_of_many(texts)
    at = 0
    for text, n in zip(texts, counts):
        want = model.merged(text)[0] if text else []
        assert [model.named(c) for c in codes[at : at + n]] == want
        assert [model.named(c) for c in model.pieces(text)] == want
        at += n
        longest, k, greedy = model.longest(text) if text else [], 0, []
        while k < len(text):
            greedy.append(model.named(longest[k]))
            k += len(greedy[-1])
        astray += greedy != want
    assert astray > 100


def test_round_trip(spark, none):
    rows = messy() + [(2000 + k, t, None, None) for k, t in enumerate(hostile(300))]
    got = op.decode_pieces(op.encode_pieces(make_docs(spark, rows), MODEL), MODEL).collect()
    library = op.PieceBpe(MODEL).library
    want = [(i, ids, library.decode(ids)) for i, ids in ((i, library.encode(t or "") + [2]) for i, t, *_ in rows)]
    assert sorted((tuple(r) for r in got), key=str) == sorted(want, key=str)
    assert op.encode_pieces(none, MODEL).count() == 0
    empty = spark.createDataFrame([(1, None), (2, [])], "doc_id long, ids array<int>")
    assert [r.decoded for r in op.decode_pieces(empty, MODEL).collect()] == ["", ""]
