"""Counts of the compiled tokenizer against the library, and chunk maps against whole texts."""

from __future__ import annotations

import random

import numpy as np
import pytest
import sentencepiece
from cases import CLASHES, empty, frame, hard_rows

from pressloom.llm import token_counts as tc


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=tc.vocabulary_path())


@pytest.fixture(scope="module")
def compiled():
    return tc.Machine(tc.vocabulary_path())


LETTERS = "aab  \n\t\r　\x1c'sdl0123½²éßЖдあ中‍😀👍!?-_—…IV▁thein\x00"


def test_random_texts(compiled, library):
    rng = random.Random(3)
    texts = ["".join(rng.choice(LETTERS) for _ in range(rng.randint(0, 60))) for _ in range(1500)]
    texts += [a + c * n + b for n in (*range(1, 40), 200) for a, b in (("", ""), ("x", "the"), ("\n", "é")) for c in " a-0h"]
    texts += ["<s> </s> <unk> <0x41>", " ", "", "a" * 5000, " " * 999]
    assert [compiled.count(t) for t in texts] == [len(library.encode(t)) for t in texts]


def test_chunk_maps_compose_at_any_cut(compiled, library):
    rng = random.Random(4)
    texts = ["".join(rng.choice(LETTERS) for _ in range(120)) for _ in range(60)] + ["a" * 300, " " * 300, "the then there " * 20, "中文字符" * 60]
    for text in texts:
        read = tc.spaced(text)
        cuts = sorted({0, len(read), *(rng.randint(0, len(read)) for _ in range(6))})
        maps = [compiled.chunk_map(read[max(0, a - 2 * compiled.longest) : a], read[a:b]) for a, b in zip(cuts, cuts[1:])]
        whole = maps[0]
        for m in maps[1:]:
            whole = tc.compose(whole, m)
        assert tc.tokens_at(whole) == len(library.encode(text))
        if len(maps) > 2:  # composition is associative
            right = maps[-1]
            for m in reversed(maps[:-1]):
                right = tc.compose(m, right)
            assert sorted(map(tuple, right.tolist())) == sorted(map(tuple, whole.tolist()))


def test_states_are_compiled_anew(library, monkeypatch):
    monkeypatch.setattr(tc, "KEPT", 50)
    own = tc.Machine(tc.vocabulary_path())
    texts = [r[1] or "" for r in hard_rows()]
    assert [own.count(t) for t in texts] == [len(library.encode(t)) for t in texts]
    assert len(own.borders) <= 51


@pytest.mark.parametrize("size", [tc.CHUNK, 40])
def test_documents(spark, library, size):
    rows = hard_rows()
    expected = sorted(((r[0], len((r[1] or "").encode()), len(library.encode(r[1] or ""))) for r in rows), key=str)
    counted = tc.count_tokens(frame(spark), size=size)
    assert counted.columns == ["doc_id", "n_bytes", "n_tokens"]
    assert sorted(map(tuple, counted.collect()), key=str) == expected
    docs = frame(spark, clash=True)
    for name in ("part", "map", "before", "piece", "n_bytes", "n_tokens"):
        assert name not in CLASHES.split(", ")
        docs = docs.selectExpr("*", f"'other' AS {name}")
    assert sorted(map(tuple, tc.count_tokens(docs, size=size).collect()), key=str) == expected
    assert tc.count_tokens(empty(spark), size=size).count() == 0


def test_scan_gives_the_tokens_before_each_chunk(spark, library):
    rows = [(1, "the quick brown fox " * 60, "en", "a", 1), (2, None, "en", "a", 1), (3, "x" * 700, "en", "a", 1), (4, "", "en", "a", 1)]
    found = {(r["doc_id"], r["part"]): r["tokens_before"] for r in tc.prefix_counts(frame(spark, rows), size=7).collect()}
    expected = {}
    for doc, text, *_ in rows:
        read = tc.spaced(text) if text else ""
        for first in range(0, len(read), 7):
            expected[doc, first // 7] = len(library.encode(read[1:first])) if first else 0
    assert found == expected


def test_empty_maps():
    assert tc.tokens_at(np.zeros((0, 5), np.int64)) == 0 and len(tc.compose(tc.START, np.zeros((0, 5), np.int64))) == 0
