"""Encoding against the tokenizers library, and exact round trips."""

from __future__ import annotations

import hashlib
import random

import pytest
from cases import empty, frame, hard_rows
from tokenizers import Tokenizer

from pressloom.llm import bpe


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(bpe.vocabulary_path())


def test_random_texts(library):
    rng = random.Random(2)
    letters = "aab  \n\t\r 　\x1c\x85'sdl0123½²éßЖдあ中‍😀👍🏽!?-_—…IVⅣ٣"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 60))) for _ in range(3000)]
    texts += ["a" * 3000, "-" * 2000, " " * 999, "x<|endoftext|>y <|endoftext|><|endoftext|>", "it's they'LL we've", ""]
    own = bpe.Encoder(bpe.vocabulary_path())
    for text, expected in zip(texts, library.encode_batch(texts, add_special_tokens=False)):
        assert own.encode(text) == expected.ids
        assert own.decode(expected.ids) == library.decode(expected.ids, skip_special_tokens=False) == text


def test_report_and_columns(spark, library):
    rows = hard_rows()
    expected = []
    for r in rows:
        ids = library.encode(r[1] or "", add_special_tokens=False).ids
        expected.append((r[0], len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((r[1] or "").encode()).hexdigest()))
    assert sorted(map(tuple, bpe.encoding_report(frame(spark)).collect()), key=str) == sorted(expected, key=str)
    docs = frame(spark, clash=True).drop("tokens")
    coded = bpe.decode_documents(bpe.encode_documents(docs))
    assert coded.columns == [*docs.columns, "tokens", "decoded"]
    at_once = bpe.encode_documents(docs, with_decoded=True)
    assert at_once.columns == coded.columns and sorted(map(str, at_once.collect())) == sorted(map(str, coded.collect()))
    assert all(r["decoded"] == (r["text"] or "") for r in coded.collect())
    assert bpe.encoding_report(empty(spark)).count() == 0
