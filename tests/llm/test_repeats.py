"""Repeated passages and byte strings against brute force, on both ways through ``windows``."""

from __future__ import annotations

import dataclasses
import random
from collections import Counter

import numpy as np
import pytest
from cases import empty, frame, hard_rows, passages, repeated_bytes, words

from pressloom.llm import base, block_repeats, suffix_repeats
from pressloom.llm.hashing import ranges


@pytest.mark.parametrize("many", [2048, 1])
def test_passages(spark, monkeypatch, many):
    monkeypatch.setattr(block_repeats, "WORDS", dataclasses.replace(block_repeats.WORDS, many=many))
    rows = hard_rows()
    got = block_repeats.repeated_passage_report(frame(spark, rows, clash=True)).collect()
    assert Counter(map(tuple, got)) == Counter(passages(rows))
    assert sum(r["n_removed"] for r in got) > 400


@pytest.mark.parametrize("many", [4096, 1])
def test_bytes(spark, monkeypatch, many):
    monkeypatch.setattr(suffix_repeats, "BYTES", dataclasses.replace(suffix_repeats.BYTES, many=many))
    rows = hard_rows()
    got = suffix_repeats.repeated_byte_report(frame(spark, rows, clash=True)).collect()
    assert Counter(map(tuple, got)) == Counter(repeated_bytes(rows))


def test_equal_rows_are_folded(spark):
    """Lists and rows that meet the texts do not grow with the number of equal rows."""
    rng = random.Random(6)
    text = " ".join(words(rng, 400))
    sizes = []
    for n in (100, 400):
        docs = frame(spark, [(1, text, "en", "a", 1), *[(2, text, "en", "a", 1)] * n])
        sizes.append([[(len(r["starts"]), len(r["counts"])) for r in found(base.texts(docs)).collect()] for found in (block_repeats.repeated_passages, suffix_repeats.repeated_bytes)])
        rows = block_repeats.repeated_passage_report(docs).collect()
        assert sorted((r["doc_id"], r["n_removed"]) for r in rows) == [(1, 0), *[(2, 400)] * n]
        assert Counter(r["n_removed"] for r in suffix_repeats.repeated_byte_report(docs).collect()) == {len(text.encode()): n + 1}
    assert sizes[0] == sizes[1] and len(sizes[0][0]) == 1 and len(sizes[0][1]) == 2


def test_empty_tables(spark):
    assert block_repeats.repeated_passage_report(empty(spark)).count() == 0
    assert suffix_repeats.repeated_byte_report(empty(spark)).count() == 0
    assert suffix_repeats.remove_repeated_bytes(empty(spark)).columns == empty(spark).columns


def test_texts_keep_rows_columns_and_characters(spark):
    rows = hard_rows() + [(50, "é" * 150, "fr", "a", 1), (51, "x" + "é" * 150, "fr", "a", 1)]
    docs = frame(spark, rows, clash=True)
    out = suffix_repeats.remove_repeated_bytes(docs)
    assert out.columns == docs.columns and out.count() == len(rows)
    by_id = {r["doc_id"]: r["text"] for r in out.collect()}
    assert by_id[1] is None and by_id[2] == "" and by_id[50] == "" and by_id[51] == "x"


def test_suffix_array_orders_suffixes():
    rng = np.random.default_rng(3)
    for letters in (1, 2, 4):
        parts = [rng.integers(97, 97 + letters, rng.integers(20, 60)).astype(np.uint8) for _ in range(8)]
        lengths = np.array([len(p) for p in parts])
        starts = np.cumsum(lengths + 1) - (lengths + 1)
        text = np.zeros(int(starts[-1] + lengths[-1] + 1), np.uint8)
        text[ranges(starts, lengths)] = np.concatenate(parts) + 1
        wanted = np.zeros(len(text), bool)
        wanted[ranges(starts, lengths - 15)] = True
        order = suffix_repeats.suffix_array(text, wanted, 16)
        order = order[wanted[order]]
        raw = text.tobytes()
        assert sorted(order.tolist()) == np.flatnonzero(wanted).tolist()
        assert [raw[i : i + 16] for i in order] == sorted(raw[i : i + 16] for i in np.flatnonzero(wanted))


def test_hits_extend_to_whole_windows():
    rng = random.Random(5)
    words = [np.array([rng.randint(0, 3) for _ in range(rng.randint(50, 90))], np.uint64) for _ in range(30)]
    words[3][10:70] = words[2][5:65] if len(words[2]) >= 65 and len(words[3]) >= 70 else words[3][10:70]
    order = np.array([rng.randint(0, 20) for _ in words])
    which, start, count, best = block_repeats.repeats_by_blocks(words, np.zeros(30, np.int64), np.ones(30, np.int64), order)
    got = {(w, s + k): b for w, s, c, b in zip(which, start, count, best) for k in range(c)}
    least: dict = {}
    for i, w in enumerate(words):
        for s in range(len(w) - 49):
            k = tuple(w[s : s + 50])
            least[k] = min(least.get(k, 99), order[i])
    assert got == {(i, s): least[tuple(w[s : s + 50])] for i, w in enumerate(words) for s in range(len(w) - 49)}
