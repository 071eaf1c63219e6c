"""DartMinHash signatures, classes against brute force, components."""

from __future__ import annotations

import random

import numpy as np
from cases import empty, frame, hard_rows, kept_ids, least_ids, similarity, shingles, words

from pressloom.llm import dart_minhash
from pressloom.llm.graphs import components
from pressloom.llm.hashing import words as split


def _signature(text: str) -> np.ndarray:
    data = np.frombuffer(text.encode(), np.uint8)
    _, _, hashes, at = split(data, np.array([0, len(data)]))
    return dart_minhash.signatures(*dart_minhash.cells(hashes, at), coordinates=512)[0]


def test_agreement_is_weighted_similarity():
    rng = random.Random(4)
    for changed in (2, 10, 40):
        a = words(rng, 300) + ["again", "and", "again", "and"] * 20
        b = list(a)
        for i in rng.sample(range(300), changed):
            b[i] = "other"
        expected = similarity(shingles(" ".join(a)), shingles(" ".join(b)))
        found = float((_signature(" ".join(a)) == _signature(" ".join(b))).mean())
        assert abs(found - expected) < 0.08


def test_short_texts_have_whole_signatures():
    for text in ("one", "one two", "a b c d e f"):
        assert (_signature(text) != 0).all()


def _near_copies(seed: int) -> list[tuple]:
    rng = random.Random(seed)
    base = words(rng, 120)
    rows = [(1000, " ".join(base), "en", "a", 1)] * 3
    for i in range(60):
        own = list(base)
        for j in rng.sample(range(120), rng.choice([1, 2, 3, 4, 6])):
            own[j] = f"edit{i}x{j % 7}"
        rows.append((i, " ".join(own), "en", "a", 1))
    return rows


def test_classes(spark):
    for rows in (hard_rows(), _near_copies(1)):
        got = dart_minhash.near_duplicate_classes(frame(spark, rows, clash=True)).select("doc_id", "class_id").collect()
        assert sorted(map(tuple, got), key=str) == sorted(least_ids(rows), key=str)


def test_one_of_each_class_stays(spark):
    rows = hard_rows()
    docs = frame(spark, rows, clash=True)
    kept = dart_minhash.without_near_duplicates(docs)
    assert kept.columns == docs.columns
    found = [r["doc_id"] for r in kept.collect()]
    assert sorted(x for x in found if x is not None) + [x for x in found if x is None] == kept_ids(rows)
    assert dart_minhash.without_near_duplicates(empty(spark)).count() == 0
    assert dart_minhash.near_duplicate_classes(empty(spark)).count() == 0


def test_components_of_chains(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 102), (102, 101), (200, 201)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100, 102: 100, 200: 200, 201: 200}
