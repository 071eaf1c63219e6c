"""Counts and base score against brute force; the model is proper and better than the base on held-out texts."""

from __future__ import annotations

import math
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from cases import empty, frame, hard_rows

from pressloom.llm import base, brown


def _score(spark, docs):
    docs = base.texts(docs).withColumn("held_out", base.remainder(10) == 0)
    train = docs.where("not held_out")
    model, counts = brown.learn(train)
    return model, brown.score(docs, model, counts, train.count()).collect()


def test_base_score_and_counts(spark, monkeypatch):
    monkeypatch.setattr(brown, "HELD", 20)
    rows = hard_rows()
    model, got = _score(spark, frame(spark, rows, clash=True))
    tokens = [(r[0], [*(r[1] or "").encode().lower().split(), None]) for r in rows]
    rest = lambda i: zlib.crc32(b"null" if i is None else str(i).encode()) % 10
    count = Counter(t for i, ts in tokens if rest(i) for t in ts)
    total, kinds = sum(count.values()), len(count)
    expected = sorted(
        ((str(i), rest(i) == 0, len(ts), sum(count[t] > 0 for t in ts), total, round(sum(math.log10((count[t] + 0.1) / (total + 0.1 * (kinds + 1))) for t in ts), 6)) for i, ts in tokens), key=str
    )
    assert sorted(((str(r["doc_id"]), r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in got), key=str) == expected


def _words(rows):
    return sorted({w for r in rows for w in (r[1] or "").encode().lower().split()})


def _classes(model, words):
    """Classes of words, one at a time."""
    out = []
    for w in words:
        ((hashes, endings, _),) = brown.tokens(pa.array([w.decode("utf-8", "surrogateescape")]))
        at = int(model.place(hashes)[0])
        out.append(int(model.of[at + (brown.ENDINGS + 1 if at >= brown.CLUSTERED else 0)] if 0 <= at < model.clustered else model.of[endings[0]]))
    return out


def test_probabilities_sum_to_one_and_scores_follow_from_them(spark):
    rows = hard_rows()
    model, got = _score(spark, frame(spark, rows))
    assert np.allclose((10.0 ** model.step).sum(1), 1)
    rest = lambda i: zlib.crc32(b"null" if i is None else str(i).encode()) % 10
    train = [r for r in rows if rest(r[0])]
    count = Counter(w for r in train for w in (r[1] or "").encode().lower().split())
    of = dict(zip(_words(rows), _classes(model, _words(rows))))
    assert not set(of.values()) & {brown.CLASSES}
    share = np.zeros(brown.ALL)
    for w, n in count.items():
        share[of[w]] += (n + brown.ADD) / 10 ** model.share[of[w]]
    share[brown.CLASSES] = (len(train) + brown.ADD) / 10 ** model.share[brown.CLASSES]
    used = share > 0
    assert np.allclose(share[used] + brown.ADD / 10 ** model.share[used], 1)
    expected = []
    for r in rows:
        score, before = 0.0, brown.CLASSES
        for w in [*(r[1] or "").encode().lower().split(), None]:
            cls, n = (of[w], count[w]) if w else (brown.CLASSES, len(train))
            score += model.step[before, cls] + math.log10(n + brown.ADD) - model.share[cls]
            before = cls
        expected.append((str(r[0]), score))
    for (a, x), (b, y) in zip(sorted(expected), sorted((str(r["doc_id"]), r["score"]) for r in got)):
        assert a == b and abs(x - y) < 1e-6


def test_better_than_base_on_held_out(spark):
    _, got = _score(spark, spark.read.parquet("/root/testdata/sf0.001/documents.parquet"))
    held = [r for r in got if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


def test_exchange_separates_alternating_words():
    met = np.zeros((brown.UNITS, 2, brown.ALL))
    of = np.append(np.arange(brown.END) % brown.CLASSES, brown.CLASSES)
    met[0, 0, of[1]] = met[0, 1, of[1]] = met[1, 0, of[0]] = met[1, 1, of[0]] = 100
    moved = brown.exchange(met, of)
    assert moved[0] != moved[1]


def test_nothing_to_learn_from(spark):
    _, got = _score(spark, empty(spark))
    assert got == []


def test_best_class_by_the_whole_likelihood():
    rng = np.random.default_rng(3)
    pairs = rng.integers(20, 90, (brown.ALL, brown.ALL)).astype(float)
    own, met = np.array([4, 9, 7]), np.zeros((3, 2, brown.ALL))
    for w in range(3):  # as many neighbours before as after
        for side in range(2):
            np.add.at(met[w, side], rng.choice([20, 21, 33, 64], 6), 1)
        pairs[own[w]] += met[w, 1]
        pairs[:, own[w]] += met[w, 0]
    likelihood = lambda p: (brown._xlogx(p).sum() - brown._xlogx(p.sum(0)).sum() - brown._xlogx(p.sum(1)).sum())
    expected = []
    for w in range(3):
        without = pairs.copy()
        without[own[w]] -= met[w, 1]
        without[:, own[w]] -= met[w, 0]
        after = []
        for c in range(brown.CLASSES):
            p = without.copy()
            p[c] += met[w, 1]
            p[:, c] += met[w, 0]
            after.append(likelihood(p))
        expected.append(int(np.argmax(after)))
    word, side, cls = np.nonzero(met)
    assert brown.best_classes(word, side, cls, met[word, side, cls], own, pairs).tolist() == expected


def test_words_past_the_most_frequent_get_their_own_class(spark):
    rng = np.random.default_rng(4)
    common = [f"c{i}" for i in range(brown.CLUSTERED)]
    lines = [" ".join(rng.permutation(common)) for _ in range(12)]
    kinds = [[f"{k}{i}xyz" for i in range(40)] for k in "pq"]  # one ending for all, so one class for all by their ending
    for _ in range(25):
        lines += [f"pre {w} mid" for w in kinds[0]] + [f"mid {w} pre" for w in kinds[1]]
    docs = spark.createDataFrame([(line,) for line in lines], "text string")
    model, _ = brown.learn(docs)
    of = [set(_classes(model, [w.encode() for w in ws])) for ws in kinds]
    assert not of[0] & of[1]
