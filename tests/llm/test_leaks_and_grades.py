"""BM25 retrieval against a plain version, planted leaks, ordinal grades."""

from __future__ import annotations

import math
import random
from collections import Counter

import numpy as np
from cases import SCHEMA, empty, frame, hard_rows, words

from pressloom.llm import decontaminate, ordinal_quality


def test_block_max_loses_nothing():
    rng = random.Random(8)
    vocabulary = [f"w{i}" for i in range(200)]
    pick = lambda n: [vocabulary[min(199, int(rng.expovariate(0.03)))] for _ in range(n)]
    items = [(i, ws[:9], ws[9:]) for i, ws in enumerate(pick(12) for _ in range(60))]
    frequency = Counter(w for _, q, a in items for w in {*q, *a})
    index = decontaminate.build_index(items, frequency, len(items), 12.0, 12)
    texts = [pick(rng.randint(0, 80)) for _ in range(80)] + [pick(5) + q + a + pick(5) for _, q, a in items[:20]]
    joined = [" ".join(t).encode() for t in texts]
    data = np.frombuffer(b"".join(joined), np.uint8)
    hashes, at = decontaminate.term_hashes(data, np.cumsum([0, *map(len, joined)]))
    got = {(t, i): s for t, i, s in zip(*decontaminate.retrieve(index, hashes, at))}
    expected = {}
    for t, ws in enumerate(texts):
        parts = [ws[k : k + 12] for k in range(0, len(ws), 12)]
        for i, q, a in items:
            own = Counter(q + a)
            weight = {w: math.log(1 + (60 - frequency[w] + 0.5) / (frequency[w] + 0.5)) * n * 2.2 / (n + 1.2 * (0.25 + 0.75 * 12 / 12)) for w, n in own.items()}
            for k in range(len(parts)):
                s = sum(weight[w] for w in set(parts[k] + (parts[k + 1] if k + 1 < len(parts) else [])) if w in weight) / sum(weight.values())
                expected[t, i] = max(expected.get((t, i), 0), s)
    expected = {k: s for k, s in expected.items() if s >= decontaminate.THRESHOLD}
    assert got.keys() == expected.keys() and all(abs(got[k] - s) < 1e-4 for k, s in expected.items())


def test_leaks(spark):
    rng = random.Random(9)
    item = " ".join(words(rng, 40))
    rows = hard_rows() + [(80, " ".join(words(rng, 500)) + " " + "".join(c.upper() if c.isascii() else c for c in item) + "! " + " ".join(words(rng, 90)), "en", "a", 1), (81, item[: len(item) // 2], "en", "a", 1)]
    benchmark = spark.createDataFrame([(1, item), (2, ""), (3, None), (None, " ".join(words(rng, 30)))], "item_id long, text string")
    docs = frame(spark, rows, clash=True)
    found = {(r["doc_id"], r["item_id"]) for r in decontaminate.find_items(docs, benchmark).where("contaminated").collect()}
    assert found == {(80, 1)}
    clean = decontaminate.without_contaminated(docs, benchmark)
    assert clean.columns == docs.columns and clean.count() == len(rows) - 1
    assert decontaminate.find_items(docs, benchmark.where("false")).count() == 0
    assert decontaminate.find_items(empty(spark), benchmark).count() == 0
    asked = spark.createDataFrame([(5, "what is the tok of dolen mira suvan", "the reka word straße")], "item_id long, question string, answer string")
    both = [(90, "well what is the tok of dolen mira suvan said the reka word straße here", "en", "a", 1), (91, "what is the tok of dolen mira suvan", "en", "a", 1)]
    assert [r["doc_id"] for r in decontaminate.find_items(spark.createDataFrame(both, SCHEMA), asked).where("contaminated").collect()] == [90]


def test_leaks_of_short_items(spark):
    rng = random.Random(11)
    around = lambda s: " ".join([*words(rng, 30), s, *words(rng, 30)])
    items = [(1, "what is the chief town of the old land of gorm", "Paris"), (2, "sum of forty zu", "option B"), (3, "who wrote Quixotl", "the man of Lepanth himself"), (4, "Zweibrug", "1477")]
    rows = [(100 + i, around(f"{q}? {a}."), "en", "a", 1) for i, q, a in items] + [(110 + i, around(f"{q}?"), "en", "a", 1) for i, q, _ in items] + [(120, items[0][1], "en", "a", 1)]
    asked = spark.createDataFrame(items, "item_id long, question string, answer string")
    found = decontaminate.find_items(spark.createDataFrame(rows, SCHEMA), asked).where("contaminated").collect()
    assert {(r["doc_id"], r["item_id"]) for r in found} == {(100 + i, i) for i, _, _ in items}
    whole = spark.createDataFrame([(i, f"{q} {a}") for i, q, a in [(5, "mur tel", "pons"), (6, "arvo bask celt dorn eft fal", "gild hax")]], "item_id long, text string")
    copies = [(130, around("Mur, tel: pons"), "en", "a", 1), (131, around("arvo bask celt dorn eft fal gild hax"), "en", "a", 1), (132, around("mur tel"), "en", "a", 1)]
    found = decontaminate.find_items(spark.createDataFrame(copies, SCHEMA), whole).where("contaminated").collect()
    assert {(r["doc_id"], r["item_id"]) for r in found} == {(130, 5), (131, 6)}


def test_grades(spark):
    rng = random.Random(10)
    rows, ratings = [], []
    for i in range(600):
        grade = i % 3
        own = words(rng, 80)
        if grade == 0:
            own[rng.randint(0, 79)] = "vile"
        if grade == 1:
            own[rng.randint(0, 79)] = "meh"
        rows.append((i, " ".join(own), "en", "a", 1))
        ratings.append((i, grade))
    docs = spark.createDataFrame(rows, SCHEMA)
    rated = spark.createDataFrame([*ratings[:450], (None, 1), (5, None), (99999, 2)], "doc_id long, grade int")
    model = ordinal_quality.learn(docs, rated)
    got = {r["doc_id"]: r for r in ordinal_quality.grade_documents(docs, model, tail=2).collect()}
    test = range(450, 600)
    assert sum(got[i]["kept"] == (i % 3 == 2) for i in test) >= 0.95 * len(test)
    means = [np.mean([got[i]["expected_grade"] for i in test if i % 3 == g]) for g in range(3)]
    assert means[0] < means[1] < means[2] and (np.diff(model.thresholds) >= 0).all()


def test_grades_of_hard_rows(spark):
    rated = spark.createDataFrame([(6, 2), (11, 0)], "doc_id long, grade int")
    docs = frame(spark, clash=True)
    for model in (ordinal_quality.learn(docs, rated), ordinal_quality.learn(docs, rated.where("false"))):
        got = ordinal_quality.grade_documents(docs, model, tail=2).collect()
        assert len(got) == len(hard_rows()) and all(0 <= r["tail_prob"] <= 1 for r in got)
    assert not any(r["kept"] for r in got)
    assert ordinal_quality.grade_documents(empty(spark), model, tail=1).count() == 0
