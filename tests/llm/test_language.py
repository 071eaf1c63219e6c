"""Spans, Viterbi against all paths, accuracy on held-out documents."""

from __future__ import annotations

import itertools

import numpy as np
from cases import SCHEMA, empty, frame

from pressloom.llm import base, language_id


def test_best_path_is_the_best_of_all():
    rng = np.random.default_rng(1)
    for _ in range(200):
        scores = rng.normal(0, 6, (6, 3))
        worth = lambda p: sum(scores[i, k] for i, k in enumerate(p)) - 5 * sum(a != b for a, b in zip(p, p[1:]))
        best = max(itertools.product(range(3), repeat=6), key=worth)
        assert abs(worth(language_id.best_path(scores, 5.0).tolist()) - worth(best)) < 1e-9


def test_scripts_and_mixed_spans(spark):
    english = "the quick brown fox jumps over the lazy dog and runs through the old forest with his friends "
    russian = "быстрая коричневая лиса прыгает через ленивую собаку и бежит через старый лес вместе с друзьями "
    greek = "η γρήγορη καφέ αλεπού πηδάει πάνω από το τεμπέλικο σκυλί και τρέχει στο παλιό δάσος "
    rows = [(i, t * 5, lang, "a", 1) for i, (t, lang) in enumerate([(english, "en"), (russian, "ru"), (greek, "el")])]
    model = language_id.learn(spark.createDataFrame(rows, SCHEMA))
    asked = [(10, english + russian, None, None, 1), (11, "привет", None, None, 1), (12, "", None, None, 1), (13, "12 !!", None, None, 1), (14, None, None, None, 1), (15, "καλημέρα κόσμε", None, None, 1)]
    got = {r["doc_id"]: r for r in language_id.identify(spark.createDataFrame(asked, SCHEMA), model).collect()}
    assert [(s["lang"], s["start"]) for s in got[10]["spans"]] == [("en", 0), ("ru", 18)]
    assert [got[i]["lang_pred"] for i in (11, 12, 13, 14, 15)] == ["ru", "und", "und", "und", "el"]
    assert got[14]["score"] == 0 and 0 < got[10]["score"] < 1


def test_hard_rows_and_nothing_to_learn(spark):
    docs = frame(spark, clash=True)
    kept = language_id.in_known_language(docs)
    assert kept.columns == docs.columns and kept.where("text is null or text = ''").count() == 0
    nothing = language_id.learn(empty(spark))
    assert {r["lang_pred"] for r in language_id.identify(frame(spark), nothing).collect()} == {"und"}


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    model = language_id.learn(docs.where(base.remainder(4) != 2))
    held = language_id.identify(docs.where(base.remainder(4) == 2), model).collect()
    assert sum(r["lang_pred"] == r["lang"] for r in held) >= 0.98 * len(held)
