"""Hard negatives against a plain loop over all pairs of rows."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest

from pressloom.llm import hard_negatives as hn

SCHEMA = "vec_id long, embedding array<float>, label int"


def plain(rows):
    taking = set()
    for vec_id, vector, label in rows:
        if label is None or vector is None or any(x is None or not math.isfinite(x) for x in vector):
            continue
        if vec_id is not None and vec_id % 7 == 0:
            label = (label + 1) % 10
        numbers = [math.floor(256 * float(np.float32(x))) for x in vector]
        while numbers and numbers[-1] == 0:
            numbers.pop()
        taking.add((vec_id, label, np.array(numbers, "<i4").tobytes()))
    numbers_of = {r: np.frombuffer(r[2], "<i4").tolist() for r in taking}
    order = lambda pair: (-pair[1], pair[0][0] is None, pair[0][0] or 0, pair[0][1], pair[0][2])
    out = []
    for a in taking:
        if a[0] is None or a[0] % 100:
            continue
        scored = sorted(((r, sum(x * y for x, y in zip(numbers_of[a], numbers_of[r]))) for r in taking if r != a), key=order)
        for positive, ps in [p for p in scored if p[0][1] == a[1]][:5]:
            fits = [(r, ns) for r, ns in scored if r[1] != a[1] and 30 * ps <= 100 * ns <= 90 * ps][:10]
            out += [(a[0], positive[0], k + 1, r[0], ps, ns) for k, (r, ns) in enumerate(fits)]
    return sorted(out, key=str)


def planted(seed=1, n=260, dims=11):
    rng = random.Random(seed)
    centre = [[rng.uniform(-0.5, 0.5) for _ in range(dims)] for _ in range(3)]
    rows = []
    for i in range(n):
        base = rng.choice(centre)
        rows.append((i * 5, [round(x + rng.choice([0, 0.1, -0.1]), 2) for x in base], rng.choice([0, 1, 1, 1, 9])))
    rows += rows[:40] + rows[:40]  # repeated rows
    rows += [(100, [0.5] * dims, 3), (100, [0.5] * dims, 4), (100, [0.25] * dims, 3), (None, [0.5] * dims, 3), (None, [0.4] * dims, 1)]
    rows += [(7000, None, 1), (7100, [0.5], None), (7200, [None, 1.0], 1), (7300, [float("nan")], 1), (7400, [float("inf")], 1)]
    rows += [(7500, [], 1), (7600, [3.5, -2.25], 1), (7700, [0.0] * dims, 1), (8000, [20.0] * dims, 2), (8100, [-0.001] * 20, 9)]
    return rows


def test_tables_and_planes():
    rng = np.random.default_rng(2)
    for high in (1, 2, 256, 1 << 20):
        numbers, anchors = rng.integers(-high, high, (300, 24)), rng.integers(-high, high, (7, 24))
        numbers[:3], anchors[:2] = -high, -high
        assert (hn.scores(hn.tables(anchors), hn.planes(numbers)) == numbers @ anchors.T).all()
    packed = [anchors[i].astype("<i4").tobytes() for i in range(7)]
    assert (hn.matrix(packed, 4)[:, :24] == anchors).all()


@pytest.mark.parametrize(("block", "slice_rows", "at_once"), [(1 << 17, 4096, 64), (60, 16, 2)])
def test_against_all_pairs(spark, monkeypatch, block, slice_rows, at_once):
    monkeypatch.setattr(hn, "BLOCK", block)
    rows = planted()
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    # sizes reach the tasks as defaults of the module there, so results must not depend on them
    found = hn.mine(df)
    assert found.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    expected = plain(rows)
    assert len(expected) > 50 and sorted(map(tuple, found.collect()), key=str) == expected
    # the same in one task, with small slices and batches
    monkeypatch.setattr(hn, "SLICE", slice_rows)
    own = hn.Block([(1, 0, np.array([i % 5, 1], "<i4").tobytes()) for i in range(100)], 1)
    anchors = [{"vec_id": 0, "label": 0, "vector": np.array([1, 1], "<i4").tobytes()}] * at_once
    assert [r[2] for r in hn._positives(own, anchors, 1)] == [5] * 5 * at_once


def test_empty_and_clashing_columns(spark):
    assert hn.mine(spark.createDataFrame([], SCHEMA)).count() == 0
    rows = planted(3, 120)
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", *[f"'other' AS {c}" for c in ("number", "vector", "score", "scores", "block", "share", "rank", "k", "positives")])
    assert sorted(map(tuple, hn.mine(df).collect()), key=str) == plain(rows)


def test_numbers_too_large_are_an_error(spark):
    with pytest.raises(Exception, match="more than 24 bits"):
        hn.mine(spark.createDataFrame([(100, [1e9], 1)], SCHEMA))
