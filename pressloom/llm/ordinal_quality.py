"""Ordinal regression on graded ratings: one weight for each hashed feature, ordered thresholds between the grades.

P(grade >= k) = sigmoid(weights . features - threshold k). The expected grade is the sum of these probabilities, and one of them, the tail, selects.
Features are the distinct words, the first ``STEM`` bytes of longer words and the runs of punctuation of a text, hashed, and steps of four shares: length, repeated words,
capitals and punctuation. The model is fitted on at most ``SAMPLE`` rated documents, those of least hash of their ids, taken evenly from the
whole table; features of under ``LEAST`` of them don't count. It scores every document.

Defined results: a null or empty text has only the features of its shares and is scored like any; texts are read whole; ratings that are null or whose
document is missing don't teach, several ratings of a document all do; without ratings the grade is 0 and nothing is selected;
ids may be null (never rated) or repeat; equal rows get equal scores; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pressloom.llm import base
from pressloom.llm.hashing import BYTE_VALUES, IS_SPACE, Prefix, buffer, chunks, mix

BINS = 1 << 20
SAMPLE = 12_000
LEAST = 5
ROUNDS = 150
SHRINK = 3.0  # L1 penalty, in documents
RATE = 0.3
SELECT = 0.5
STEM = 5

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[0x41:0x5B] += 0x20
_KIND = np.full(256, 2, np.uint8)
_KIND[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = 1
_KIND[IS_SPACE] = 0


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct feature numbers of consecutive texts, and the texts' offsets among them."""
    n = len(offsets) - 1
    shares = np.zeros((4, n), np.int64)
    token_text, token_bin = np.zeros(0, np.int64), np.zeros(0, np.int64)
    if len(data):
        kind = _KIND[data]
        edge = np.zeros(len(data), bool)
        edge[offsets[:-1][np.diff(offsets) > 0]] = True
        start = np.flatnonzero((kind > 0) & (edge | np.append(True, kind[1:] != kind[:-1])))
        change = np.append(np.flatnonzero((kind[1:] != kind[:-1]) | edge[1:]) + 1, len(data))
        stop = change[np.searchsorted(change, start, "right")] if len(start) else stop[:0]
        prefix = Prefix(BYTE_VALUES[_FOLD[data]])
        hashed = prefix.slices(start, stop)
        token_text = np.searchsorted(offsets, start, "right") - 1
        token_bin = (hashed % np.uint64(BINS)).astype(np.int64)
        word = kind[start] == 1
        text, own = token_text[word], hashed[word]
        long = np.flatnonzero(word & (stop - start > STEM))
        stem = mix(prefix.slices(start[long], start[long] + STEM) + np.uint64(STEM))
        lower = np.append(0, np.cumsum((data >= 0x61) & (data <= 0x7A)))
        upper = np.append(0, np.cumsum((data >= 0x41) & (data <= 0x5A)))
        a, b = start[word], stop[word]
        capital = (lower[b] == lower[a]) & (upper[b] - upper[a] > 1)
        again = np.append(False, (own[1:] == own[:-1]) & (text[1:] == text[:-1]))[: len(own)]
        count = lambda mask, of: np.bincount(of[mask], minlength=n)
        words = np.bincount(text, minlength=n)
        shares[0] = np.log2(words + 1)
        for i, x in ((1, count(again, text)), (2, count(capital, text)), (3, count(~word, token_text))):
            shares[i] = np.minimum(16 * x // np.maximum(words, 1), 16)
        token_text = np.concatenate([token_text, token_text[long]])
        token_bin = np.concatenate([token_bin, (stem % np.uint64(BINS)).astype(np.int64)])
    step = mix((np.arange(4, dtype=np.uint64)[:, None] * np.uint64(1000) + shares.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))
    pair = np.unique(np.concatenate([token_text * BINS + token_bin, (np.arange(n) * BINS + (step % np.uint64(BINS)).astype(np.int64)).ravel()]))
    return pair % BINS, np.searchsorted(pair // BINS, np.arange(n + 1))


@dataclass(frozen=True)
class Model:
    weights: np.ndarray
    thresholds: np.ndarray  # one below each grade but the least


def _below(eta: np.ndarray, thresholds: np.ndarray) -> np.ndarray:
    """P(grade < k) for k = 0 ... grades: texts x (grades + 1)."""
    inner = 1 / (1 + np.exp(np.clip(eta[:, None] - thresholds[None, :], -40, 40)))
    return np.hstack([np.zeros((len(eta), 1)), inner, np.ones((len(eta), 1))])


def fit(rows: list[np.ndarray], grade: np.ndarray) -> Model:
    """Features and grades 0, 1, ... of rated texts -> the cumulative-link model, by proximal adaptive gradient steps."""
    weights = np.zeros(BINS, np.float32)
    if not len(grade):
        return Model(weights, np.array([40.0]))
    grades = max(2, int(grade.max()) + 1)
    flat = np.concatenate(rows).astype(np.int64)
    row = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    used = np.flatnonzero(np.bincount(flat, minlength=BINS) >= LEAST)
    place = np.full(BINS, -1)
    place[used] = np.arange(len(used))
    keep = place[flat] >= 0
    column, row = place[flat[keep]], row[keep]
    w, n = np.zeros(len(used)), len(grade)
    share = np.clip(np.array([(grade < k).mean() for k in range(1, grades)]), 1e-3, 1 - 1e-3)
    thresholds = np.log(share / (1 - share))
    seen_w, seen_t = np.full(len(used), 1e-8), np.full(grades - 1, 1e-8)
    for _ in range(ROUNDS):
        below = _below(np.bincount(row, w[column], minlength=n), thresholds)
        low, high = below[np.arange(n), grade], below[np.arange(n), grade + 1]
        slope = 1 - high - low  # of the loss, by the text's score
        gradient = np.bincount(column, slope[row], minlength=len(used))
        p = np.maximum(high - low, 1e-9)
        by_threshold = np.zeros(grades - 1)
        for k in range(1, grades):
            f = below[:, k] * (1 - below[:, k])
            by_threshold[k - 1] = (f / p)[grade == k].sum() - (f / p)[grade == k - 1].sum()
        seen_w += gradient**2
        seen_t += by_threshold**2
        size = RATE / np.sqrt(seen_w)
        w = w - size * gradient
        w = np.sign(w) * np.maximum(np.abs(w) - size * SHRINK, 0)
        thresholds = np.maximum.accumulate(thresholds - RATE * by_threshold / np.sqrt(seen_t))
    weights[used] = w
    return Model(weights, thresholds)


def _featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = buffer(batch.column(1))
        out = []
        for a, b in chunks(offsets):
            found, at = features(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
            out += [found[at[i] : at[i + 1]].astype(np.int32).tobytes() for i in range(b - a)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], ["grade", "features"])


def learn(docs: DataFrame, ratings: DataFrame, sample: int = SAMPLE) -> Model:
    """``docs`` (doc_id, text), ``ratings`` (doc_id, grade from 0 on) -> the model, from ``sample`` rated documents at most."""
    rated = ratings.where("grade is not null and doc_id is not null").select("doc_id", F.col("grade").cast("int").alias("grade"))
    rated = rated.join(docs.select("doc_id").distinct(), "doc_id", "left_semi").orderBy(F.xxhash64("doc_id"), "doc_id", "grade").limit(sample)
    rows = base.texts(docs).join(rated, "doc_id").select("grade", "text").mapInArrow(_featured, "grade int, features binary").collect()  # ``sample`` rows
    rows.sort(key=lambda r: (r["grade"], bytes(r["features"])))
    return fit([np.frombuffer(r["features"], np.int32) for r in rows], np.array([r["grade"] for r in rows], np.int64))


def grade_documents(docs: DataFrame, model: Model, tail: int) -> DataFrame:
    """``docs`` (doc_id, text) -> doc_id, expected grade, P(grade >= tail), selected."""
    held = docs.sparkSession.sparkContext.broadcast(model)  # BINS numbers

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        for batch in batches:
            data, offsets = buffer(batch.column(1))
            eta = []
            for a, b in chunks(offsets):
                found, at = features(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                eta.append(np.add.reduceat(m.weights[found].astype(float), at[:-1]))  # every text has features
            above = 1 - _below(np.concatenate(eta) if eta else np.zeros(0), m.thresholds)[:, 1:-1]
            chosen = above[:, min(tail, above.shape[1]) - 1]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(above.sum(1)), pa.array(chosen), pa.array(chosen >= SELECT)], ["doc_id", "expected_grade", "tail_prob", "kept"])

    return base.texts(docs).mapInArrow(scan, "doc_id long, expected_grade double, tail_prob double, kept boolean")


def ratings_from_labels(labels: DataFrame) -> DataFrame:
    """Grade 0 for toxic documents, 1 for others of low quality, 2 for those of high quality."""
    return labels.select("doc_id", F.when(F.col("toxic") > 0, 0).when(F.col("quality") > 0, 2).when(F.col("quality") == 0, 1).alias("grade"))


@base.query("op10_ordinal_grades")
def op10_ordinal_grades(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = base.table(spark, sf_dir, "documents")
    model = learn(docs, ratings_from_labels(base.table(spark, sf_dir, "labels")))
    return grade_documents(docs, model, tail=2)
