"""Language identification: scripts narrow the candidates, Viterbi over the words' scores labels spans.

A language's model is the smoothed frequency of its hashed byte trigrams in the labelled training texts, and the scripts that its letters
come from. A word scores for each language that uses its script; the best path through these scores, at a fixed price for each switch, labels the words.
The document's language is the one with most words.

Defined results: a null text and a text without a letter give ``und`` with score 0 and no span; texts are read whole; equal rows get equal
results; equal totals go to the language that sorts first; rows with a null lang don't teach; with nothing to learn from, all is ``und``;
ids may be null or repeat (a null id's remainder is that of the text 'null'); other columns are not read.
The model has 2^16 numbers for each language, whatever the size of the corpus.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pressloom.llm import base
from pressloom.llm.hashing import buffer, chunks, words

BINS = 1 << 16
SWITCH = 14.0  # price of a change of language between two words, in nats
SCRIPT_SHARE = 0.01  # a language uses a script that this share of its letters comes from
UNKNOWN = "und"

#: First and last code points of letter blocks, by script.
SCRIPTS = [
    ("Latin", 0x41, 0x5A), ("Latin", 0x61, 0x7A), ("Latin", 0xC0, 0x24F), ("Greek", 0x370, 0x3FF), ("Cyrillic", 0x400, 0x52F),
    ("Armenian", 0x530, 0x58F), ("Hebrew", 0x590, 0x5FF), ("Arabic", 0x600, 0x6FF), ("Arabic", 0x750, 0x77F), ("Devanagari", 0x900, 0x97F),
    ("Bengali", 0x980, 0x9FF), ("Gurmukhi", 0xA00, 0xA7F), ("Gujarati", 0xA80, 0xAFF), ("Tamil", 0xB80, 0xBFF), ("Telugu", 0xC00, 0xC7F),
    ("Kannada", 0xC80, 0xCFF), ("Malayalam", 0xD00, 0xD7F), ("Thai", 0xE00, 0xE7F), ("Georgian", 0x10A0, 0x10FF), ("Hangul", 0x1100, 0x11FF),
    ("Latin", 0x1E00, 0x1EFF), ("Greek", 0x1F00, 0x1FFF), ("Kana", 0x3040, 0x30FF), ("Han", 0x3400, 0x4DBF), ("Han", 0x4E00, 0x9FFF),
    ("Hangul", 0xAC00, 0xD7AF), ("Han", 0x20000, 0x2FA1F),
]
SCRIPT_NAMES = sorted({name for name, _, _ in SCRIPTS})
_LOW = np.array([low for _, low, _ in SCRIPTS])
_HIGH = np.array([high for _, _, high in SCRIPTS])
_NUMBER = np.array([SCRIPT_NAMES.index(name) for name, _, _ in SCRIPTS])
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20
_LOWER[0x09:0x0E] = 0x20
_ANY_LATIN = re.compile("[A-Za-z]")


def _trigrams(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Hashed trigram around every byte; the texts' edges count as spaces."""
    low = _LOWER[data]
    upper = np.zeros(len(data), bool)  # the capitals of the Latin-1 block
    upper[1:] = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)
    low[upper] += 0x20
    before, after = np.full(len(low), 0x20, np.uint32), np.full(len(low), 0x20, np.uint32)
    before[1:], after[:-1] = low[:-1], low[1:]
    edges = offsets[(offsets > 0) & (offsets < len(low))]
    before[edges], after[edges - 1] = 0x20, 0x20
    x = (before << np.uint32(16) | low.astype(np.uint32) << np.uint32(8) | after) * np.uint32(0x9E3779B1)
    return x >> np.uint32(16)


def _letters(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions and script numbers of the letters of known scripts."""
    at = np.flatnonzero((data & 0xC0) != 0x80)
    b = np.concatenate([data, np.zeros(3, np.uint8)]).astype(np.int64)
    lead = b[at]
    code = lead.copy()
    for first, more in ((0xC0, 1), (0xE0, 2), (0xF0, 3)):
        own = at[lead >= first]
        value = b[own] & (0x3F >> more)
        for k in range(1, more + 1):
            value = value << 6 | (b[own + k] & 0x3F)
        code[lead >= first] = value
    block = np.searchsorted(_LOW, code, "right") - 1
    inside = (block >= 0) & (code <= _HIGH[block])
    return at[inside], _NUMBER[block[inside]]


@dataclass(frozen=True)
class Model:
    languages: list[str]
    scores: np.ndarray  # BINS x languages: log frequency
    uses: np.ndarray  # scripts x languages


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """lang, feature, n: trigram bins, and scripts as negative numbers."""
    totals: dict[str, np.ndarray] = {}
    for batch in batches:
        data, offsets = buffer(batch.column(1))
        langs = np.array(batch.column(0).to_pylist(), object)
        for a, b in chunks(offsets):
            own, bounds = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
            if not len(own):
                continue
            bins = _trigrams(own, bounds)
            at, script = _letters(own)
            names, number = np.unique(langs[a:b].astype(str), return_inverse=True)
            by_byte = np.repeat(number, np.diff(bounds))
            found = np.bincount(by_byte * BINS + bins, minlength=len(names) * BINS).reshape(len(names), BINS)
            scripts = np.bincount(by_byte[at] * len(SCRIPT_NAMES) + script, minlength=len(names) * len(SCRIPT_NAMES)).reshape(len(names), -1)
            for name, x, y in zip(names.tolist(), found, scripts, strict=True):
                totals[name] = totals.get(name, 0) + np.concatenate([x, y])
    for name, x in totals.items():
        at = np.flatnonzero(x)
        yield pa.RecordBatch.from_arrays([pa.array([name] * len(at), pa.string()), pa.array(np.where(at < BINS, at, BINS - 1 - at)), pa.array(x[at])], ["lang", "feature", "n"])


def learn(docs: DataFrame) -> Model:
    """``docs`` (text, lang) -> the model, from all rows with a lang."""
    counts = (
        docs.where("lang is not null and text is not null").select("lang", "text").mapInArrow(_count, "lang string, feature long, n long")
        .groupBy("lang", "feature").agg(F.sum("n").alias("n")).toPandas()  # at most 2^16 numbers a language, and one for each script
    )
    languages = sorted(counts["lang"].unique())
    scores, uses = np.zeros((BINS, len(languages)), np.float32), np.zeros((len(SCRIPT_NAMES), len(languages)))
    for i, lang in enumerate(languages):
        own = counts[counts["lang"] == lang]
        feature, n = own["feature"].to_numpy(), own["n"].to_numpy(float)
        trigram = feature >= 0
        column = np.full(BINS, 0.5)
        column[feature[trigram]] += n[trigram]
        scores[:, i] = np.log(column / column.sum())
        uses[-1 - feature[~trigram], i] = n[~trigram]
    uses = uses >= SCRIPT_SHARE * uses.sum(0)
    uses[~uses.any(1)] = True  # a script that no language uses rules none out
    return Model([str(x) for x in languages], scores, uses)


def best_path(scores: np.ndarray, switch: float = SWITCH) -> np.ndarray:
    """Labels of the words (rows) that maximise the sum of scores less the price of the switches."""
    total = scores.sum(0)
    first = int(total.argmax())
    gain = np.cumsum(np.vstack([np.zeros(scores.shape[1]), scores - scores[:, [first]]]), axis=0)
    # if no stretch of words gains half a switch by any other label, no path with switches can win
    if 2 * (gain[1:] - np.minimum.accumulate(gain, axis=0)[:-1]).max(initial=0) <= switch:
        return np.full(len(scores), first)
    n = scores.shape[1]
    labels = range(n)
    value, came = scores[0].tolist(), []
    for row in scores[1:].tolist():
        top = max(value)
        best, least = value.index(top), top - switch
        came.append([best if value[k] < least else k for k in labels])
        value = [max(value[k], least) + row[k] for k in labels]
    at = value.index(max(value))
    path = [at]
    for step in reversed(came):
        at = step[at]
        path.append(at)
    return np.array(path[::-1])


def _word_scores(model: Model, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words x languages, and the texts' offsets among the words; words without a letter score nothing."""
    starts, ends, _, bounds = words(data, offsets)
    if not len(starts) or not model.languages:
        bounds = bounds if model.languages else np.zeros_like(bounds)
        return np.zeros((0, len(model.languages)), np.float32), bounds
    each = np.vstack([model.scores[_trigrams(data, offsets)], np.zeros((1, len(model.languages)), np.float32)])
    scores = np.add.reduceat(each, np.column_stack([starts, ends]).ravel(), axis=0)[::2]
    at, script = _letters(data)
    word = np.searchsorted(starts, at, "right") - 1
    allowed = np.zeros_like(scores, bool)
    for s in np.unique(script):
        allowed[word[script == s]] |= model.uses[s]
    lettered = np.zeros(len(starts), bool)
    lettered[word] = True
    high = data >= 0x80  # letters outside the listed blocks
    unlisted = np.unique(np.searchsorted(starts, np.flatnonzero(high), "right") - 1)
    allowed[unlisted[(unlisted >= 0) & ~lettered[unlisted]]] = True
    lettered[unlisted[unlisted >= 0]] = True
    scores = np.where(allowed, scores, scores.min(1, keepdims=True) - np.float32(SWITCH))
    scores[~lettered] = 0
    return scores, bounds


SPANS = "array<struct<lang: string, start: int, words: int>>"


def _labels(model: Model, texts: pa.Array) -> tuple[pa.Array, pa.Array, pa.Array]:
    """Language, score and spans of each text."""
    data, offsets = buffer(texts)
    langs, shares, spans = [], [], []
    for a, b in chunks(offsets):
        scores, at = _word_scores(model, data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
        for i in range(b - a):
            rows = scores[at[i] : at[i + 1]]
            text = texts[a + i].as_py() if len(rows) else ""
            if not model.languages or not len(rows) or not (_ANY_LATIN.search(text) or any(map(str.isalpha, text))):
                langs.append(UNKNOWN)
                shares.append(0.0)
                spans.append([])
                continue
            path = best_path(rows)
            number = np.bincount(path, minlength=len(model.languages))
            top = int(number.argmax())
            first = np.flatnonzero(np.append(True, path[1:] != path[:-1]))
            langs.append(model.languages[top])
            shares.append(float(number[top] / len(path)))
            spans.append([{"lang": model.languages[path[s]], "start": int(s), "words": int(n)} for s, n in zip(first, np.diff(np.append(first, len(path))), strict=True)])
    kind = pa.list_(pa.struct([("lang", pa.string()), ("start", pa.int32()), ("words", pa.int32())]))
    return pa.array(langs, pa.string()), pa.array(shares, pa.float64()), pa.array(spans, kind)


def identify(docs: DataFrame, model: Model, names: tuple[str, str, str] = ("lang_pred", "score", "spans")) -> DataFrame:
    """``docs`` (text and any columns) -> the same columns, the language, its share of the words, and the spans of one language, in words."""
    held = docs.sparkSession.sparkContext.broadcast(model)  # 2^16 numbers a language
    at = docs.columns.index("text")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, *_labels(held.value, batch.column(at))], [*batch.schema.names, *names])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return docs.mapInArrow(scan, f"{fields}, {names[0]} string, {names[1]} double, {names[2]} {SPANS}")


def in_known_language(docs: DataFrame, least: float = 0.5) -> DataFrame:
    """The documents whose text is in a learned language for a share of ``least`` of its words or more. Same columns; learns from their own lang."""
    lang, score, spans = "__lang_pred", "__lang_score", "__lang_spans"
    marked = identify(docs, learn(docs), (lang, score, spans))
    return marked.where((F.col(lang) != UNKNOWN) & (F.col(score) >= least)).drop(lang, score, spans)


@base.query("op9_language_spans")
def op9_language_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = base.table(spark, sf_dir, "documents")
    model = learn(docs.where(base.remainder(4) != 2))
    return identify(docs.select("doc_id", "text"), model).select("doc_id", (base.remainder(4) == 2).alias("held_out"), "lang_pred", "score", F.size("spans").alias("n_spans"))
