"""Benchmark decontamination: BM25 over an inverted index of the test items, with block maxima, then a check of question and answer.

The items are the indexed texts and every passage of every document is a query. An item's terms weigh by BM25, divided by the item's
own best score, so one threshold holds for all. Passages are two neighbouring stretches of as many words as the longest item has, so an item's copy is
whole within one. The items are held in blocks with the greatest weight of each term in each block (block-max WAND): a block is read only if
the maxima of the passage's terms reach the threshold together, and then each of its items is scored. All items above the threshold are
retrieved; the document is contaminated if word runs of both the item's question and its answer are in it. A question or answer shorter
than a run is one run of its own length.

The index goes to the tasks in parts of ``ITEMS`` items at most, one pass over the documents each, so its size is bounded whatever the benchmark's.

Defined results: null and empty texts have no passage and items without a word are never found; texts are read whole; equal rows and
items give equal rows each; ids may be null or repeat; an item has columns ``question`` and ``answer``, or a ``text`` whose last quarter of
words counts as the answer; other columns are not read; an empty benchmark finds nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pressloom.llm import base
from pressloom.llm.hashing import BYTE_VALUES, Prefix, buffer, chunks, ranges

ITEMS = 1024
THRESHOLD = 0.6
K1, B = 1.2, 0.75
BLOCK = 8
QUESTION_RUN, ANSWER_RUN = 5, 3
OVERLAP = 0.5

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[0x41:0x5B] += 0x20
_PART = np.ones(256, bool)
_PART[[*range(0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]] = False


def terms(text: Column) -> Column:
    """Words of a text: runs of letters, digits and non-ASCII characters, lower case."""
    return F.filter(F.split(F.translate(text, _UPPER, _LOWER), _NOT_WORD), lambda w: w != "")


def term_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same words of consecutive texts, hashed, and the texts' offsets among them."""
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    low = _FOLD[data]
    part = _PART[low]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    starts = np.flatnonzero(part & (np.append(True, ~part[:-1]) | edge[:-1]))
    ends = np.flatnonzero(part & (np.append(~part[1:], True) | edge[1:])) + 1
    return Prefix(BYTE_VALUES[low]).slices(starts, ends), np.searchsorted(starts, offsets)


def _hashes(words: list[str]) -> np.ndarray:
    joined = " ".join(words).encode()
    return term_hashes(np.frombuffer(joined, np.uint8), np.array([0, len(joined)]))[0]


def runs(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of n words, or of the whole if it is shorter."""
    return Prefix(words).grams(min(n, len(words))) if len(words) else words


def overlap(wanted: np.ndarray, n: int, own: np.ndarray) -> float:
    """Share of the wanted runs of n words that a text with the words ``own`` has; 1 if none are wanted."""
    return float(np.isin(wanted, runs(own, n)).mean()) if len(wanted) else 1.0


@dataclass(frozen=True)
class Index:
    ids: list[int | None]
    term: np.ndarray  # sorted hashes
    weight: np.ndarray  # terms x items
    block_max: np.ndarray  # terms x blocks
    question: list[np.ndarray]
    answer: list[np.ndarray]
    run: list[tuple[int, int]]  # words in a run of each item's question and answer: fewer where the whole is shorter
    stretch: int


def build_index(items: list, frequency: dict[str, int], total: int, average: float, stretch: int) -> Index:
    """items: (id, question words, answer words); frequency: in how many of all ``total`` items a word is."""
    words = [list(q) + list(a) for _, q, a in items]
    vocabulary = sorted({w for ws in words for w in ws})
    hashed = _hashes(vocabulary) if vocabulary else np.zeros(0, np.uint64)
    order = np.argsort(hashed)
    place = {vocabulary[o]: i for i, o in enumerate(order.tolist())}
    weight = np.zeros((len(vocabulary), -(-max(1, len(items)) // BLOCK) * BLOCK), np.float32)
    for i, ws in enumerate(words):
        for w in set(ws):
            df, tf = frequency[w], ws.count(w)
            idf = np.log(1 + (total - df + 0.5) / (df + 0.5))
            weight[place[w], i] = idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * len(ws) / average))
    best = weight.sum(0)
    weight /= np.where(best > 0, best, 1)
    block_max = weight.reshape(len(vocabulary), weight.shape[1] // BLOCK, BLOCK).max(2)
    return Index([i for i, _, _ in items], hashed[order], weight, block_max, [runs(_hashes(q), QUESTION_RUN) for _, q, _ in items], [runs(_hashes(a), ANSWER_RUN) for _, _, a in items], [(min(QUESTION_RUN, len(q)), min(ANSWER_RUN, len(a))) for _, q, a in items], stretch)


def retrieve(index: Index, hashes: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, item, score) of all pairs at or above the threshold, with the best passage's score."""
    none = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.float32)
    if not len(index.term) or not len(hashes):
        return none
    # stretches of each text, numbered through
    stretches = -(-np.diff(at) // index.stretch)
    first = np.append(0, np.cumsum(stretches))
    text = np.repeat(np.arange(len(at) - 1), np.diff(at))
    own = first[text] + (np.arange(len(hashes)) - at[text]) // index.stretch
    term = np.minimum(np.searchsorted(index.term, hashes), len(index.term) - 1)
    known = index.term[term] == hashes
    pair = np.unique(own[known] * len(index.term) + term[known])
    stretch, term = pair // len(index.term), pair % len(index.term)
    if not len(pair):
        return none
    begin = np.flatnonzero(np.append(True, stretch[1:] != stretch[:-1]))
    bound = np.zeros((first[-1] + 1, index.block_max.shape[1]), np.float32)
    bound[stretch[begin]] = np.add.reduceat(index.block_max[term], begin, axis=0)
    of = np.repeat(np.arange(len(stretches)), stretches)
    joined = np.append(of[1:] == of[:-1], False) if len(of) else np.zeros(0, bool)
    upper = bound[:-1] + np.where(joined[:, None], bound[1:], 0)
    passage, block = np.nonzero(upper >= THRESHOLD - 1e-4)
    if not len(passage):
        return none
    bounds = np.searchsorted(stretch, np.arange(first[-1] + 2))
    found = []
    for part in range(0, len(passage), 4096):
        p, b = passage[part : part + 4096], block[part : part + 4096]
        last = np.where(joined[p], p + 1, p)
        count = bounds[last + 1] - bounds[p]
        entry = ranges(bounds[p], count)
        candidate = np.repeat(np.arange(len(p)), count)
        key = np.unique(candidate * len(index.term) + term[entry])
        candidate, word = key // len(index.term), key % len(index.term)
        weights = index.weight.reshape(len(index.term), -1, BLOCK)[word, b[candidate]]
        head = np.flatnonzero(np.append(True, candidate[1:] != candidate[:-1]))
        score = np.add.reduceat(weights, head, axis=0)
        i, j = np.nonzero(score >= THRESHOLD - 1e-6)
        c = candidate[head][i]
        found.append((of[p[c]], b[c] * BLOCK + j, score[i, j]))
    text, item, score = (np.concatenate([f[i] for f in found]) for i in range(3))
    order = np.lexsort((-score, item, text))
    text, item, score = text[order], item[order], score[order]
    best = np.flatnonzero(np.append(True, (text[1:] != text[:-1]) | (item[1:] != item[:-1]))) if len(text) else text
    return text[best], item[best], score[best]


def _scanning(held) -> object:
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = held.value
        for batch in batches:
            ids = batch.column(0)
            data, offsets = buffer(batch.column(1))
            out: list[tuple] = []
            for a, b in chunks(offsets):
                hashes, at = term_hashes(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                for t, i, score in zip(*(x.tolist() for x in retrieve(index, hashes, at)), strict=True):
                    own = hashes[at[t] : at[t + 1]]
                    shares = [overlap(wanted, n, own) for wanted, n in zip((index.question[i], index.answer[i]), index.run[i], strict=True)]
                    out.append((ids[a + t].as_py(), index.ids[i], float(score), *shares))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], kind) for i, kind in enumerate([pa.int64(), pa.int64(), *[pa.float64()] * 3])], ["doc_id", "item_id", "score", "question_overlap", "answer_overlap"])

    return scan


def find_items(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text), ``benchmark`` -> doc_id, item_id, score, the two overlaps and contaminated, for each pair above the threshold."""
    spark = docs.sparkSession
    if {"question", "answer"} <= set(benchmark.columns):
        items = benchmark.select("item_id", terms(F.coalesce("question", F.lit(""))).alias("q"), terms(F.coalesce("answer", F.lit(""))).alias("a"))
    else:
        words = terms(F.coalesce("text", F.lit("")))
        items = benchmark.select("item_id", words.alias("w")).select("item_id", (F.size("w") - F.ceil(F.size("w") / 4)).cast("int").alias("n"), "w").select("item_id", F.slice("w", 1, F.col("n")).alias("q"), F.expr("slice(w, n + 1, size(w))").alias("a"))
    items = items.where(F.size("q") + F.size("a") > 0)
    size = F.size("q") + F.size("a")
    total, average, longest = items.agg(F.count("*"), F.avg(size), F.max(size)).first()
    parts = max(1, -(-total // ITEMS))
    items = items.withColumn("part", F.pmod(F.xxhash64("item_id", "q", "a"), F.lit(parts)).cast("int"))
    word = items.select("part", F.explode(F.array_distinct(F.concat("q", "a"))).alias("word"))
    counts = word.groupBy("word").agg(F.count("*").alias("n"))
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    found = spark.createDataFrame([], "doc_id long, item_id long, score double, question_overlap double, answer_overlap double")
    for part in range(parts if total else 0):
        own = f"part = {part}"  # about ITEMS items, and their words
        frequency = {r["word"]: r["n"] for r in word.where(own).select("word").distinct().join(counts, "word").collect()}
        index = build_index([(r["item_id"], r["q"], r["a"]) for r in items.where(own).collect()], frequency, total, average, longest)
        scan = docs.mapInArrow(_scanning(spark.sparkContext.broadcast(index)), "doc_id long, item_id long, score double, question_overlap double, answer_overlap double")
        found = scan if part == 0 else found.unionByName(scan)
    return found.withColumn("contaminated", (F.col("question_overlap") >= OVERLAP) & (F.col("answer_overlap") >= OVERLAP))


def without_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without the documents that hold an item. Same columns. Rows are told apart by id and text."""
    keyed = docs.withColumn("__key", F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.coalesce("text", F.lit(""))))
    bad = find_items(keyed.select(F.col("__key").alias("doc_id"), "text"), benchmark).where("contaminated").select(F.col("doc_id").alias("__bad")).distinct()
    return keyed.join(bad.hint("shuffle_hash"), keyed["__key"] == bad["__bad"], "left_anti").drop("__key")


@base.query("op7_bm25_leaks")
def op7_bm25_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_items(base.table(spark, sf_dir, "documents"), base.table(spark, sf_dir, "benchmark"))
