"""Removal of repeated passages by fixed-block anchors.

The reference blocks of a segment are its non-overlapping runs of half a window, so each window holds a whole one. Every rolling run of
that length is looked up among them, and each hit is extended to both sides as far as the words agree; where the extent reaches a
window's length, its windows are repeats. ``windows`` brings the segments that can share a window together.

Defined results: a null or empty text has no words; a null doc_id counts as larger than all others; equal rows and rows with one id
have no smaller document between them and keep their text; texts under a window's length lose nothing; other columns are not read.
"""

from __future__ import annotations


import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pressloom.llm import base
from pressloom.llm.hashing import Prefix, mix, ranges
from pressloom.llm.windows import Unit, covered, repeated_windows

LENGTH = 50
GRAM = 25
LAST = (1 << 63) - 1


def repeats_by_blocks(contents: list[np.ndarray], least: np.ndarray, weight: np.ndarray, order: np.ndarray, size: int = LENGTH):
    """Solver for ``repeated_windows``: segments of word hashes -> runs of windows, each with the least order value that holds it."""
    block = size // 2
    lengths = np.array([len(c) for c in contents])
    starts = np.cumsum(lengths) - lengths
    text = np.concatenate(contents)
    which = np.repeat(np.arange(len(contents)), lengths)
    end = (starts + lengths)[which]
    group = mix(least.astype(np.uint64))[which]  # only segments of one key can share a window

    prefix = Prefix(text)
    probe = np.flatnonzero(np.arange(len(text)) + block <= end)
    probe_hash = prefix.slices(probe, probe + block) ^ group[probe]
    reference = (probe - starts[which[probe]]) % block == 0
    index, index_hash = probe[reference], probe_hash[reference]
    sort = np.argsort(index_hash, kind="stable")
    index, index_hash = index[sort], index_hash[sort]
    low = np.searchsorted(index_hash, probe_hash, "left")
    hits = np.searchsorted(index_hash, probe_hash, "right") - low
    windows = lengths - size + 1
    at = ranges(starts, windows)
    best = np.full(len(text), LAST)
    best[at] = order[which[at]]
    upto = np.cumsum(hits)
    first = 0
    while first < len(probe):  # about a million hits at once
        part = slice(first, max(first + 1, int(np.searchsorted(upto, (upto[first - 1] if first else 0) + (1 << 20), "right"))))
        first = part.stop
        q = np.repeat(probe[part], hits[part])
        r = index[ranges(low[part], hits[part])]
        other = (which[q] != which[r]) & (order[which[r]] < order[which[q]])
        _extend(text, starts[which], end, q[other], r[other], block, size, order[which[r[other]]], best)
    change = np.append(True, (best[at[1:]] != best[at[:-1]]) | (at[1:] != at[:-1] + 1))
    first = np.flatnonzero(change)
    where = at[first]
    return which[where], where - starts[which[where]], np.diff(np.append(first, len(at))), best[where]


def _extend(text, begin, end, q, r, block, size, order, best) -> None:
    """Extends hits (a block at q equals one at r) both ways and lowers ``best`` of all windows of q inside."""
    left, right = np.zeros(len(q), np.int64), np.full(len(q), block)
    going = np.arange(len(q))
    for step in range(1, size - block + 1):
        a, b = q[going] - step, r[going] - step
        inside = (a >= begin[q[going]]) & (b >= begin[r[going]])
        going, a, b = going[inside], a[inside], b[inside]
        going = going[text[a] == text[b]]
        left[going] = step
    going = np.arange(len(q))
    for step in range(block, size):
        a, b = q[going] + step, r[going] + step
        inside = (a < end[q[going]]) & (b < end[r[going]])
        going, a, b = going[inside], a[inside], b[inside]
        going = going[text[a] == text[b]]
        right[going] = step + 1
    count = np.maximum(left + right - size + 1, 0)
    np.minimum.at(best, ranges(q - left, count), np.repeat(order, count))


WORDS = Unit("word", LENGTH, GRAM, many=2048)


def repeated_passages(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text) -> key, text, starts, counts of the documents with windows that a document with a smaller id holds too."""
    held, spans = repeated_windows(docs, WORDS, F.coalesce("doc_id", F.lit(LAST)), repeats_by_blocks)
    lists = spans.where("best < ord").groupBy("key").agg(F.collect_set(F.struct("start", "n")).alias("spans"))  # equal rows bring equal spans
    return held.join(lists.hint("shuffle_hash"), "key").select("key", "text", F.col("spans.start").alias("starts"), F.col("spans.n").alias("counts"))


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        removed, kept = [], []
        for text, starts, counts in zip(batch.column(1), batch.column(2), batch.column(3), strict=True):
            own = text.as_py().encode().split()
            gone = covered(len(own), starts.values.to_numpy(), counts.values.to_numpy(), LENGTH)
            removed.append(int(gone.sum()))
            kept.append(b" ".join([w for w, g in zip(own, gone.tolist(), strict=True) if not g]))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())], ["key", "n_removed", "kept"])


def kept_words(docs: DataFrame) -> DataFrame:
    """key, n_removed and the words kept, joined by one space, of the documents that lose words."""
    return repeated_passages(base.texts(docs)).mapInArrow(_kept, "key long, n_removed long, kept string")


def repeated_passage_report(docs: DataFrame) -> DataFrame:
    """Per document: words, words removed, SHA-256 of the kept words."""
    docs = base.texts(docs)
    found = kept_words(docs).select("key", "n_removed", F.sha2("kept", 256).alias("cut_sha256"))
    plain = F.regexp_replace(F.regexp_replace("text", f"[{base.SPACE_CLASS}]+", " "), "^ | $", "")
    whole = docs.select(base.row_key().alias("key"), "doc_id", plain.alias("plain")).select(
        "key", "doc_id", F.when(F.col("plain") == "", 0).otherwise(F.length("plain") - F.length(F.replace("plain", F.lit(" "), F.lit(""))) + 1).cast("long").alias("n_words"),
        F.sha2("plain", 256).alias("sha256"),
    )
    return whole.join(found, "key", "left").select("doc_id", "n_words", F.coalesce("n_removed", F.lit(0)).alias("n_removed"), F.coalesce("cut_sha256", "sha256").alias("kept_sha256"))


@base.query("op5_block_repeats")
def op5_block_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_passage_report(base.table(spark, sf_dir, "documents"))
