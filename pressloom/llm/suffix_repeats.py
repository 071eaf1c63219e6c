"""Removal of repeated byte strings with suffix arrays, sorted in two stages.

Each task gets whole groups of segments that can share a window (``windows``) and builds one suffix array over them:
the suffixes smaller than their successors are sorted directly, all others follow from them by one scan over the buckets of first bytes,
and the common prefixes of neighbours then tell which windows occur again.

Defined results: a null text is empty; an empty text has nothing to remove; equal rows are separate documents and so repeat each other;
the choice does not depend on order, so ties cannot occur; ids may be null or repeat; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pressloom.llm import base
from pressloom.llm.hashing import buffer, ranges
from pressloom.llm.windows import Unit, covered, repeated_windows

LENGTH = 200
GRAM = 100


def _words_at(text: np.ndarray) -> np.ndarray:
    """The eight bytes from every position on, as one big-endian number."""
    padded = np.concatenate([text, np.zeros(8, np.uint8)])
    return np.ndarray(len(text), ">u8", padded.data, 0, (1,))


def _sort_directly(at: np.ndarray, eights: np.ndarray, depth: int) -> np.ndarray:
    """The given suffixes in order of their first ``depth`` bytes, by rounds of eight over those still tied."""
    key = eights[at].astype(np.uint64)
    order = np.argsort(key, kind="stable")
    at, key = at[order], key[order]
    group = np.cumsum(np.append(True, key[1:] != key[:-1])) if len(at) else at
    for done in range(8, depth, 8):
        alone = np.ones(len(at) + 1, bool)
        alone[1:-1] = group[1:] != group[:-1]
        tied = np.flatnonzero(~(alone[:-1] & alone[1:]))
        if not len(tied):
            break
        key = eights[np.minimum(at[tied] + done, len(eights) - 1)].astype(np.uint64)
        order = np.lexsort((key, group[tied]))
        at[tied], key, old = at[tied][order], key[order], group[tied]
        fresh = np.zeros(len(at), bool)
        fresh[tied[1:]] = (old[1:] == old[:-1]) & (key[1:] != key[:-1])
        group = group + np.cumsum(fresh)
    return at


def suffix_array(text: np.ndarray, wanted: np.ndarray, depth: int) -> np.ndarray:
    """Order of the wanted suffixes by their first ``depth`` bytes at least.

    ``text`` holds values from 1 on, and a 0 after every segment. A wanted suffix that is larger than its successor needs that successor
    in the order too; the run of those up to the next suffix of the other kind is added.
    """
    n = len(text)
    run_end = np.append(np.flatnonzero(text[1:] != text[:-1]), n - 1)
    end = run_end[np.searchsorted(run_end, np.arange(n))]
    following = np.append(text, 0).astype(np.int16)
    smaller = following[end] < following[end + 1]
    smaller[text == 0] = True
    # a suffix that needs its successor hands the need on, up to the next one that is sorted directly
    direct = np.flatnonzero(smaller)
    stop = direct[np.searchsorted(direct, np.flatnonzero(wanted))]
    need = wanted.copy()
    need[stop] = True
    larger = np.flatnonzero(wanted & ~smaller)
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, larger, 1)
    np.add.at(edge, direct[np.searchsorted(direct, larger)] + 1, -1)
    need |= np.cumsum(edge[:n]) > 0
    induced = need & ~smaller

    ordered = _sort_directly(np.flatnonzero(need & smaller), _words_at(text), depth)
    by_first = np.split(ordered, np.searchsorted(text[ordered], np.arange(1, 256)))
    waiting: list[list[np.ndarray]] = [[] for _ in range(256)]
    out = []
    for c in np.flatnonzero(np.bincount(text[need], minlength=256)):
        front = np.concatenate(waiting[c]) if waiting[c] else ordered[:0]
        bucket = []
        while len(front):
            bucket.append(front)
            before = front - 1
            front = before[induced[before] & (text[before] == c)]
        bucket.append(by_first[c])
        whole = np.concatenate(bucket)
        out.append(whole)
        before = whole - 1
        before = before[(before >= 0) & induced[before]]
        before = before[text[before] > c]
        before = before[np.argsort(text[before], kind="stable")]
        first = text[before]
        cuts = np.flatnonzero(first[1:] != first[:-1]) + 1
        for part in np.split(before, cuts):
            if len(part):
                waiting[text[part[0]]].append(part)
    return np.concatenate(out) if out else ordered


def common_prefixes(text: np.ndarray, order: np.ndarray, most: int) -> np.ndarray:
    """Common prefix of each suffix with the one before it, in steps of eight bytes, ``most`` if at least so long."""
    eights = _words_at(text)
    found = np.zeros(len(order), np.int64)
    left = np.arange(1, len(order))
    for done in [*range(0, most - 7, 8)] + ([most - 8] if most % 8 else []):
        a, b = order[left - 1] + done, order[left] + done
        inside = np.maximum(a, b) < len(text)
        left, a, b = left[inside], a[inside], b[inside]
        left = left[eights[a] == eights[b]]
        found[left] = min(done + 8, most)
    return found


def repeats_by_suffix_array(contents: list[np.ndarray], least: np.ndarray, weight: np.ndarray, order: np.ndarray, size: int = LENGTH):
    """Solver for ``repeated_windows``: segments of bytes -> runs of windows that occur more than once."""
    lengths = np.array([len(c) for c in contents])
    starts = np.cumsum(lengths + 1) - (lengths + 1)
    text = np.zeros(int(starts[-1] + lengths[-1] + 1), np.uint8)
    text[ranges(starts, lengths)] = np.concatenate(contents) + 1  # UTF-8 has no byte 255
    windows = lengths - size + 1
    wanted = np.zeros(len(text), bool)
    wanted[ranges(starts, windows)] = True
    array = suffix_array(text, wanted, size)
    array = array[wanted[array]]
    twice = common_prefixes(text, array, size) >= size
    again = np.zeros(len(text), bool)
    again[array[twice]] = True
    again[array[np.flatnonzero(twice) - 1]] = True
    heavy = weight > 1
    again[ranges(starts[heavy], windows[heavy])] = True
    at = np.flatnonzero(again)
    first = np.flatnonzero(np.append(True, at[1:] != at[:-1] + 1)) if len(at) else at
    which = np.searchsorted(starts, at[first], "right") - 1
    count = np.diff(np.append(first, len(at)))
    return which, at[first] - starts[which], count, np.zeros(len(first), np.int64)


BYTES = Unit("byte", LENGTH, GRAM, many=4096)


def repeated_bytes(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text) -> key, text, starts, counts of the documents that hold repeated windows."""
    held, spans = repeated_windows(docs, BYTES, F.lit(0), repeats_by_suffix_array)
    lists = spans.groupBy("key").agg(F.collect_set(F.struct("start", "n")).alias("spans"))  # equal rows bring equal spans
    return held.join(lists.hint("shuffle_hash"), "key").select("key", "text", F.col("spans.start").alias("starts"), F.col("spans.n").alias("counts"))


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = buffer(batch.column(1))
        removed, runs, digest = [], [], []
        for i, (starts, counts) in enumerate(zip(batch.column(2), batch.column(3), strict=True)):
            own = data[offsets[i] : offsets[i + 1]]
            gone = covered(len(own), starts.values.to_numpy(), counts.values.to_numpy(), LENGTH)
            removed.append(int(gone.sum()))
            runs.append(int((gone[1:] & ~gone[:-1]).sum()) + bool(len(gone) and gone[0]))
            digest.append(hashlib.sha256(own[~gone].tobytes()).hexdigest())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(removed, pa.int64()), pa.array(runs, pa.int64()), pa.array(digest, pa.string())], ["key", "n_removed", "n_spans", "cut_sha256"])


def _cut_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = buffer(batch.column(1))
        cut = []
        for i, (starts, counts) in enumerate(zip(batch.column(2), batch.column(3), strict=True)):
            own = data[offsets[i] : offsets[i + 1]]
            gone = covered(len(own), starts.values.to_numpy(), counts.values.to_numpy(), LENGTH)
            # a character stays whole: it goes only if all of its bytes go
            first = np.flatnonzero((own & 0xC0) != 0x80)
            keep = ~np.logical_and.reduceat(gone, first) if len(first) else gone[:0]
            cut.append(own[np.repeat(keep, np.diff(np.append(first, len(own))))].tobytes().decode("utf-8", "replace"))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(cut, pa.string())], ["key", "cut"])


def remove_repeated_bytes(docs: DataFrame) -> DataFrame:
    """``docs`` with every repeated ``LENGTH``-byte string cut out of its texts; same rows and columns, null texts stay null.

    A character of several bytes goes only if all its bytes are repeated.
    """
    cut = repeated_bytes(base.texts(docs)).mapInArrow(_cut_texts, "key long, cut string")
    key = F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.coalesce("text", F.lit("")))
    marked = docs.select(key.alias("__key"), *[F.col(f"`{c}`") for c in docs.columns])
    joined = marked.join(cut.withColumnRenamed("key", "__key").withColumnRenamed("cut", "__cut"), "__key", "left")
    return joined.select(*[F.coalesce("__cut", "text").alias("text") if c == "text" else F.col(f"`{c}`") for c in docs.columns])


def repeated_byte_report(docs: DataFrame) -> DataFrame:
    """Per document: bytes, bytes removed, maximal removed runs, SHA-256 of what is left."""
    docs = base.texts(docs)
    found = repeated_bytes(docs).mapInArrow(_digests, "key long, n_removed long, n_spans long, cut_sha256 string")
    whole = docs.select(base.row_key().alias("key"), "doc_id", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2(F.col("text").cast("binary"), 256).alias("sha256"))
    return whole.join(found, "key", "left").select(
        "doc_id", "n_bytes", F.coalesce("n_removed", F.lit(0)).alias("n_removed"), F.coalesce("n_spans", F.lit(0)).alias("n_spans"),
        F.coalesce("cut_sha256", "sha256").alias("kept_sha256"),
    )


@base.query("op6_suffix_repeats")
def op6_suffix_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_byte_report(base.table(spark, sf_dir, "documents"))
