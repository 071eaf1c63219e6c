"""Finds windows of a fixed length that occur more than once, so that equal windows meet in one task.

Every window of ``size`` units (bytes or words) has a key: the least hash among its runs of ``gram`` units. Equal windows have equal keys.
Consecutive windows with one key form a segment, and only segments whose key occurs again can hold a repeated window. Equal segments are
folded into one, with its weight and the least order value of its documents, before anything is compared. The distinct segments of a key then go to
a solver, which the operator brings. Keys with more distinct segments than the unit's ``many`` (a common line amid many texts) don't go to a
solver as one group: their segments are cut into single windows, which meet by their own hash.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pressloom.llm.base import row_key
from pressloom.llm.hashing import BYTE_VALUES, Prefix, buffer, chunks, ranges, sliding_min, words
from pressloom.session import cut_lineage

@dataclass(frozen=True)
class Unit:
    """What a window consists of: bytes or words."""

    name: str
    size: int
    gram: int
    #: Distinct segments of one key that a solver gets as a group. It decides the way only, never the result.
    many: int

    def values(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if self.name == "byte":
            return BYTE_VALUES[data], offsets
        _, _, hashes, bounds = words(data, offsets)
        return hashes, bounds

    def decode(self, content: bytes) -> np.ndarray:
        return np.frombuffer(content, np.uint8 if self.name == "byte" else np.uint64)

    def numbers(self, content: np.ndarray) -> np.ndarray:
        return BYTE_VALUES[content] if self.name == "byte" else content


def segments(values: np.ndarray, offsets: np.ndarray, unit: Unit):
    """(text, start within the text, windows, key, digest, key's places) of all segments of consecutive texts.

    The last is 2 where the key's run of units lies in the segment twice, so that its own windows can be equal, and else 1.
    """
    size, reach = unit.size, unit.size - unit.gram + 1
    n = len(values) - size + 1
    if n <= 0:
        none = np.zeros(0, np.int64)
        return none, none, none, np.zeros(0, np.uint64), np.zeros(0, np.uint64), none
    prefix = Prefix(values)
    grams = prefix.grams(unit.gram)
    least = sliding_min(grams, reach)
    long = np.flatnonzero(np.diff(offsets) >= size)
    edge = np.zeros(n + 1, np.int8)
    edge[offsets[long]] += 1
    edge[offsets[long + 1] - size + 1] -= 1
    inside = np.cumsum(edge[:n]).astype(bool)
    new = inside.copy()
    new[1:] &= (least[1:] != least[:-1]) | ~inside[:-1] | (edge[1:n] > 0)
    new[offsets[long]] = True
    start = np.flatnonzero(new)
    beside = np.full(reach - 1, ~np.uint64(0))
    places = np.flatnonzero(grams == ~sliding_min(np.concatenate([beside, ~least, beside]), reach))
    twice = places[:-1][(grams[places[1:]] == grams[places[:-1]]) & (np.diff(places) < reach)]
    twice = twice[twice + 1 < n]
    twice = twice[inside[twice] & inside[twice + 1] & ~new[twice + 1]]
    found = np.ones(len(start), np.int32)
    found[np.searchsorted(start, twice, "right") - 1] = 2
    text = np.searchsorted(offsets, start, "right") - 1
    limit = offsets[text + 1] - size + 1
    count = np.minimum(np.append(start[1:], n), limit) - start
    parts = -(-count // reach)  # more than one only where a text repeats itself within a window
    if (parts > 1).any():
        whole, step = np.repeat(np.arange(len(start)), parts), ranges(np.zeros(len(parts), np.int64), parts)
        start, text, found = start[whole] + step * reach, text[whole], found[whole]
        count = np.minimum(count[whole] - step * reach, reach)
    digest = prefix.slices(start, start + count + size - 1)
    return text, start - offsets[text], count, least[start], digest, found


def _rows_of(unit: Unit) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, order = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            data, offsets = buffer(batch.column(2))
            for a, b in chunks(offsets):
                values, bounds = unit.values(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                text, start, count, least, digest, found = segments(values, bounds, unit)
                columns = [least.view(np.int64), digest.view(np.int64), keys[a + text], order[a + text], start.astype(np.int32), count.astype(np.int32), found.astype(np.int32)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["least", "digest", "key", "ord", "start", "n", "places"])

    return scan


def _contents_of(unit: Unit) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = buffer(batch.column(0))
            out: list[tuple] = []
            for i, wanted in enumerate(batch.column(1)):
                own = data[offsets[i] : offsets[i + 1]]
                values = own if unit.name == "byte" else words(own, np.array([0, len(own)]))[2]
                for w in wanted.as_py():
                    out.append((w["least"], w["digest"], w["weight"], w["ord"], w["many"], values[w["start"] : w["start"] + w["n"] + unit.size - 1].tobytes()))
                if len(out) > 4096:
                    yield _content_batch(out)
                    out = []
            yield _content_batch(out)

    return cut


_CONTENT = pa.schema([("least", pa.int64()), ("digest", pa.int64()), ("weight", pa.int64()), ("ord", pa.int64()), ("many", pa.bool_()), ("content", pa.binary())])


def _content_batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(_CONTENT)], schema=_CONTENT)


def _solving(unit: Unit, solver: Callable, most: int = 1 << 20) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Feeds whole groups of a key to the solver, about ``most`` bytes at once; the rows arrive sorted by key and digest."""

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0
        for batch in batches:
            for row in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                if held and held[-1][:2] == row[:2]:  # the same segment, taken twice from equal rows
                    continue
                if size > most and held[-1][0] != row[0]:
                    yield answer(held)
                    held, size = [], 0
                held.append(row)
                size += len(row[4])
        if held:
            yield answer(held)

    def answer(rows: list[tuple]) -> pa.RecordBatch:
        which, start, count, best = solver([unit.decode(r[4]) for r in rows], *(np.array([r[i] for r in rows], np.int64) for i in (0, 2, 3)))
        least, digest = (np.array([r[i] for r in rows], np.int64)[which] for i in (0, 1))
        return pa.RecordBatch.from_arrays([pa.array(c) for c in (least, digest, start.astype(np.int32), count.astype(np.int32), best)], ["least", "digest", "s", "n", "best"])

    return solve


def _single_windows(unit: Unit) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, 1024):
                part = batch.slice(first, 1024)
                least, digest, weight, order = (part.column(i).to_numpy() for i in range(4))
                contents = [unit.decode(c.as_py()) for c in part.column(4)]
                lengths = np.array([len(c) for c in contents])
                prefix = Prefix(unit.numbers(np.concatenate(contents)))
                counts = lengths - unit.size + 1
                at = ranges(np.cumsum(lengths) - lengths, counts)
                which = np.repeat(np.arange(len(contents)), counts)
                window = prefix.slices(at, at + unit.size).view(np.int64)
                off = ranges(np.zeros(len(counts), np.int64), counts).astype(np.int32)
                columns = [least[which], digest[which], off, window, weight[which], order[which]]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["least", "digest", "s", "window", "weight", "ord"])

    return cut


def repeated_windows(docs: DataFrame, unit: Unit, order: F.Column, solver: Callable) -> tuple[DataFrame, DataFrame]:
    """``docs`` (doc_id, text without nulls) -> (the distinct documents that may hold a repeated window: key, doc_id, text; their spans: key, start, n, best).

    A span says that the n windows from unit ``start`` of the document on occur more than once; ``best`` is the least order value among the
    documents that hold them, itself included. ``solver(contents, least, weight, ord)`` gets distinct segments and returns
    (which, start, count, best) of their repeated windows.
    """
    keyed = docs.select(row_key().alias("key"), order.cast("long").alias("ord"), "doc_id", "text")
    rows = keyed.select("key", "ord", "text").mapInArrow(_rows_of(unit), "least long, digest long, key long, ord long, start int, n int, places int")
    again = rows.groupBy("least").agg(F.sum("places").alias("total")).where("total > 1").select("least")
    shared = cut_lineage(rows.drop("places").join(again, "least"))

    folded = shared.groupBy("least", "digest").agg(F.count("*").alias("weight"), F.min("ord").alias("ord"), F.min("key").alias("key"))
    kinds = folded.groupBy("least").agg((F.count("*") > unit.many).alias("many"))
    chosen = folded.join(kinds, "least")
    place = shared.groupBy("least", "digest", "key").agg(F.min("start").alias("start"), F.min("n").alias("n"))
    wanted = chosen.join(place, ["least", "digest", "key"]).groupBy("key").agg(F.collect_list(F.struct("least", "digest", "weight", "ord", "many", "start", "n")).alias("wanted"))

    held = cut_lineage(keyed.join(shared.select("key").distinct().hint("shuffle_hash"), "key", "left_semi").select("key", "doc_id", "text").dropDuplicates(["key"]))
    contents = cut_lineage(
        held.join(wanted.hint("shuffle_hash"), "key").select("text", "wanted")
        .mapInArrow(_contents_of(unit), "least long, digest long, weight long, ord long, many boolean, content binary")
    )
    few = (
        contents.where("not many").select("least", "digest", "weight", "ord", "content").repartition("least").sortWithinPartitions("least", "digest")
        .mapInArrow(_solving(unit, solver), "least long, digest long, s int, n int, best long")
    )
    single = (
        contents.where("many").select("least", "digest", "weight", "ord", "content")
        .mapInArrow(_single_windows(unit), "least long, digest long, s int, window long, weight long, ord long")
        .groupBy("least", "digest", "s", "window").agg(F.max("weight").alias("weight"), F.min("ord").alias("ord"))
    )
    met = single.groupBy("least", "window").agg(F.sum("weight").alias("total"), F.min("ord").alias("best")).where("total > 1")
    many = single.join(met, ["least", "window"]).select("least", "digest", "s", F.lit(1).alias("n"), "best")
    spans = (
        shared.select("least", "digest", "key", "ord", "start").join(few.unionByName(many), ["least", "digest"])
        .select("key", "ord", (F.col("start") + F.col("s")).alias("start"), "n", "best")
    )
    return held, spans


def covered(length: int, starts: np.ndarray, counts: np.ndarray, size: int) -> np.ndarray:
    """Which units of a text lie in one of the windows."""
    edge = np.zeros(length + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + counts - 1 + size, -1)
    return np.cumsum(edge[:length]) > 0
