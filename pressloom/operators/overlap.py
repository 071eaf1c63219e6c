"""Pairs of word sets with enough words in common, counted block by block.

Frequent words bring most queries and most rows of an index together, so a join on words makes a row for nearly every pair. Here queries
and index rows are dealt to blocks by their numbers, and every block of queries meets every block of the index in a cell. A task holds
the index block of its cell as postings, the queries stream past, and all counts of a query are one histogram of its words' postings: a
pair that shares too little is never a row. Where only the best rows are asked for, only the best of each cell leave the task. A pair can
leave with what is to be told of both sides, so that the pairs, which may be many, are not joined and shuffled again.

No pair is left out; words are compared by 64-bit hashes. The words counted still grow with queries times index rows, a few nanoseconds
each; rows, shuffle and memory do not, but for the pairs that are asked for.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from pressloom.session import cut_lineage

#: Rows of an index block, queries of a query block, cells at least (for work to deal out), pairs that leave a task at once.
BLOCK, QUERIES, CELLS, AT_ONCE = 1 << 18, 1 << 17, 32, 1 << 18

def numbered(rows: DataFrame, name: str, *order: Column) -> DataFrame:
    """``rows`` with a whole number, rising in ``order`` where one is given; written, so that it stays."""
    dealt = cut_lineage(rows).repartitionByRange(*order).sortWithinPartitions(*order) if order else rows  # ranges are found in a pass of their own
    return cut_lineage(dealt.withColumn(name, F.monotonically_increasing_id()))


def _hashed(rows: DataFrame, name: str) -> Column:
    kind = rows.schema[name].dataType
    words = F.coalesce(F.col(name), F.array().cast(kind))
    return words if kind.elementType == LongType() else F.transform(words, lambda w: F.xxhash64(w))


def shared_words(
    queries: DataFrame, index: DataFrame, per_key: int | None = None, limit: int | None = None, told: tuple[list[str], list[str]] | None = None, first_of_key: bool = False,
    blocks: int | None = None,
) -> DataFrame:
    """(q, o, shared) for the pairs with at least ``needed`` words in common.

    ``queries``: q (long), words, needed, and where a part of the words is enough by itself also few and few_needed; a pair counts by either.
    ``index``: o (long, rising in the order of preference), words, and key where ``per_key`` or ``first_of_key`` is given. Words are distinct in
    their array. Pairs without a common word never count. With ``per_key`` only so many rows of each key, and with ``limit`` so many of all keys,
    leave each cell: those with most words in common, then the smallest o. The best of all rows are among them. With ``first_of_key`` a key
    stands for its matching row of the smallest o, whatever the others have in common, and lies in one block.

    ``told``: columns of the queries and of the index that come with each pair, in place of q and o, so that pairs need not be joined again.
    ``blocks``: into how many the index is dealt; then its rows, which may be long, come once and all queries pass each block.
    Words that are whole numbers already are not hashed; a word that a query names twice counts twice.
    Where the index has ``ahead`` (an array of flags) and the queries ``sense``, rows whose flag of that place is set rank before all others.
    """
    none = F.array().cast("array<long>")
    few = [_hashed(queries, "few"), F.col("few_needed").cast("int")] if "few" in queries.columns else [none, F.lit(0)]
    sense = F.col("sense").cast("int") if "sense" in queries.columns else F.lit(0)
    ahead = F.col("ahead") if "ahead" in index.columns else F.array().cast("array<boolean>")
    with_queries, with_index = told or (["q"], ["o"])
    q_told, o_told = ([df.schema[c] for c in names] for df, names in ((queries, with_queries), (index, with_index)))
    kinds = [f"struct<{','.join(f'`{f.name}`:{f.dataType.simpleString()}' for f in fields)}>" for fields in (q_told, o_told)]
    asked = queries.select(
        F.col("q").alias("n"), _hashed(queries, "words").alias("words"), F.col("needed").cast("int"), few[0].alias("few"), few[1].alias("few_needed"), F.lit(None).cast("string").alias("key"),
        sense.alias("sense"), F.lit(None).cast("array<boolean>").alias("ahead"), F.struct(*with_queries).alias("q_told"), F.lit(None).cast(kinds[1]).alias("o_told"),
    )
    key = F.col("key").cast("string") if per_key or first_of_key else F.lit(None).cast("string")
    held = index.select(
        F.col("o").alias("n"), _hashed(index, "words").alias("words"), F.lit(0).alias("needed"), none.alias("few"), F.lit(0).alias("few_needed"), key.alias("key"),
        F.lit(0).alias("sense"), ahead.alias("ahead"), F.lit(None).cast(kinds[0]).alias("q_told"), F.struct(*with_index).alias("o_told"),
    )
    across = blocks or max(1, -(-index.count() // BLOCK))
    down = 1 if blocks else max(1, -(-queries.count() // QUERIES), -(-CELLS // across))
    of = lambda n, salt, by="n": F.pmod(F.xxhash64(F.col(by), F.lit(salt)), F.lit(n)).cast("int")
    to_rows = held.withColumn("__row", of(across, 1, "key" if first_of_key else "n")).withColumn("__column", F.explode(F.sequence(F.lit(0), F.lit(down - 1)))).withColumn("side", F.lit(0))
    to_columns = asked.withColumn("__row", F.explode(F.sequence(F.lit(0), F.lit(across - 1)))).withColumn("__column", of(down, 2)).withColumn("side", F.lit(1))
    cells = to_rows.unionByName(to_columns).withColumn("cell", (F.col("__row") * down + F.col("__column")).cast("int")).drop("__row", "__column")
    dealt = cells.repartitionById(across * down, "cell").sortWithinPartitions("cell", "side", "n")
    found = StructType([StructField(f.name, f.dataType) for f in (*q_told, *o_told)] + [StructField("shared", IntegerType())])
    ordered = dealt.select("cell", "side", "n", "words", "needed", "few", "few_needed", "key", "sense", "ahead", "q_told", "o_told")
    return ordered.mapInArrow(_counting(per_key, limit, first_of_key), found)


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, pa.RecordBatch]]:
    """(cell, side, rows) in the order in which they come."""
    for batch in batches:
        cell, side = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        cuts = np.flatnonzero((np.diff(cell) != 0) | (np.diff(side) != 0)) + 1
        for start, end in pairwise([0, *cuts.tolist(), len(cell)]):
            if end > start:
                yield int(cell[start]), int(side[start]), batch.slice(start, end - start)


def _lists(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """The values of all lists, and where each list ends."""
    return column.flatten().to_numpy(), np.cumsum(column.value_lengths().to_numpy())


class _Postings:
    """An index block: for each word the places of its rows, smallest o first."""

    def __init__(self, parts: list[pa.RecordBatch]):
        rows = pa.Table.from_batches(parts).combine_chunks()
        self.o = rows.column("n").to_numpy()
        words, ends = _lists(rows.column("words").chunk(0))
        order = np.argsort(words, kind="stable")
        self.words, starts = np.unique(words[order], return_index=True)
        self.bounds = np.append(starts, len(words))
        self.places = np.repeat(np.arange(len(self.o)), np.diff(ends, prepend=0))[order]
        self.key = rows.column("key").chunk(0).dictionary_encode().indices.fill_null(-1).to_numpy()
        self.repeated = len(np.unique(self.key)) < len(self.key)
        self.told = rows.column("o_told").chunk(0)
        flags = rows.column("ahead").chunk(0)
        most = pc.max(flags.value_lengths()).as_py() or 0
        self.ahead = flags.flatten().fill_null(False).to_numpy(zero_copy_only=False).reshape(-1, most).T if most else None

    def known(self, column: pa.ListArray) -> list[np.ndarray]:
        """For each list the numbers of its words that are in the block."""
        flat, ends = _lists(column)
        if not len(self.words):
            return [flat[:0]] * len(ends)
        at = np.minimum(np.searchsorted(self.words, flat), len(self.words) - 1)
        here = self.words[at] == flat
        return np.split(at[here], np.append(0, np.cumsum(here))[ends[:-1]])

    def counts(self, words: np.ndarray) -> np.ndarray:
        """How many of the words each row has."""
        met = [self.places[self.bounds[w] : self.bounds[w + 1]] for w in words]
        return np.bincount(np.concatenate(met), minlength=len(self.o)) if met else np.zeros(len(self.o), int)


def _best(rows: np.ndarray, shared: np.ndarray, keys: np.ndarray, per_key: int, limit: int | None) -> np.ndarray:
    """Places in ``rows`` of the best, at most ``per_key`` of a key and ``limit`` in all."""
    order = np.lexsort((rows, -shared))
    by_key = np.argsort(keys[order], kind="stable")
    begins = np.flatnonzero(np.diff(keys[order][by_key], prepend=-2))
    place = np.empty(len(order), int)
    place[by_key] = np.arange(len(order)) - np.repeat(begins, np.diff(np.append(begins, len(order))))
    return order[place < per_key][:limit]


def _chosen(rows: np.ndarray, shared: np.ndarray, key: np.ndarray, per_key: int, limit: int | None) -> np.ndarray:
    """The best of ``rows``; with a limit, from the highest counts down as far as it takes."""
    if limit is None or len(rows) <= 8 * limit:
        return _best(rows, shared, key[rows], per_key, limit)
    above = np.cumsum(np.bincount(shared)[::-1])[::-1]  # rows with so many words or more
    wanted = limit
    while True:
        level = np.flatnonzero(above >= wanted)
        high = np.flatnonzero(shared >= (level[-1] if len(level) else 0))
        kept = high[_best(rows[high], shared[high], key[rows[high]], per_key, limit)]
        if len(kept) >= limit or len(high) == len(rows):
            return kept
        wanted = 8 * len(high)


def _told(part: pa.RecordBatch, index: _Postings, found: list[tuple[int, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    """The pairs of some queries, with what is told of both."""
    places = np.repeat([i for i, _, _ in found], [len(rows) for _, rows, _ in found])
    sides = part.column("q_told").take(pa.array(places)), index.told.take(pa.array(np.concatenate([rows for _, rows, _ in found])))
    names = [f.name for side in sides for f in side.type]
    shared = pa.array(np.concatenate([shared for _, _, shared in found]), pa.int32())
    return pa.RecordBatch.from_arrays([*sides[0].flatten(), *sides[1].flatten(), shared], [*names, "shared"])


def _counting(per_key: int | None, limit: int | None, first_of_key: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, waiting, index = None, [], None
        for at, side, part in _parts(batches):
            if at != cell:
                cell, waiting, index = at, [], None
            if side == 0:
                waiting.append(part)
                continue
            if not waiting and index is None:
                continue  # no row of the index is in this cell
            if index is None:
                index, waiting = _Postings(waiting), []
            found, size = [], 0
            needed, few_needed, senses = (part.column(c).to_numpy() for c in ("needed", "few_needed", "sense"))
            asked = zip(index.known(part.column("words")), needed, index.known(part.column("few")), few_needed, senses)
            for i, (words, least, few, few_least, sense) in enumerate(asked):
                by_few = 0 < few_least <= len(few)
                if len(words) < max(least, 1) and not by_few:
                    continue
                counts = index.counts(words)
                enough = counts >= max(least, 1)
                if by_few:
                    enough |= index.counts(few) >= few_least
                rows = np.flatnonzero(enough)
                if first_of_key and index.repeated:
                    rows = np.sort(rows[np.unique(index.key[rows], return_index=True)[1]])
                if per_key and len(rows):
                    rank = counts[rows] if index.ahead is None else counts[rows] + np.where(index.ahead[sense][rows], len(words) + 1, 0)
                    rows = rows[_chosen(rows, rank, index.key, per_key, limit)]
                if len(rows):
                    found.append((i, rows, counts[rows]))
                    size += len(rows)
                if size >= AT_ONCE:
                    yield _told(part, index, found)
                    found, size = [], 0
            if found:
                yield _told(part, index, found)

    return run
