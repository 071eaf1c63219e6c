"""Brown class-based language model: exchange clustering, then log10 P(text) = sum of log10 P(class | class before) + log10 P(word | class).

Tokens are lower-cased words and one end a text. Words are known by hashes of 64 bits, so a model is a few arrays. The counts of all words
of the training texts are a table. The ``HELD`` most frequent words (at most; all of a frequency or none) with ``LEAST`` occurrences or
more are clustered; any other word belongs to one of ``ENDINGS`` groups by its last bytes, and each group is clustered like a word.
Exchange: the tasks count how often each word meets each class before and after it, over the whole training corpus. Of the most frequent
``CLUSTERED`` words and the groups, every one in turn moves to the class that raises the likelihood of the class bigrams most; then the
tasks move each other word so, against the class bigrams counted anew. The two steps take turns until neither raises the classes'
mutual information by the share ``STILL``; a step that lowers it is undone. Counts in the driver are bounded by the model's size.

Smoothing: a class transition mixes with the class's own frequency (``PRIOR`` pseudo-counts); a word's share of its class has ``ADD`` added,
and each class keeps the share of one unseen word. So the probabilities of all words after any word sum to at most one.

The counts of the held words go to the tasks; all others' counts come by a join.

Defined results: a null or empty text is one end; texts are scored whole; equal rows get equal scores; ties in frequency go by the hash;
with nothing to learn from, scores are those of the smoothing alone; ids may be null (their remainder is that of the text 'null') or
repeat; other columns are not read. Two words of one hash would count as one word.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pressloom.llm import base
from pressloom.llm.hashing import buffer, chunks, mix, words
from pressloom.session import cut_lineage

CLUSTERED, ENDINGS, CLASSES, STILL = 4096, 512, 64, 2e-3
HELD = 1 << 18
LEAST = 3  # occurrences from which a word after the first CLUSTERED has a class of its own choice
ADD, PRIOR = 0.1, 20.0
END = CLUSTERED + ENDINGS  # the number of the end among the clustered units; it has a class of its own
UNITS = END + 1  # the held words after the first CLUSTERED have the numbers from here on
ALL = CLASSES + 1
CONTEXTS, WORDS = 1 << 20, 4096  # of a bucket of words that one row holds, about
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def tokens(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each million bytes of whole texts: the words' hashes, the groups of their endings, and the texts' offsets among the words."""
    data, offsets = buffer(column)
    for first, last in chunks(offsets):
        own = offsets[first : last + 1]
        part = LOWER[data[own[0] : own[-1]]]
        starts, ends, hashes, at = words(part, own - own[0])
        tail = np.zeros(len(starts), np.uint64)
        for back in (1, 2, 3):
            place = ends - back
            tail = tail << np.uint64(8) | np.where(place >= starts, part[np.maximum(place, 0)] if len(part) else 0, 0).astype(np.uint64)
        yield hashes, CLUSTERED + (mix(tail + np.uint64(1)) % np.uint64(ENDINGS)).astype(np.int64), at


def word_counts(docs: DataFrame) -> DataFrame:
    """``docs`` (text) -> hash, ending, n of all words of all texts; a task adds up a few million words at a time before they are dealt."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def added() -> pa.RecordBatch:
            hashes, endings = (np.concatenate(x) for x in zip(*held))
            key, first, times = np.unique(hashes, return_index=True, return_counts=True)
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(endings[first], pa.int32()), pa.array(times, pa.int64())], ["hash", "ending", "n"])

        for batch in batches:
            for hashes, endings, _ in tokens(batch.column(0)):
                held.append((hashes, endings))
                n += len(hashes)
                if n > 1 << 21:
                    yield added()
                    n = 0
        if held:
            yield added()

    return docs.select("text").mapInArrow(count, "hash long, ending int, n long").groupBy("hash").agg(F.min("ending").alias("ending"), F.sum("n").alias("n"))


def frequent_words(counts: DataFrame, most: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes, counts and endings of the words of all frequencies so high that no more than ``most`` (``HELD``) words have them, by frequency and hash."""
    by_count = counts.groupBy(F.least("n", F.lit(1 << 20)).alias("n")).agg(F.count("*").alias("words")).orderBy(F.desc("n"))
    least, held = 1 << 62, 0
    for row in by_count.toLocalIterator():
        held += row["words"]
        if held > (most or HELD):
            break
        least = row["n"]
    rows = counts.where(F.col("n") >= least).toArrow()  # at most ``most`` rows of three numbers
    key, n, endings = (rows.column(c).to_numpy() for c in ("hash", "n", "ending"))
    order = np.lexsort((key, -n))
    return key[order].view(np.uint64), n[order], endings[order]


class Places:
    """Hashes of held words -> their places by frequency, -1 for any other word."""

    def __init__(self, keys: np.ndarray):
        self.order = np.argsort(keys).astype(np.int32)
        self.keys = keys[self.order]

    def __len__(self) -> int:
        return len(self.keys)

    def __call__(self, hashes: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return np.full(len(hashes), -1)
        at = np.minimum(np.searchsorted(self.keys, hashes), len(self.keys) - 1)
        return np.where(self.keys[at] == hashes, self.order[at], -1).astype(np.int64)


def unit_of(at: np.ndarray) -> np.ndarray:
    """Places among the held words -> units."""
    return at + (at >= CLUSTERED) * (ENDINGS + 1)


def _sequences(held) -> object:
    """Texts -> one row for each batch of about a million tokens: the units, ends included."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = held.value
        units, n = [np.array([END])], 1

        def row() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([np.concatenate(units).astype(np.uint32).tobytes()], pa.binary())], ["units"])

        for batch in batches:
            for hashes, endings, at in tokens(batch.column(0)):
                own = place(hashes)
                units.append(np.insert(np.where(own < 0, endings, unit_of(own)), at[1:], END))
                n += len(units[-1])
                if n > 1 << 20:
                    yield row()
                    units, n = [np.array([END])], 1
        if n > 1:
            yield row()

    return scan


def _meetings(held) -> object:
    """Units -> (cell, n): cell = (row * 2 + side) * ALL + class; side 0 counts the class before the unit, side 1 the class after it.
    Rows are the units below UNITS, then one for each class, of all its other words."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = held.value
        row = np.append(np.arange(UNITS), UNITS + of[UNITS:])
        total = np.zeros((UNITS + ALL) * 2 * ALL, np.int64)
        for batch in batches:
            for units in batch.column(0):
                unit = np.frombuffer(units.as_py(), np.uint32).astype(np.int64)
                cls, own = of[unit], row[unit]
                total += np.bincount(own[1:] * 2 * ALL + cls[:-1], minlength=len(total))
                total += np.bincount((own[:-1] * 2 + 1) * ALL + cls[1:], minlength=len(total))
        cell = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(total[cell])], ["cell", "n"])

    return scan


def meetings(sequences: DataFrame, of: np.ndarray) -> np.ndarray:
    """rows x 2 x classes: how often each unit meets each class; at most (UNITS + ALL) * 2 * ALL numbers reach the driver."""
    held = sequences.sparkSession.sparkContext.broadcast(of)
    found = sequences.mapInArrow(_meetings(held), "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toPandas()
    held.destroy()
    out = np.zeros((UNITS + ALL) * 2 * ALL)
    out[found["cell"].to_numpy(np.int64)] = found["n"].to_numpy(float)
    return out.reshape(UNITS + ALL, 2, ALL)


def _contexts(buckets: int) -> object:
    """Units -> bucket, contexts of the held words after the first CLUSTERED: (word * 2 + side) << 32 | neighbour."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for units in batch.column(0):
                unit = np.frombuffer(units.as_py(), np.uint32).astype(np.int64)
                at = np.flatnonzero(unit >= UNITS)  # an end stands at both edges, so each has two neighbours
                word = (unit[at] - UNITS) * 2
                key = np.concatenate([word << 32 | unit[at - 1], (word + 1) << 32 | unit[at + 1]])
                key, n = np.unique(key, return_counts=True)
                bucket = (key >> 33) % buckets
                order = np.argsort(bucket, kind="stable")
                own, first = np.unique(bucket[order], return_index=True)
                keys, times = (np.split(x[order], first[1:]) if len(own) else [] for x in (key, n.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([pa.array(own, pa.int64()), pa.array([k.tobytes() for k in keys], pa.binary()), pa.array([t.tobytes() for t in times], pa.binary())], ["bucket", "contexts", "times"])

    return scan


def _counted(rows: pa.Table) -> pa.Table:
    """One row for each bucket: its distinct contexts and their counts."""
    every = np.concatenate([np.frombuffer(x.as_py(), np.int64) for x in rows.column("contexts")])
    key, at = np.unique(every, return_inverse=True)
    n = np.bincount(at, np.concatenate([np.frombuffer(x.as_py(), np.int32) for x in rows.column("times")]), len(key))
    return pa.table({"contexts": pa.array([key.tobytes()], pa.binary()), "times": pa.array([n.astype(np.int64).tobytes()], pa.binary())})


def contexts(sequences: DataFrame, rest: int, tokens: int) -> DataFrame:
    """The contexts of the ``rest`` words after the first CLUSTERED, a row for each bucket of words; each of them is at most one of CLUSTERED tokens."""
    buckets = max(1, -(-2 * tokens // CONTEXTS), -(-rest // WORDS))
    dealt = sequences.mapInArrow(_contexts(buckets), "bucket long, contexts binary, times binary")
    return cut_lineage(dealt.groupBy("bucket").applyInArrow(_counted, "contexts binary, times binary"))


def best_classes(word: np.ndarray, side: np.ndarray, cls: np.ndarray, n: np.ndarray, own: np.ndarray, pairs: np.ndarray) -> np.ndarray:
    """For each of the words 0, 1, ..., in class ``own`` now: the class that raises the likelihood of the class bigrams most."""
    met = np.bincount((word * 2 + side) * ALL + cls, n, len(own) * 2 * ALL)
    total = np.bincount(word[side == 1], n[side == 1], len(own))[:, None]
    cell = np.flatnonzero(met)
    word, base, met = cell // (2 * ALL), np.concatenate([pairs, pairs.T]), met[cell][:, None]
    gain = np.zeros((len(own), ALL))
    for a in range(0, len(cell), 1 << 15):
        w, m = word[a : a + (1 << 15)], met[a : a + (1 << 15)]
        x = base[cell[a : a + (1 << 15)] % (2 * ALL)]
        at = np.arange(len(w)), own[w]
        x[at] = np.maximum(x[at] - m[:, 0], 0)  # without the word itself
        first = np.flatnonzero(np.append(True, w[1:] != w[:-1]))
        gain[w[first]] += np.add.reduceat(_xlogx(x + m) - _xlogx(x), first, axis=0)
    for sums in (pairs.sum(1), pairs.sum(0)):
        x = np.tile(sums, (len(own), 1))
        at = np.arange(len(own)), own
        x[at] = np.maximum(x[at] - total[:, 0], 0)
        gain -= _xlogx(x + total) - _xlogx(x)
    best = gain[:, :CLASSES].argmax(1)
    every = np.arange(len(own))
    return np.where(gain[every, best] > gain[every, own] + 1e-9, best, own)


def _moves(held) -> object:
    """Contexts -> unit, class of all words that move."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, pairs = held.value
        for batch in batches:
            for keys, times in zip(batch.column(0), batch.column(1), strict=True):
                key, n = np.frombuffer(keys.as_py(), np.int64), np.frombuffer(times.as_py(), np.int64)
                unit, word = np.unique((key >> 33) + UNITS, return_inverse=True)
                best = best_classes(word, (key >> 32) & 1, of[key & 0xFFFFFFFF], n, of[unit], pairs)
                moved = best != of[unit]
                yield pa.RecordBatch.from_arrays([pa.array(unit[moved]), pa.array(best[moved])], ["unit", "class"])

    return scan


def exchange_rest(found: DataFrame, of: np.ndarray, pairs: np.ndarray) -> np.ndarray:
    """Each held word after the first CLUSTERED moves to its best class; at most HELD rows reach the driver."""
    held = found.sparkSession.sparkContext.broadcast((of, pairs))
    moves = found.mapInArrow(_moves(held), "unit long, class long").toArrow()
    held.destroy()
    of = of.copy()
    of[moves.column("unit").to_numpy()] = moves.column("class").to_numpy()
    return of


def class_pairs(met: np.ndarray, of: np.ndarray) -> np.ndarray:
    pairs = np.zeros((ALL, ALL))
    np.add.at(pairs, np.append(of[:UNITS], np.arange(len(met) - UNITS)), met[:, 1])
    return pairs


def information(pairs: np.ndarray) -> float:
    """Mutual information of neighbouring classes, by the token: the part of the likelihood that the classes decide."""
    total = max(pairs.sum(), 1)
    return float((_xlogx(pairs).sum() - _xlogx(pairs.sum(0)).sum() - _xlogx(pairs.sum(1)).sum() + _xlogx(total)) / total)


def _xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1e-9))


def exchange(met: np.ndarray, of: np.ndarray) -> np.ndarray:
    """One round: each unit in turn moves to the class that raises the likelihood of the class bigrams most."""
    of = of.copy()
    pairs = class_pairs(met, of)
    for u in np.argsort(-met[:END].sum((1, 2)), kind="stable"):
        before, after = met[u]
        total = after.sum()
        if not total:
            continue
        own = of[u]
        pairs[own] -= after
        pairs[:, own] -= before
        np.maximum(pairs, 0, out=pairs)
        rows, cols = pairs.sum(1), pairs.sum(0)
        gain = (_xlogx(pairs + after) - _xlogx(pairs)).sum(1) + (_xlogx(pairs.T + before) - _xlogx(pairs.T)).sum(1)
        gain -= _xlogx(rows + total) - _xlogx(rows) + _xlogx(cols + total) - _xlogx(cols)
        best = int(gain[:CLASSES].argmax())
        own = best if gain[best] > gain[own] + 1e-9 else own
        of[u] = own
        pairs[own] += after
        pairs[:, own] += before
    return of


@dataclass(frozen=True)
class Model:
    place: Places  # held words, by frequency
    clustered: int  # of them have classes of their own choice
    count: np.ndarray  # of the held words
    of: np.ndarray  # class of each unit
    step: np.ndarray  # log10 P(class | class before)
    share: np.ndarray  # log10 of the divisor of a class's words
    total: int  # training tokens
    kinds: int  # distinct ones, with the end

    @property
    def divisor(self) -> float:
        return float(np.log10(self.total + ADD * (self.kinds + 1)))

    def classes(self, at: np.ndarray, endings: np.ndarray) -> np.ndarray:
        """Classes of words from their places among the held ones and their endings."""
        own = (at >= 0) & (at < self.clustered)
        return np.where(own, self.of[np.where(own, unit_of(at), 0)], self.of[endings])


def cluster(sequences: DataFrame, found: DataFrame | None, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The two steps in turn from ``of`` on, until each has failed once in a row -> classes, and their bigrams."""
    met = meetings(sequences, of)
    pairs = class_pairs(met, of)
    step = failed = 0
    while failed < (1 if found is None else 2):
        if found is None or step % 2 == 0:
            moved = np.append(exchange(met, of[:UNITS]), of[UNITS:])
        else:
            moved = exchange_rest(found, of, pairs)
        met_then = meetings(sequences, moved)
        then = class_pairs(met_then, moved)
        gain = information(then) - information(pairs)
        failed = 0 if gain > STILL * information(pairs) else failed + 1
        if gain > 0:
            of, met, pairs = moved, met_then, then
        step += 1
    return of, pairs


def learn(docs: DataFrame) -> tuple[Model, DataFrame]:
    """``docs`` (text without nulls) -> the model, and the table of all words' counts (hash, n)."""
    spark = docs.sparkSession
    counts = cut_lineage(word_counts(docs))
    texts = docs.count()
    kinds_all, total = counts.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    keys, count, endings = frequent_words(counts)
    clustered = max(min(CLUSTERED, len(keys)), int((count >= LEAST).sum()))
    rest = max(0, clustered - CLUSTERED)
    held = spark.sparkContext.broadcast(Places(keys[:clustered]))
    sequences = cut_lineage(docs.select("text").mapInArrow(_sequences(held), "units binary"))
    found = contexts(sequences, rest, int(count[CLUSTERED:clustered].sum())) if rest else None
    of = np.concatenate([np.arange(END) % CLASSES, [CLASSES], np.arange(rest) % CLASSES])
    of, pairs = cluster(sequences, found, of)
    own = pairs.sum(0) + 0.5
    step = np.log10((pairs + PRIOR * own / own.sum()) / (pairs.sum(1, keepdims=True) + PRIOR))
    size = pairs.sum(0)
    kinds = np.bincount(of[unit_of(np.arange(clustered))], minlength=ALL).astype(float)
    by_ending = np.zeros(END, np.int64)  # of the words without a choice of their own
    for e, k in counts.groupBy("ending").agg(F.count("*")).collect():
        by_ending[e] = k
    by_ending -= np.bincount(endings[:clustered], minlength=END)
    kinds += np.bincount(of[:END], by_ending, ALL)
    kinds[CLASSES] = texts > 0
    model = Model(Places(keys), clustered, count, of, step, np.log10(size + ADD * (kinds + 1)), int(total + texts), int(kinds_all + (texts > 0)))
    return model, counts.select("hash", "n")


_LOCAL = "key long, doc_id long, held_out boolean, n_tokens long, known long, steps double, shares double, logs double, rare array<long>, times array<long>"


def _scoring(held, ends: int) -> object:
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        logs = np.append(np.log10(m.count + ADD), 0.0)
        end = float(np.log10(ends + ADD))
        for batch in batches:
            out = []
            for hashes, endings, offsets in tokens(batch.column(3)):
                at = m.place(hashes)
                classes = np.insert(m.classes(at, endings), offsets[1:], CLASSES)
                before = np.append(CLASSES, classes[:-1])
                first = offsets + np.arange(len(offsets))  # of each text among the tokens, ends included
                sums = [np.add.reduceat(x, first[:-1]) for x in (m.step[before, classes], m.share[classes], np.insert(logs[at], offsets[1:], end), np.insert(at >= 0, offsets[1:], ends > 0).astype(np.int64))]
                for i, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist())):
                    rare, times = np.unique(hashes[a:b][at[a:b] < 0], return_counts=True)
                    out.append((b - a + 1, sums[3][i], sums[0][i], sums[1][i], sums[2][i], rare.view(np.int64), times))
            kinds = [pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64(), pa.list_(pa.int64()), pa.list_(pa.int64())]
            names = ["key", "doc_id", "held_out", "n_tokens", "known", "steps", "shares", "logs", "rare", "times"]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *[pa.array([r[i] for r in out], kind) for i, kind in enumerate(kinds)]], names)

    return scan


def score(docs: DataFrame, model: Model, counts: DataFrame, ends: int) -> DataFrame:
    """``docs`` (doc_id, held_out, text) -> the tokens and log10 probabilities of each text; ends: training texts."""
    spark = docs.sparkSession
    keyed = docs.select(base.row_key().alias("key"), "doc_id", "held_out", "text")
    local = keyed.mapInArrow(_scoring(spark.sparkContext.broadcast(model), ends), _LOCAL)
    rare = local.select("key", F.explode(F.arrays_zip("rare", "times")).alias("x")).select("key", F.col("x.rare").alias("hash"), F.col("x.times").alias("times"))
    log = F.log10(F.coalesce("n", F.lit(0)) + ADD)
    joined = rare.join(counts, "hash", "left").groupBy("key").agg(
        F.sum(F.col("times") * log).alias("rare_logs"), F.sum(F.when(F.col("n").isNotNull(), F.col("times")).otherwise(0)).alias("rare_known")
    )
    rows = local.drop("rare", "times")
    rows = rows.groupBy(*rows.columns).agg(F.count("*").alias("copies")).join(joined, "key", "left")  # equal rows share a key, and so their sums
    logs = F.col("logs") + F.coalesce("rare_logs", F.lit(0.0)) / F.col("copies")
    return rows.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).select(
        "doc_id", "held_out", "n_tokens", (F.col("known") + F.expr("coalesce(rare_known, 0) div copies")).alias("n_known"), F.lit(model.total).cast("long").alias("train_tokens"),
        (logs - F.col("n_tokens") * model.divisor).alias("base_score"), (F.col("steps") + logs - F.col("shares")).alias("score"),
    )


@base.query("op1_brown_classes")
def op1_brown_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = base.texts(base.table(spark, sf_dir, "documents")).withColumn("held_out", base.remainder(10) == 0)
    train = docs.where("not held_out")
    model, counts = learn(train)
    return score(docs, model, counts, train.count())
