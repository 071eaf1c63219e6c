"""Token counts by a tokenizer compiled into a deterministic transducer, whose chunk maps compose.

A sequence of pieces is the tokenizer's encoding if no two neighbours would have merged across their border. So a text read so far has
few *readings*: the place of the last border that may still hold, as a node of the trie of pieces (what was read since), the piece before
that border, and the number of pieces up to it. The set of readings is the state of a deterministic machine; its transitions are found
when they are first taken and carry the number of pieces that all readings of the next state share. The readings of a state differ in
their remaining counts alone, of which the one without an open piece is the count of the text as it stands.

A text of more than ``CHUNK`` characters is cut into chunks, and tasks anywhere read them without knowing the state before. A chunk's map
gives, for each reading that the characters before it allow, the readings it leads to and the pieces added; a state's image is the union
of its readings' images. Maps compose (``compose``), so a scan over the chunks of a text, 64 maps at a time and level by level, gives the
state before each chunk (``prefix_counts``) and the count of the whole (``count_tokens``).

Defined results: a null or empty text has no tokens; texts are read whole, whatever their length; equal rows get equal results; ids may
be null or repeat; other columns are left behind; characters outside the vocabulary count one token for each UTF-8 byte.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate
from operator import attrgetter, getitem

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pressloom.llm import base
from pressloom.session import cut_lineage

VOCABULARY = "piece_bpe_32k.model"
#: Tokens a document may have before it is marked.
LIMIT = 4096
#: Characters of a chunk, chunk maps composed at a time, and levels: 64 ** 3 chunks exceed the longest string Spark can hold.
CHUNK, FAN, LEVELS = 1 << 15, 64, 3
#: States, and pairs of pieces, that a worker keeps at most; beyond that it compiles them anew.
KEPT = 200_000
SPACE = "▁"

#: (trie node, piece before the border or None, pieces up to the border)
Reading = tuple[int, str | None, int]


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class State(dict):
    """Next state by character; ``emitted`` is the output of every transition that leads here."""

    __slots__ = ("readings", "emitted", "machine")

    def __missing__(self, character: str) -> State:
        found = self[character] = self.machine.step(self.readings, character)
        return found

    def count(self) -> int | None:
        """Pieces still to be added if the text ends here; None if no reading ends here."""
        return next((c for node, _, c in self.readings if node == 0), None)


class Machine:
    """The compiled tokenizer. Spaces stand for the vocabulary's space character."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        plain = [i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
        self.rank = {model.id_to_piece(i).replace(SPACE, " "): -model.get_score(i) for i in plain}
        self.neighbours = {p[i : i + 2] for p in self.rank for i in range(len(p) - 1)}
        self.longest = max(map(len, self.rank))
        self.edges = {p: edges for p in sorted(self.rank) if (edges := self._edges(p))}
        self.pieces = list(self.edges)
        self.number = {p: i for i, p in enumerate(self.pieces)} | {None: -1}
        self.child: dict[tuple[int, str], int] = {}
        self.piece_at: list[str | None] = [None]
        self.inner = {0}
        for piece in self.pieces:
            node = 0
            for character in piece:
                self.inner.add(node)
                if (node, character) not in self.child:
                    self.child[node, character] = len(self.piece_at)
                    self.piece_at.append(None)
                node = self.child[node, character]
            self.piece_at[node] = piece
        self.borders: dict[tuple[str, str], bool] = {}
        self.states: dict[tuple, State] = {}

    def _merge(self, text: str) -> Iterator[tuple[list[str], int, float]]:
        """The merges of a text in their order: parts, place and rank of the next one; best rank first, then the leftmost."""
        parts = list(text)
        while True:
            ranked = [(self.rank[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in self.rank]
            rank, at = min(ranked, default=(float("inf"), -1))
            yield parts, at, rank
            if at < 0:
                return
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def _edges(self, piece: str) -> tuple[list, list] | None:
        """The parts at a piece's left and right edge while it forms, each with the rank of the merge that ends it."""
        left, right = [], []
        for parts, at, rank in self._merge(piece):
            if at < 0 and len(parts) > 1:
                return None  # never the outcome of its own merges
            if at in (0, -1):
                left.append((parts[0], rank))
            if at in (len(parts) - 2, -1):
                right.append((parts[-1], rank))
        return left, right

    def border(self, left: str, right: str) -> bool:
        """Whether two neighbouring pieces stay apart."""
        key = left, right
        known = self.borders.get(key)
        if known is None:
            if left[-1] == " " == right[0]:  # runs of spaces share one rank, so their order counts
                known = [parts for parts, at, _ in self._merge(left + right) if at < 0] == [[left, right]]
            else:
                rank, known = self.rank, True
                for x, x_until in self.edges[left][1]:
                    for y, y_until in self.edges[right][0]:
                        r = rank.get(x + y)
                        if r is not None and r < x_until and r <= y_until:
                            known = False
            if len(self.borders) >= KEPT:
                self.borders.clear()
            self.borders[key] = known
        return known

    def state(self, readings: list[Reading]) -> State:
        low = min([c for _, _, c in readings], default=0)
        key = low, tuple(sorted([(node, piece or "", c - low) for node, piece, c in readings]))
        found = self.states.get(key)
        if found is None:
            found = State()
            found.emitted, found.machine = low, self
            found.readings = tuple([(node, piece or None, c) for node, piece, c in key[1]])
            self.states[key] = found
        return found

    def step(self, readings: tuple[Reading, ...], character: str) -> State:
        out, ended = [], None
        for node, piece, c in readings:
            if node == 0 and piece is not None and piece[-1] + character not in self.neighbours:
                piece = None  # no piece reaches across this place
            if node == 0 and character not in self.rank:
                ended = 0, None, c + len(character.encode("utf-8", "surrogatepass"))
            below = self.child.get((node, character))
            if below is None:
                continue
            formed = self.piece_at[below]
            if formed is not None and ended is None and (piece is None or self.border(piece, formed)):
                ended = 0, formed, c + 1
            if below in self.inner:
                out.append((below, piece, c))
        return self.state(out + [ended] if ended else out)

    def start(self) -> State:
        """The state before a text; also the place where a worker that holds too many states starts anew."""
        if len(self.states) > KEPT:
            for state in self.states.values():
                state.clear()
            self.states.clear()
        return self.state([(0, None, 0)])

    def run(self, state: State, text: str) -> tuple[State, int]:
        path = list(accumulate(text, getitem, initial=state))
        return path[-1], sum(map(attrgetter("emitted"), path)) - state.emitted

    def count(self, text: str) -> int:
        if not text:
            return 0
        last, n = self.run(self.start(), spaced(text))
        return n + last.count()

    def entries(self, before: str) -> list[Reading]:
        """All readings that a chunk may start with, by the characters before it (all of them, or at least two longest pieces)."""
        if not before:
            return [(0, None, 0)]
        out = []
        for n in range(min(self.longest, len(before) + 1)):
            node = 0
            for character in before[len(before) - n :]:
                node = self.child.get((node, character), -1)
            if node not in self.inner:
                continue
            rest = before[: len(before) - n]
            if not rest or rest[-1] not in self.rank or (n and rest[-1] + before[-n] not in self.neighbours):
                out.append((node, None, 0))
            else:
                out += [(node, rest[-k:], 0) for k in range(1, min(self.longest, len(rest)) + 1) if rest[-k:] in self.edges]
        return out

    def chunk_map(self, before: str, text: str) -> np.ndarray:
        """Rows (node and piece at the start, node and piece at the end, pieces added) of all readings that survive the chunk."""
        self.start()
        at = {(node, piece): (self.state([(node, piece, c)]), 0) for node, piece, c in self.entries(before)}
        read = 0
        while read < len(text) and len({id(s) for s, _ in at.values()}) > 1:
            moved = {e: (s[text[read]], n) for e, (s, n) in at.items()}
            at = {e: (s, n + s.emitted) for e, (s, n) in moved.items() if s.readings}
            read += 1
        if at and read < len(text):  # all readings have met in one state
            last, more = self.run(next(iter(at.values()))[0], text[read:])
            at = {e: (last, n + more) for e, (_, n) in at.items()}
        rows = [(node, self.number[piece], x, self.number[y], n + c) for (node, piece), (s, n) in at.items() for x, y, c in s.readings]
        return np.array(rows, np.int64).reshape(-1, 5)


def compose(first: np.ndarray, then: np.ndarray) -> np.ndarray:
    """The map of two neighbouring chunks: every way through both."""
    ways: dict[tuple[int, int], list] = {}
    for a, b, c, d, n in then.tolist():
        ways.setdefault((a, b), []).append((c, d, n))
    rows = [(a, b, e, f, n + m) for a, b, c, d, n in first.tolist() for e, f, m in ways.get((c, d), ())]
    return np.array(rows, np.int64).reshape(-1, 5)


START = np.array([(0, -1, 0, -1, 0)], np.int64)


def tokens_at(prefix: np.ndarray) -> int:
    """Tokens of a text from the map of all its chunks."""
    return next((n for a, b, c, _, n in prefix.tolist() if (a, b, c) == (0, -1, 0)), 0)


_machines: dict[str, Machine] = {}


def machine(path: str) -> Machine:
    if path not in _machines:
        _machines[path] = Machine(path)
    return _machines[path]


def spaced(text: str) -> str:
    """The text as the tokenizer reads it: with a space before it."""
    return " " + text.replace(SPACE, " ")


def _count_short(docs: DataFrame, path: str) -> DataFrame:
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = machine(path)
        for batch in batches:
            n = [own.count(t.as_py()) for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    return docs.select("doc_id", "n_bytes", "text").mapInArrow(count, "doc_id long, n_bytes long, n_tokens long")


def _chunk_maps(docs: DataFrame, path: str, size: int) -> DataFrame:
    """``docs`` (key, text) -> key, part, map. Equal texts are one; the chunks of a text are dealt over all tasks."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        back = 2 * machine(path).longest
        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                text = spaced(text.as_py())
                for first in range(0, len(text), size):
                    before, piece = text[max(0, first - back) : first], text[first : first + size]
                    yield pa.RecordBatch.from_pylist([{"key": key, "part": first // size, "before": before, "piece": piece}])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = machine(path)
        for batch in batches:
            maps = [own.chunk_map(b.as_py(), p.as_py()).tobytes() for b, p in zip(batch.column(2), batch.column(3))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(maps, pa.binary())], ["key", "part", "map"])

    pieces = docs.mapInArrow(cut, "key long, part long, before string, piece string").dropDuplicates(["key", "part"])
    return pieces.select("key", "part", "before", "piece").mapInArrow(read, "key long, part long, map binary")


def _groups(maps: DataFrame) -> DataFrame:
    """key, part of the next level, and the maps of its at most ``FAN`` parts in order."""
    above = F.expr(f"part div {FAN}").alias("above")
    return maps.groupBy("key", above).agg(F.array_sort(F.collect_list(F.struct("part", "map"))).alias("parts")).withColumnRenamed("above", "part")


def _maps(parts) -> Iterator[tuple[int, np.ndarray]]:
    for p in parts:
        yield p["part"], np.frombuffer(p["map"], np.int64).reshape(-1, 5)


def _up(groups: DataFrame) -> DataFrame:
    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for parts in batch.column(2).to_pylist():
                *_, last = accumulate((m for _, m in _maps(parts)), compose)
                out.append(last.tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.binary())], ["key", "part", "map"])

    return groups.mapInArrow(whole, "key long, part long, map binary")


def _down(groups: DataFrame, before: DataFrame) -> DataFrame:
    """The map of all that lies before each part, from that before its group."""

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for key, parts, head in zip(*(c.to_pylist() for c in batch.columns)):
                prefix = np.frombuffer(head, np.int64).reshape(-1, 5)
                for part, own in _maps(parts):
                    rows.append({"key": key, "part": part, "map": prefix.tobytes()})
                    prefix = compose(prefix, own)
            yield pa.RecordBatch.from_pylist(rows, pa.schema([("key", pa.int64()), ("part", pa.int64()), ("map", pa.binary())]))

    joined = groups.join(before.withColumnRenamed("map", "head"), ["key", "part"]).select("key", "parts", "head")
    return joined.mapInArrow(spread, "key long, part long, map binary")


def _keyed(docs: DataFrame) -> DataFrame:
    return base.texts(docs).withColumn("n_bytes", F.octet_length("text").cast("long")).withColumn("key", base.row_key())


def prefix_counts(docs: DataFrame, path: str | None = None, size: int = CHUNK) -> DataFrame:
    """doc_id, part, ``tokens_before``: tokens of each text up to each of its chunks, read as a text of its own; a scan in both directions."""
    path = path or vocabulary_path()
    keyed = _keyed(docs).where("n_bytes > 0")
    levels = [cut_lineage(_chunk_maps(keyed.select("key", "text"), path, size))]
    for _ in range(LEVELS - 1):
        levels.append(cut_lineage(_up(_groups(levels[-1]))))
    tops = levels[-1].select("key", F.expr(f"part div {FAN}").alias("part")).distinct()
    before = tops.withColumn("map", F.lit(bytearray(START.tobytes())))
    for maps in reversed(levels):
        before = _down(_groups(maps), before)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = [tokens_at(np.frombuffer(m, np.int64).reshape(-1, 5)) for m in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64())], ["key", "part", "tokens_before"])

    counted = before.mapInArrow(count, "key long, part long, tokens_before long")
    return keyed.select("doc_id", "key").join(counted, "key").drop("key")


def count_tokens(docs: DataFrame, path: str | None = None, size: int = CHUNK) -> DataFrame:
    """Per document: bytes and tokens. Texts within one chunk are read where they lie, longer ones in chunks."""
    path = path or vocabulary_path()
    keyed = _keyed(docs)
    long = keyed.where(F.col("n_bytes") > size)
    maps = _chunk_maps(long.select("key", "text"), path, size)
    for _ in range(LEVELS):
        maps = _up(_groups(maps))

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = [tokens_at(np.frombuffer(m, np.int64).reshape(-1, 5)) for m in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64())], ["key", "n_tokens"])

    totals = maps.select("key", "map").mapInArrow(total, "key long, n_tokens long")
    counted = long.select("doc_id", "n_bytes", "key").join(totals, "key").select("doc_id", "n_bytes", "n_tokens")
    return _count_short(keyed.where(F.col("n_bytes") <= size), path).unionByName(counted)


@base.query("op12_piece_counts")
def op12_piece_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = count_tokens(base.table(spark, sf_dir, "documents"))
    return counted.withColumn("over_limit", F.col("n_tokens") > LIMIT)
