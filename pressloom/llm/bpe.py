"""Byte-pair encoding by walking the trie of distinct words, and decoding.

The encoding of a prefix is the encoding of a shorter prefix and one last token; which token is last follows from the last tokens of the
shorter prefixes alone: it is the one suffix in the vocabulary that may stand after the last token of what precedes it. So the last
tokens are states of trie nodes, and words that share a prefix share its states. Distinct words in sorted order are the trie in
depth-first order: a stack holds the states of the current path, and the next word goes on where it leaves that path. A state keeps only
the places from which a token may still reach further; nodes that agree in these are one state, whose steps are found once.

Defined results: a null or empty text has no tokens; texts are encoded whole, whatever their length; equal rows get equal results; the
special token's text becomes its id wherever it stands; ids may be null or repeat; other columns are passed on or left out, never read.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from itertools import accumulate, islice
from operator import getitem
from struct import pack, unpack

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from pressloom.llm import base
from pressloom.llm.hashing import buffer, chunks

VOCABULARY = "byte_bpe_50k.json"
#: Distinct words (and those of one batch), states, and pairs of tokens that a worker keeps at most.
KEPT = 200_000
_PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+".replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}"))


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _byte_of_character() -> dict[str, int]:
    """Byte-level vocabularies write each byte as one character: printable ones as themselves, the rest from U+0100 on."""
    printable = {b for b in range(256) if chr(b).isprintable() and b not in (0x20, 0xA0, 0xAD)}
    rest = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(rest)}


class State(dict):
    """What a prefix leaves to the next byte: next state by byte, and the last token of the prefix with its length in bytes."""

    __slots__ = ("key", "token", "size", "encoder")

    def __missing__(self, byte: int) -> State:
        found = self[byte] = self.encoder.step(self, byte)
        return found


class Encoder:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        byte = _byte_of_character()
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        self.text = {i: bytes(byte[c] for c in t) for t, i in vocab.items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.text |= {i: t.encode() for t, i in self.special.items()}
        self.rank: dict[tuple[int, int], int] = {}
        self.parts: dict[int, tuple[int, int]] = {}
        for rank, pair in enumerate(merges):
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            key = vocab[left], vocab[right]
            self.rank[key] = rank
            self.parts.setdefault(vocab[left + right], key)
        self.split_special = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        # the trie of the vocabulary: node and byte -> node, and the token of a node
        self.below: dict[int, int] = {}
        self.token_of: dict[int, int] = {}
        self.inner: set[int] = set()
        for token in vocab.values():
            node = 0
            for b in self.text[token]:
                self.inner.add(node)
                node = self.below.setdefault(node << 8 | b, len(self.below) + 1)
            self.token_of[node] = token
        self.states: dict[tuple, State] = {}
        self.may_follow: dict[int, bool] = {}
        self.words: dict[str, tuple[int, str, bytes]] = {}
        self.earlier: dict[str, tuple[int, str, bytes]] = {}

    def _edge(self, token: int, side: int) -> list[tuple[int, int]]:
        """The pieces that stand at a token's edge while it forms, each with the rank of the merge that ends it."""
        edge, until = [], len(self.rank)
        while True:
            edge.append((token, until))
            if token not in self.parts:
                return edge
            pair = self.parts[token]
            until, token = self.rank[pair], pair[side]

    def follows(self, left: int, right: int) -> bool:
        """Whether no merge across the border comes before both tokens are formed."""
        key = left << 32 | right
        known = self.may_follow.get(key)
        if known is None:
            rank, ahead = self.rank, self._edge(right, 0)
            known = True
            for x, x_until in self._edge(left, 1):
                for y, y_until in ahead:
                    r = rank.get((x, y))
                    if r is not None and r < x_until and r <= y_until:
                        known = False
            if len(self.may_follow) > KEPT:
                self.may_follow.clear()
            self.may_follow[key] = known
        return known

    def state(self, open_: list[int], token: int, size: int) -> State:
        key = pack(f"{len(open_) + 1}q", token << 8 | size, *open_)
        found = self.states.get(key)
        if found is None:
            found = self.states[key] = State()
            found.key, found.token, found.size, found.encoder = key, token, size, self
        return found

    def step(self, before: State, byte: int) -> State:
        """The next state of a prefix. Its open places, the longest stretch first, are those from which a token may still reach further:
        the token before the place, the node of the vocabulary's trie for what was read since, and the bytes since, in one number."""
        out, last = [], None
        for place in (*unpack(f"{len(before.key) // 8}q", before.key)[1:], before.token + 1 << 32):
            left, node, n = (place >> 32) - 1, place >> 8 & 0xFFFFFF, (place & 0xFF) + 1
            node = self.below.get(node << 8 | byte)
            if node is None:
                continue
            token = self.token_of.get(node)
            if last is None and token is not None and (left < 0 or self.follows(left, token)):
                last = token, n
            if node in self.inner:
                out.append(left + 1 << 32 | node << 8 | n)
        return self.state(out, *last)

    def learn(self, words: list[str]) -> None:
        """Encodes the distinct words by one walk over their trie: the stack holds the states of the current path, and the next word goes
        on where it leaves that path."""
        if len(self.states) > KEPT:
            for state in self.states.values():
                state.clear()
            self.states.clear()
        path, stack = b"", [self.state([], -1, 0)]
        for raw, word in sorted((w.encode(), w) for w in words):
            shared = 0
            for a, b in zip(path, raw):
                if a != b:
                    break
                shared += 1
            del stack[shared + 1 :]
            stack += islice(accumulate(raw[shared:], getitem, initial=stack[-1]), 1, None)
            path = raw
            ids, end = [], len(raw)
            while end:
                state = stack[end]
                ids.append(state.token)
                end -= state.size
            ids.reverse()
            self.words[word] = len(ids), ",".join(map(str, ids)), self.decode_bytes(ids)

    def pieces(self, text: str) -> list[str]:
        if self.split_special is None or not self.split_special.search(text):
            return _PIECES.findall(text)
        out = []
        for part in self.split_special.split(text):
            if part in self.special:
                ids = [self.special[part]]
                self.words[part] = 1, str(ids[0]), self.decode_bytes(ids)
                out.append(part)
            else:
                out += _PIECES.findall(part)
        return out

    def encode_all(self, texts: list[str]) -> list[list[tuple[int, str, bytes]]]:
        """For each text, its words' (number of tokens, ids, decoded bytes)."""
        if len(self.words) > KEPT // 3:  # words of the last two generations are kept, so frequent ones stay
            self.earlier, self.words = self.words, {}
        cut = [self.pieces(t) for t in texts]
        known, earlier, new = self.words, self.earlier, []
        for word in set().union(*cut) - known.keys():
            if word in earlier:
                known[word] = earlier[word]
            else:
                new.append(word)
        self.learn(new)
        return [[known[p] for p in pieces] for pieces in cut]

    def encode(self, text: str) -> list[int]:
        joined = ",".join(ids for _, ids, _ in self.encode_all([text])[0])
        return [int(i) for i in joined.split(",")] if joined else []

    def decode_bytes(self, ids) -> bytes:
        return b"".join([self.text[i] for i in ids])

    def decode(self, ids) -> str:
        return self.decode_bytes(ids).decode("utf-8", "replace")


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def _parts(batch: pa.RecordBatch, at: int) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Rows of about a million bytes of text, and their texts; only these become Python strings at a time."""
    _, offsets = buffer(batch.column(at))
    for first, last in chunks(offsets):
        part = batch.slice(first, last - first)
        yield part, [t or "" for t in part.column(at).to_pylist()]


def encode_documents(docs: DataFrame, path: str | None = None, with_decoded: bool = False) -> DataFrame:
    """``docs`` (text and any columns) -> the same columns, ``tokens`` (array of ids) and, if asked for, ``decoded``: the text from these ids."""
    path = path or vocabulary_path()
    at = docs.columns.index("text")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path)
        for batch in batches:
            for part, texts in _parts(batch, at):
                coded = own.encode_all(texts)
                joined = [",".join([w[1] for w in words]) for words in coded]
                flat = np.array(",".join(filter(None, joined)).split(","), np.int32) if any(joined) else np.zeros(0, np.int32)
                counts = [sum([w[0] for w in words]) for words in coded]
                tokens = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *counts]), pa.int32()), pa.array(flat))
                more = [pa.array([own.decode(flat[e - n : e].tolist()) for n, e in zip(counts, np.cumsum(counts))], pa.string())] if with_decoded else []
                yield pa.RecordBatch.from_arrays([*part.columns, tokens, *more], [*batch.schema.names, "tokens", *["decoded"] * with_decoded])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return docs.mapInArrow(encode, f"{fields}, tokens array<int>" + ", decoded string" * with_decoded)


def decode_documents(docs: DataFrame, path: str | None = None) -> DataFrame:
    """``docs`` (tokens and any columns) -> the same columns and ``decoded``; null tokens give an empty text."""
    path = path or vocabulary_path()
    at = docs.columns.index("tokens")

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path)
        for batch in batches:
            for first in range(0, batch.num_rows, 256):
                part = batch.slice(first, 256)
                texts = [own.decode(t or ()) for t in part.column(at).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string())], [*batch.schema.names, "decoded"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return docs.mapInArrow(decode, f"{fields}, decoded string")


def encoding_report(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Per document: tokens, SHA-256 of the ids, SHA-256 of the text decoded from them."""
    path = path or vocabulary_path()

    def report(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path)
        for batch in batches:
            n, ids, decoded = [], [], []
            for _, texts in _parts(batch, 1):
                for words in own.encode_all(texts):
                    n.append(sum([w[0] for w in words]))
                    ids.append(hashlib.sha256(",".join([w[1] for w in words]).encode()).hexdigest())
                    decoded.append(hashlib.sha256(b"".join([w[2] for w in words]).decode("utf-8", "replace").encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return base.texts(docs).mapInArrow(report, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


@base.query("op8_bpe_trie")
def op8_bpe_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoding_report(base.table(spark, sf_dir, "documents"))
