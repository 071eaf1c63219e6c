"""The prefix trie of rebuilt conversations, its node table addressed by minimal perfect hashes.

A prefix of turns has a digest of 128 bits: two polynomials over the hashes of its turns, which can be taken over parts of a conversation
and put together. So turns are sorted over all tasks by (conversation, turn), a task hashes the part it holds, and only the few
conversations that reach over the border of two tasks are put together afterwards; texts are read once and go no further than that sort.

Conversations are dealt to shards, ``BAND`` turns of one at most. A shard enumerates the distinct prefix digests it sees, gives each a
slot by a minimal perfect hash, verifies every slot against the stored digest, and scatters into flat arrays by slot: members, least
member; then, in a second pass, the values of the nodes whose least member it holds, which it adds up through the array of parents' slots,
deepest nodes first. Shards' results are added by digest. A node's value enters through its least member alone, so every value is counted
once in each of its prefixes, however the members are dealt; values below a band enter at the band's last turn.

Defined results: turns are ordered by turn (null first), then role, then text (null as empty, by bytes); equal rows are turns of their own;
rows without a conv_id take no part; ``%`` has the sign of the dividend; other columns are left behind; an empty table has no node, not
even the root. A collision of turn digests under one prefix digest is an error.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pressloom.llm import base
from pressloom.llm.hashing import mix
from pressloom.session import cut_lineage

#: Conversations that share a first one, most turns taken from it plus one, turns of a conversation in one shard, turns of a shard, ids hashed at a time.
FAMILY, HEADS, BAND, SHARD, IDS = 5, 9, 4096, 1 << 18, 4096
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_DEPTH = 0xD1B54A32D192ED03


def power(exponents: np.ndarray) -> np.ndarray:
    """The base of the polynomials to whole powers, negative ones too, modulo 2 ** 64."""
    out = np.ones(len(exponents), np.uint64)
    left, sign = np.abs(exponents).astype(np.int64), exponents < 0
    step, back = _BASE, _INVERSE
    while left.any():
        odd = (left & 1).astype(bool)
        out[odd] *= np.where(sign, np.uint64(back), np.uint64(step))[odd]
        left >>= 1
        step, back = step * step % (1 << 64), back * back % (1 << 64)
    return out


def _unsigned(column: pa.Array) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64), pa.int64())


def _batch(**columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, pa.int64()) for c in columns.values()], list(columns))


def finish(total: np.ndarray, depth: np.ndarray) -> np.ndarray:
    return mix(total + depth.astype(np.uint64) * np.uint64(_DEPTH))


def taken(conv_id: int) -> int:
    """Turns that a conversation takes from the first of its family."""
    return zlib.crc32(str(conv_id).encode()) % HEADS


# --- turns in order, with polynomials over the part of a conversation that a task holds


def ordered_turns(conversations: DataFrame) -> DataFrame:
    """conv_id, part (the task's number), i (place inside the part), polynomials a1 and a2 up to it, turn digests d1 and d2, n_bytes."""
    empty = F.lit("")
    rows = conversations.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.coalesce("role", empty).alias("role"), F.coalesce("text", empty).alias("text"),
        F.xxhash64(F.monotonically_increasing_id()).alias("salt"),
    )
    order = [F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("role"), F.col("text"), F.col("salt")]
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    narrow = dealt.select("conv_id", F.xxhash64("role", "text").alias("d1"), F.xxhash64(F.lit("second"), "text", "role").alias("d2"), F.octet_length("text").cast("long").alias("n_bytes"))

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        conv, n, totals = None, 0, [np.uint64(0)] * 2
        for batch in batches:
            ids = batch.column(0).to_numpy()
            if not len(ids):
                continue
            first = np.flatnonzero(np.concatenate(([True], ids[1:] != ids[:-1])))
            run = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(ids))))
            goes_on = conv is not None and ids[0] == conv
            place = np.arange(1, len(ids) + 1) - first[run] + np.where((run == 0) & goes_on, n, 0)
            sums = []
            for k in (0, 1):
                total = np.cumsum(mix(_unsigned(batch.column(1 + k))) * power(place))
                before = np.concatenate((np.zeros(1, np.uint64), total))[first]
                sums.append(total - before[run] + np.where((run == 0) & goes_on, totals[k], np.uint64(0)))
            conv, n, totals = ids[-1], place[-1], [s[-1] for s in sums]
            yield _batch(conv_id=ids, part=np.full(len(ids), part), i=place, a1=_signed(sums[0]), a2=_signed(sums[1]), d1=batch.column(1), d2=batch.column(2), n_bytes=batch.column(3))

    return narrow.mapInArrow(number, "conv_id long, part long, i long, a1 long, a2 long, d1 long, d2 long, n_bytes long")


# --- rebuilt conversations

def _wrap(x: int) -> int:
    """A whole number as a signed one of 64 bits."""
    return (x + (1 << 63)) % (1 << 64) - (1 << 63)


def _joined(parts: list[dict]) -> tuple[int, tuple[int, int], list[dict]]:
    """Turns, polynomials and first turns of a conversation from its parts in order."""
    n, totals, heads = 0, (0, 0), []
    for part in parts:
        shift = pow(_BASE, n, 1 << 64)
        for head in part["heads"]:
            if len(heads) < HEADS - 1:
                heads.append({**head, "i": head["i"] + n, "a1": totals[0] + head["a1"] * shift, "a2": totals[1] + head["a2"] * shift})
        totals = totals[0] + part["a1"] * shift, totals[1] + part["a2"] * shift
        n += part["n"]
    return n, totals, heads


def _families(turns: DataFrame) -> DataFrame:
    """One row a conversation: its parts and those of the first of its family, null if that is absent."""
    own = turns.groupBy("conv_id", "part").agg(
        F.max("i").alias("n"), F.max_by("a1", "i").alias("a1"), F.max_by("a2", "i").alias("a2"),
        F.array_sort(F.collect_list(F.when(F.col("i") < HEADS, F.struct("i", "a1", "a2", "d1", "d2", "n_bytes")))).alias("heads"),
    )
    convs = cut_lineage(own.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("part", "n", "a1", "a2", "heads"))).alias("parts")))
    bases = convs.select(F.col("conv_id").alias("base"), F.col("parts").alias("base_parts"))
    return convs.join(bases, F.col("conv_id") - F.col("conv_id") % FAMILY == F.col("base"), "left").select("conv_id", "parts", "base_parts")


def _plans(families: DataFrame) -> DataFrame:
    """How each conversation is rebuilt: one row for the conversation (pos null) and one for each turn from its family's first, and the root."""

    def plan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for conv, parts, base_parts in zip(*(c.to_pylist() for c in batch.columns)):
                n, totals, heads = _joined(parts)
                base_n, _, base_heads = _joined(base_parts or [])
                h = taken(conv)
                m = min(h, base_n)
                start = (base_heads[m - 1]["a1"], base_heads[m - 1]["a2"]) if m else (0, 0)
                skipped = (heads[min(h, n) - 1]["a1"], heads[min(h, n) - 1]["a2"]) if min(h, n) else (0, 0)
                shift = pow(_INVERSE, h - m, 1 << 64)
                ends = [start[k] + shift * (totals[k] - skipped[k]) for k in (0, 1)]
                rows.append({"conv_id": conv, "h": h, "m": m, "length": m + max(0, n - h), "s1": _wrap(start[0]), "s2": _wrap(start[1]), "o1": _wrap(skipped[0]), "o2": _wrap(skipped[1]), "a1": _wrap(ends[0]), "a2": _wrap(ends[1])})
                rows.append({"conv_id": conv, "pos": 0, "a1": 0, "a2": 0, "b1": 0, "b2": 0, "d1": 0, "d2": 0, "n_bytes": 0})
                before = (0, 0)
                for pos, head in enumerate(base_heads[:m], 1):
                    rows.append({"conv_id": conv, "pos": pos, "a1": _wrap(head["a1"]), "a2": _wrap(head["a2"]), "b1": _wrap(before[0]), "b2": _wrap(before[1]), "d1": head["d1"], "d2": head["d2"], "n_bytes": head["n_bytes"]})
                    before = head["a1"], head["a2"]
            yield pa.RecordBatch.from_pylist(rows, pa.schema([(c, pa.int64()) for c in _PLAN]))

    return families.mapInArrow(plan, ", ".join(f"{c} long" for c in _PLAN))


_PLAN = ["conv_id", "pos", "h", "m", "length", "s1", "s2", "o1", "o2", "a1", "a2", "b1", "b2", "d1", "d2", "n_bytes"]
_NODE = ["conv_id", "pos", "k1", "k2", "p1", "p2", "d1", "d2", "n_bytes"]


def _split_parts(turns: DataFrame) -> dict[int, tuple[int, int, int, int]]:
    """part -> (conversation, turns and polynomials before it) where a part goes on with the conversation of an earlier one.

    At most one row a part reaches the driver, since only the first conversation of a part can have begun before it.
    """
    span = turns.groupBy("part").agg(F.min("conv_id").alias("first"), F.max("conv_id").alias("last"))
    totals = turns.groupBy("conv_id", "part").agg(F.max("i").alias("n"), F.max_by("a1", "i").alias("a1"), F.max_by("a2", "i").alias("a2"))
    edges = totals.join(span, "part").where((F.col("conv_id") == F.col("first")) | (F.col("conv_id") == F.col("last")))
    out: dict[int, tuple[int, int, int, int]] = {}
    held = (None, 0, 0, 0)
    for row in sorted(edges.select("part", "conv_id", "n", "a1", "a2").collect()):
        part, conv, n, a1, a2 = row
        if conv == held[0]:
            out[part] = held
            shift = pow(_BASE, held[1], 1 << 64)
            held = conv, held[1] + n, (held[2] + a1 * shift) % (1 << 64), (held[3] + a2 * shift) % (1 << 64)
        else:
            held = conv, n, a1 % (1 << 64), a2 % (1 << 64)
    return out


def rebuilt_turns(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conv_id, pos, digest k1 k2 of the first pos rebuilt turns, digest p1 p2 of one less, d1, d2, n_bytes) and (conv_id, depth, k1, k2) of whole conversations."""
    turns = cut_lineage(turns)
    plans = cut_lineage(_plans(_families(turns)))
    before = _split_parts(turns)

    def finished(pos, a1, a2) -> list[pa.Array]:
        return [_signed(finish(a, pos)) for a in (a1, a2)]

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            depth = batch.column(1).to_numpy()
            k1, k2 = finished(depth, *(_unsigned(batch.column(c)) for c in (2, 3)))
            yield _batch(conv_id=batch.column(0), depth=depth, k1=k1, k2=k2)

    def from_base(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pos = batch.column(1).to_numpy()
            a1, a2, b1, b2 = (_unsigned(batch.column(c)) for c in range(2, 6))
            k1, k2 = finished(pos, a1, a2)
            p1, p2 = finished(np.maximum(pos - 1, 0), b1, b2)
            yield _batch(conv_id=batch.column(0), pos=pos, k1=k1, k2=k2, p1=p1, p2=p2, d1=batch.column(6), d2=batch.column(7), n_bytes=batch.column(8))

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            conv, part, i, h, m = (batch.column(c).to_numpy() for c in range(5))
            found = [before.get(p, (None, 0, 0, 0)) for p in part.tolist()] if before else [(None, 0, 0, 0)] * len(part)
            late = np.array([f[0] == c for f, c in zip(found, conv.tolist())], bool)
            offset = np.where(late, np.array([f[1] for f in found], np.int64), 0)
            i = i + offset
            keep = np.flatnonzero(i > h)
            pos, shift = m + i - h, power(m - h)
            digests = []
            for k in (0, 1):
                d, a, start, skipped = (_unsigned(batch.column(c + k)) for c in (5, 7, 9, 11))
                earlier = np.where(late, np.array([f[2 + k] % (1 << 64) for f in found], np.uint64), np.uint64(0))
                total = earlier + a * power(offset)
                here = mix(d) * power(i)
                digests.append((finish(start + shift * (total - skipped), pos), finish(start + shift * (total - here - skipped), pos - 1)))
            (k1, p1), (k2, p2) = digests
            columns = [conv, pos, *(x.view(np.int64) for x in (k1, k2, p1, p2)), *(batch.column(c).to_numpy() for c in (5, 6, 13))]
            yield _batch(**{name: c[keep] for name, c in zip(_NODE, columns)})

    ends = plans.where("pos is null").select("conv_id", F.col("length").alias("depth"), "a1", "a2").mapInArrow(whole, "conv_id long, depth long, k1 long, k2 long")
    schema = ", ".join(f"{c} long" for c in _NODE)
    shared = plans.where("pos is not null").select("conv_id", "pos", "a1", "a2", "b1", "b2", "d1", "d2", "n_bytes").mapInArrow(from_base, schema)
    how = plans.where("pos is null").select("conv_id", "h", "m", "s1", "s2", "o1", "o2")
    later = turns.join(how, "conv_id").select("conv_id", "part", "i", "h", "m", "d1", "d2", "a1", "a2", "s1", "s2", "o1", "o2", "n_bytes")
    return shared.unionByName(later.mapInArrow(own, schema)), ends


# --- node tables


class Slots:
    """A minimal perfect hash of distinct digests. Digests alone in their place get a slot, the others go on to the next level."""

    def __init__(self, keys: np.ndarray):
        self.keys = np.zeros_like(keys)
        self.levels: list[np.ndarray] = []
        rest, used = keys, 0
        while len(rest):
            size = len(rest) + len(rest) // 2 + 1
            at = self._places(rest, len(self.levels), size)
            alone = np.bincount(at, minlength=size) == 1
            slots = np.where(alone, used + np.cumsum(alone) - 1, -1)
            self.levels.append(slots)
            placed = alone[at]
            self.keys[slots[at[placed]]] = rest[placed]
            used += int(alone.sum())
            rest = rest[~placed]

    @staticmethod
    def _places(keys: np.ndarray, level: int, size: int) -> np.ndarray:
        return (mix(keys[:, 0] + mix(keys[:, 1] + np.uint64((level + 1) * _DEPTH % (1 << 64)))) % np.uint64(size)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Slots, each verified by the stored digest; -1 for a digest that is not in the table."""
        out, open_ = np.full(len(keys), -1), np.arange(len(keys))
        for level, slots in enumerate(self.levels):
            found = slots[self._places(keys[open_], level, len(slots))]
            out[open_] = found
            open_ = open_[found < 0]
        right = out >= 0
        right[right] = (self.keys[out[right]] == keys[right]).all(axis=1)
        return np.where(right, out, -1)


class Shard:
    """Node table of the conversations of one shard: flat arrays by slot."""

    def __init__(self, rows: dict[str, np.ndarray]):
        keys = np.stack([rows["k1"], rows["k2"]], axis=1).view(np.uint64)
        order = np.lexsort((rows["k2"], rows["k1"]))
        distinct = np.ones(len(order), bool)
        distinct[1:] = (keys[order[1:]] != keys[order[:-1]]).any(axis=1)
        self.slots = Slots(keys[order[distinct]])
        self.size = int(distinct.sum())
        self.at = self.known(rows["k1"], rows["k2"])
        self.depth, self.parent = np.zeros(self.size, np.int64), np.zeros(self.size, np.int64)
        self.depth[self.at] = rows["pos"]
        above = self.slots.find(np.stack([rows["p1"], rows["p2"]], axis=1).view(np.uint64))
        self.parent[self.at] = np.where(rows["pos"] % BAND > 0, above, -1)  # bands are not linked, also where a shard holds several

    def known(self, k1: np.ndarray, k2: np.ndarray) -> np.ndarray:
        slots = self.slots.find(np.stack([k1, k2], axis=1).view(np.uint64))
        if (slots < 0).any():
            raise RuntimeError("a digest without a slot")
        return slots

    def by_slot(self, values: np.ndarray) -> np.ndarray:
        out = np.zeros(self.size, np.int64)
        out[self.at] = values
        return out

    def key_columns(self) -> dict[str, pa.Array]:
        return {"k1": _signed(self.slots.keys[:, 0].copy()), "k2": _signed(self.slots.keys[:, 1].copy())}

    def sums_below(self, values: np.ndarray) -> np.ndarray:
        """Adds every slot's value to all its ancestors, deepest first."""
        order = np.argsort(self.depth, kind="stable")
        first = np.searchsorted(self.depth[order], np.arange(self.depth.max(initial=0) + 2))
        for d in range(len(first) - 2, 0, -1):
            here = order[first[d] : first[d + 1]]
            here = here[self.parent[here] >= 0]
            np.add.at(values, self.parent[here], values[here])
        return values


def _in_shards(rows: DataFrame, work: Callable[[dict[str, np.ndarray]], pa.RecordBatch], columns: list[str], schema: str) -> DataFrame:
    """Deals (conversation, band) pairs to tasks; a task works on whole pairs, about ``SHARD`` rows at a time."""
    family, band = F.expr(f"conv_id div {FAMILY}"), F.expr(f"pos div {BAND}")
    dealt = rows.repartition(family, band).sortWithinPartitions("conv_id", "pos").select(*columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def cut(whole: bool) -> Iterator[pa.RecordBatch]:
            table = {c: np.concatenate([b.column(i).to_numpy(zero_copy_only=False) for b in held]) for i, c in enumerate(columns)}
            pair = np.stack([table["conv_id"], table["pos"] // BAND], axis=1)
            last = len(pair) if whole else int(np.flatnonzero((pair != pair[-1]).any(axis=1)).max(initial=-1)) + 1
            held.clear()
            if last < len(pair):
                held.append(pa.RecordBatch.from_arrays([pa.array(c[last:]) for c in table.values()], columns))
            if last:
                yield work({c: x[:last] for c, x in table.items()})

        for batch in batches:
            if batch.num_rows:
                held.append(batch)
            if sum(b.num_rows for b in held) >= SHARD:
                yield from cut(False)
        if held:
            yield from cut(True)

    return dealt.mapInArrow(run, schema)


def _members(rows: dict[str, np.ndarray]) -> pa.RecordBatch:
    shard = Shard(rows)
    members = np.bincount(shard.at, minlength=shard.size)
    least = np.full(shard.size, np.iinfo(np.int64).max)
    np.minimum.at(least, shard.at, rows["conv_id"])
    more = {c: shard.by_slot(rows[c]) for c in ("p1", "p2", "d1", "d2", "n_bytes")}
    return _batch(**shard.key_columns(), depth=shard.depth, **more, conv_id=least, n_convs=members)


def _below(rows: dict[str, np.ndarray]) -> pa.RecordBatch:
    turns = rows["kind"] == 0
    shard = Shard({c: rows[c][turns] for c in ("k1", "k2", "p1", "p2", "pos")})
    at = shard.known(rows["k1"][~turns], rows["k2"][~turns])
    sums = {}
    for name in ("n_leaves", "saved_tokens"):
        values = np.zeros(shard.size, np.int64)
        np.add.at(values, at, rows[name][~turns])
        sums[name] = shard.sums_below(values)
    return _batch(**shard.key_columns(), **sums)


def ends_hashes(ends: DataFrame) -> DataFrame:
    """k1, k2, SHA-256 of the ascending ids of the conversations that end there. Ids meet in blocks, and a task hashes the blocks in turn."""
    blocks = ends.groupBy("k1", "k2", F.shiftright("conv_id", IDS.bit_length() - 1).alias("block")).agg(F.array_sort(F.collect_list("conv_id")).alias("ids"))
    texts = blocks.select("k1", "k2", "block", F.array_join(F.col("ids").cast("array<string>"), ",").alias("ids"))
    dealt = texts.repartition("k1", "k2").sortWithinPartitions("k1", "k2", "block").select("k1", "k2", "ids")

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, own = None, hashlib.sha256()
        schema = pa.schema([("k1", pa.int64()), ("k2", pa.int64()), ("ends_sha256", pa.string())])
        for batch in batches:
            out = []
            for k1, k2, ids in zip(*(c.to_pylist() for c in batch.columns)):
                if key != (k1, k2):
                    if key is not None:
                        out.append({"k1": key[0], "k2": key[1], "ends_sha256": own.hexdigest()})
                    key, own = (k1, k2), hashlib.sha256()
                else:
                    own.update(b",")
                own.update(ids.encode())
            yield pa.RecordBatch.from_pylist(out, schema)
        if key is not None:
            yield pa.RecordBatch.from_pylist([{"k1": key[0], "k2": key[1], "ends_sha256": own.hexdigest()}], schema)

    return dealt.mapInArrow(digest, "k1 long, k2 long, ends_sha256 string")


def _values_below_bands(values: DataFrame, turns: DataFrame) -> DataFrame:
    """Values of a conversation's nodes below each of its bands, at the band's last turn."""
    deep = values.where(F.col("pos") >= BAND).groupBy("conv_id", F.expr(f"pos div {BAND}").alias("band")).agg(F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens"))
    above = deep.select("conv_id", F.explode(F.sequence(F.lit(0).cast("long"), F.col("band") - 1)).alias("band"), "n_leaves", "saved_tokens")
    totals = above.groupBy("conv_id", "band").agg(F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens"))
    last = turns.where(F.col("pos") % BAND == BAND - 1).withColumn("band", F.expr(f"pos div {BAND}"))
    return last.join(totals, ["conv_id", "band"]).select("conv_id", "pos", "k1", "k2", "n_leaves", "saved_tokens")


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """All nodes: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    turns, ends = rebuilt_turns(ordered_turns(conversations))
    turns = cut_lineage(turns)
    schema = "k1 long, k2 long, depth long, p1 long, p2 long, d1 long, d2 long, n_bytes long, conv_id long, n_convs long"
    partial = _in_shards(turns, _members, _NODE, schema)
    same = [F.max(c).alias(c) for c in ("depth", "p1", "p2", "d1", "d2", "n_bytes")]
    differs = " or ".join(f"min({c}) <> max({c})" for c in ("depth", "p1", "p2", "d1", "d2", "n_bytes"))
    merged = partial.groupBy("k1", "k2").agg(*same, F.min("conv_id").alias("conv_id"), F.sum("n_convs").alias("n_convs"), F.expr(differs).alias("differs"))
    checked = F.when(F.col("differs"), F.raise_error(F.lit("two prefixes share a digest")).cast("long")).otherwise(F.col("n_convs"))
    nodes = cut_lineage(merged.withColumn("n_convs", checked).drop("differs", "d1", "d2"))

    inner = nodes.where("depth > 0").groupBy(F.col("p1").alias("k1"), F.col("p2").alias("k2")).agg(F.count(F.lit(1)).alias("n_children"))
    counted = cut_lineage(nodes.join(inner, ["k1", "k2"], "left").withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("long"))))
    values = counted.select(
        "conv_id", F.col("depth").alias("pos"), "k1", "k2",
        F.when(F.col("n_children") == 0, 1).otherwise(0).cast("long").alias("n_leaves"), ((F.col("n_convs") - 1) * F.col("n_bytes")).alias("saved_tokens"),
    )
    values = values.unionByName(_values_below_bands(values, turns))
    zero = F.lit(0).cast("long")
    both = turns.select("conv_id", "pos", zero.alias("kind"), "k1", "k2", "p1", "p2", zero.alias("n_leaves"), zero.alias("saved_tokens")).unionByName(
        values.select("conv_id", "pos", F.lit(1).cast("long").alias("kind"), "k1", "k2", zero.alias("p1"), zero.alias("p2"), "n_leaves", "saved_tokens")
    )
    below = _in_shards(both, _below, ["conv_id", "pos", "kind", "k1", "k2", "p1", "p2", "n_leaves", "saved_tokens"], "k1 long, k2 long, n_leaves long, saved_tokens long")
    sums = below.groupBy("k1", "k2").agg(F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens"))

    parents = counted.where("n_children > 0").select(F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("conv_id").alias("parent_conv_id"))
    placed = counted.join(parents, ["p1", "p2"], "left").join(sums, ["k1", "k2"]).join(ends_hashes(ends), ["k1", "k2"], "left")
    nothing = F.lit(hashlib.sha256(b"").hexdigest())
    return placed.select(
        "conv_id", "depth", F.when(F.col("depth") > 0, F.col("parent_conv_id")).alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", nothing).alias("ends_sha256"),
    )


_SQL = """
WITH RECURSIVE turns AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS i
  FROM conversations WHERE conv_id IS NOT NULL
), sums AS (
  SELECT conv_id, count(*) AS n,
         xor(list_reduce(list_concat([4294967295], list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda s: CAST(ascii(s) AS BIGINT))),
             lambda c, b: list_reduce(list_concat([xor(c, b)], range(8)), lambda x, k: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END)), 4294967295) % 9 AS h
  FROM turns GROUP BY conv_id
), rebuilt AS (
  SELECT s.conv_id, t.i AS pos, t.role, t.text FROM sums s JOIN turns t ON t.conv_id = s.conv_id - s.conv_id % 5 AND t.i <= s.h
  UNION ALL
  SELECT s.conv_id, t.i - s.h + least(s.h, coalesce(b.n, 0)), t.role, t.text
  FROM sums s JOIN turns t ON t.conv_id = s.conv_id AND t.i > s.h LEFT JOIN sums b ON b.conv_id = s.conv_id - s.conv_id % 5
), prefixes AS (
  SELECT conv_id, CAST(0 AS BIGINT) AS depth, '' AS node, '' AS parent, CAST(0 AS BIGINT) AS n_bytes FROM sums
  UNION ALL
  SELECT p.conv_id, r.pos, sha256(p.node || ':' || strlen(r.role) || ':' || r.role || r.text), p.node, strlen(r.text)
  FROM prefixes p JOIN rebuilt r ON r.conv_id = p.conv_id AND r.pos = p.depth + 1
), nodes AS (
  SELECT node, depth, any_value(parent) AS parent, any_value(n_bytes) AS n_bytes, min(conv_id) AS conv_id, count(*) AS n_convs FROM prefixes GROUP BY node, depth
), children AS (
  SELECT parent AS node, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY parent
), below AS (
  SELECT p.node, sum(CASE WHEN c.node IS NULL THEN 1 ELSE 0 END) AS n_leaves, sum((n.n_convs - 1) * n.n_bytes) AS saved_tokens
  FROM nodes n LEFT JOIN children c ON c.node = n.node JOIN prefixes p ON p.conv_id = n.conv_id AND p.depth <= n.depth GROUP BY p.node
), lengths AS (
  SELECT conv_id, max(depth) AS depth FROM prefixes GROUP BY conv_id
), ends AS (
  SELECT p.node, sha256(string_agg(CAST(p.conv_id AS VARCHAR), ',' ORDER BY p.conv_id)) AS ends_sha256 FROM lengths l JOIN prefixes p ON p.conv_id = l.conv_id AND p.depth = l.depth GROUP BY p.node
)
SELECT n.conv_id, n.depth, CASE WHEN n.depth > 0 THEN u.conv_id END AS parent_conv_id, n.n_convs, CAST(coalesce(c.n_children, 0) AS BIGINT) AS n_children,
       CAST(b.n_leaves AS BIGINT) AS n_leaves, CAST(b.saved_tokens AS BIGINT) AS saved_tokens, coalesce(e.ends_sha256, sha256('')) AS ends_sha256
FROM nodes n LEFT JOIN nodes u ON u.node = n.parent LEFT JOIN children c ON c.node = n.node JOIN below b ON b.node = n.node LEFT JOIN ends e ON e.node = n.node
"""


@base.query("op11_prefix_slots", _SQL)
def op11_prefix_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(base.table(spark, sf_dir, "conversations"))
