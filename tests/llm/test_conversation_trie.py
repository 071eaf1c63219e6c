"""The prefix trie against a plain trie of tuples."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from compare import compare, connect

from pressloom.llm import conversation_trie as ct

SCHEMA = "conv_id long, turn long, role string, text string"
SF = "/root/testdata/sf0.001"


def plain(rows):
    turns = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            turns[conv].append((turn is not None, turn or 0, role or "", (text or "").encode()))
    turns = {c: [(r, t) for _, _, r, t in sorted(ts)] for c, ts in turns.items()}
    members, ends = defaultdict(list), defaultdict(list)
    for conv, own in turns.items():
        h = zlib.crc32(str(conv).encode()) % 9
        rebuilt = tuple(turns.get(conv - conv % 5, [])[:h] + own[h:])
        for d in range(len(rebuilt) + 1):
            members[rebuilt[:d]].append(conv)
        ends[rebuilt].append(conv)
    children = defaultdict(int)
    for node in members:
        if node:
            children[node[:-1]] += 1
    leaves, saved = defaultdict(int), defaultdict(int)
    for node, m in members.items():
        for d in range(len(node) + 1):
            leaves[node[:d]] += node not in children
            saved[node[:d]] += (len(m) - 1) * len(node[-1][1]) if node else 0
    return sorted(
        (min(m), len(node), min(members[node[:-1]]) if node else None, len(m), children.get(node, 0), leaves[node], saved[node],
         hashlib.sha256(",".join(map(str, sorted(ends.get(node, [])))).encode()).hexdigest())
        for node, m in members.items()
    )


def planted(seed=1, n=60):
    rng = random.Random(seed)
    rows = []
    for conv in rng.sample(range(4, 4 * n), n):
        depth = rng.choice([0, 1, 3, 8, 12])
        for turn in range(depth):
            rows.append((conv, turn, rng.choice(["user", "assistant"]) if turn > 2 else "user", rng.choice(["hi", "hello there", "é", ""])))
    rows += [(c, t, "user", "the same") for c in range(1000, 1040) for t in range(11)]  # a large group of copies
    rows += [(9, None, "user", "a"), (9, None, None, None), (9, 2, None, "x"), (9, 2, "user", "x"), (9, 2, "user", "x"), (9, 2, "user", "w"), (9, 10, "ab", "c"), (14, 10, "a", "bc")]
    rows += [(None, 1, "user", "lost"), (2001, None, None, None), (2500, 1, "user", "long " * 3000), (10**12, 0, "user", "hi"), (3001, 5, "user", "alone")]
    return rows


def test_against_plain_trie(spark):
    rows = planted()
    found = ct.prefix_trie(spark.createDataFrame(rows, SCHEMA).repartition(3))
    assert found.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    assert sorted(map(tuple, found.collect()), key=str) == sorted(plain(rows), key=str)


def test_one_conversation_over_many_tasks(spark, request):
    """A third of all rows in one conversation: parts of it are hashed in several tasks, and its bands lie in several shards."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    request.addfinalizer(lambda: spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled"))
    rng = random.Random(5)
    rows = [(15, t, "user", rng.choice("abc")) for t in range(11000)] + [(c, t, "user", str(t)) for c in range(100, 300) for t in range(12)]
    rows += [(16, t, "user", "z") for t in range(9000)] + [(15, 3, "user", "again")] * 50
    trie = {(r["conv_id"], r["depth"]): r for r in ct.prefix_trie(spark.createDataFrame(rows, SCHEMA).repartition(4)).collect()}
    own = sorted([(t, x) for c, t, _, x in rows if c == 15])
    assert max(d for c, d in trie if c == 15) == len(own)
    h = zlib.crc32(b"16") % 9
    length = len(own[:h]) + 9000 - h
    assert trie[15, len(own)]["n_leaves"] == 1 and max(d for c, d in trie if c == 16) == length
    assert trie[15, h]["n_leaves"] == trie[15, 1]["n_leaves"] and sum(r["n_children"] for r in trie.values()) == len(trie) - 1
    assert trie[15, 0]["n_convs"] == 202 and trie[15, 0]["n_leaves"] == sum(r["n_children"] == 0 for r in trie.values())
    shared = sum(len(x) for _, x in own[:h])
    assert trie[15, 0]["saved_tokens"] >= shared
    part = ct.ordered_turns(spark.createDataFrame(rows, SCHEMA).repartition(4)).where("conv_id = 15").select("part").distinct().count()
    assert part > 1


def test_slots_are_minimal_and_verified():
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 5000):
        keys = rng.integers(0, 1 << 63, (n, 2), np.uint64)
        slots = ct.Slots(keys)
        assert sorted(slots.find(keys).tolist()) == list(range(n))
        assert (slots.find(rng.integers(0, 1 << 63, (100, 2), np.uint64)) == -1).all()


def test_polynomials():
    e = np.array([0, 1, 5, -1, -7, 100000])
    assert (ct.power(e) * ct.power(-e) == 1).all() and ct.power(np.array([3]))[0] == pow(ct._BASE, 3, 1 << 64)


def test_empty_and_clashing_columns(spark):
    assert ct.prefix_trie(spark.createDataFrame([], SCHEMA)).count() == 0
    rows = planted(2, 20)
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", *[f"'other' AS {c}" for c in ("pos", "part", "i", "k1", "k2", "depth", "salt", "d1", "n_bytes", "h", "m")])
    assert sorted(map(tuple, ct.prefix_trie(df).collect()), key=str) == sorted(plain(rows), key=str)


def test_small_shards(spark, monkeypatch):
    """Shards of few rows, on the Python side alone."""
    rng = random.Random(2)
    rows = [{"conv_id": c, "pos": d, "path": tuple((c // 3 + j) % 2 for j in range(d))} for c in range(30) for d in range(6)]
    key = {p: i + 1 for i, p in enumerate({r["path"] for r in rows})}
    table = {n: np.array(v, np.int64) for n, v in {
        "conv_id": [r["conv_id"] for r in rows], "pos": [r["pos"] for r in rows], "k1": [key[r["path"]] for r in rows], "k2": [0] * len(rows),
        "p1": [key[r["path"][:-1]] for r in rows], "p2": [0] * len(rows)}.items()}
    shard = ct.Shard(table)
    below = shard.sums_below(np.ones(shard.size, np.int64))
    expected = {i: sum(q[: len(p)] == p for q in key) for p, i in key.items()}
    assert {int(k): int(v) for k, v in zip(shard.slots.keys[:, 0], below)} == expected


@pytest.mark.parametrize("name", ["op11_prefix_slots"])
def test_sql(spark, name):
    from pressloom.llm.base import ORACLES, QUERIES

    ok, message = compare(spark, connect(SF), QUERIES[name], ORACLES[name], SF)
    assert ok, message
