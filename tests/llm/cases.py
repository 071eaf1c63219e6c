"""Small tables with everything a column can hold, and brute-force versions of the operators."""

from __future__ import annotations

import hashlib
import itertools
import random
from collections import Counter, defaultdict

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Columns whose names the operators use themselves.
CLASHES = "key, node, ord, score, tokens, least, digest, lang_pred, kept, text_, pivot, root, value"


def words(rng: random.Random, n: int) -> list[str]:
    stems = ["the", "of", "reka", "dolen", "mira", "tok", "suvan", "élan", "straße", "ñandú", "word", "läuft"]
    return [rng.choice(stems) + rng.choice(["", "s", "ing", "en", "a", "or", "ik"]) + rng.choice(["", "", ".", ","]) for _ in range(n)]


def hard_rows(seed: int = 1) -> list[tuple]:
    """Nulls, empty and long texts, repeated rows and ids, near copies, self-repetition, shared passages."""
    rng = random.Random(seed)
    text = lambda n: " ".join(words(rng, n))
    base, passage = text(150), text(70)
    near = base.split(" ")
    near[40] = "changed"
    long = text(6000) + "\n" + passage + "\n" + text(20)
    rows = [
        (1, None, "en", "a", 0), (2, "", "en", "a", 0), (3, " \n\t ", None, None, 3), (4, "...!!! 123", "en", "a", 9), (5, "one", "en", None, 3),
        (6, base, "en", "a", 1), (7, base, "de", "b", 1), (8, " ".join(near), "en", "a", 1), (9, long, None, "b", 1), (10, text(30) + " " + passage + " " + text(30), "de", "a", 1),
        (11, "ab " * 300, "en", "a", 900), (12, "x" * 700, "en", "b", 700), (13, text(80), "en", "a", 1), (13, text(90), "de", "a", 1),
        (14, base, "en", "a", 1), (14, base, "en", "a", 1), (None, base, None, None, None), (None, text(60), "en", "a", 1), (None, text(61), "en", "a", 1), (None, None, None, None, None),
        (15, "日本語のテキスト " * 40, "ja", "c", 1), (16, "<|endoftext|> mixed 😀 é \x00   text's", "en", "a", 1), (17, text(49) + " " + passage, "en", "a", 1),
    ]
    return rows


def frame(spark, rows=None, clash: bool = False):
    df = spark.createDataFrame(hard_rows() if rows is None else rows, SCHEMA).repartition(3)
    if clash:
        from pyspark.sql import functions as F

        for name in CLASHES.split(", "):
            df = df.withColumn(name, F.lit("other"))
    return df


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def passages(rows, size=50):
    last = (1 << 63) - 1
    first: dict = {}
    cut = [(last if r[0] is None else r[0], r[0], (r[1] or "").encode().split()) for r in rows]
    for rank, _, w in cut:
        for i in range(len(w) - size + 1):
            k = tuple(w[i : i + size])
            first[k] = min(first.get(k, last), rank)
    out = []
    for rank, doc, w in cut:
        gone = [False] * len(w)
        for i in range(len(w) - size + 1):
            if first[tuple(w[i : i + size])] < rank:
                gone[i : i + size] = [True] * size
        out.append((doc, len(w), sum(gone), hashlib.sha256(b" ".join(x for x, g in zip(w, gone) if not g)).hexdigest()))
    return out


def repeated_bytes(rows, size=200):
    seen: Counter = Counter()
    cut = [(r[0], (r[1] or "").encode()) for r in rows]
    for _, b in cut:
        seen.update(b[i : i + size] for i in range(len(b) - size + 1))
    out = []
    for doc, b in cut:
        gone = [False] * len(b)
        for i in range(len(b) - size + 1):
            if seen[b[i : i + size]] > 1:
                gone[i : i + size] = [True] * size
        spans = sum(g and (i == 0 or not gone[i - 1]) for i, g in enumerate(gone))
        out.append((doc, len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest()))
    return out


def shingles(text, n=5) -> Counter:
    w = (text or "").encode().split()
    return Counter(tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))) if w else Counter()


def similarity(a: Counter, b: Counter) -> float:
    both = sum((a & b).values())
    return both / max(1, sum(a.values()) + sum(b.values()) - both)


def classes(rows, least=0.8) -> list[int]:
    """For each row the number of its class's first row."""
    sets = [shingles(r[1]) for r in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in itertools.combinations(range(len(rows)), 2):
        if (rows[i][1] or "") == (rows[j][1] or "") or (sets[i] and sets[j] and similarity(sets[i], sets[j]) >= least):
            a, b = sorted((find(i), find(j)))
            root[b] = a
    return [find(i) for i in range(len(rows))]


def least_ids(rows) -> list:
    """For each row its doc_id and the least id of its class."""
    groups = defaultdict(list)
    of = classes(rows)
    for i, c in enumerate(of):
        if rows[i][0] is not None:
            groups[c].append(rows[i][0])
    return [(r[0], min(groups[c]) if groups[c] else None) for r, c in zip(rows, of)]


def kept_ids(rows) -> list:
    """The least id of each class, classes without ids last."""
    by_class = {c: least for c, (_, least) in zip(classes(rows), least_ids(rows))}
    return sorted((x for x in by_class.values() if x is not None)) + [None] * sum(x is None for x in by_class.values())
