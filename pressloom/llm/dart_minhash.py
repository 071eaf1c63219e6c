"""Near-duplicates by DartMinHash: weighted signatures from hashed darts, joined by bands.

A text is a weighted set: its runs of five words, each weighing as often as it occurs. Every unit of weight of an element is a region of its own, on
which darts fall at ranks that depend on the hash of element and unit alone (a unit Poisson process). Each dart has a
coordinate. A signature keeps the earliest dart of each coordinate. So two texts agree in a coordinate with the probability of their weighted
Jaccard similarity, and only as many darts are thrown as the coordinates need, however long the text is.

Texts that agree in all rows of a band share a bucket. Equal texts are one node. A bucket's texts are compared with its pivot, the node
with most copies, then with most bucket mates. Those that differ from the pivot are compared with all texts of
the pivot's buckets, block against block, where only a spanning set of links leaves the task; so no link between buckets' texts is lost and no pairs
are written out. Classes are the connected components of links of ``SIMILARITY`` or more, each verified on the whole texts.

Nodes are known by 64-bit hashes of their texts.

Defined results: a null text is empty; texts without words are equal only to equal texts; a text of under five words is one run; ids may be null (a class takes its
least non-null id; a class of null ids has the class id null) or repeat; equal rows share a class; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pressloom.llm import base
from pressloom.llm.graphs import components
from pressloom.llm.hashing import Prefix, buffer, chunks, mix, words
from pressloom.session import cut_lineage

SHINGLE = 5
SIMILARITY = 0.8
BANDS, ROWS = 16, 4
COORDINATES = BANDS * ROWS
#: Runs of words in a block that is compared with another block.
BLOCK = 40_000
_GOLD = np.uint64(0x9E3779B97F4A7C15)


def cells(hashes: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Units of weight of consecutive texts (word hashes, offsets): hashes of (run of words, how often before), and offsets."""
    length = np.diff(at)
    count = np.where(length >= SHINGLE, length - SHINGLE + 1, (length > 0).astype(np.int64))
    bounds = np.append(0, np.cumsum(count))
    text = np.repeat(np.arange(len(count)), count)
    start = at[:-1][text] + np.arange(len(text)) - bounds[text]
    run = Prefix(hashes).slices(start, np.minimum(start + SHINGLE, at[1:][text]))
    order = np.lexsort((run, text))
    new = np.ones(len(run), bool)
    new[1:] = (run[order][1:] != run[order][:-1]) | (text[order][1:] != text[order][:-1])
    place = np.arange(len(run))
    before = np.empty(len(run), np.uint64)
    before[order] = place - np.maximum.accumulate(np.where(new, place, 0))
    return mix(run + before * _GOLD), bounds


def signatures(cell: np.ndarray, bounds: np.ndarray, coordinates: int = COORDINATES) -> np.ndarray:
    """Texts x coordinates: the earliest dart of each coordinate; texts without cells have zeros."""
    weight = np.diff(bounds)
    out = np.zeros((len(weight), coordinates), np.uint64)
    darts = coordinates * math.log(coordinates) + 2 * coordinates
    todo = np.flatnonzero(weight > 0)
    while len(todo):
        own = np.repeat(np.arange(len(todo)), weight[todo])
        which = np.arange(len(own)) - (np.cumsum(weight[todo]) - weight[todo])[own] + bounds[:-1][todo][own]
        key, latest = cell[which], (darts / weight[todo])[own]
        rank, thrown, number = np.zeros(len(own)), [], 0
        while len(own):
            number += 1
            dart = mix(key + np.uint64(number * int(_GOLD) % (1 << 64)))
            rank = rank - np.log(((dart >> np.uint64(11)).astype(np.float64) + 1) / (1 << 53))
            falls = rank <= latest
            own, key, latest, rank, dart = own[falls], key[falls], latest[falls], rank[falls], dart[falls]
            thrown.append((own, rank, dart))
        text, rank, dart = (np.concatenate([t[i] for t in thrown]) for i in range(3))
        again = mix(dart ^ _GOLD)
        slot = text * coordinates + (again % np.uint64(coordinates)).astype(np.int64)
        order = np.lexsort((again, rank, slot))
        first = order[np.flatnonzero(np.append(True, slot[order][1:] != slot[order][:-1]))]
        found = np.zeros(len(todo) * coordinates, np.uint64)
        found[slot[first]] = again[first] | np.uint64(1)
        found = found.reshape(len(todo), coordinates)
        out[todo] = found
        todo = todo[(found == 0).any(1)]  # a coordinate without a dart: these texts get twice as many
        darts *= 2
    return out


def _bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    salt = np.arange(1, ROWS + 1, dtype=np.uint64) * _GOLD
    for batch in batches:
        data, offsets = buffer(batch.column(2))
        out = []
        for a, b in chunks(offsets):
            _, _, hashes, at = words(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
            cell, bounds = cells(hashes, at)
            rows = mix(signatures(cell, bounds).reshape(b - a, BANDS, ROWS) + salt)
            band = mix(np.bitwise_xor.reduce(rows, axis=2) + np.arange(BANDS, dtype=np.uint64)).view(np.int64)
            out += [x if n else None for x, n in zip(band, np.diff(bounds), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.list_(pa.int64()))], ["node", "doc_id", "bands"])


def _cells_of(text: str) -> np.ndarray:
    own = np.frombuffer(text.encode(), np.uint8)
    _, _, hashes, at = words(own, np.array([0, len(own)]))
    return np.sort(cells(hashes, at)[0])


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """pivot, node, their texts -> pivot, node, similarity."""
    last, pivot = None, None
    for batch in batches:
        out = []
        for p, x, y in zip(batch.column(0).to_pylist(), batch.column(2), batch.column(3), strict=True):
            if p != last:
                last, pivot = p, _cells_of(x.as_py())
            own = _cells_of(y.as_py())
            both = len(np.intersect1d(pivot, own, assume_unique=True))
            out.append(both / max(1, len(pivot) + len(own) - both))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.float64())], ["pivot", "node", "similarity"])


def _as_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [_cells_of(t.as_py()) for t in batch.column(3)]
        columns = [*batch.columns[:3], pa.array([len(c) for c in found], pa.int64()), pa.array([c.tobytes() for c in found], pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, ["pivot", "node", "minor", "size", "cells"])


def _incidence(block: list[dict], universe: np.ndarray) -> np.ndarray:
    out = np.zeros((len(block), len(universe)), np.float32)
    for i, x in enumerate(block):
        own = np.frombuffer(x["cells"], np.uint64)
        at = np.minimum(np.searchsorted(universe, own), len(universe) - 1)
        out[i, at[universe[at] == own]] = 1
    return out


def _block_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Two blocks of texts -> links that connect all their similar texts."""
    for batch in batches:
        links: list[tuple[int, int]] = []
        for rare, common in zip(batch.column(0), batch.column(1), strict=True):
            a, b = rare.as_py(), common.as_py()
            known = np.unique(np.concatenate([np.frombuffer(x["cells"], np.uint64) for x in a]))
            size_a, size_b = (np.array([len(x["cells"]) // 8 for x in s]) for s in (a, b))
            similar = np.zeros((len(a), len(b)), bool)
            for first in range(0, len(known), 8192):
                part = known[first : first + 8192]
                both = _incidence(a, part) @ _incidence(b, part).T
                similar = both if first == 0 else similar + both
            similar = similar >= SIMILARITY * (size_a[:, None] + size_b[None, :] - similar) - 1e-6
            root = {x["node"]: x["node"] for x in a + b}

            def find(n: int) -> int:
                while root[n] != n:
                    root[n] = root[root[n]]
                    n = root[n]
                return n

            for i, j in np.argwhere(similar).tolist():
                p, q = find(a[i]["node"]), find(b[j]["node"])
                if p != q:
                    root[p] = q
                    links.append((a[i]["node"], b[j]["node"]))
        yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in links], pa.int64()), pa.array([y for _, y in links], pa.int64())], ["a", "b"])


def near_duplicate_classes(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text) -> doc_id, node (hash of the text), root (least node of the class), class_id (its least id), class_docs (its documents)."""
    docs = base.texts(docs).withColumn("node", F.xxhash64("text"))
    signed = cut_lineage(docs.select("node", "doc_id", "text").mapInArrow(_bands, "node long, doc_id long, bands array<long>"))
    nodes = signed.groupBy("node").agg(F.min("doc_id").alias("id"), F.count("*").alias("copies"))

    buckets = signed.select("node", F.explode("bands").alias("band")).distinct()
    shared = buckets.groupBy("band").agg(F.count("*").alias("mates")).where("mates > 1")
    placed = cut_lineage(buckets.join(shared, "band"))
    degree = placed.groupBy("node").agg(F.sum("mates").alias("degree")).join(nodes, "node")
    # copies, then mates, then the node's hash, in one ordered number for each bucket, so that the aggregate works on longs
    order = F.least(F.col("copies"), F.lit((1 << 20) - 1)) * (1 << 42) + F.least(F.col("degree"), F.lit((1 << 42) - 1))
    ranked = cut_lineage(placed.join(degree.select("node", order.alias("rank")), "node").select("band", "node", "rank"))
    top = ranked.groupBy("band").agg(F.max("rank").alias("rank"))
    pivots = ranked.join(top, ["band", "rank"]).groupBy("band").agg(F.min("node").alias("pivot"))
    pairs = cut_lineage(ranked.join(pivots, "band").where("node != pivot").select("pivot", "node").distinct())

    wanted = pairs.select("node").union(pairs.select("pivot")).distinct().join(nodes.select("node", "id"), "node")
    texts = cut_lineage(
        docs.join(wanted.hint("shuffle_hash"), (docs["node"] == wanted["node"]) & docs["doc_id"].eqNullSafe(wanted["id"]), "left_semi").select("node", "text")
    )
    texts = texts.join(texts.groupBy("node").agg(F.count("*").alias("rows")), "node").where("rows = 1").select("node", "text").unionByName(
        texts.join(texts.groupBy("node").agg(F.count("*").alias("rows")), "node").where("rows > 1").dropDuplicates(["node"]).select("node", "text")
    )  # the same row twice is rare; only those rows are folded with their texts
    compared = cut_lineage(
        pairs.join(texts, "node").select("pivot", "node", F.col("text").alias("own"))
        .join(texts.select(F.col("node").alias("pivot"), "text"), "pivot").select("pivot", "node", "text", "own")
        .mapInArrow(_compare, "pivot long, node long, similarity double")
    )
    links = compared.where(f"similarity >= {SIMILARITY}").select(F.col("pivot").alias("a"), F.col("node").alias("b"))
    rest = _links_beside_pivots(compared, texts)
    roots = components(links.unionByName(rest))

    named = nodes.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    classes = named.groupBy("root").agg(F.min("id").alias("class_id"), F.sum("copies").alias("class_docs"))
    of_node = named.join(classes, "root").select("node", "root", "class_id", "class_docs")
    return signed.select("node", "doc_id").join(of_node, "node").select("doc_id", "node", "root", "class_id", "class_docs")


def _links_beside_pivots(compared: DataFrame, texts: DataFrame) -> DataFrame:
    """Links of the texts that differ from their pivot, with any text of the pivot's buckets."""
    minor = compared.withColumn("minor", F.col("similarity") < SIMILARITY)
    groups = minor.groupBy("pivot").agg(F.sum(F.col("minor").cast("long")).alias("minors"), F.count("*").alias("members")).where("minors > 0 and members > 1").select("pivot")
    held = (
        minor.join(groups, "pivot").select("pivot", "node", "minor").join(texts, "node").select("pivot", "node", "minor", "text")
        .mapInArrow(_as_cells, "pivot long, node long, minor boolean, size long, cells binary")
    )
    held = cut_lineage(held)
    size = held.groupBy("pivot").agg(F.sum("size").alias("all"), F.sum(F.when(F.col("minor"), F.col("size"))).alias("some"))
    dealt = held.join(size, "pivot")
    item = F.collect_list(F.struct("node", "cells"))

    def blocks(rows: DataFrame, total: str, name: str) -> DataFrame:
        count = F.ceil(F.col(total) / BLOCK)
        return rows.withColumn("block", F.pmod(F.hash("node"), count)).groupBy("pivot", "block").agg(item.alias(name)).drop("block")

    return blocks(dealt.where("minor"), "some", "rare").join(blocks(dealt, "all", "common"), "pivot").select("rare", "common").mapInArrow(_block_links, "a long, b long").where("a != b")


def without_near_duplicates(docs: DataFrame) -> DataFrame:
    """One document of each class stays: the one with the least id, then the least text hash. Same columns.

    Equal rows are one document here: one of them stays. Rows of a class without any id keep the one with the least text hash.
    """
    marked = near_duplicate_classes(docs)
    nearest = marked.where("doc_id <=> class_id").groupBy("root").agg(F.min("class_id").alias("class_id"), F.min("node").alias("node"))
    keyed = docs.withColumn("__node", F.xxhash64(F.coalesce("text", F.lit(""))))
    kept = keyed.join(nearest.hint("shuffle_hash"), (keyed["doc_id"].eqNullSafe(nearest["class_id"])) & (keyed["__node"] == nearest["node"]), "left_semi")
    extra = kept.groupBy("doc_id", "__node").agg(F.count("*").alias("__rows")).where("__rows > 1")
    once = kept.join(extra.select(F.col("doc_id").alias("__id"), F.col("__node").alias("__n")), F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__node") == F.col("__n")), "left_anti")
    twice = kept.join(extra.select(F.col("doc_id").alias("__id"), F.col("__node").alias("__n")), F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__node") == F.col("__n")), "left_semi")
    return once.unionByName(twice.dropDuplicates(["doc_id", "__node"])).drop("__node")


@base.query("op4_dart_minhash")
def op4_dart_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicate_classes(base.table(spark, sf_dir, "documents")).select("doc_id", "class_id", "class_docs")
