"""Hard negatives by full exact scores from tables of subset sums (the method of the four Russians).

Components become whole numbers. Eight dimensions are a group; for an anchor and a group, a table holds the sums of all 256 subsets of the
anchor's eight components. A candidate's eight components, written in binary, are one byte for each bit plane, and that byte is the place
in the table. So a score is one look-up for each group and plane, the planes added from the top with a shift in between; the top plane
is the sign and is subtracted.

Candidates lie in blocks of about ``BLOCK`` rows (by a hash of the row, so no label or id makes a block large), and the anchors, a
hundredth of all rows, are dealt to every block: a stated query set against all rows, in blocks. A task holds one block and takes the anchors
in batches. An anchor's positives are looked for among its own label alone; their scores then give the ranges in which the rows of all
other labels are looked for, so each pair of anchor and candidate is scored once. Only the best rows of each block leave a task.

Defined results: rows with a null label, a null vector or a null or non-finite component take no part; a shorter vector counts as if it
went on with zeros, an empty one has score 0 with all. Rows that are equal in all three columns count once. Rows that share a vec_id but
differ elsewhere are rows of their own, also as anchors; between equal scores and ids the smaller label comes first, then the smaller
vector as bytes. A null vec_id is no anchor, is not relabelled and comes last among equal scores. Other columns are left behind. A
component whose scaled value needs more than ``BITS`` bits raises an error, since scores would not fit their 64 bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pressloom.llm import base
from pressloom.session import cut_lineage

#: Rows of a candidate block, anchors scored at a time, candidates scored at a time, and shares into which the anchors of a block are dealt.
BLOCK, AT_ONCE, SLICE, SHARES = 1 << 17, 64, 4096, 4
BITS = 24
POSITIVES, NEGATIVES, LEAST, MOST = 5, 10, 30, 90
GROUP = 8

_ROW = "vec_id long, label int, vector binary"


def whole_numbers(vectors: DataFrame, scale: int = 256) -> DataFrame:
    """vec_id, label (after the change of every seventh), vector: 32-bit whole numbers without zeros at the end; equal rows are one."""
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    fit = vectors.where(F.col("label").isNotNull() & F.col("embedding").isNotNull()).where(~bad)
    changed = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = fit.select(F.col("vec_id").cast("long"), changed.cast("int").alias("label"), F.col("embedding").cast("array<double>").alias("vector"))

    def scaled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(2)
            flat = np.floor(column.flatten().to_numpy(zero_copy_only=False) * scale)
            if len(flat) and np.abs(flat).max() >= 1 << (BITS - 1):
                raise ValueError(f"a component of more than {BITS} bits")
            ends = np.cumsum([len(v) for v in column])
            packed = [v.tobytes().rstrip(b"\0") for v in np.split(flat.astype("<i4"), ends[:-1])]
            packed = [v + b"\0" * (-len(v) % 4) for v in packed]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(packed, pa.binary())], ["vec_id", "label", "vector"])

    return rows.mapInArrow(scaled, _ROW).dropDuplicates(["vec_id", "label", "vector"])


def matrix(packed: list[bytes], groups: int) -> np.ndarray:
    """One row of ``GROUP * groups`` numbers for each vector."""
    out = np.zeros((len(packed), GROUP * groups), "<i4")
    for row, v in zip(out, packed):
        row[: len(v) // 4] = np.frombuffer(v, "<i4")
    return out


def planes(numbers: np.ndarray) -> np.ndarray:
    """Bytes [plane, group, row]: the bits of the two's complement of each eight components, the sign plane first."""
    low, high = int(numbers.min(initial=0)), int(numbers.max(initial=0))
    bits = max((-low - 1).bit_length() if low < 0 else 0, high.bit_length()) + 1
    shifts = np.arange(bits - 1, -1, -1)
    return np.stack([np.packbits(((numbers >> s) & 1).astype(np.uint8), axis=1).T for s in shifts])


def tables(anchors: np.ndarray) -> np.ndarray:
    """Sums [group, byte, anchor] of the subsets of each eight components; built by doubling, one component at a time."""
    n, width = anchors.shape
    sums = np.zeros((width // GROUP, 1, n), np.int64)
    for column in range(GROUP):
        own = anchors[:, column::GROUP].T.astype(np.int64)[:, None, :]
        sums = np.stack([sums, sums + own], axis=2).reshape(width // GROUP, -1, n)
    return sums


def scores(table: np.ndarray, plane_bytes: np.ndarray) -> np.ndarray:
    """Exact scores [row, anchor] by look-ups, additions and shifts."""
    total = np.zeros((plane_bytes.shape[2], table.shape[2]), table.dtype)
    for p, plane in enumerate(plane_bytes):
        total <<= 1
        for sums, places in zip(table, plane):
            part = sums.take(places, axis=0)
            if p:
                total += part
            else:
                total -= part
    return total


class Block:
    """The candidates of a task, by label, then in the order of ties."""

    def __init__(self, rows: list[tuple], groups: int):
        rows.sort(key=lambda r: (r[1], r[0] is None, r[0] or 0, r[2]))
        self.ids, self.labels, self.vectors = [r[0] for r in rows], np.array([r[1] for r in rows], np.int64), [r[2] for r in rows]
        self.tie = np.array(sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0, i)), np.int64).argsort()
        numbers = matrix(self.vectors, groups)
        self.size = int(np.abs(numbers.astype(np.int64)).max(initial=0)) + 1
        self.planes = planes(numbers)

    def table(self, anchors: np.ndarray) -> np.ndarray:
        """Tables in 32 bits where no sum and no score can leave them."""
        built = tables(anchors)
        safe = int(np.abs(anchors.astype(np.int64)).sum(axis=1).max(initial=0)) * 4 * self.size < 1 << 31
        return built.astype(np.int32) if safe else built

    def own_label(self, label: int) -> slice:
        return slice(*np.searchsorted(self.labels, [label, label + 1]).tolist())

    def slices(self, within: slice) -> Iterator[slice]:
        for first in range(within.start, within.stop, SLICE):
            yield slice(first, min(first + SLICE, within.stop))

    def best(self, found: np.ndarray, places: np.ndarray, n: int) -> np.ndarray:
        """Indices of the ``n`` best of the found scores, ties by the order of the rows."""
        if len(found) > n:
            keep = np.flatnonzero(found >= np.partition(found, len(found) - n)[len(found) - n])
        else:
            keep = np.arange(len(found))
        return keep[np.lexsort((self.tie[places[keep]], -found[keep].astype(np.int64)))][:n]


def _positives(block: Block, anchors: list[dict], groups: int) -> Iterator[tuple]:
    """(anchor's number, place, score) of the best rows of each anchor's own label in the block; ``anchors`` share a label."""
    table = block.table(matrix([a["vector"] for a in anchors], groups))
    own = block.own_label(anchors[0]["label"])
    kept = [(np.zeros(0, np.int64), np.zeros(0, np.int64))] * len(anchors)
    for part in block.slices(own):
        scored = scores(table, block.planes[:, :, part]).T
        for i, row in enumerate(scored):
            # one more than needed: the anchor itself may be among them
            values, places = np.concatenate((kept[i][0], row)), np.concatenate((kept[i][1], np.arange(part.start, part.stop)))
            best = block.best(values, places, POSITIVES + 1)
            kept[i] = values[best], places[best]
    for i, (values, places) in enumerate(kept):
        a = anchors[i]
        others = [(i, p, v) for v, p in zip(values.tolist(), places.tolist()) if (block.ids[p], block.vectors[p]) != (a["vec_id"], a["vector"])]
        yield from others[:POSITIVES]


def _negatives(block: Block, anchors: list[dict], groups: int) -> Iterator[tuple]:
    """(anchor's number, number of its positive, place, score) of the best rows of other labels inside each positive's range."""
    table = block.table(matrix([a["vector"] for a in anchors], groups))
    own = block.own_label(anchors[0]["label"])
    ranges = [[(-(-LEAST * s // 100), MOST * s // 100) for s in a["scores"]] for a in anchors]
    kept: dict[tuple[int, int], tuple] = {}
    for within in (slice(0, own.start), slice(own.stop, len(block.ids))):
        for part in block.slices(within):
            scored = np.ascontiguousarray(scores(table, block.planes[:, :, part]).T)
            places = np.arange(part.start, part.stop)
            for i, row in enumerate(scored):
                for k, (low, high) in enumerate(ranges[i]):
                    values, at = kept.get((i, k), (row[:0], places[:0]))
                    least = max(low, int(values[-1])) if len(values) == NEGATIVES else low
                    fits = np.flatnonzero((row >= least) & (row <= high))
                    if len(fits):
                        values, at = np.concatenate((values, row[fits])), np.concatenate((at, places[fits]))
                        best = block.best(values, at, NEGATIVES)
                        kept[i, k] = values[best], at[best]
    for (i, k), (values, places) in kept.items():
        yield from ((i, k, p, v) for v, p in zip(values.tolist(), places.tolist()))


def _against_all(rows: DataFrame, anchors: DataFrame, blocks: int, groups: int, find, schema: str, emit) -> DataFrame:
    """Deals every anchor (number, vec_id, label, vector, scores) to every block of candidates and lets ``find`` score them there.

    Partition = one share of the anchors with one block. The candidates of a block are sorted before its anchors, so a task reads the
    block once and then a stream of anchors.
    """
    block = F.pmod(F.xxhash64("vec_id", "label", "vector"), F.lit(blocks))
    candidates = rows.select(F.explode(F.sequence(F.lit(0), F.lit(SHARES - 1))).alias("share"), block.alias("block"), F.lit(None).cast("long").alias("number"),
                             "vec_id", "label", "vector", F.lit(None).cast("array<long>").alias("scores"))
    dealt = anchors.select(F.pmod(F.xxhash64("number"), F.lit(SHARES)).cast("int").alias("share"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("block"),
                           "number", "vec_id", "label", "vector", "scores")
    place = (F.col("block") * SHARES + F.col("share")).cast("int")
    both = candidates.unionByName(dealt).repartitionById(blocks * SHARES, place)
    both = both.sortWithinPartitions(F.col("number").isNotNull(), "label", "number").select("number", "vec_id", "label", "vector", "scores")

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, own, waiting = [], None, []

        def flush():
            columns = list(zip(*(emit(own, waiting, row) for row in find(own, waiting, groups)))) or [()] * len(arrow)
            waiting.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, arrow.types)], schema=arrow)

        for batch in batches:
            columns = [batch.column(i).to_pylist() for i in range(5)]
            for number, vec_id, label, vector, known in zip(*columns):
                if number is None:
                    held.append((vec_id, label, vector))
                    continue
                if own is None:
                    own = Block(held, groups)
                if waiting and (waiting[0]["label"] != label or len(waiting) == AT_ONCE):
                    yield flush()
                waiting.append({"number": number, "vec_id": vec_id, "label": label, "vector": vector, "scores": known})
        if waiting:
            yield flush()

    types = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    arrow = pa.schema([(name, types[kind]) for name, kind in (f.split(" ") for f in schema.split(", "))])
    return both.mapInArrow(score, schema)


def _order(score: str, row_id: str) -> list:
    return [F.col(score).desc(), F.col(row_id).asc_nulls_last(), F.col("label").asc(), F.col("vector").asc()]


def mine(vectors: DataFrame, every: int = 100) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id and both scores, for the anchors: rows whose vec_id is divisible by ``every``."""
    rows = cut_lineage(whole_numbers(vectors))
    n, width = rows.agg(F.count(F.lit(1)), F.max(F.octet_length("vector"))).first()
    blocks, groups = -(-n // BLOCK) or 1, max(1, -(-(width or 0) // (4 * GROUP)))
    numbered = rows.where(F.col("vec_id") % every == 0).withColumn("number", F.monotonically_increasing_id()).withColumn("scores", F.lit(None).cast("array<long>"))
    anchors = cut_lineage(numbered)

    def positive(block, waiting, row):
        i, p, score = row
        return waiting[i]["number"], block.ids[p], int(block.labels[p]), block.vectors[p], score

    found = _against_all(rows, anchors, blocks, groups, _positives, "number long, positive_id long, label int, vector binary, positive_score long", positive)
    ranked = Window.partitionBy("number").orderBy(*_order("positive_score", "positive_id"))
    best = found.withColumn("k", F.row_number().over(ranked)).where(F.col("k") <= POSITIVES)
    lists = best.groupBy("number").agg(F.array_sort(F.collect_list(F.struct("k", "positive_id", "positive_score"))).alias("positives"))
    known = cut_lineage(anchors.drop("scores").join(lists, "number").withColumn("scores", F.col("positives.positive_score")))

    def negative(block, waiting, row):
        i, k, p, score = row
        return waiting[i]["number"], k, block.ids[p], int(block.labels[p]), block.vectors[p], score

    schema = "number long, k int, negative_id long, label int, vector binary, negative_score long"
    against = _against_all(rows, known, blocks, groups, _negatives, schema, negative)
    ranked = Window.partitionBy("number", "k").orderBy(*_order("negative_score", "negative_id"))
    chosen = against.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= NEGATIVES).drop("label", "vector")
    whose = known.select("number", F.col("vec_id").alias("anchor_id"), F.posexplode("positives").alias("k", "positive"))
    return chosen.join(whose, ["number", "k"]).select("anchor_id", "positive.positive_id", "rank", "negative_id", "positive.positive_score", "negative_score")


_SQL = """
WITH taking AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT a.vec_id AS anchor_id, c.vec_id AS other_id, a.label = c.label AS same,
         CAST(list_inner_product(CAST(a.v AS DOUBLE[]), CAST(c.v AS DOUBLE[])) AS BIGINT) AS score
  FROM taking a, taking c WHERE a.vec_id % 100 = 0 AND a.vec_id <> c.vec_id
), positives AS (
  SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5
), ranked AS (
  SELECT p.anchor_id, p.positive_id, s.other_id AS negative_id, p.positive_score, s.score AS negative_score,
         row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.other_id) AS rank
  FROM positives p JOIN scored s ON s.anchor_id = p.anchor_id AND NOT s.same
  WHERE 30 * p.positive_score <= 100 * s.score AND 100 * s.score <= 90 * p.positive_score
)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM ranked WHERE rank <= 10
"""


@base.query("op13_subset_sums", _SQL)
def op13_subset_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mine(base.table(spark, sf_dir, "embeddings"))
