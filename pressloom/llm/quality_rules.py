"""Quality rules whose limits come from the corpus: quantile sketches per language and source.

A sketch counts values in buckets of relative width: bucket i holds the values up to GAMMA^i, so each quantile read from it is within one per cent of
a true one. Sketches merge by adding counts. So one aggregation gives those of all groups, and the language's and the whole corpus's
are sums of them. A group of fewer than ``LEAST`` documents uses its language's limits, and a small language the corpus's. The limit of
a measure lies ``REACH`` interquartile ranges beyond the outer quartile, a range counting as the measure's ``SPREAD`` at least. A joined
filter then keeps the documents inside all limits.

Defined results: a null or empty text has no words and fails; null language and null source are values of their own; texts are read whole;
ids may be null or repeat; equal rows get equal results; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pressloom.llm import base
from pressloom.llm.hashing import IS_SPACE, Prefix, buffer, chunks, words

GAMMA = 1.02
LEAST = 200
REACH = 3.0
#: measure -> (which sides have a limit, the least spread)
MEASURES = {
    "log_words": ("low", 0.5), "word_length": ("both", 0.4), "symbols_per_word": ("high", 0.05), "dup_line_share": ("high", 0.2), "repeat_share": ("high", 0.1),
}
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_lines", "n_repeat_words"]


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = buffer(batch.column(3))
        texts = batch.column(3)
        parts = []
        for a, b in chunks(offsets):
            own, bounds = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
            _, _, hashes, at = words(own, bounds)

            def per_text(marks: np.ndarray, at: np.ndarray) -> np.ndarray:
                return np.diff(np.append(0, np.cumsum(marks))[at])

            repeated = np.zeros(len(hashes) + 1, np.int64)
            if len(hashes) >= 3:
                text = np.searchsorted(at, np.arange(len(hashes)), "right") - 1
                start = np.flatnonzero(np.arange(len(hashes)) + 3 <= at[text + 1])
                gram = Prefix(hashes).slices(start, start + 3) ^ (text[start].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
                order = np.argsort(gram, kind="stable")
                same = gram[order][1:] == gram[order][:-1]
                twice = np.zeros(len(gram), bool)
                twice[order[1:]] |= same
                twice[order[:-1]] |= same
                np.add.at(repeated, start[twice], 1)
                np.add.at(repeated, start[twice] + 3, -1)
            lines, dup = [], []
            for i in range(a, b):
                held = [x for x in (texts[i].as_py() or "").split("\n") if x.encode().split()]
                lines.append(len(held))
                dup.append(len(held) - len(set(held)))
            parts.append([np.diff(at), per_text(~IS_SPACE[own] & ((own & 0xC0) != 0x80), bounds), per_text(_SYMBOL[own], bounds), dup, lines, per_text(np.cumsum(repeated[:-1]) > 0, at)])
        columns = [np.concatenate([p[i] for p in parts]).astype(np.int64) if parts else np.zeros(0, np.int64) for i in range(6)]
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], *[pa.array(c) for c in columns]], ["doc_id", "lang", "source", *_COUNTS])


def measures(docs: DataFrame) -> DataFrame:
    """Counts of each document, base_failed, and the measures that have limits (null without words)."""
    out = docs.select("doc_id", F.col("lang").cast("string"), F.col("source").cast("string"), F.coalesce("text", F.lit("")).alias("text")).mapInArrow(
        _measure, "doc_id long, lang string, source string, " + ", ".join(f"{c} long" for c in _COUNTS)
    )
    n = F.when(F.col("n_words") > 0, F.col("n_words"))
    return out.select(
        "*", ((F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))).alias("base_failed"),
        F.log(n).alias("log_words"), (F.col("word_chars") / n).alias("word_length"), (F.col("n_symbols") / n).alias("symbols_per_word"),
        (F.col("n_dup_lines") / F.when(F.col("n_lines") > 0, F.col("n_lines"))).alias("dup_line_share"), (F.col("n_repeat_words") / n).alias("repeat_share"),
    )


def bucket(x: Column) -> Column:
    """Number of the sketch's bucket; zero has one of its own."""
    return F.when(x > 0, F.ceil(F.log(x) / math.log(GAMMA))).otherwise(-100_000).cast("int")


def sketches(measured: DataFrame) -> DataFrame:
    """lang, source, measure, bucket, n. The levels above are there too, with ``all`` set to their depth: 2 the group, 1 the language, 0 the corpus."""
    long = measured.where("n_words > 0").select("lang", "source", F.explode(F.create_map(*[x for m in MEASURES for x in (F.lit(m), bucket(F.col(m)))])).alias("measure", "bucket"))
    groups = long.groupBy("lang", "source", "measure", "bucket").agg(F.count("*").alias("n"))
    group = groups.select(F.lit(2).alias("level"), "lang", "source", "measure", "bucket", "n")
    lang = groups.groupBy("lang", "measure", "bucket").agg(F.sum("n").alias("n")).select(F.lit(1).alias("level"), "lang", F.lit(None).cast("string").alias("source"), "measure", "bucket", "n")
    corpus = groups.groupBy("measure", "bucket").agg(F.sum("n").alias("n")).select(F.lit(0).alias("level"), F.lit(None).cast("string").alias("lang"), F.lit(None).cast("string").alias("source"), "measure", "bucket", "n")
    return group.unionByName(lang).unionByName(corpus)


def limits(sketch: DataFrame) -> DataFrame:
    """level, lang, source, measure, n, low, high."""
    whole = W.partitionBy("level", "lang", "source", "measure")
    running = sketch.withColumn("upto", F.sum("n").over(whole.orderBy("bucket"))).withColumn("total", F.sum("n").over(whole))
    value = F.when(F.col("bucket") == -100_000, 0.0).otherwise(2 * F.pow(F.lit(GAMMA), F.col("bucket")) / (GAMMA + 1))
    quartiles = running.groupBy("level", "lang", "source", "measure").agg(
        F.max("total").alias("n"), *[F.min(F.when(F.col("upto") >= F.ceil(F.col("total") * q), value)).alias(name) for name, q in (("q1", 0.25), ("q3", 0.75))]
    )
    spread = F.greatest(F.col("q3") - F.col("q1"), F.coalesce(*[F.when(F.col("measure") == m, s) for m, (_, s) in MEASURES.items()]))
    side = lambda *wanted: F.col("measure").isin([m for m, (s, _) in MEASURES.items() if s in wanted])
    return quartiles.select(
        "level", "lang", "source", "measure", "n", F.when(side("low", "both"), F.col("q1") - REACH * spread).alias("low"), F.when(side("high", "both"), F.col("q3") + REACH * spread).alias("high")
    )


def _wide(limit: DataFrame, level: int, keys: list[str]) -> DataFrame:
    """One row for each group of a level that has enough documents: its limits side by side."""
    pick = lambda m, c: F.max(F.when(F.col("measure") == m, F.col(c))).alias(f"{m}_{c}_{level}")
    own = limit.where(f"level = {level}").groupBy("lang", "source").agg(F.max("n").alias("__n"), *[pick(m, c) for m in MEASURES for c in ("low", "high")])
    if level:
        own = own.where(f"__n >= {LEAST}")
    return own.select(*[F.col(k).alias(f"__{k}") for k in keys], F.lit(True).alias(f"__level_{level}"), *[f"{m}_{c}_{level}" for m in MEASURES for c in ("low", "high")])


def judge(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text, lang, source) -> their counts, base_failed and kept."""
    measured = measures(docs)
    limit = limits(sketches(measured))
    group, lang, corpus = (_wide(limit, level, keys) for level, keys in ((2, ["lang", "source"]), (1, ["lang"]), (0, [])))
    joined = measured.join(group, F.col("lang").eqNullSafe(F.col("__lang")) & F.col("source").eqNullSafe(F.col("__source")), "left").drop("__lang", "__source")
    joined = joined.join(lang, F.col("lang").eqNullSafe(F.col("__lang")), "left").drop("__lang").join(F.broadcast(corpus), F.lit(True), "left")  # one row
    outside = F.lit(False)
    for m in MEASURES:
        for c, wrong in (("low", lambda x, y: x < y), ("high", lambda x, y: x > y)):
            own = F.when(F.col("__level_2"), F.col(f"{m}_{c}_2")).when(F.col("__level_1"), F.col(f"{m}_{c}_1")).otherwise(F.col(f"{m}_{c}_0"))
            outside = outside | F.coalesce(wrong(F.col(m), own), F.lit(False))
    return joined.select("doc_id", "lang", "source", *_COUNTS, "base_failed", (~F.col("base_failed") & ~outside).alias("kept"))


@base.query("op2_adaptive_rules")
def op2_adaptive_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(base.table(spark, sf_dir, "documents")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
