"""From raw documents to token sequences: five stages over the operators of ``pressloom.llm``.

Each stage takes what its predecessor kept. Null and empty texts, and texts without a letter, go in the first stage. The second keeps one
document of each class of near-duplicates. The third cuts repeated byte strings out of the texts and keeps every document,
also one that is empty then. The fourth drops the documents that hold a benchmark item. The last gives the tokens, and the text as
decoded from them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pressloom.llm import base
from pressloom.llm.bpe import encode_documents
from pressloom.llm.dart_minhash import without_near_duplicates
from pressloom.llm.decontaminate import without_contaminated
from pressloom.llm.language_id import in_known_language
from pressloom.llm.suffix_repeats import remove_repeated_bytes
from pressloom.session import cut_lineage


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return in_known_language(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return without_near_duplicates(docs)


def suffix_array_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return remove_repeated_bytes(docs).withColumn("n_chars", F.length("text").cast("long"))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return without_contaminated(docs, base.table(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    coded = encode_documents(docs, with_decoded=True)
    return coded.select("doc_id", F.col("decoded").alias("text"), "lang", "source", "n_chars", F.size("tokens").cast("long").alias("n_tokens"), "tokens")


STAGES = [
    ("language_id", language_id), ("near_dedup", near_dedup), ("suffix_array_dedup", suffix_array_dedup),
    ("decontamination", decontamination), ("bpe", tokens),
]

#: No stage but the filter on exact items could be written in SQL; tests/llm hold each against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = base.table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = cut_lineage(stage(spark, docs, sf_dir))
    return docs
