"""Registry of this subpackage's queries and what its operators share on the Spark side."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

#: A word is a run of bytes that are not one of these (space and \x09-\x0D); Python's bytes.split() cuts at the same bytes.
SPACE_CLASS = r"\x20\x09-\x0D"


def query(name: str, oracle: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(df: DataFrame, *more: str) -> DataFrame:
    """doc_id, text with null read as empty, and the named columns; all other columns are left behind."""
    return df.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), *more)


def row_key() -> Column:
    """Identity of a document row: equal rows share it (and so get equal results), ids that repeat with other texts don't."""
    return F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.col("text"))


def remainder(modulus: int) -> Column:
    """crc32 of the id as text, modulo; a null id counts as the text 'null'."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")).cast("binary")) % modulus
