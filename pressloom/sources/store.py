"""The article store on files: a guarded read, and a write that replaces the old state only after it succeeded."""

from __future__ import annotations

import time
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

ARTICLE_SCHEMA = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("title", T.StringType()),
        T.StructField("desc", T.StringType()),
        T.StructField("url", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("kind", T.StringType()),
        T.StructField("published", T.StringType()),
        T.StructField("seen", T.StringType()),
        T.StructField("anterior", T.StringType()),
        T.StructField("alterado", T.StringType()),
    ]
)


class StoreCorrupted(RuntimeError):
    """The store exists but cannot be read; starting empty would lose its history."""


def read_json_store(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines to articles with instants in UTC. A broken line or a row without id or date fails the read."""
    raw = spark.read.schema(ARTICLE_SCHEMA).option("mode", "FAILFAST").json(path)
    complete = F.col("id").isNotNull() & F.col("published").isNotNull()
    guard = F.when(~complete, F.raise_error(F.lit("article without id or date"))).otherwise(F.col("id"))
    instant = lambda name: F.to_timestamp(F.col(name))  # noqa: E731  an explicit offset wins over the session zone
    return raw.withColumn("id", guard).select(
        "id", "title", "desc", "url", "source", "kind", instant("published").alias("published"), instant("seen").alias("seen"),
        "anterior", instant("alterado").alias("alterado"),
    )


def load_store(spark: SparkSession, path: str) -> DataFrame:
    """The store, an empty one when nothing was written yet, or ``StoreCorrupted``."""
    if not _exists(spark, path):
        return read_json_store_empty(spark)
    store = read_json_store(spark, path)
    try:
        store.agg(F.count("id"), F.max("published")).first()
    except (PySparkException, Py4JJavaError) as exc:
        raise StoreCorrupted(f"cannot read the store at {path}") from exc
    return store


def read_json_store_empty(spark: SparkSession) -> DataFrame:
    schema = T.StructType(
        [T.StructField(f.name, T.TimestampType() if f.name in ("published", "seen", "alterado") else f.dataType) for f in ARTICLE_SCHEMA]
    )
    return spark.createDataFrame([], schema)


def _exists(spark: SparkSession, path: str) -> bool:
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jvm_path)


def write_version(df: DataFrame, root: str, partition_by: str | None = None) -> str:
    """Write a new version that no reader sees yet."""
    version = uuid.uuid4().hex
    writer = df.write.mode("errorifexists")
    (writer.partitionBy(partition_by) if partition_by else writer).parquet(f"{root}/v={version}")
    return version


def point_to(spark: SparkSession, root: str, version: str) -> None:
    """Pointers are never changed or removed: each is written whole under a name of its own, and the last one by name counts."""
    spark.createDataFrame([(version,)], "version string").coalesce(1).write.json(f"{root}/_pointers/{time.time_ns():020d}-{version}")


def publish(df: DataFrame, root: str, check=None, partition_by: str | None = None) -> str:
    """Write a new version, check what was written, then move the pointer; readers never see half a state.

    ``check`` takes the written rows and raises to keep the previous version.
    """
    version = write_version(df, root, partition_by)
    if check is not None:
        check(df.sparkSession.read.parquet(f"{root}/v={version}"))
    point_to(df.sparkSession, root, version)
    return version


def current(spark: SparkSession, root: str) -> DataFrame:
    """The version published last."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/_pointers")
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [x.getPath().getName() for x in fs.listStatus(path)]
    whole = [n for n in names if _exists(spark, f"{root}/_pointers/{n}/_SUCCESS")]
    version = spark.read.schema("version string").json(f"{root}/_pointers/{max(whole)}").first()["version"]
    return spark.read.parquet(f"{root}/v={version}")
