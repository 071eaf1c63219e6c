"""The given tables seen as the library's inputs: headlines, feed items, claims, subscribers, logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pressloom.functions import dates, text, urls

NOW = "2024-01-30 00:00:00"


def now():
    return dates.moment(NOW)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def source_number(source):
    return F.substring(source, 4, 10).cast("int")


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Source dimension: one row per outlet seen in the documents; outlets from number 10 are regional."""
    seen = table(spark, sf_dir, "documents").select("source").distinct().withColumn("n", source_number("source"))
    nation = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("n"), F.col("n_name").alias("state"))
    group = F.when(F.col("n") < 2, "checagem").when(F.col("n") < 4, "oficial").when(F.col("n") < 10, "nacional").otherwise("regional")
    return (
        seen.join(nation, "n", "left")
        .withColumn("grupo", group)
        .select(
            F.col("source").alias("id"),
            F.concat(F.lit("Outlet "), F.col("n").cast("string")).alias("name"),
            F.when(F.col("n") < 2, "checagem").otherwise("noticia").alias("kind"),
            F.concat(F.lit("https://www."), F.col("source"), F.lit(".example.org/home")).alias("home"),
            "grupo",
            F.when(F.col("grupo") == "regional", F.col("state")).otherwise("").alias("uf"),
            "n",
        )
    )


def raw_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as delivered by feeds: the first line is the title, the rest is the description."""
    d = table(spark, sf_dir, "documents")
    return d.select(
        "doc_id",
        "source",
        "lang",
        "n_chars",
        F.substring_index("text", "\n", 1).alias("raw_title"),
        F.regexp_replace("text", r"^[^\n]*\n?", "").alias("raw_desc"),
        F.concat(F.lit("https://"), "source", F.lit(".Example.org/"), "lang", F.lit("/"), F.col("doc_id").cast("string"), F.lit("?utm_source=feed")).alias("raw_url"),
        (F.to_timestamp(F.lit(NOW)) - F.make_dt_interval(mins=(F.col("doc_id") * 37 % 20160).cast("int"))).alias("published"),
    )


def headlines(spark: SparkSession, sf_dir: str, body: bool = False) -> DataFrame:
    """The article store: id, title, desc, url, source, kind, published (and the whole body where asked for)."""
    r = raw_items(spark, sf_dir)
    title = text.short(text.clean(F.col("raw_title")), 300)
    n = source_number(F.col("source"))
    columns = [
        "doc_id",
        urls.article_id(F.col("raw_url")).alias("id"),
        title.alias("title"),
        text.short(text.clean(F.col("raw_desc"))).alias("desc"),
        urls.canonical(F.col("raw_url")).alias("url"),
        "source",
        F.when(n < 2, "checagem").otherwise("noticia").alias("kind"),
        F.when(n < 2, "checagem").when(n < 4, "oficial").when(n < 10, "nacional").otherwise("regional").alias("grupo"),
        "published",
        "lang",
    ]
    if body:
        columns.append(F.col("raw_desc").alias("body"))
    return r.select(*columns)
