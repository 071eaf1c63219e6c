"""Full enrichment of the article store: serving columns, topics, people, states and the strict story number."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pressloom.functions import text
from pressloom.operators import coverage, listings, tagging


def tag(articles: DataFrame, value: Column, title: Column, default_state: Column, config: dict | None = None) -> DataFrame:
    """``topics``, ``pessoas_t`` (title), ``pessoas``, ``ufs``, ``ufs_txt`` and ``uf_fonte``; ``config`` replaces the fixed lists."""
    c = config or {}
    tagged = (
        articles.withColumn("topics", tagging.topics(value, c.get("topics")))
        .withColumn("pessoas_t", tagging.people(title, c.get("people")))
        .withColumn("pessoas", tagging.people(value, c.get("people")))
    )
    return tagging.with_states(tagged, value, default_state, c.get("states"))


def enrich(articles: DataFrame, sources: DataFrame, now: Column, blocked: DataFrame | None = None, config: dict | None = None, grow: bool = False) -> DataFrame:
    """Store rows to publishable rows. Shuffles only for the story number. ``grow``: see ``coverage.number_stories``."""
    served = listings.serve(articles, sources, now, blocked)
    tagged = tag(served, F.concat_ws(" ", "title", "desc"), F.col("title"), F.when(F.col("grupo") == "regional", F.col("uf")), config)
    news = coverage.number_stories(tagged.where(F.col("kind") == "noticia"), text.grouping_tokens(F.col("title")), grow)
    checks = tagged.where(F.col("kind") != "noticia").withColumn("gid", F.lit(None).cast("string"))
    return news.unionByName(checks)
