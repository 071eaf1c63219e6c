"""From feed entries to the article store."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pressloom.functions import dates, text, urls
from pressloom.functions import fixed_values as fv
from pressloom.operators.leaders import first_wins
from pressloom.operators.ranking import top_per_group


def addresses(sources: DataFrame) -> DataFrame:
    """One row per address of a source: its list, or its single address."""
    listed = F.when(F.size("urls") > 0, F.col("urls"))
    single = F.when(F.coalesce(F.col("url"), F.lit("")) != "", F.array("url")).otherwise(F.array().cast("array<string>"))
    return sources.select("id", F.posexplode(F.coalesce(listed, single)).alias("pos", "address"))


def swap_label_titles(entries: DataFrame, sources: DataFrame) -> DataFrame:
    """Feeds that put a label in the title: a title of at most five words gives way to a longer description."""
    flags = sources.select(F.col("id").alias("source"), "titulo_na_descricao")
    joined = entries.join(flags, "source", "left")
    words = text.word_count(F.col("title"))
    swap = (
        F.coalesce(F.col("titulo_na_descricao"), F.lit(False))
        & (F.col("desc") != "")
        & (words <= 5)
        & (text.word_count(F.col("desc")) > words)
    )
    return (
        joined.withColumn("new_title", F.when(swap, text.short(F.col("desc"), fv.MAX_TITLE)).otherwise(F.col("title")))
        .withColumn("desc", F.when(swap, F.col("title")).otherwise(F.col("desc")))
        .drop("title", "titulo_na_descricao")
        .withColumnRenamed("new_title", "title")
    )


def keep_flag(
    url: Column, title: Column, desc: Column, include: Column, exclude: Column, relevant_only: Column,
    noise: list[str] | None = None, relevant: Column | None = None,
) -> Column:
    """Noise out, excluded sections out, included sections in, then the relevance test or the absence of a list."""
    patterns = fv.NOISE_TITLES if noise is None else noise
    noisy = title.rlike("(?i)" + "|".join(f"(?:{p})" for p in patterns)) if patterns else F.lit(False)
    has = lambda parts: F.exists(F.coalesce(parts, F.array().cast("array<string>")), lambda x: F.contains(url, x))
    passes = text.is_relevant(F.concat_ws(" ", title, desc)) if relevant is None else relevant
    return (
        F.when(noisy | has(exclude), F.lit(False))
        .when(has(include), F.lit(True))
        .when(F.coalesce(relevant_only, F.lit(False)), passes)
        .otherwise(F.coalesce(F.size(include), F.lit(0)) <= 0)
    )


def merge_addresses(entries: DataFrame) -> DataFrame:
    """Feed and sitemap rows of one source as one row per link (or title): first description and first date win.

    ``entries``: source, pos, title, url, desc, published. Minimum-by aggregates combine before the shuffle.
    """
    link = F.when(F.col("url") != "", urls.canonical(F.col("url"))).otherwise(F.concat(F.lit("t|"), F.col("title")))
    with_desc = F.when(F.col("desc") != "", F.col("pos"))
    with_date = F.when(F.col("published").isNotNull(), F.col("pos"))
    return (
        entries.withColumn("link", link)
        .groupBy("source", "link")
        .agg(
            F.min("pos").alias("pos"),
            F.min_by(F.struct("title", "url"), "pos").alias("first"),
            F.coalesce(F.min_by("desc", with_desc), F.lit("")).alias("desc"),
            F.min_by("published", with_date).alias("published"),
        )
        .select("source", "pos", "first.title", "first.url", "desc", "published", "link")
    )


def newest_per_source(entries: DataFrame, limits: DataFrame | None = None, default: int = fv.PER_SOURCE_LIMIT) -> DataFrame:
    """The newest rows of each source up to its own limit; undated rows last, then delivery order."""
    order = [F.col("published").desc_nulls_last(), F.col("pos").asc()]
    if limits is None:
        return top_per_group(entries, ["source"], order, default)
    own = entries.join(limits.select("source", "limite"), "source", "left")
    return top_per_group(own, ["source"], order, F.coalesce(F.col("limite"), F.lit(default))).drop("limite")


def admit(entries: DataFrame, now: Column, window_days: int = fv.WINDOW_DAYS) -> DataFrame:
    """Undated and future rows count as now; rows older than the window are dropped."""
    admitted = entries.withColumn("published", dates.admitted_time(F.col("published"), now))
    return admitted.where(F.col("published") >= now - F.make_dt_interval(days=F.lit(window_days)))


def with_keys(entries: DataFrame) -> DataFrame:
    return entries.withColumn("id", urls.article_id(F.col("url"))).withColumn(
        "title_key", text.title_key(F.col("source"), F.col("title"))
    )


def unknown(entries: DataFrame, store: DataFrame) -> DataFrame:
    """Entries whose id the store does not hold."""
    return entries.join(store.select("id"), "id", "left_anti")


def unknown_titles(entries: DataFrame, store: DataFrame) -> DataFrame:
    """Entries whose source and title the store does not hold."""
    known = store.select(text.title_key(F.col("source"), F.col("title")).alias("title_key"))
    return entries.join(known, "title_key", "left_anti")


def drop_repeats(entries: DataFrame, order: str) -> DataFrame:
    """In-batch de-duplication on id and title key at once, exactly as the one-pass loop decides it."""
    return first_wins(entries, order, "id", "title_key")


@F.pandas_udf(T.DoubleType())
def matching_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Matching-block ratio of two words; rows with a null are not compared."""
    return pd.Series(
        [SequenceMatcher(None, x, y).ratio() if isinstance(x, str) and isinstance(y, str) else None for x, y in zip(a, b)],
        dtype="float64",
    )


def _title_words(title: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(text.fold_grouping(title), F.lit("[a-z0-9]+"), F.lit(0)))


def title_changed(old: Column, new: Column) -> Column:
    """At least two words differ, and not just one misspelt word put right."""
    gone = F.array_except(_title_words(old), _title_words(new))
    came = F.array_except(_title_words(new), _title_words(old))
    swap = (F.size(gone) == 1) & (F.size(came) == 1)
    ratio = matching_ratio(F.when(swap, gone[0]), F.when(swap, came[0]))
    return (F.size(gone) + F.size(came) >= 2) & ~(swap & F.coalesce(ratio >= 0.8, F.lit(False)))


def title_revisions(store: DataFrame, entries: DataFrame) -> DataFrame:
    """Known articles whose outlet changed the title; going back to the first title does not count."""
    incoming = entries.select("id", F.col("title").alias("new_title"))
    first = F.coalesce(F.col("anterior"), F.col("title"))
    return (
        store.join(incoming, "id")
        .where(F.col("title") != F.col("new_title"))
        .where(title_changed(F.col("title"), F.col("new_title")) & title_changed(first, F.col("new_title")))
        .select("id", F.col("new_title").alias("title"), first.alias("anterior"))
    )


def apply_revisions(store: DataFrame, revisions: DataFrame, now: Column) -> DataFrame:
    """The store with revised titles, the first title and the time of the change."""
    changed = revisions.select("id", F.struct("title", "anterior").alias("revision"))
    joined = store.join(changed, "id", "left")
    was = F.col("revision").isNotNull()
    return (
        joined.withColumn("title", F.when(was, F.col("revision.title")).otherwise(F.col("title")))
        .withColumn("anterior", F.when(was, F.col("revision.anterior")).otherwise(F.col("anterior")))
        .withColumn("alterado", F.when(was, now).otherwise(F.col("alterado")))
        .drop("revision")
    )


def link_outcomes(articles: DataFrame, crawl_log: DataFrame) -> DataFrame:
    """Articles with the outcome of their link: ok, dead, uncertain or unchecked.

    ``crawl_log``: url, status, final_url. Only an outlet saying itself that the page is gone makes a link dead.
    """
    deep = F.regexp_replace(urls.path(F.col("url")), "^/+|/+$", "") != ""
    landed_home = F.regexp_replace(urls.path(F.coalesce(F.col("final_url"), F.lit(""))), "^/+|/+$", "") == ""
    status = F.col("status")
    outcome = (
        F.when(status.isNull() & F.col("seen_in_log").isNull(), "unchecked")
        .when(status.isin(404, 410), "dead")
        .when(status.between(200, 399) & deep & landed_home, "dead")
        .when(status.between(200, 399), "ok")
        .otherwise("uncertain")
    )
    log = crawl_log.select("url", "status", "final_url", F.lit(True).alias("seen_in_log"))
    return articles.join(log, "url", "left").withColumn("outcome", outcome).drop("seen_in_log")


def validate(articles: DataFrame, crawl_log: DataFrame) -> DataFrame:
    """Title and link checks with the reason of a rejection; in doubt a row is accepted."""
    checked = link_outcomes(articles.withColumn("reason", text.bad_title_reason(F.col("title"))), crawl_log)
    reason = (
        F.when(F.col("reason") != "", F.col("reason"))
        .when((F.col("outcome") == "dead") & F.col("status").isin(404, 410), F.concat(F.lit("HTTP "), F.col("status").cast("string")))
        .when(F.col("outcome") == "dead", "landed on the home page")
        .otherwise("")
    )
    return checked.withColumn("reason", reason).withColumn("accepted", F.col("reason") == "")


def retain(articles: DataFrame, cap: int = fv.STORE_CAP, floor: int = fv.STORE_FLOOR_PER_SOURCE) -> DataFrame:
    """The newest ``cap`` rows overall, and in any case the newest ``floor`` rows of every source."""
    order = [F.col("published").desc(), F.col("id").asc()]
    newest = articles.orderBy(*order).limit(cap)
    per_source = top_per_group(articles, ["source"], order, floor)
    return newest.unionByName(per_source).dropDuplicates(["id"])


def collection_stats(sources: DataFrame, entries: DataFrame, usable: DataFrame, added: DataFrame, failures: DataFrame) -> DataFrame:
    """Per source: delivered, usable and new rows, and whether any address answered."""

    def count(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy("source").agg(F.count(F.lit(1)).alias(name))

    out = sources.select(F.col("id").alias("source"), "name")
    for df, name in ((entries, "items"), (usable, "usable"), (added, "new")):
        out = out.join(count(df, name), "source", "left")
    down = failures.groupBy("source").agg(F.min("error").alias("error"))
    return (
        out.join(down, "source", "left")
        .fillna(0, ["items", "usable", "new"])
        .fillna("", ["error"])
        .withColumn("ok", F.col("error") == "")
    )
