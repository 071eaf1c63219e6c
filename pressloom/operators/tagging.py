"""What a headline is about: topics, people, states, framing words, denial alerts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pressloom.functions import dates, places, text, verdicts
from pressloom.functions import fixed_values as fv


def matching_names(folded: Column, patterns: dict[str, str]) -> Column:
    """Names whose pattern occurs, in configuration order; one pass, no join, no Python."""
    if not patterns:
        return F.array().cast("array<string>")
    return F.array_compact(F.array(*[F.when(folded.rlike(p), F.lit(name)) for name, p in patterns.items()]))


def topics(value: Column, keywords: dict[str, list[str]] | None = None) -> Column:
    """Topics with a keyword at the start of a word of the folded text."""
    table = fv.TOPICS if keywords is None else keywords
    patterns = {t: text.prefix_pattern([text.plain_fold(k).strip() for k in ks]) for t, ks in table.items()}
    return matching_names(text.fold_grouping(value), patterns)


def people(value: Column, patterns: dict[str, str] | None = None) -> Column:
    return matching_names(text.fold_grouping(value), fv.PEOPLE if patterns is None else patterns)


def with_states(df: DataFrame, value: Column, default: Column, states: dict | None = None) -> DataFrame:
    """``ufs`` (with the state of a regional outlet) and ``ufs_txt`` (text only); a text naming many states is national."""
    named = df.withColumn("__named", places.state_codes(value, states))
    own = F.coalesce(default, F.lit(""))
    all_states = places.with_default(F.col("__named"), own)
    only_default = F.when(own != "", F.array(own)).otherwise(F.array().cast("array<string>"))
    return (
        named.withColumn("ufs", F.when(F.size(all_states) > fv.MAX_STATES, only_default).otherwise(all_states))
        .withColumn(
            "ufs_txt",
            F.when(F.size("__named") > fv.MAX_STATES, F.array().cast("array<string>")).otherwise(F.col("__named")),
        )
        .withColumn("uf_fonte", own)
        .drop("__named")
    )


def framing_words(value: Column, words: list[str] | None = None) -> Column:
    """Listed words as they occur, longest first, whole words only."""
    pattern = text.whole_word_pattern([text.plain_fold(w) for w in (fv.FRAMING_WORDS if words is None else words)])
    return F.regexp_extract_all(text.fold_grouping(value), F.lit(pattern), F.lit(0))


def framing_counts(df: DataFrame, value: Column, words: list[str] | None = None) -> DataFrame:
    """How often each source uses each listed word."""
    return (
        df.select("source", F.explode(framing_words(value, words)).alias("word"))
        .groupBy("source", "word")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def denial_alerts(checks: DataFrame, now: Column, hours: int = 24, limit: int = 10) -> DataFrame:
    """The newest fact checks that deny something."""
    fresh = (checks.kind == "checagem") & (dates.age_hours(F.col("published"), now) < hours)
    return (
        checks.where(fresh & verdicts.is_denial(F.col("title")))
        .orderBy(F.col("published").desc(), F.col("id").asc())
        .limit(limit)
    )
