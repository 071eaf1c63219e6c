"""Texts against dictionaries that are tables: topics, relevance words, framing words, people.

A dictionary is rows (key, term, ord), and its size is nowhere in the plan. Every place of a text where a word starts is a row with the
characters that follow; it meets the terms by an equi join on the first ``KEY`` characters (all of a shorter term), and the whole term
is compared afterwards. The terms are written first, so that Spark knows their size: while they are few, no word start is shuffled. Which dictionary a channel uses is decided by rows too: its own, where it has one of that kind, else the common one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pressloom.functions import text
from pressloom.session import cut_lineage

#: Characters by which terms and texts meet.
KEY = 8


def of_channel(dictionaries: DataFrame, channel: str) -> DataFrame:
    """``dictionaries`` (channel, kind, ...) -> the channel's rows, and the common ones (null channel) of the kinds it has none of."""
    own = dictionaries.where(F.col("channel") == channel)
    common = dictionaries.where(F.col("channel").isNull()).join(own.select("kind").distinct(), "kind", "left_anti")
    return own.unionByName(common.select(own.columns)).drop("channel")


def plain(value: Column) -> Column:
    """The folded text with single spaces, in which terms are looked for."""
    return F.trim(F.regexp_replace(text.fold_grouping(value), r"\s+", " "))


def hits(df: DataFrame, row_id: str, value: Column, terms: DataFrame, edge: str, whole: bool) -> DataFrame:
    """id, place (number of the word start), term and the other columns of ``terms``, for every place of a text where a term stands.

    A term starts where no character of the class ``edge`` stands before it; if ``whole``, it also ends where none follows. Terms start
    with a character of that class; null and empty terms match nothing.
    """
    known = cut_lineage(terms.where(F.length("term") > 0).withColumn("__key", F.substring("term", 1, KEY)))
    lengths, longest = known.agg(F.array_sort(F.collect_set(F.length("__key"))), F.max(F.length("term"))).first()  # at most KEY numbers
    starts = F.regexp_extract_all(value, F.lit(rf"(?s)(?<![{edge}])(?=([{edge}].{{0,{longest or 0}}}))"), F.lit(1))
    places = df.select(F.col(row_id).alias("id"), F.posexplode(starts).alias("place", "__ahead"))
    keyed = places.withColumn("__n", F.explode(F.array(*[F.lit(n) for n in lengths]).cast("array<int>"))).where(F.length("__ahead") >= F.col("__n"))
    met = keyed.withColumn("__key", F.substring(F.col("__ahead"), F.lit(1), F.col("__n"))).join(known, "__key")
    stands = F.startswith(F.col("__ahead"), F.col("term"))
    if whole:
        stands = stands & ~F.substring(F.col("__ahead"), F.length("term") + 1, F.lit(1)).rlike(f"[{edge}]")
    return met.where(stands).drop("__key", "__n", "__ahead")


def not_overlapping(found: DataFrame, edge: str) -> DataFrame:
    """Of each text's hits the leftmost, the longest of them, and so on behind its end: what one alternation of all terms would find.

    A term of n words covers n word starts. The list that is folded holds the hits of one text.
    """
    covered = F.size(F.regexp_extract_all("term", F.lit(f"[{edge}]+"), F.lit(0)))
    ordered = F.array_sort(F.collect_list(F.struct("place", (-F.length("term")).alias("shorter"), covered.alias("covered"), "term")))
    none = F.struct(F.lit(0).alias("free"), F.array().cast("array<struct<place:int,term:string>>").alias("kept"))

    def take(acc: Column, hit: Column) -> Column:
        taken = F.struct((hit["place"] + hit["covered"]).alias("free"), F.array_append(acc["kept"], F.struct(hit["place"].alias("place"), hit["term"].alias("term"))).alias("kept"))
        return F.when(hit["place"] >= acc["free"], taken).otherwise(acc)

    kept = found.groupBy("id").agg(ordered.alias("hits")).select("id", F.explode(F.aggregate("hits", none, take, lambda acc: acc["kept"])).alias("hit"))
    return kept.select("id", "hit.place", "hit.term")


WORD = r"\p{L}\p{N}_"
ASCII_WORD = "a-z0-9"
CAPITALS = "A-Za-zÀ-ÿ"


def folded_terms(dictionary: DataFrame) -> DataFrame:
    return dictionary.withColumn("term", plain(F.col("term")))


def keys_named(df: DataFrame, row_id: str, value: Column, dictionary: DataFrame, name: str = "keys") -> DataFrame:
    """``df`` with the keys that have a term at the start of a word of the folded text, in the dictionary's order (``ord`` of the key)."""
    found = hits(df, row_id, plain(value), folded_terms(dictionary), WORD, whole=False).select("id", "ord", "key").distinct()
    listed = found.groupBy("id").agg(F.array_sort(F.collect_set(F.struct("ord", "key"))).alias("__found"))
    joined = df.join(listed, df[row_id] == listed["id"], "left").drop(listed["id"])
    none = F.array().cast("array<string>")
    return joined.withColumn(name, F.coalesce(F.transform("__found", lambda x: x["key"]), none)).drop("__found")


def patterns_named(df: DataFrame, row_id: str, value: Column, patterns: DataFrame, name: str = "keys") -> DataFrame:
    """``df`` with the keys whose ``pattern`` occurs in the folded text. Each row of ``patterns`` (key, term, pattern, ord) names a term
    that starts a word wherever the pattern matches; only texts with that term are tested."""
    folded = df.select(F.col(row_id).alias("id"), text.fold_grouping(value).alias("__text"))
    near = hits(df, row_id, plain(value), folded_terms(patterns), WORD, whole=False).select("id", "key", "pattern", "ord").distinct()
    found = near.join(folded, "id").where("__text rlike pattern")
    listed = found.groupBy("id").agg(F.array_sort(F.collect_set(F.struct("ord", "key"))).alias("__found"))
    joined = df.join(listed, df[row_id] == listed["id"], "left").drop(listed["id"])
    none = F.array().cast("array<string>")
    return joined.withColumn(name, F.coalesce(F.transform("__found", lambda x: x["key"]), none)).drop("__found")


def relevant_rows(df: DataFrame, row_id: str, value: Column, prefixes: DataFrame, acronyms: DataFrame) -> DataFrame:
    """Ids of the texts with a listed word start in the folded text, or a listed acronym with its exact capitals."""
    starts = hits(df, row_id, plain(value), folded_terms(prefixes), WORD, whole=False).select("id")
    exact = hits(df, row_id, F.coalesce(value, F.lit("")), acronyms, CAPITALS, whole=True).select("id")
    return starts.unionByName(exact).distinct()


def words_used(df: DataFrame, row_id: str, value: Column, dictionary: DataFrame) -> DataFrame:
    """id, place, term: listed words as they occur in the folded text, longest first, whole words only."""
    found = hits(df, row_id, text.fold_grouping(value), dictionary.withColumn("term", text.fold_grouping(F.col("term"))).select("term").distinct(), ASCII_WORD, whole=True)
    return not_overlapping(found, ASCII_WORD)
