"""Dictionaries as tables against one regular expression, and channels."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from pressloom.functions import text
from pressloom.operators import dictionary, tagging

TEXTS = ["O Senado aprova; câmara dos  deputados não", "eua na continuação", "senadores, EUA e MP", "MPs e mp", "with-the with the WITH-THE-x", "", None, "ação-penal acao penalx", "the then that the"]


def table(spark, rows, schema="key string, term string, ord int"):
    return spark.createDataFrame(rows, schema)


def docs(spark, texts=TEXTS):
    return spark.createDataFrame(list(enumerate(texts)), "n int, t string").repartition(3)


def test_topics_equal_the_pattern(spark):
    listed = {"casa": ["câmara dos deputados", "senad"], "fora": ["eua"], "lei": ["ação penal", "penal"]}
    rows = [(k, term, i) for i, (k, terms) in enumerate(listed.items()) for term in terms] + [("casa", "", 0), ("casa", None, 0)]
    df = docs(spark)
    found = dictionary.keys_named(df, "n", F.col("t"), table(spark, rows))
    expected = df.select("n", "t", tagging.topics(F.col("t"), listed).alias("keys"))
    assert sorted(map(str, found.collect())) == sorted(map(str, expected.collect()))


def test_words_used_equal_one_alternation(spark):
    words = ["the", "with-the", "with the", "that", "ação", "penal"]
    rng = random.Random(4)
    parts = ["the", "with", "-", " ", ", ", "that", "acao", "PENAL", "x", "the "]
    df = docs(spark, TEXTS + ["".join(rng.choice(parts) for _ in range(12)) for _ in range(200)])
    found = dictionary.words_used(df, "n", F.col("t"), table(spark, [(None, w, 0) for w in words])).groupBy("id", "term").count()
    expected = df.select("n", F.explode(tagging.framing_words(F.col("t"), words)).alias("term")).groupBy("n", "term").count()
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, expected.collect()))


def test_relevance(spark):
    prefixes, acronyms = ["senad", "camara dos deputados"], ["MP", "EUA"]
    df = docs(spark)
    found = dictionary.relevant_rows(df, "n", F.col("t"), table(spark, [(None, p, 0) for p in prefixes]), table(spark, [(None, a, 0) for a in acronyms]))
    expected = df.where(text.is_relevant(F.col("t"), prefixes, acronyms)).select("n")
    assert sorted(r[0] for r in found.collect()) == sorted(r[0] for r in expected.collect())


def test_people(spark):
    patterns = {"ana": r"\bthat\b(?! the)", "bo": r"(?<!dos )\bdeputados"}
    rows = [("ana", "that", patterns["ana"], 0), ("bo", "deputados", patterns["bo"], 1)]
    df = docs(spark, [*TEXTS, "that the", "that they", "deputados"])
    found = dictionary.patterns_named(df, "n", F.col("t"), table(spark, rows, "key string, term string, pattern string, ord int"))
    expected = df.select("n", "t", tagging.people(F.col("t"), patterns).alias("keys"))
    assert sorted(map(str, found.collect())) == sorted(map(str, expected.collect()))


def test_a_channel_replaces_whole_dictionaries(spark):
    rows = [(None, "topic", "a", "x"), (None, "topic", "b", "y"), (None, "word", None, "w"), ("sports", "topic", "c", "z"), ("arts", "word", None, "v")]
    dims = spark.createDataFrame(rows, "channel string, kind string, key string, term string")
    at = lambda c: sorted(map(tuple, dictionary.of_channel(dims, c).collect()), key=str)
    assert at("sports") == sorted([("topic", "c", "z"), ("word", None, "w")], key=str)
    assert at("arts") == sorted([("topic", "a", "x"), ("topic", "b", "y"), ("word", None, "v")], key=str)
    assert len(at("none")) == 3


def test_a_hundred_thousand_terms(spark):
    rng = random.Random(9)
    terms = list({"".join(rng.choice("abcdefgh") for _ in range(rng.randint(3, 12))) + rng.choice(["", "", " ab"]) for _ in range(110_000)})[:100_000]
    texts = [" ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(3, 12))) for _ in range(40)) for _ in range(60)]
    df = docs(spark, texts)
    found = dictionary.hits(df, "n", F.col("t"), spark.createDataFrame([(t,) for t in terms], "term string"), "a-z", whole=True)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert len(plan) < 20_000
    listed, expected = set(terms), set()
    for n, t in enumerate(texts):
        words = t.split(" ")
        expected |= {(n, i, w) for i, w in enumerate(words) if w in listed}
        expected |= {(n, i, f"{a} {b}") for i, (a, b) in enumerate(zip(words, words[1:])) if f"{a} {b}" in listed}
    assert {tuple(r) for r in found.select("id", "place", "term").collect()} == expected and len(expected) > 100


def test_empty_tables(spark):
    none = table(spark, [])
    assert [r["keys"] for r in dictionary.keys_named(docs(spark), "n", F.col("t"), none).collect()] == [[]] * len(TEXTS)
    assert dictionary.words_used(docs(spark, []), "n", F.col("t"), none).count() == 0


def test_few_terms_shuffle_no_word_starts(spark):
    """The terms come from Python rows, whose size Spark does not know; the word starts must stay where they are all the same."""
    listed = table(spark, [("lei", "penal", 0), ("fora", "eua", 1), ("none", None, 2)])
    found = dictionary.hits(docs(spark), "n", dictionary.plain(F.col("t")), dictionary.folded_terms(listed), dictionary.WORD, whole=False)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "hashpartitioning(__key" not in plan
    assert {(r.id, r.term) for r in found.collect()} == {(1, "eua"), (2, "eua"), (7, "penal"), (7, "penal")}
