"""Common words counted block by block, against all pairs; best titles per claim and per article, against a plain scan."""

from __future__ import annotations

import random
from collections import Counter
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from pressloom.operators import evidence, overlap, retrieval

#: A few words stand in nearly every set.
WORDS = [f"word{i:02d}" for i in range(40)]


def sets(n, seed):
    rng = random.Random(seed)
    return [sorted({WORDS[int(40 * rng.random() ** 2)] for _ in range(rng.randint(0, 12))}) for _ in range(n)]


def best(pairs, key, per_key, limit):
    taken, out = Counter(), []
    for shared, o in sorted(pairs, key=lambda p: (-p[0], p[1])):
        taken[key[o]] += 1
        if taken[key[o]] <= per_key:
            out.append((shared, o))
    return out[:limit]


@pytest.fixture(params=[(1 << 18, 1 << 17), (40, 25)], ids=["one block", "many blocks"])
def blocks(request, monkeypatch):
    monkeypatch.setattr(overlap, "BLOCK", request.param[0])
    monkeypatch.setattr(overlap, "QUERIES", request.param[1])
    monkeypatch.setattr(overlap, "CELLS", 4)
    monkeypatch.setattr(overlap, "AT_ONCE", 64)


def test_all_pairs_and_the_best_of_them(spark, blocks):
    asked, held = sets(90, 1), sets(130, 2)
    queries = spark.createDataFrame([(i, w, min(3, len(w)), w[:2], 2 if i % 3 == 0 else 0) for i, w in enumerate(asked)], "q long, words array<string>, needed int, few array<string>, few_needed int")
    key = [None if i % 7 == 0 else f"k{i % 7 // 2}" for i in range(len(held))]
    index = spark.createDataFrame([(i, w, key[i]) for i, w in enumerate(held)], "o long, words array<string>, key string").repartition(3)

    def pairs(q, few):
        w = set(asked[q])
        for o, d in enumerate(held):
            n = len(w & set(d))
            if n >= max(1, min(3, len(w))) or (few and q % 3 == 0 and len(set(asked[q][:2]) & set(d)) >= 2):
                yield n, o

    plain = {(q, o, n) for q in range(len(asked)) for n, o in pairs(q, False)}
    assert {tuple(r) for r in overlap.shared_words(queries.drop("few", "few_needed"), index).collect()} == plain and len(plain) > 1000
    for per_key, limit in ((1, None), (2, 8), (1, 3), (50, 5)):
        rows = overlap.shared_words(queries, index, per_key, limit).collect()
        found = {q: [] for q in range(len(asked))}
        for q, o, n in rows:
            found[q].append((n, o))
        for q in found:
            assert best(found[q], key, per_key, limit) == best(pairs(q, True), key, per_key, limit)
            assert overlap.BLOCK == 40 or len(found[q]) <= (limit or len(held))  # one block: only the best leave the task


def test_empty_sides(spark):
    queries = spark.createDataFrame([(1, ["aaaa"], 1)], "q long, words array<string>, needed int")
    index = spark.createDataFrame([(5, ["aaaa"])], "o long, words array<string>")
    assert [tuple(r) for r in overlap.shared_words(queries, index).collect()] == [(1, 5, 1)]
    assert overlap.shared_words(queries.where("q = 0"), index).count() == 0 and overlap.shared_words(queries, index.where("o = 0")).count() == 0


def test_claims_and_articles_against_a_scan(spark, blocks):
    rng = random.Random(3)
    start = datetime(2024, 1, 1)
    rows = [(f"i{i:03d}", " ".join(w), f"https://o{i % 5}.org/{i}", f"o{i % 5}", "noticia", "nacional", "", start + timedelta(hours=rng.randint(0, 30))) for i, w in enumerate(sets(120, 4))]
    index = spark.createDataFrame(rows, "id string, title string, url string, source string, kind string, grupo string, desc string, published timestamp")
    asked = [(f"q{i}", w[:3], w) for i, w in enumerate(sets(40, 5))]
    claims = spark.createDataFrame(asked, "qid string, b array<string>, w array<string>")
    expected = set()
    for qid, b, w in asked:
        hits = []
        for r in rows:
            terms = set(r[1].split())
            shared = len(terms & set(w))
            if w and (shared >= min(3, len(w)) or len(terms & set(b)) >= -(-len(b) * 6 // 10)):
                hits.append((-shared, -r[7].timestamp(), r[0], r[3]))
        taken, place = Counter(), 0
        for s, _, i, outlet in sorted(hits):
            taken[outlet] += 1
            if taken[outlet] <= 2 and place < 8:
                place += 1
                expected.add((qid, i, -s, place))
    found = retrieval.coverage_candidates(claims, index).select("qid", "id", "shared", "place")
    assert {tuple(r) for r in found.collect()} == expected and len(expected) > 100
    told = retrieval.questions(index).select("article", "qid").join(retrieval.other_outlets(retrieval.same_story(index, index)), "qid")
    others = set()
    for r in rows:
        mine, ranked = set(r[1].split()), []
        for outlet in {x[3] for x in rows} - {r[3]}:
            hits = [(-len(mine & set(x[1].split())), -x[7].timestamp(), x[0]) for x in rows if x[3] == outlet and len(mine & set(x[1].split())) >= 3]
            ranked += sorted(hits)[:1]
        others |= {(r[0], i, -s, n + 1) for n, (s, _, i) in enumerate(sorted(ranked)[:4])} if len(mine) >= 3 else set()
    assert {tuple(r) for r in told.select("article", "id", "shared", "place").collect()} == others and len(others) > 100


def test_equal_queries_and_long_descriptions(spark):
    queries = spark.createDataFrame([("a", ["x1", "x2"]), ("a", ["x2", "x1"]), ("b", ["x1", "x2"]), (None, ["x1"]), ("c", [])], "qid string, terms array<string>")
    index = spark.createDataFrame([("d", ["x1", "x2", "x3"]), ("e", ["x3"])], "did string, terms array<string>")
    found = Counter(tuple(r) for r in retrieval.find(queries, index, F.lit(2)).collect())
    assert found == {("a", "d", 2): 4, ("b", "d", 2): 1}


def test_descriptions_are_squeezed_once(spark):
    said = " ".join(f"palavra{i}" for i in range(9))
    rows = [("q", 0, "Outra coisa", f" {said}\n"), ("q", 1, "Outra coisa", said.upper()), ("q", 2, "Outra coisa", None), ("q", 3, said, said), ("q", 4, None, said + " mais"), ("r", 0, "t", said)]
    found = evidence.useful_descriptions(spark.createDataFrame(rows, "qid string, pos int, title string, value string"))
    assert {tuple(r) for r in found.select("qid", "pos", "value").collect()} == {("q", 0, said), ("q", 4, said + " mais"), ("r", 0, said)}
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count(r"(?U)\s+") == 1


def above_the_cells(df):
    """The steps that the pairs still go through when they have left the cells."""
    return df._jdf.queryExecution().optimizedPlan().toString().split("MapInArrow")[0]


def test_pairs_leave_the_cells_whole(spark, blocks):
    rng = random.Random(6)
    start = datetime(2024, 1, 1)
    held = sets(120, 7)
    kinds = ["É falso que ", "É verdade, mas ", "É verdade que não ", "Fato ou Fake: ", ""]
    titles = [None if i == 5 else kinds[i % 5] + " ".join(w) for i, w in enumerate(held)]
    rows = [(f"i{i:03d}", t, f"https://o{i % 5}.org/{i}", "o", "noticia" if i % 9 == 0 else "checagem", start + timedelta(hours=rng.randint(0, 30))) for i, t in enumerate(titles)]
    index = spark.createDataFrame(rows + rows[:2], "id string, title string, url string, source string, kind string, published timestamp")
    asked = [(f"q{i}", w, i % 3 == 0) for i, w in enumerate(sets(40, 8))]
    asked += [("q1", asked[1][1], True), (None, held[0], False)]
    claims = spark.createDataFrame(asked, "qid string, terms array<string>, negado boolean")
    terms = {r[0]: set(r[1].split()) & set(WORDS) if r[1] else set() for r in rows}
    every = Counter(r[0] for r in rows + rows[:2])
    expected, checked = Counter(), Counter()
    for qid, w, _ in asked:
        times = sum(a[0] == qid for a in asked)
        for r in rows if qid else []:
            shared = len(set(w) & terms[r[0]])
            if shared >= 2:
                expected[qid, r[0], shared] += times * every[r[0]]
            if w and shared >= min(3, len(w)) and r[4] == "checagem":
                verdict = {0: ("falso", [False]), 1: ("misto", [False, True]), 2: ("verdadeiro", [True])}.get(int(r[0][1:]) % 5)
                for a in asked:
                    if a[0] == qid:
                        checked[qid, r[0], shared, verdict[0] if verdict and a[2] in verdict[1] else ""] += times * every[r[0]]
    matches = retrieval.title_matches(claims, index, F.lit(2))
    assert Counter(tuple(r) for r in matches.select("qid", "id", "shared").collect()) == expected and len(expected) > 500
    found = retrieval.index_checks(claims, index, ("id",))
    assert Counter(tuple(r) for r in found.select("qid", "id", "shared", "classe").collect()) == checked and len(checked) > 300
    assert "Join" not in above_the_cells(matches) and "Join" not in above_the_cells(found)
    few = retrieval.title_matches(claims, index, F.lit(2), limit=3)
    first = lambda df: Counter(tuple(r) for r in retrieval.top_per_group(df, ["qid"], retrieval.best_order(), 3, rank="place").collect())
    assert first(few) == first(matches) and few.count() < matches.count()


def test_delivered_and_merged_checks_against_every_row(spark, blocks):
    rng = random.Random(9)
    start = datetime(2024, 1, 1)
    labels = ["Falso", "Verdadeiro", "Enganoso", "?", "", None]
    classes = {"Falso": "falso", "Verdadeiro": "verdadeiro", "Enganoso": "enganoso"}
    leads = {"É falso que ": "falso", "É verdade, mas ": "misto", "Fato ou Fake: ": ""}
    asked = [(f"q{i}", w, i % 2 == 0) for i, w in enumerate(sets(30, 10))]
    claims = spark.createDataFrame(asked, "qid string, terms array<string>, negado boolean")
    held = [(f"i{i:03d}", [*leads][i % 3], w, f"https://o{i % 5}.org/{i // 2 * 2}{'/' * (i % 2)}", start + timedelta(hours=i)) for i, w in enumerate(sets(100, 11))]
    index = spark.createDataFrame([(i, lead + " ".join(w), u, "s", "checagem", t) for i, lead, w, u, t in held], "id string, title string, url string, source string, kind string, published timestamp")
    results, said = [], sets(40, 12)
    for qid, w, _ in asked:
        for rid in rng.sample(range(100), 45):
            own = rng.choice([" ".join(w[1:]), "não " + " ".join(w), "", None])
            results.append((qid, rid, own, rng.choice([None, "nunca " + " ".join(said[rid % 40])]), rng.choice(labels), held[rid][3] if rid % 9 else "ftp://x", None, "p"))
    delivered = spark.createDataFrame(results, "qid string, rid long, claim_text string, review_title string, rating string, url string, published timestamp, publisher string")

    def guarded(kind, denies, negado):
        return "" if kind in ("falso", "verdadeiro") and denies != negado else kind

    kept = Counter()
    lists = {qid: [] for qid, _, _ in asked}
    by_claim = {qid: (set(w), negado) for qid, w, negado in asked}
    for qid, rid, own, title, rating, url, _, _ in results:
        terms, negado = by_claim[qid]
        shared = len(terms & set(f"{own or ''} {title or ''}".split()))
        if url != "ftp://x" and shared >= min(2, len(terms)):
            about = (own or title or "").split()
            kind = guarded(classes.get(rating, ""), "não" in about or "nunca" in about, negado)
            kept[qid, rid, shared, kind] += 1
            lists[qid].append((0, rid, url.rstrip("/"), kind, shared))
    found = retrieval.delivered_checks(claims, delivered)
    assert found.columns == [*delivered.columns, "shared", "classe"]
    assert Counter(tuple(r) for r in found.select("qid", "rid", "shared", "classe").collect()) == kept and len(kept) > 300
    for qid, w, negado in asked:
        for _, lead, words, url, published in held:
            shared = len(set(w) & set(words))
            if w and shared >= min(3, len(w)):
                lists[qid].append((1, -int((published - datetime(1970, 1, 1)).total_seconds()), url.rstrip("/"), guarded(leads[lead], False, negado), shared))
    expected = set()
    for qid, rows in lists.items():
        links = {}
        for row in sorted(rows):
            links.setdefault(row[2], row)
        best_of = sorted(links.values(), key=lambda r: (r[3] == "", -r[4], r[0], r[1]))[:5]
        expected |= {(qid, link, kind, shared, place + 1) for place, (_, _, link, kind, shared) in enumerate(best_of)}
    for ahead in (1, None):  # of one link a claim the first round settles few
        merged = retrieval.merged_checks(claims, index, delivered, ahead=ahead).select("qid", F.regexp_replace("url", "/$", ""), "classe", "shared", "place")
        assert sorted(tuple(r) for r in merged.collect()) == sorted(expected) and len(expected) > 100
