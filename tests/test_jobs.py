"""Boundary cases on small inputs, and brute force where SQL is no help."""

from __future__ import annotations

import math
import random
import re
from collections import Counter
from datetime import datetime, timedelta
from difflib import SequenceMatcher
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from pressloom.functions import chain, dates, places, text, urls, verdicts
from pressloom.operators import alerts, evidence, ingest, leaders, operations, place_check, tagging
from pressloom.operators.leaders import LOOSE, STRICT, Similarity, first_wins, similar_leaders
from pressloom.plans.catalog import coverage as coverage_catalog
from pressloom.session import cut_lineage, shared_folder
from pressloom.sources import pages as page_source
from pressloom.sources import store as store_source
from pressloom.streaming import jobs


def column(spark, values, expression):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r[0] for r in df.orderBy("i").select(expression(F.col("v"))).collect()]


def test_first_wins_equals_the_loop(spark):
    rng = random.Random(20261006)
    rows = [(i, f"a{rng.randint(0, 25)}", f"b{rng.randint(0, 25)}") for i in range(120)]
    used_a, used_b, expected = set(), set(), []
    for i, a, b in rows:
        if a not in used_a and b not in used_b:
            used_a.add(a), used_b.add(b), expected.append(i)
    df = spark.createDataFrame(rows, "o int, ka string, kb string").repartition(5)
    assert sorted(r.o for r in first_wins(df, "o", "ka", "kb").collect()) == expected


@pytest.mark.parametrize("rule", [LOOSE, STRICT])
def test_leaders_do_not_depend_on_the_partitions(spark, rule):
    rng = random.Random(7)
    vocabulary = [f"word{i}" for i in range(40)]
    start = datetime(2024, 1, 30)
    stories = [rng.sample(vocabulary, 8) for _ in range(6)]
    rows = [
        (f"{i:03d}", start - timedelta(minutes=97 * i), list(dict.fromkeys(rng.sample(rng.choice(stories), 6) + rng.sample(vocabulary, 1))))
        for i in range(60)
    ]
    df = spark.createDataFrame(rows, "id string, ts timestamp, tokens array<string>")
    whole = {r.id: r.leader for r in similar_leaders(df, rule).collect()}
    cut = {r.id: r.leader for r in similar_leaders(df.repartition(3), rule).collect()}
    assert whole == cut and len(whole) == 60
    assert all(whole[leader] == leader for leader in whole.values())


@pytest.mark.parametrize("frequent", [0, 8])
@pytest.mark.parametrize("rule", [LOOSE, STRICT, Similarity(min_shared=2), Similarity(min_shared=1, jaccard=None, weight_share=0.4)])
def test_pairs_with_frequent_tokens_alone_in_common_are_found_once(spark, monkeypatch, rule, frequent):
    monkeypatch.setattr(leaders, "FREQUENT", frequent)
    rng = random.Random(11)
    vocabulary = [f"word{i}" for i in range(30)]
    sets = list({tuple(sorted(rng.choices(vocabulary, [1 / (i + 1) for i in range(30)], k=rng.randint(3, 14)))) for _ in range(70)})
    sets = [s for s in {tuple(dict.fromkeys(s)) for s in sets} if len(s) >= rule.min_shared]
    items = spark.createDataFrame([(" ".join(s), list(s)) for s in sets], "sig string, tokens array<string>")
    df = Counter(t for s in sets for t in s)
    weight = {t: math.log(max(len(sets), 2) / n) for t, n in df.items()}
    expected = set()
    for a in sets:
        for b in sets:
            common = set(a) & set(b)
            alike = len(common) >= rule.min_shared
            alike = alike and (not rule.jaccard or len(common) / len({*a, *b}) >= rule.jaccard)
            smaller = min(sum(weight[t] for t in s) for s in (a, b))
            alike = alike and (not rule.weight_share or sum(weight[t] for t in common) >= rule.weight_share * smaller - 1e-9)
            if a == b or alike:
                expected.add((" ".join(a), " ".join(b)))
    sigs = cut_lineage(leaders.signatures(items, rule))
    found = [(r.sig, r.other) for r in leaders.similar_pairs(sigs, rule).collect()]
    assert len(found) == len(set(found)) and set(found) == expected
    if frequent == 0:
        assert leaders._at_one_token(sigs, rule).isEmpty() and len(expected) > len(sets)



def test_the_overlay_groups_the_headlines_once(spark, monkeypatch):
    start = datetime(2024, 1, 29)
    rows = [(f"{i:03d}", f"Senado aprova reforma tributaria depois debate {i % 3}", f"src{i % 4}", start - timedelta(minutes=i)) for i in range(12)]
    h = spark.createDataFrame(rows, "id string, title string, source string, published timestamp").withColumn("url", F.col("id"))
    names = spark.createDataFrame([(f"src{i}", f"Outlet {i}") for i in range(4)], "id string, name string")
    grouped = []

    def links(spark, sf):
        grouped.append(sf)
        return h, h.select("id", F.lit("000").alias("leader"))

    monkeypatch.setattr(coverage_catalog, "loose_links", links)
    monkeypatch.setattr(coverage_catalog, "named_headlines", lambda spark, sf: h)
    monkeypatch.setattr(coverage_catalog, "external_grouping", lambda spark, sf: h)
    monkeypatch.setattr(coverage_catalog.views, "sources", lambda spark, sf: names)
    monkeypatch.setattr(coverage_catalog.coverage, "external_stories", lambda *a, **k: spark.createDataFrame([], "pos int, n bigint, lead_id string, lead_published timestamp"))
    monkeypatch.setattr(coverage_catalog.coverage, "external_members", lambda *a, **k: spark.createDataFrame([], "pos int, id string"))
    assert [tuple(r) for r in coverage_catalog.j22(spark, "none").collect()] == [("words", "000", 4)] and grouped == ["none"]


def test_headlines_of_one_event_meet(spark):
    titles = ["Senado aprova reforma tributaria depois longo debate", "Reforma tributaria aprovada: Senado aprova texto depois debate", "Time vence classico com gol aos noventa minutos"]
    df = spark.createDataFrame([(str(i), datetime(2024, 1, 1, 12, 9 - i), t) for i, t in enumerate(titles)], "id string, ts timestamp, title string")
    links = {r.id: r.leader for r in similar_leaders(df.select("id", "ts", text.grouping_tokens(F.col("title")).alias("tokens"))).collect()}
    assert links == {"0": "0", "1": "0", "2": "2"}


def test_bad_addresses_are_refused(spark):
    bad = ["", "ftp://x.org/a", "javascript:alert(1)", "http://", "https://u:p@x.org/", "https://x.org/a b", "https://x.org/" + "a" * 2000, "//x.org", "data:text/html,x"]
    assert not any(column(spark, bad, urls.is_admissible))
    assert column(spark, [" https://X.org/a?b=1 "], urls.is_admissible) == [True]


def test_canonical_address_drops_tracking_and_blank_values(spark):
    given = ["https://X.org/a?utm_source=f&b=1&c=&GCLID=3#top"]
    assert column(spark, given, urls.canonical) == ["https://x.org/a?b=1"]
    assert column(spark, ["https://g1.globo.com/x", "https://www.uol.com.br/x"], urls.outlet_key) == ["globo.com", "uol.com.br"]


def test_entities_are_decoded_once(spark):
    assert column(spark, ["&amp;lt; &eacute; &#8212; &lt;"], text.decode_entities) == ["&lt; é — <"]


def test_two_folds_differ(spark):
    assert column(spark, ["Straße Ação"], text.fold_grouping) == ["straße acao"]
    assert column(spark, ["Straße Ação"], text.fold_retrieval) == ["strasse acao"]


def test_title_revisions(spark):
    pairs = [("Governo anuncia medida", "GOVERNO ANUNCIA MEDIDA", False), ("Senado aprva projeto", "Senado aprova projeto", False),
             ("Senado aprova projeto", "Senado rejeita projeto", True), ("Senado aprova projeto", "Senado aprova projeto fiscal", False)]
    df = spark.createDataFrame(pairs, "a string, b string, e boolean")
    assert [r.c == r.e for r in df.select(ingest.title_changed(F.col("a"), F.col("b")).alias("c"), "e").collect()] == [True] * 4
    ratio = spark.createDataFrame([("aprva", "aprova")], "a string, b string").select(ingest.matching_ratio("a", "b")).first()[0]
    assert ratio == SequenceMatcher(None, "aprva", "aprova").ratio()


def test_retention_keeps_a_floor_per_source(spark):
    rows = [(f"a{i:03d}", "big", datetime(2024, 1, 30) - timedelta(minutes=i)) for i in range(100)]
    rows += [(f"b{i:03d}", "small", datetime(2024, 1, 1) - timedelta(minutes=i)) for i in range(40)]
    df = spark.createDataFrame(rows, "id string, source string, published timestamp")
    assert {r.source: r["count"] for r in ingest.retain(df, 50, 5).groupBy("source").count().collect()} == {"big": 50, "small": 5}


def test_states_in_portuguese_titles(spark):
    given = ["Mato Grosso do Sul e Bahia assinam acordo", "Minas e Energia: ministro fala", "Prefeito (SP) visita gaúchos no RJ", "Para o governo, Natal é feriado", "Carioca em São Paulo"]
    assert column(spark, given, places.state_codes) == [["MS", "BA"], [], ["SP", "RJ"], [], ["RJ", "SP"]]


def test_people_with_the_same_surname(spark):
    given = ["Flávio Dino decide", "Flávio Bolsonaro fala", "Michelle Obama no Brasil", "Bolsonaro depõe", "Eduardo Bolsonaro viaja"]
    assert column(spark, given, tagging.people) == [["flavio-dino"], ["flavio-bolsonaro"], [], ["jair-bolsonaro"], ["eduardo-bolsonaro"]]


def test_topics_match_word_starts(spark):
    assert column(spark, ["Ministros discutem", "Continuação da obra"], tagging.topics) == [["governo"], []]


def test_verdicts(spark):
    given = ["É falso que governo vai taxar Pix", "Não é verdade que", "Fato ou Fake: o que se sabe", "#FATO: é verdade", "Vídeo é enganoso", "É verdade, mas falta contexto"]
    assert column(spark, given, verdicts.title_class) == ["falso", "falso", "desconhecido", "verdadeiro", "enganoso", "misto"]
    assert column(spark, ["É falso que governo não vai taxar", "É falso que governo vai taxar"], verdicts.remainder_negated) == [True, False]


def test_chain_message_score(spark):
    message = "URGENTE!!! Compartilhe antes que apaguem: o governo vai taxar o Pix"
    items = column(spark, [message, "bom dia"], chain.evidence)
    assert [i.peso for i in items[0]] == [25, 25, 15, 10] and items[1] == []
    assert "(“Compartilhe”)" in items[0][0].texto


def test_municipal_context_and_mentions(spark):
    assert column(spark, ["O prefeito de Xique-Xique e a prefeitura de Olho d'Água."], places.mentions) == [["Xique-Xique", "Olho d'Água"]]
    assert column(spark, ["Fortaleza/CE", "Fortaleza (CE)", "Fortaleza - CE"], places.place_key) == ["fortaleza"] * 3


def test_place_check_against_a_full_scan(spark):
    rng = random.Random(20261006)
    listed = sorted({"".join(rng.choice("abcde") for _ in range(rng.randint(5, 14))) for _ in range(60)})

    def edited(w):
        i = rng.randrange(len(w) - 1)
        return rng.choice([w[:i] + w[i + 1:], w[:i] + "x" + w[i:], w[:i] + "z" + w[i + 1:], w[:i] + w[i + 1] + w[i] + w[i + 2:], w])

    asked = sorted({edited(rng.choice(listed)) for _ in range(60)})

    def distance(a, b):
        d = {(i, j): i + j for i in range(len(a) + 1) for j in range(len(b) + 1) if i * j == 0}
        for i in range(1, len(a) + 1):
            for j in range(1, len(b) + 1):
                d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (a[i - 1] != b[j - 1]))
                if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                    d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
        return d[len(a), len(b)]

    expected = {}
    for name in asked:
        limit = 2 if len(name) >= 12 else 1
        near = min(((distance(name, n), i, n) for i, n in enumerate(listed)), default=None)
        expected[name] = (True, None) if name in listed else (False, near[2] if near[0] <= limit else None)
    ref = spark.createDataFrame([(n, "XX", i) for i, n in enumerate(listed)], "nome string, uf string, idx int")
    got = place_check.check_places(spark.createDataFrame([(a,) for a in asked], "name string"), ref).collect()
    assert {r.name: (r.existe, r.parecido) for r in got} == expected


def decision(spark, **given):
    row = dict(qid="q", tipo="afirmacao", inexistentes=[], total=5571, n_conf=0, n_contra=0, oficial=False, nomes_conf="", nomes_contra="", cobertura=1, pontos=0, itens=[], consultou=True, checagens=0)
    row.update(given)
    schema = "qid string, tipo string, inexistentes array<string>, total int, n_conf int, n_contra int, oficial boolean, nomes_conf string, nomes_contra string, cobertura int, pontos int, itens array<struct<peso: int, texto: string>>, consultou boolean, checagens int"
    return evidence.decide(spark.createDataFrame([tuple(row.values())], schema)).first()


def test_decision_boundaries(spark):
    assert decision(spark, pontos=44).nivel == "nao_confirmado"
    assert decision(spark, pontos=45).nivel == "suspeito"
    assert decision(spark, pontos=24, cobertura=0).nivel == "nao_confirmado"
    assert decision(spark, pontos=25, cobertura=0).nivel == "suspeito"
    assert decision(spark, n_conf=1, oficial=True).nivel == "provavelmente_verdadeiro"
    assert decision(spark, n_contra=2).nivel == "provavelmente_falso"
    assert decision(spark, inexistentes=["X"]).motivos[0].startswith("Não existe município chamado “X” na lista oficial do IBGE (5.571")
    assert decision(spark, inexistentes=["X"], tipo="opiniao").nivel == "nao_confirmado"


def test_scanner_paths(spark):
    given = ["/wp-login.php", "/.ENV", "/api/news", "/vendor/phpunit/src", "/cgi-bin/x", "/config.php.bak"]
    assert column(spark, given, lambda c: c.rlike(operations.scanner_pattern())) == [True, True, False, True, True, False]


def test_dates(spark):
    given = ["Mon, 01 Jan 2024 10:00:00 GMT", "01 Jan 2024 10:00:00 -0300", "2024-01-01T10:00:00Z", "2024-01-01T10:00:00", "2024-01-01", "nonsense"]
    got = column(spark, given, lambda c: F.date_format(dates.parse_mixed(c), "HH:mm"))
    assert got == ["10:00", "13:00", "10:00", "10:00", "00:00", None]


def test_a_broken_store_is_not_an_empty_one(spark, tmp_path):
    assert store_source.load_store(spark, str(tmp_path / "none")).isEmpty()
    broken = tmp_path / "store"
    broken.mkdir()
    (broken / "part.json").write_text('{"id": "a", "published": "2024-01-01T00:00:00-03:00"}\n{"id": ')
    with pytest.raises(store_source.StoreCorrupted):
        store_source.load_store(spark, str(broken))


def test_a_failed_check_keeps_the_published_version(spark, tmp_path):
    root = str(tmp_path / "out")
    store_source.publish(spark.range(3), root)
    with pytest.raises(operations.GateFailed):
        store_source.publish(spark.range(0), root, check=lambda df: operations.require_quality(operations.quality_problems({"o": df}, {"o": 1}, {}, {})))
    assert store_source.current(spark, root).count() == 3


def test_no_live_source_fails_the_run(spark):
    with pytest.raises(operations.GateFailed):
        operations.require_a_live_source(spark.createDataFrame([("a", False)], "source string, ok boolean"))


def test_streams_of_several_batches_equal_their_batch_twins(spark, tmp_path):
    rng = random.Random(11)
    start = datetime(2024, 1, 1)
    rows = [(f"s{rng.randint(0, 4)}", start + timedelta(minutes=10 * i), rng.random() < 0.6, rng.choice("ab")) for i in range(200)]
    schema = "source string, ts timestamp, ok boolean, topic string"
    for i in range(4):  # files in the order of their times, one batch each
        spark.createDataFrame(rows[50 * i : 50 * i + 50], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    arriving = lambda: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    health = jobs.drain(jobs.source_health(arriving()), str(tmp_path / "health"), "update", ["source"]).collect()
    for r in health:
        own = [(ts, ok) for source, ts, ok, _ in rows if source == r["source"]]
        last = max((ts for ts, ok in own if ok), default=None)
        down = [ts for ts, ok in own if not ok and (last is None or ts > last)]
        assert (r["down_since"], r["last_ok"]) == (f"{min(down):%Y-%m-%d %H:00}" if down else "", f"{last:%Y-%m-%d}" if last else "")
    assert len(health) == 5
    windows = jobs.coverage_windows(arriving().withColumnRenamed("ts", "published"), "1 hour")
    got = {(r["start"], r["topic"]): r["headlines"] for r in jobs.drain(windows, str(tmp_path / "windows"), "update", ["start", "topic"]).collect()}
    expected = Counter((ts.replace(minute=0), topic) for _, ts, _, topic in rows)
    assert got == dict(expected)


def test_local_sessions_without_a_shared_folder_get_one_of_their_own():
    def session(master, application, folder=None):
        conf = SimpleNamespace(get=lambda key, default: folder or default)
        return SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master=master, applicationId=application))

    assert shared_folder(session("local[2]", "a", "/shared")) == "/shared"
    assert shared_folder(session("local[2]", "a")) == shared_folder(session("local[2]", "a")) != shared_folder(session("local[2]", "b"))
    with pytest.raises(RuntimeError):
        shared_folder(session("spark://host:7077", "a"))


def test_alert_ledger_over_two_batches_equals_the_batch_job_twice(spark, tmp_path):
    prefs = "key long, geral boolean, temas array<string>, ufs array<string>, pessoas array<string>, checagens boolean, nivel string, max int, s array<string>, d string, n int"
    people = [(k, k % 2 == 0, ["alpha"] if k % 3 else [], [], [], False, "importantes", 1 + k % 4, None if k % 5 == 0 else [f"old{k}"], "2024-01-28", 1) for k in range(20)]
    subscribers = spark.createDataFrame(people, prefs)
    shape = "pos long, id string, t string, u string, f string, n long, temas array<string>, ufs array<string>, pessoas array<string>, k string, p long"
    batches = [[(10 * b + i, f"d{b}{i}", "t", f"u{b}{i}", "f", 6 + i, ["alpha"] if i % 2 else [], [], [], "assunto", 100 * b + i) for i in range(6)] for b in range(2)]
    moments = [dates.moment("2024-01-29 18:30:00"), dates.moment("2024-01-29 19:30:00")]
    deliver = lambda sent: sent.withColumn("status", F.when(F.col("key") == 7, 410).when(F.col("key") == 8, 500).otherwise(201))

    expected = subscribers
    for rows, at in zip(batches, moments):
        chosen = alerts.select(expected, spark.createDataFrame(rows, shape), at)
        receipts = deliver(chosen.select("key", F.posexplode("enviar").alias("pos", "id")))
        after = alerts.merge_receipts(expected, receipts, chosen.where("primeira").select("key", "s", "d"), at)
        expected = spark.createDataFrame(after.select(subscribers.columns).collect(), prefs)

    ledger = jobs.AlertLedger(subscribers, f"{tmp_path}/ledger")
    stream = spark.readStream.schema(shape).parquet(f"{tmp_path}/in/*")
    for number, rows in enumerate(batches):
        spark.createDataFrame(rows, shape).write.parquet(f"{tmp_path}/in/{number}")
        jobs.run_alerts(stream, ledger, deliver, lambda n: moments[n], f"{tmp_path}/checkpoint").awaitTermination()
    key = lambda rows: sorted((r["key"], r["s"], r["d"], r["n"]) for r in rows)
    found = ledger.read().collect()
    assert key(found) == key(expected.collect()) and len(found) == 19 and any(len(r["s"] or []) > 2 for r in found)

    before = ledger.read(1)  # the second batch again
    chosen = alerts.select(before, spark.createDataFrame(batches[1], shape), moments[1])
    receipts = deliver(chosen.select("key", F.posexplode("enviar").alias("pos", "id")))
    first = chosen.where("primeira").select("key", "s", "d")
    ledger.write(receipts.select("key").unionByName(first.select("key")), alerts.merge_receipts(before, receipts, first, moments[1]), 1)
    assert key(ledger.read().collect()) == key(found)
    assert spark.read.parquet(f"{tmp_path}/ledger/batch=1").count() < 20


def test_article_bodies_in_structured_data(spark):
    say = lambda word: (word + " words of a body that is long enough to count. ") * 3
    block = lambda inner: f'<html><script type="application/ld+json">{inner}</script></html>'
    nested = '{"a":' * 7 + '{"articleBody":"%s"}' % say("deep") + "}" * 7
    too_deep = '{"a":' * 9 + '{"articleBody":"%s"}' % say("lost") + "}" * 9
    given = [
        block('{"@graph":[{"x":1},[{"articleBody":"%s"}],{"articleBody":"short"}]}' % say("graph")),
        block('{"description":"says \\"articleBody\\": \\"%s\\""}' % say("quoted")),
        block('{"articleBody":"%s\n%s"}' % (say("raw"), say("break"))),
        block('{"articleBody":17}') + block('[{"articleBody":"%s"}]' % say("second")),
        block(nested), block(too_deep), block("{}"), "",
    ]
    found = column(spark, given, page_source.structured_body)
    begins = [f.split(" ")[0] for f in found]
    assert begins == ["graph", "", "raw", "second", "deep", "", "", ""] and "\nbreak" in found[2]


def test_every_rule_keeps_the_pointer(spark, tmp_path):
    """Each rule fails once on the write itself; readers go on seeing the version before."""
    good = spark.createDataFrame([("a", "https://x.org/a", '{"k":1}'), ("b", None, "[]")], "title string, url string, meta string")
    rules = {"pages": operations.Rules(2, "url", ("title",), ("meta",)), "hosts": operations.Rules()}
    hosts = spark.createDataFrame([("x.org", 1)], "host string, n int")
    root = str(tmp_path)
    operations.publish_checked({"pages": good, "hosts": hosts}, root, rules, {"hosts": "host"})
    bad = {
        "rows below minimum": good.limit(1), "rows": good.where("false"), "dangerous link": good.withColumn("url", F.lit(" JavaScript:alert(1)")), "empty title": good.withColumn("title", F.lit("")),
        "empty title (2)": good.withColumn("title", F.lit(None).cast("string")), "no JSON in meta": good.withColumn("meta", F.lit("{")), "no JSON in meta (2)": good.withColumn("meta", F.lit(None).cast("string")),
    }
    for rule, pages in bad.items():
        with pytest.raises(operations.GateFailed, match=rule.replace("(", "\\(").replace(")", "\\)")):
            operations.publish_checked({"pages": pages, "hosts": hosts}, root, rules)
    with pytest.raises(operations.GateFailed, match="hosts: missing"):
        operations.publish_checked({"pages": good}, root, rules)
    assert sorted(r["title"] for r in store_source.current(spark, f"{root}/pages").collect()) == ["a", "b"]
    operations.publish_checked({"pages": good.withColumn("title", F.upper("title")), "hosts": hosts}, root, rules)
    assert sorted(r["title"] for r in store_source.current(spark, f"{root}/pages").collect()) == ["A", "B"]


def test_ledgers_are_not_broadcast(spark, tmp_path):
    """The subscribers' file is small, their ledgers together are not; ids already sent are left out all the same."""
    ledger = F.transform(F.sequence(F.lit(0), (F.col("id") % 50).cast("int")), lambda i: F.concat(F.lit("a"), i.cast("string")))
    spark.range(200).repartition(1).write.parquet(f"{tmp_path}/keys")
    none = F.array().cast("array<string>")
    subscribers = spark.read.parquet(f"{tmp_path}/keys").select(
        F.col("id").alias("key"), F.lit(True).alias("geral"), none.alias("temas"), none.alias("ufs"), none.alias("pessoas"), F.lit(False).alias("checagens"),
        F.lit("importantes").alias("nivel"), F.lit(5).alias("max"), ledger.alias("s"), F.lit("2024-01-01").alias("d"), F.lit(0).alias("n"),
    )
    shape = "pos int, id string, u string, f string, n int, temas array<string>, ufs array<string>, pessoas array<string>, k string, p long"
    digests = spark.createDataFrame([(i, f"a{i}", f"u{i}", "f", 9, [], [], [], "assunto", i) for i in range(60)], shape)
    chosen = alerts.select(subscribers, digests, F.to_timestamp(F.lit("2024-01-29 18:30:00")))
    plan = chosen._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"Broadcast\w+Join[^\n]*LeftAnti", plan)
    got = {r.key: r.enviar for r in chosen.collect()}
    assert len(got) == 200 and got[0] == ["a59", "a58"] and all(not set(v) & {f"a{i}" for i in range(k % 50 + 1)} for k, v in got.items())


@pytest.mark.parametrize("name", ["st1_streaming_dedup", "st2_streaming_admission", "st3_coverage_bursts", "st3_coverage_windows"])
def test_streams_read_tables_of_one_file_or_many(spark, tmp_path, name):
    from pressloom.plans.catalog.base import QUERIES

    rows = spark.range(40).selectExpr("id AS doc_id", "concat('Title ', id) AS text", "'en' AS lang", "concat('src', id % 3) AS source", "id * 40 AS n_chars")
    rows.repartition(3).write.parquet(str(tmp_path / "many" / "documents.parquet"))
    rows.coalesce(1).write.parquet(str(tmp_path / "written"))
    (tmp_path / "one").mkdir()
    next((tmp_path / "written").glob("part-*.parquet")).rename(tmp_path / "one" / "documents.parquet")
    found = [sorted(map(tuple, QUERIES[name](spark, str(tmp_path / folder)).collect())) for folder in ("one", "many")]
    assert found[0] and found[0] == found[1]
