"""Checked queries: retrieval, search, verdicts, evidence and decisions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pressloom.functions import chain, places, text, urls, verdicts
from pressloom.functions import fixed_values as fv
from pressloom.operators import evidence, retrieval, search
from pressloom.plans import views
from pressloom.plans.catalog import base
from pressloom.plans.catalog.base import HEADLINES, NOW, SOURCES, query
from pressloom.plans.catalog.coverage import CHECKS, TAGGED, checks, members, named_headlines, tagged, LOOSE_SQL
from pressloom.plans.views import table
from pressloom.session import cut_lineage

_LEADS = [
    "URGENTE!!! Compartilhe antes que apaguem: ",
    "O governo vai taxar o Pix e a midia nao mostra ",
    "Um amigo policial contou que nao foi assim: ",
    "Foto: prova irrefutável https://x.example.org ",
    "",
]


def claims(spark, sf):
    """Benchmark items and all turns as claims, some worded like chain messages."""
    b = table(spark, sf, "benchmark").select(F.concat(F.lit("b"), F.col("item_id").cast("string")).alias("qid"), F.col("item_id").alias("k"), "text")
    c = table(spark, sf, "conversations")
    c = c.select(F.concat(F.lit("c"), F.col("conv_id").cast("string"), F.lit("-"), F.col("turn").cast("string")).alias("qid"), (F.col("conv_id") + F.col("turn")).alias("k"), "text")
    lead = F.array(*[F.lit(x) for x in _LEADS])[F.pmod(F.col("k"), F.lit(len(_LEADS))).cast("int")]
    tipo = F.array(*[F.lit(x) for x in ("afirmacao", "opiniao", "previsao", "outro")])[F.pmod(F.floor(F.col("k") / 5), F.lit(4)).cast("int")]
    return b.unionByName(c).select("qid", "k", "text", F.concat(lead, "text").alias("message"), tipo.alias("tipo"))


CLAIMS = f"""clm AS MATERIALIZED (SELECT qid, k, text, [{", ".join(f"'{x}'" for x in _LEADS)}][k % 5 + 1] || text AS message,
    ['afirmacao', 'opiniao', 'previsao', 'outro'][(k // 5) % 4 + 1] AS tipo FROM
    (SELECT 'b' || item_id AS qid, item_id AS k, text FROM benchmark UNION ALL SELECT 'c' || conv_id || '-' || turn, conv_id + turn, text FROM conversations))"""


@query(
    "x1_postings",
    f"""SELECT doc_id, unnest({base.topic_terms('text')}) AS term FROM documents""",
)
def x1(spark, sf):
    return retrieval.postings(table(spark, sf, "documents"), "doc_id", text.topic_terms(F.col("text")))


@query(
    "x0_folded_text",
    f"""SELECT doc_id, md5({base.fold1('text')}) AS grouping_fold, md5({base.fold2('text')}) AS retrieval_fold FROM documents""",
)
def x0(spark, sf):
    d = table(spark, sf, "documents")
    return d.select("doc_id", F.md5(text.fold_grouping(F.col("text"))).alias("grouping_fold"), F.md5(text.fold_retrieval(F.col("text"))).alias("retrieval_fold"))


@query("x2_outlet_keys", f"""SELECT page_id, {base.outlet_key("replace(url, '.example.', '.com.')")} AS three, {base.outlet_key('url')} AS key FROM pages""")
def x2(spark, sf):
    p = table(spark, sf, "pages")
    return p.select("page_id", urls.outlet_key(F.replace("url", F.lit(".example."), F.lit(".com."))).alias("three"), urls.outlet_key(F.col("url")).alias("key"))


_TITLE_TERMS = f"tt AS MATERIALIZED (SELECT h.*, {base.tokens2('title')} AS terms FROM h)"


@query(
    "j11_term_overlap",
    f"""WITH {HEADLINES}, {CLAIMS}, {_TITLE_TERMS}, q AS (SELECT qid, {base.topic_terms('text')} AS qt FROM clm),
    titles AS MATERIALIZED (SELECT DISTINCT list_sort(terms) AS terms FROM tt), m AS (SELECT qid, terms, len(list_intersect(qt, terms)) AS shared FROM q, titles WHERE len(list_intersect(qt, terms)) >= 3)
    SELECT qid, id, shared FROM m JOIN tt ON list_sort(tt.terms) = m.terms""",
)
def j11(spark, sf):
    q = claims(spark, sf).select("qid", text.topic_terms(F.col("text")).alias("terms"))
    return retrieval.title_matches(q, views.headlines(spark, sf), F.lit(3)).select("qid", "id", F.col("shared").cast("bigint").alias("shared"))


def claim_terms(spark, sf):
    """Query terms are those of the first sentence, claim terms those of the whole text."""
    c = claims(spark, sf)
    b = text.topic_terms(F.substring_index("text", ".", 1))
    return c.select("qid", b.alias("b"), F.array_union(b, text.topic_terms(F.col("text"))).alias("w"))


_CANDIDATES = f"""q AS (SELECT qid, {base.topic_terms("split_part(text, '.', 1)")} AS b, {base.topic_terms('text')} AS w FROM clm),
    hit AS (SELECT qid, id, title, url, published, h2.source, h2.grupo, h2.terms, split_part(h2.source, '.', 1) AS src0, 'example.org' AS outlet, len(list_intersect(w, terms)) AS shared FROM q,
      (SELECT * FROM tt WHERE kind <> 'checagem') h2 WHERE len(w) > 0 AND (len(list_intersect(w, terms)) >= least(3, len(w)) OR (len(b) BETWEEN 1 AND 4 AND len(list_intersect(b, terms)) >= ceil(0.6 * len(b))))),
    few AS (SELECT *, row_number() OVER (PARTITION BY qid, outlet ORDER BY shared DESC, published DESC, id) AS r FROM hit)"""


def spread_outlets(df):
    """One registrable domain per source, so that outlets differ."""
    return df.withColumn("url", F.concat(F.lit("https://"), "source", F.lit(".org/"), F.col("id")))


@query(
    "j13_coverage_candidates",
    f"""WITH {HEADLINES}, {CLAIMS}, {_TITLE_TERMS}, {_CANDIDATES.replace("'example.org' AS outlet", "h2.source || '.org' AS outlet")},
    placed AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY shared DESC, published DESC, id) AS place FROM few WHERE r <= 2)
    SELECT qid, id, outlet, shared, place FROM placed WHERE place <= 8""",
)
def j13(spark, sf):
    c = retrieval.coverage_candidates(claim_terms(spark, sf), spread_outlets(views.headlines(spark, sf)))
    return c.select("qid", "id", "outlet", F.col("shared").cast("bigint").alias("shared"), F.col("place").cast("bigint").alias("place"))


@query(
    "k4_retrieval_order",
    f"""WITH {HEADLINES}, {CLAIMS}, {_TITLE_TERMS}, q AS (SELECT qid, {base.topic_terms('text')} AS qt FROM clm),
    titles AS MATERIALIZED (SELECT DISTINCT list_sort(terms) AS terms FROM tt), m AS (SELECT qid, terms, len(list_intersect(qt, terms)) AS shared FROM q, titles WHERE len(list_intersect(qt, terms)) >= 2),
    r AS (SELECT qid, id, row_number() OVER (PARTITION BY qid ORDER BY shared DESC, published DESC, id) AS place FROM m JOIN tt ON list_sort(tt.terms) = m.terms)
    SELECT qid, id, place FROM r WHERE place <= 3""",
)
def k4(spark, sf):
    from pressloom.operators.ranking import top_per_group

    q = claims(spark, sf).select("qid", text.topic_terms(F.col("text")).alias("terms"))
    h = views.headlines(spark, sf)
    hits = retrieval.title_matches(q, h, F.lit(2), limit=3)
    return top_per_group(hits, ["qid"], retrieval.best_order(), 3, rank="place").select("qid", "id", F.col("place").cast("bigint").alias("place"))


def two_lists(spark, sf):
    """Local and external candidates for each claim: headlines by conversation number, some links in both lists."""
    h = spread_outlets(views.headlines(spark, sf)).select("doc_id", "id", "url", F.concat("source", F.lit(".org")).alias("outlet"))
    n = table(spark, sf, "documents").agg(F.count(F.lit(1)).alias("n"))
    e = table(spark, sf, "events").crossJoin(F.broadcast(n)).select("event_id", "user_id", "event_type", (F.col("event_id") % F.col("n")).alias("doc_id"))  # one row
    both = e.join(h, "doc_id").select(F.concat(F.lit("q"), F.col("user_id").cast("string")).alias("qid"), F.col("event_id").alias("pos"), "url", "outlet", "event_type")
    local = both.where(F.col("event_type").isin("click", "view"))
    external = both.where(~F.col("event_type").isin("click", "view")).withColumn("url", F.concat("url", F.lit("/")))
    return local.drop("event_type"), external.drop("event_type")


@query(
    "w6_merge_candidates",
    f"""WITH {HEADLINES}, e AS (SELECT 'q' || user_id AS qid, event_id AS pos, 'https://' || source || '.org/' || id AS link, source || '.org' AS outlet, CASE WHEN event_type IN ('click', 'view') THEN 0 ELSE 1 END AS part FROM events JOIN h ON doc_id = event_id % (SELECT count(*) FROM documents)),
    u AS (SELECT *, row_number() OVER (PARTITION BY qid, link ORDER BY part, pos) AS r FROM e), o AS (SELECT *, row_number() OVER (PARTITION BY qid, outlet ORDER BY part, pos) AS ro FROM u WHERE r = 1),
    p AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY part, pos) AS place FROM o WHERE ro <= 2) SELECT qid, link, outlet, place FROM p WHERE place <= 8""",
)
def w6(spark, sf):
    m = retrieval.merge_candidates(*two_lists(spark, sf))
    return m.select("qid", urls.without_slash(F.col("url")).alias("link"), "outlet", F.col("place").cast("bigint").alias("place"))


_SAME = f"""{_TITLE_TERMS}, asked AS (SELECT id AS article, source AS qs, {base.topic_terms('title')} AS qt FROM h),
    pairs AS (SELECT article, qs, tt.id, tt.source, tt.kind, tt.grupo, tt.published, len(list_intersect(qt, terms)) AS shared FROM asked, tt WHERE len(qt) >= 3 AND source <> qs AND len(list_intersect(qt, terms)) >= 3),
    bst AS (SELECT *, row_number() OVER (PARTITION BY article, source ORDER BY shared DESC, published DESC, id) AS r FROM pairs)"""


@query(
    "j14_other_outlets",
    f"""WITH {HEADLINES}, {_SAME}, pl AS (SELECT *, row_number() OVER (PARTITION BY article ORDER BY shared DESC, published DESC, id) AS place FROM bst WHERE r = 1)
    SELECT article, id, shared, place FROM pl WHERE place <= 4""",
)
def j14(spark, sf):
    h = spread_outlets(views.headlines(spark, sf))
    best = retrieval.other_outlets(retrieval.same_story(h, h))
    out = retrieval.questions(h).select("article", "qid").join(best, "qid")
    return out.select("article", "id", F.col("shared").cast("bigint").alias("shared"), F.col("place").cast("bigint").alias("place"))


@query(
    "a9_story_outlet_counts",
    f"""WITH {HEADLINES}, {_SAME}, c AS (SELECT article, count(DISTINCT source) AS n FROM pairs WHERE grupo <> 'oficial' AND kind <> 'checagem' GROUP BY article),
    off AS (SELECT article, list(id ORDER BY shared DESC, published DESC, id)[1:2] AS l FROM bst WHERE r = 1 AND grupo = 'oficial' GROUP BY article)
    SELECT a.article AS id, CASE WHEN len(qt) >= 3 THEN coalesce(n, 0) + 1 END AS veiculos, coalesce(array_to_string(l, ','), '') AS oficiais FROM asked a LEFT JOIN c USING (article) LEFT JOIN off USING (article)""",
)
def a9(spark, sf):
    h = spread_outlets(views.headlines(spark, sf))
    return retrieval.outlet_counts(h, retrieval.same_story(h, h)).select("id", "veiculos", F.array_join("oficiais", ",").alias("oficiais"))


# --- verdicts and checks --------------------------------------------------------------------------------------------------


def _norm(x):
    return rf"trim(regexp_replace(regexp_replace({base.fold2(x)}, '\b(?:fato ou fake|verdade ou mentira)\b', ' ', 'g'), '\s+', ' ', 'g'))"


def _sq(p):
    return p.replace("'", "''")


def _explicit(x):
    return "CASE " + " ".join(f"WHEN regexp_matches({x}, '{_sq(p)}') THEN '{k}'" for k, p in fv.EXPLICIT_VERDICTS) + " ELSE 'desconhecido' END"


def _rest(x):
    return "CASE " + " ".join(f"WHEN regexp_matches({x}, '{_sq(p)}') THEN regexp_replace({x}, '(?s)^.*?(?:{_sq(p)})', '')" for k, p in fv.EXPLICIT_VERDICTS) + f" ELSE {x} END"


def _rating(x):
    label = "CASE " + " ".join(f"WHEN regexp_matches({x}, '{_sq(p)}') THEN '{k}'" for k, p in fv.LABEL_VERDICTS) + " ELSE 'desconhecido' END"
    return f"CASE WHEN {x} = '' THEN 'desconhecido' WHEN {_explicit(x)} <> 'desconhecido' OR length({x}) > 60 THEN {_explicit(x)} ELSE {label} END"


_NEG = _sq(fv.NEGATION)


@query(
    "x9_title_verdicts",
    f"""WITH {CHECKS}, n AS (SELECT doc_id, {_norm('title')} AS r FROM chk) SELECT doc_id, {_explicit('r')} AS classe, regexp_matches({_rest('r')}, '{_NEG}') AS negado FROM n""",
)
def x9(spark, sf):
    return checks(spark, sf).select("doc_id", verdicts.title_class(F.col("title")).alias("classe"), verdicts.remainder_negated(F.col("title")).alias("negado"))


_RATINGS = ["Falso", "É enganoso, falta o contexto da fala original do ministro no congresso", "Verdadeiro", "Parcialmente verdadeiro", "Distorcido", "Fato ou Fake", "Não é bem assim", "golpe antigo"]


@query(
    "x9_rating_verdicts",
    f"""WITH r AS (SELECT doc_id, {_norm("[" + ", ".join(f"'{x}'" for x in _RATINGS) + "][(doc_id + quality + 2 * toxic) % 8 + 1] || CASE WHEN doc_id % 3 = 0 THEN '' ELSE '.' END")} AS r FROM labels) SELECT doc_id, {_rating('r')} AS classe FROM r""",
)
def x9_rating(spark, sf):
    lab = table(spark, sf, "labels")
    return lab.select("doc_id", verdicts.rating_class(_rating_text()).alias("classe"))


def _rating_text():
    pick = F.array(*[F.lit(x) for x in _RATINGS])[((F.col("doc_id") + F.col("quality") + 2 * F.col("toxic")) % 8).cast("int")]
    return F.concat(pick, F.when(F.col("doc_id") % 3 == 0, "").otherwise("."))


def claim_checks(spark, sf):
    """Claim terms and sense: negated when the message says so."""
    c = claims(spark, sf)
    return c.select("qid", text.topic_terms(F.col("text")).alias("terms"), verdicts.is_negated(F.col("message")).alias("negado"))


_INDEX_CHECKS = f"""cand AS MATERIALIZED (SELECT id, title, url, published, {base.tokens2('title')} AS terms, {_norm('title')} AS r FROM chk),
    q AS (SELECT qid, {base.topic_terms('text')} AS qt, regexp_matches({base.fold2('message')}, '{_NEG}') AS qneg FROM clm),
    classed AS (SELECT *, {_explicit('r')} AS k, regexp_matches({_rest('r')}, '{_NEG}') AS neg FROM cand),
    ic AS MATERIALIZED (SELECT qid, id, url, published, len(list_intersect(qt, terms)) AS shared, CASE WHEN k = 'desconhecido' OR (k IN ('falso', 'verdadeiro') AND neg <> qneg) THEN '' ELSE k END AS classe
      FROM q, classed WHERE len(qt) > 0 AND len(list_intersect(qt, terms)) >= least(3, len(qt)))"""


@query("j15_index_checks", f"WITH {CHECKS}, {CLAIMS}, {_INDEX_CHECKS} SELECT qid, id, shared, classe FROM ic")
def j15(spark, sf):
    out = retrieval.index_checks(claim_checks(spark, sf), checks(spark, sf), ("id",))
    return out.select("qid", "id", F.col("shared").cast("bigint").alias("shared"), "classe")


def search_results(spark, sf):
    """Delivered results of an outside search: a labelled document for each user turn it shares a number with."""
    lab = table(spark, sf, "labels").withColumn("rating", _rating_text())
    h = views.headlines(spark, sf)
    r = lab.join(h, "doc_id").select((F.col("doc_id") % 97).alias("k97"), F.col("doc_id").alias("rid"), F.col("title").alias("review_title"), "rating", "url", "published")
    c = claims(spark, sf).select("qid", (F.col("k") % 97).alias("k97"), "text")
    return c.join(r, "k97").select("qid", "rid", F.when(F.col("rid") % 2 == 0, F.col("text")).otherwise("").alias("claim_text"), "review_title", "rating", "url", "published", F.lit("Agency").alias("publisher"))


_RESULTS = f"""res AS (SELECT c.qid, l.doc_id AS rid, CASE WHEN l.doc_id % 2 = 0 THEN c.text ELSE '' END AS claim_text, h.title AS review_title,
      {_norm("[" + ", ".join(f"'{x}'" for x in _RATINGS) + "][(l.doc_id + quality + 2 * toxic) % 8 + 1] || CASE WHEN l.doc_id % 3 = 0 THEN '' ELSE '.' END")} AS r, h.url, c.text, c.message
      FROM labels l JOIN h ON h.doc_id = l.doc_id JOIN clm c ON c.k % 97 = l.doc_id % 97),
    rd AS (SELECT *, {base.topic_terms('text')} AS qt, {base.tokens2("claim_text || ' ' || review_title")} AS rt, regexp_matches({base.fold2('message')}, '{_NEG}') AS qneg,
      regexp_matches({base.fold2("CASE WHEN claim_text <> '' THEN claim_text ELSE review_title END")}, '{_NEG}') AS neg, {_rating('r')} AS k FROM res),
    dc AS MATERIALIZED (SELECT qid, rid, url, len(list_intersect(qt, rt)) AS shared, CASE WHEN k = 'desconhecido' OR (k IN ('falso', 'verdadeiro') AND neg <> qneg) THEN '' ELSE k END AS classe
      FROM rd WHERE len(list_intersect(qt, rt)) >= least(2, len(qt)))"""


@query("j16_delivered_checks", f"WITH {HEADLINES}, {CLAIMS}, {_RESULTS} SELECT qid, rid, shared, classe FROM dc")
def j16(spark, sf):
    out = retrieval.delivered_checks(claim_checks(spark, sf), search_results(spark, sf))
    return out.select("qid", "rid", F.col("shared").cast("bigint").alias("shared"), "classe")


def merged_checks(spark, sf):
    return retrieval.merged_checks(claim_checks(spark, sf), checks(spark, sf), search_results(spark, sf))


_MERGED = f"""{CHECKS}, {CLAIMS}, {_INDEX_CHECKS}, {_RESULTS}, lists AS (SELECT qid, 0 AS part, rid AS pos, url, classe, shared FROM dc UNION ALL SELECT qid, 1, CAST(-epoch(published) AS BIGINT), url, classe, shared FROM ic),
    uq AS (SELECT *, row_number() OVER (PARTITION BY qid, regexp_replace(url, '/$', '') ORDER BY part, pos) AS r FROM lists),
    mk AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY CASE WHEN classe = '' THEN 1 ELSE 0 END, shared DESC, part, pos) AS place FROM uq WHERE r = 1), best AS MATERIALIZED (SELECT * FROM mk WHERE place <= 5)"""


@query("k5_merged_checks", f"WITH {_MERGED} SELECT qid, url, classe, shared, place FROM best")
def k5(spark, sf):
    m = merged_checks(spark, sf)
    return m.select("qid", "url", "classe", F.col("shared").cast("bigint").alias("shared"), F.col("place").cast("bigint").alias("place"))


@query(
    "a10_verdict_per_claim",
    f"""WITH {_MERGED}, c AS (SELECT qid, count(*) AS n, count(*) FILTER (WHERE classe = 'falso') AS f, count(*) FILTER (WHERE classe = 'enganoso') AS e, count(*) FILTER (WHERE classe = 'verdadeiro') AS v, count(*) FILTER (WHERE classe = 'misto') AS m FROM best WHERE classe <> '' GROUP BY qid)
    SELECT clm.qid, CASE WHEN n IS NULL THEN 'sem_checagem' WHEN f + e > 0 AND v = 0 THEN CASE WHEN f >= e THEN 'falso' ELSE 'enganoso' END WHEN v > 0 AND f + e = 0 AND m = 0 THEN 'verdadeiro' ELSE 'misto' END AS veredito FROM clm LEFT JOIN c USING (qid)""",
)
def a10(spark, sf):
    return evidence.aggregate_verdict(merged_checks(spark, sf), claims(spark, sf))


# --- chain messages, relations, decisions ---------------------------------------------------------------------------------


def _signal_sql(s, i):
    hit = f"regexp_matches(f, '{_sq(s['pattern'])}')"
    if "also" in s:
        hit += f" AND regexp_matches(f, '{_sq(s['also'])}')"
    if s.get("unless_link"):
        hit += " AND NOT regexp_matches(message, '(?i)https?://')"
    if s.get("or_capitals"):
        hit = f"({hit}) OR (length(regexp_replace(message, '[^\\p{{Lu}}\\p{{Ll}}]', '', 'g')) >= 20 AND length(regexp_replace(message, '\\P{{Lu}}', '', 'g')) / length(regexp_replace(message, '[^\\p{{Lu}}\\p{{Ll}}]', '', 'g')) > 0.4)"
    return f"CASE WHEN {hit} THEN {{'w': {s['weight']}, 'i': {i}}} END"


_CHAIN = f"""chn AS (SELECT *, {base.fold2('message')} AS f FROM clm), sig AS MATERIALIZED (SELECT qid, list_filter([{", ".join(_signal_sql(s, i) for i, s in enumerate(fv.CHAIN_SIGNALS))}], lambda z: z IS NOT NULL) AS l FROM chn),
    pts AS MATERIALIZED (SELECT qid, least(100, coalesce(list_sum(list_transform(l, lambda z: z.w)), 0)) AS pontos, len(l) AS itens FROM sig)"""


@query("x10_chain_score", f"WITH {CLAIMS}, {_CHAIN} SELECT qid, CAST(pontos AS BIGINT) AS pontos, CAST(itens AS BIGINT) AS itens FROM pts")
def x10(spark, sf):
    c = claims(spark, sf).select("qid", chain.evidence(F.col("message")).alias("itens"))
    return c.select("qid", chain.points(F.col("itens")).cast("bigint").alias("pontos"), F.size("itens").cast("bigint").alias("itens"))


@query(
    "x11_capital_share",
    r"""SELECT doc_id, length(regexp_replace(t, '[^\p{Lu}\p{Ll}]', '', 'g')) >= 20 AND length(regexp_replace(t, '\P{Lu}', '', 'g')) / greatest(length(regexp_replace(t, '[^\p{Lu}\p{Ll}]', '', 'g')), 1) > 0.4 AS capitals
    FROM (SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN upper(text) ELSE text END AS t FROM documents)""",
)
def x11(spark, sf):
    d = table(spark, sf, "documents")
    t = F.when(F.col("doc_id") % 4 == 0, F.upper("text")).otherwise(F.col("text"))
    return d.select("doc_id", F.coalesce(text.many_capitals(t), F.lit(False)).alias("capitals"))


_REL = ["confirma", "contradiz", "relacionada", "nao_relacionada", "talvez"]


def relations(spark, sf):
    """Coverage candidates with a relation asserted from outside, by place and claim number, after the guard."""
    cand = retrieval.coverage_candidates(claim_terms(spark, sf), spread_outlets(views.headlines(spark, sf)))
    c = cand.join(claims(spark, sf).select("qid", "k", "text"), "qid")
    asserted = F.array(*[F.lit(x) for x in _REL])[F.pmod(F.floor(F.col("k") / 2) + F.floor(F.col("place") / 4), F.lit(5)).cast("int")]
    guarded = evidence.guarded_relation(asserted, F.col("text"), F.concat_ws(" ", "title", "desc"))
    return c.select("qid", F.col("place").cast("bigint").alias("pos"), "id", "outlet", F.col("source").alias("source_name"), (F.col("grupo") == "oficial").alias("official"), guarded.alias("relation"))


_RELATIONS = f"""{HEADLINES}, {CLAIMS}, {_TITLE_TERMS}, {_CANDIDATES.replace("'example.org' AS outlet", "h2.source || '.org' AS outlet")},
    placed AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY shared DESC, published DESC, id) AS place FROM few WHERE r <= 2),
    asserted AS (SELECT p.qid, p.place, p.id, p.outlet, p.source, p.grupo, {base.topic_terms('c.text')} AS ct, {base.tokens2("h.title || ' ' || h.desc")} AS ht,
      ['confirma', 'contradiz', 'relacionada', 'nao_relacionada', 'talvez'][(c.k // 2 + p.place // 4) % 5 + 1] AS a FROM placed p JOIN clm c USING (qid) JOIN h ON h.id = p.id WHERE p.place <= 8),
    rel AS MATERIALIZED (SELECT qid, place AS pos, id, outlet, source, grupo = 'oficial' AS official, CASE WHEN a = 'talvez' THEN 'relacionada'
      WHEN a IN ('confirma', 'contradiz') AND NOT (len(ct) >= 2 AND len(list_intersect(ct, ht)) >= least(3, len(ct))) THEN 'relacionada' ELSE a END AS relation FROM asserted)"""


@query("d2g_relation_guard", f"WITH {_RELATIONS} SELECT qid, id, relation FROM rel")
def d2g(spark, sf):
    return relations(spark, sf).select("qid", "id", "relation")


_NAMES = (
    lambda r: f"(SELECT CASE WHEN len(l) = 0 THEN '' WHEN len(l) = 1 THEN l[1] WHEN len(l) <= 3 THEN array_to_string(l[1:len(l) - 1], ', ') || ' e ' || l[-1] ELSE array_to_string(l[1:3], ', ') || ' e outros' END "  # noqa: E731
    f"FROM (SELECT coalesce(list(source ORDER BY p), []) AS l FROM (SELECT source, min(pos) AS p FROM rel r WHERE r.qid = rel.qid AND r.relation = '{r}' GROUP BY source)))"
)
_EVIDENCE = f"""ev AS MATERIALIZED (SELECT qid, count(DISTINCT outlet) FILTER (WHERE relation = 'confirma') AS n_conf, count(DISTINCT outlet) FILTER (WHERE relation = 'contradiz') AS n_contra,
    coalesce(bool_or(official) FILTER (WHERE relation = 'confirma'), FALSE) AS oficial, {_NAMES('confirma')} AS nomes_conf, {_NAMES('contradiz')} AS nomes_contra, count(*) AS cobertura FROM rel WHERE relation <> 'nao_relacionada' GROUP BY qid)"""


@query("a11_outlet_evidence", f"WITH {_RELATIONS}, {_EVIDENCE} SELECT qid, n_conf, n_contra, oficial, nomes_conf, nomes_contra, cobertura FROM ev")
def a11(spark, sf):
    return evidence.outlet_evidence(relations(spark, sf))


def decision_inputs(spark, sf):
    c = claims(spark, sf)
    ev = evidence.outlet_evidence(relations(spark, sf))
    items = c.select("qid", chain.evidence(F.col("message")).alias("itens"))
    missing = F.when(F.col("k") % 7 == 0, F.array(F.lit("Atlantida"), F.lit("Nowhere"), F.lit("Elsewhere"))).otherwise(F.array().cast("array<string>"))
    return (
        c.select("qid", "k", "tipo", missing.alias("inexistentes"))
        .join(ev, "qid", "left")
        .join(items, "qid")
        .withColumn("pontos", chain.points(F.col("itens")))
        .withColumn("total", F.lit(5571))
        .withColumn("consultou", F.col("k") % 3 != 0)
        .withColumn("checagens", F.when(F.col("k") % 4 == 0, 1).otherwise(0))
        .fillna(0, ["n_conf", "n_contra", "cobertura"])
        .fillna("", ["nomes_conf", "nomes_contra"])
        .fillna(False, ["oficial"])
    )


@query(
    "d2_claim_decisions",
    f"""WITH {_RELATIONS}, {_EVIDENCE}, {_CHAIN}, din AS (SELECT clm.qid, k, tipo, tipo IN ('opiniao', 'previsao') AS op, k % 7 = 0 AS mis, coalesce(n_conf, 0) AS nc, coalesce(n_contra, 0) AS nx, coalesce(oficial, FALSE) AS ofi, coalesce(nomes_conf, '') AS nomes, coalesce(nomes_contra, '') AS contra, coalesce(cobertura, 0) AS cob, pontos, itens,
      k % 3 <> 0 AS consultou, CASE WHEN k % 4 = 0 THEN 1 ELSE 0 END AS chk FROM clm LEFT JOIN ev USING (qid) JOIN pts USING (qid)),
    lv AS (SELECT *, CASE WHEN NOT op AND mis AND nc = 0 THEN 'provavelmente_falso' WHEN NOT op AND nx >= 2 AND nc = 0 THEN 'provavelmente_falso' WHEN NOT op AND NOT mis AND nx = 0 AND (nc >= 2 OR (nc >= 1 AND ofi)) THEN 'provavelmente_verdadeiro'
      WHEN (pontos >= 45 AND nc = 0) OR (tipo = 'afirmacao' AND cob = 0 AND pontos >= 25) THEN 'suspeito' ELSE 'nao_confirmado' END AS nivel FROM din),
    rs AS (SELECT *, list_filter([CASE WHEN op THEN {{'w': 95, 'o': 0, 't': 'Isto é opinião ou previsão, não um fato que possa ser checado.'}} END,
        CASE WHEN NOT op AND mis THEN {{'w': 100, 'o': 1, 't': 'Não existe município chamado “Atlantida” na lista oficial do IBGE (5.571 municípios).'}} END,
        CASE WHEN NOT op AND mis THEN {{'w': 100, 'o': 2, 't': 'Não existe município chamado “Nowhere” na lista oficial do IBGE (5.571 municípios).'}} END,
        CASE WHEN NOT op AND nx > 0 THEN {{'w': 90, 'o': 3, 't': 'Veículos como ' || contra || ' noticiam o contrário ou desmentem a afirmação.'}} END,
        CASE WHEN nc > 0 AND nivel <> 'provavelmente_falso' THEN {{'w': 80, 'o': 4, 't': 'Foi noticiado por ' || nomes || '.'}} END,
        CASE WHEN cob = 0 THEN {{'w': 40, 'o': 5, 't': 'Nenhum veículo de imprensa que consultamos noticiou o caso.'}} END,
        CASE WHEN cob > 0 AND nc = 0 AND nx = 0 THEN {{'w': 30, 'o': 6, 't': 'Há notícias sobre o assunto, mas nenhuma confirma a afirmação.'}} END], lambda z: z IS NOT NULL) AS l FROM lv)
    SELECT qid, nivel, CASE nivel WHEN 'provavelmente_falso' THEN 'alta' WHEN 'provavelmente_verdadeiro' THEN CASE WHEN nc >= 3 THEN 'alta' ELSE 'media' END WHEN 'suspeito' THEN 'media' ELSE 'baixa' END AS confianca,
      coalesce((SELECT first(u.t ORDER BY u.w DESC, u.o) FROM (SELECT unnest(l, recursive := true)) u WHERE u.w > 25), '') AS motivo,
      least(4, len(l) + CASE WHEN nivel <> 'provavelmente_verdadeiro' THEN itens ELSE 0 END) + 1 AS motivos FROM rs""",
)
def d2(spark, sf):
    d = evidence.decide(decision_inputs(spark, sf))
    n_rules = F.col("motivos")[0]
    heavy = n_rules.rlike("^(Isto é opinião|Não existe município|Veículos como|Foi noticiado|Nenhum veículo de|Há notícias)")
    return d.select("qid", "nivel", "confianca", F.when(heavy, n_rules).otherwise("").alias("motivo"), F.size("motivos").cast("bigint").alias("motivos"))


@query("d2_agency_results", f"""WITH {_MERGED}, c AS (SELECT qid, count(*) FILTER (WHERE classe = 'falso') AS f, count(*) FILTER (WHERE classe = 'enganoso') AS e, count(*) FILTER (WHERE classe = 'verdadeiro') AS v, count(*) FILTER (WHERE classe = 'misto') AS m FROM best WHERE classe <> '' GROUP BY qid),
    vd AS (SELECT qid, CASE WHEN f + e > 0 AND v = 0 THEN CASE WHEN f >= e THEN 'falso' ELSE 'enganoso' END WHEN v > 0 AND f + e = 0 AND m = 0 THEN 'verdadeiro' ELSE 'misto' END AS vv FROM c),
    pk AS (SELECT qid, vv, arg_min(url, (classe <> vv, classe = '', place)) AS dito FROM vd JOIN best USING (qid) GROUP BY qid, vv)
    SELECT qid, CASE vv WHEN 'verdadeiro' THEN 'provavelmente_verdadeiro' WHEN 'misto' THEN 'nao_confirmado' ELSE 'provavelmente_falso' END AS nivel, 'A agência X avaliou: “' || dito || '”.' AS resumo FROM pk""")
def d2_agency(spark, sf):
    merged = merged_checks(spark, sf)
    v = evidence.aggregate_verdict(merged, claims(spark, sf))
    out = evidence.agency_result(v, merged.select("qid", "place", "classe", F.lit("X").alias("agencia"), F.col("url").alias("dito")))
    return out.select("qid", "nivel", "resumo")


# --- summaries --------------------------------------------------------------------------------------------------------------


def _repeats(s, t):
    return f"(len({s}) = 0 OR len(list_intersect({s}, {t})) / greatest(len({s}), 1) >= 0.85 OR len({s}) - len(list_intersect({s}, {t})) <= 2)"


@query("x12_repeats_title", f"""WITH {HEADLINES}, k AS (SELECT doc_id, {base.tokens2('CASE WHEN doc_id % 2 = 0 THEN title ELSE "desc" END')} AS s, {base.tokens2('title')} AS t FROM h) SELECT doc_id, {_repeats('s', 't')} AS repeats FROM k""")
def x12(spark, sf):
    h = views.headlines(spark, sf)
    s = F.when(F.col("doc_id") % 2 == 0, F.col("title")).otherwise(F.col("desc"))
    return h.select("doc_id", text.repeats_title(s, F.col("title")).alias("repeats"))


def descriptions(spark, sf):
    h = views.headlines(spark, sf, body=True)
    parts = F.array(F.col("desc"), F.col("title"), F.col("body"), F.upper("desc"))
    return h.select(F.col("id").alias("qid"), "title", F.posexplode(parts).alias("pos", "value"))


_DESCRIPTIONS = f"""ds AS (SELECT id AS qid, title, i AS pos, {base.squeeze('l[i]')} AS value FROM (SELECT id, title, ["desc", title, body, upper("desc")] AS l FROM h), range(1, 5) t(i)),
    dt AS (SELECT *, {base.tokens2('value')} AS s, {base.tokens2('title')} AS t, {base.fold2('value')} AS fd FROM ds WHERE length(value) >= 30),
    us AS MATERIALIZED (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid, fd ORDER BY pos) AS r FROM dt WHERE NOT {_repeats('s', 't')}) WHERE r = 1)"""


@query("x13_useful_descriptions", f"WITH {HEADLINES}, {_DESCRIPTIONS} SELECT qid, pos - 1 AS pos, md5(value) AS digest FROM us")
def x13(spark, sf):
    return evidence.useful_descriptions(descriptions(spark, sf)).select("qid", F.col("pos").cast("bigint").alias("pos"), F.md5("value").alias("digest"))


@query("x14_context_names_outlet", f"""WITH {HEADLINES} SELECT doc_id, regexp_matches({base.fold2('body')}, 'the daily') OR regexp_matches({base.fold2('body')}, 'daily') OR regexp_matches({base.fold2('body')}, 'thintion') AS cites FROM h""")
def x14(spark, sf):
    outlets = F.array(F.lit("The Daily"), F.lit("Thintion"))
    return views.headlines(spark, sf, body=True).select("doc_id", evidence.cites_outlet(F.col("body"), outlets).alias("cites"))


@query(
    "d3_summary_readiness",
    f"""WITH {HEADLINES}, {_DESCRIPTIONS}, ch AS (SELECT qid, sum(length(value)) AS chars FROM us GROUP BY qid)
    SELECT id AS qid, CASE WHEN source = 'src7' THEN 'bloqueada' WHEN length(body) >= 600 AND lang <> 'en' THEN 'materia' WHEN coalesce(chars, 0) >= 200 THEN 'descricoes' ELSE 'nenhuma' END AS base, CAST(coalesce(chars, 0) AS BIGINT) AS chars FROM h LEFT JOIN ch ON qid = id""",
)
def d3(spark, sf):
    h = views.headlines(spark, sf, body=True)
    a = h.select(F.col("id").alias("qid"), (F.col("source") == "src7").alias("bloq"), F.when(F.col("lang") != "en", F.col("body")).otherwise("").alias("page_text"))
    return evidence.summary_readiness(a, descriptions(spark, sf))


# --- search -------------------------------------------------------------------------------------------------------------------

_SEARCHES = ["the leau", "Éion", "nicht der outlet", "thintion re", "para"]


def _unioned(parts) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def _all_in(k, q):
    return " AND ".join(f"contains({k}, '{t}')" for t in retrieval.search_terms(q))


@query(
    "k1_keyword_search",
    f"WITH {HEADLINES}, {SOURCES}, ix AS MATERIALIZED (SELECT h.id, {base.fold1('title')} AS kt, {base.fold1("name || ' ' || body")} AS kr FROM h JOIN src ON src.id = h.source) "
    + " UNION ALL ".join(
        f"SELECT {i} AS qid, id, " + " + ".join(f"CASE WHEN contains(kt, '{t}') THEN 2 ELSE 1 END" for t in retrieval.search_terms(q))
        + " AS score FROM ix WHERE " + " AND ".join(f"(contains(kt, '{t}') OR contains(kr, '{t}'))" for t in retrieval.search_terms(q))
        for i, q in enumerate(_SEARCHES)
    ),
)
def k1(spark, sf):
    s = views.sources(spark, sf).select(F.col("id").alias("source"), F.col("name").alias("source_name"))
    index = views.headlines(spark, sf, body=True).withColumn("desc", F.col("body")).join(s, "source")
    return _unioned([retrieval.keyword_search(index, q).select(F.lit(i).alias("qid"), "id", "score") for i, q in enumerate(_SEARCHES)])


@query(
    "k2_type_ahead",
    f"WITH {HEADLINES}, {SOURCES}, ix AS MATERIALIZED (SELECT h.id, published, {base.fold1("title || ' ' || name")} AS k FROM h JOIN src ON src.id = h.source) "
    + " UNION ALL ".join(f"(SELECT {i} AS qid, id FROM ix WHERE {_all_in('k', q)} ORDER BY published DESC, id LIMIT 10)" for i, q in enumerate(_SEARCHES)),
)
def k2(spark, sf):
    index = named_headlines(spark, sf)
    return _unioned([retrieval.type_ahead(index, q).select(F.lit(i).alias("qid"), "id") for i, q in enumerate(_SEARCHES)])


_TYPED = f"""typed AS (SELECT conv_id * 1000 + turn AS qid, array_to_string(regexp_extract_all(text, '\\S+')[:3], ' ') AS q FROM conversations),
    asked AS (SELECT DISTINCT qid, unnest(list_filter(string_split_regex({base.fold1('q')}, '\\s+'), lambda w: length(w) > 1)) AS term FROM typed)"""


def typed_queries(spark, sf):
    """The first three words of every conversation turn."""
    c = table(spark, sf, "conversations")
    words = F.slice(F.regexp_extract_all("text", F.lit(r"\S+"), F.lit(0)), 1, 3)
    return c.select((F.col("conv_id") * 1000 + F.col("turn")).alias("qid"), F.array_join(words, " ").alias("q"))


@query(
    "k1_search_by_table",
    f"""WITH {HEADLINES}, {SOURCES}, {_TYPED}, ix AS MATERIALIZED (SELECT h.id, h.published, {base.fold1('title')} AS kt, {base.fold1("name || ' ' || body")} AS kr FROM h JOIN src ON src.id = h.source),
    met AS (SELECT qid, id, published, count(*) AS n, sum(CASE WHEN contains(kt, term) THEN 2 ELSE 1 END) AS score FROM asked JOIN ix ON contains(kt, term) OR contains(kr, term) GROUP BY qid, id, published),
    ranked AS (SELECT qid, id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, published DESC, id) AS place FROM met JOIN (SELECT qid, count(*) AS n FROM asked GROUP BY qid) USING (qid, n))
    SELECT qid, id, CAST(score AS BIGINT) AS score, place FROM ranked WHERE place <= 30""",
)
def k1_by_table(spark, sf):
    s = views.sources(spark, sf).select(F.col("id").alias("source"), F.col("name").alias("source_name"))
    index = views.headlines(spark, sf, body=True).withColumn("desc", F.col("body")).join(s, "source").withColumn("pessoas", F.array().cast("array<string>"))
    return search.keyword_search(index, typed_queries(spark, sf), limit=30).select("qid", "id", "score", F.col("place").cast("bigint").alias("place"))


@query(
    "k2_completion_table",
    f"""WITH {HEADLINES}, {SOURCES}, {_TYPED}, ix AS MATERIALIZED (SELECT h.id, h.published, {base.fold1("title || ' ' || name")} AS k FROM h JOIN src ON src.id = h.source),
    words AS (SELECT qid, q[:i] AS q, qid * 1000 + i AS tid FROM (SELECT qid, {base.fold1('q')} AS q FROM typed), LATERAL (SELECT unnest(range(1, length(q) + 1)) AS i)),
    parts AS (SELECT DISTINCT tid, unnest(list_filter(string_split_regex(q, '\\s+'), lambda w: length(w) > 1)) AS term FROM words),
    met AS (SELECT tid, id, published, count(*) AS n FROM parts JOIN ix ON contains(k, term) GROUP BY tid, id, published),
    ranked AS (SELECT tid, id, row_number() OVER (PARTITION BY tid ORDER BY published DESC, id) AS place FROM met JOIN (SELECT tid, count(*) AS n FROM parts GROUP BY tid) USING (tid, n))
    SELECT tid AS qid, id, place FROM ranked WHERE place <= 10""",
)
def k2_completion(spark, sf):
    """Every prefix of what users type, against a table built of old rows and kept up with new ones."""
    index = named_headlines(spark, sf).select("id", "title", "source_name", "published")
    old = F.col("published") < views.now() - F.expr("INTERVAL 96 HOUR")
    kept_up = cut_lineage(search.merged_completions(search.completions(index.where(old)), index.where(~old)))
    whole = typed_queries(spark, sf).select("qid", text.fold_grouping(F.col("q")).alias("q"))
    lengths = F.filter(F.sequence(F.lit(1), F.greatest(F.length("q"), F.lit(1))), lambda n: n <= F.length("q"))
    typed = whole.select("qid", "q", F.explode(lengths).alias("n")).select((F.col("qid") * 1000 + F.col("n")).alias("qid"), F.substring(F.col("q"), F.lit(1), F.col("n")).alias("q"))
    return search.complete(typed, kept_up, index).select("qid", "id", F.col("place").cast("bigint").alias("place"))


@query(
    "k3_story_search",
    f"""WITH {HEADLINES}, {SOURCES}, {LOOSE_SQL}, {_TYPED}, st AS MATERIALIZED (SELECT m.story, {base.fold1("string_agg(m.title || ' ' || d.desc, ' ') || ' ' || string_agg(DISTINCT src.name, ' ')")} AS k
      FROM members m JOIN h d ON d.id = m.id JOIN src ON src.id = m.source GROUP BY m.story),
    met AS (SELECT qid, story, count(*) AS n FROM asked JOIN st ON contains(k, term) GROUP BY qid, story)
    SELECT qid, story FROM met JOIN (SELECT qid, count(*) AS n FROM asked GROUP BY qid) USING (qid, n)""",
)
def k3_search(spark, sf):
    """Stories by the words of all their headlines and summaries, and by their outlets."""
    said = members(spark, sf)
    return search.filter_stories(search.story_words(said, views.sources(spark, sf)), typed_queries(spark, sf))


@query(
    "k3_story_filter",
    f"""WITH {HEADLINES}, {LOOSE_SQL}, st AS (SELECT m.story, {base.fold1("any_value(l.title) || ' ' || array_to_string(list_sort(list_distinct(list(m.source))), ' ')")} AS k FROM members m JOIN h l ON l.id = m.story GROUP BY m.story HAVING count(DISTINCT m.source) >= 2) """
    + " UNION ALL ".join(f"SELECT {i} AS qid, story FROM st WHERE {_all_in('k', q)}" for i, q in enumerate(["the src1", "la", "en src3 src4"])),
)
def k3(spark, sf):
    from pressloom.operators import coverage

    s = coverage.story_coverage(members(spark, sf), spark.createDataFrame([("src-", "src-")], "id string, name string"))
    words = s.select("story", F.concat_ws(" ", "lead_title", F.array_join("names", " ")).alias("words"))
    return _unioned([retrieval.filter_stories(words, q).select(F.lit(i).alias("qid"), "story") for i, q in enumerate(["the src1", "la", "en src3 src4"])])
