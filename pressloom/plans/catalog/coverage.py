"""Checked queries: tagging, story grouping, coverage counts and listings."""

from __future__ import annotations

from pyspark.sql import functions as F

from pressloom.functions import text
from pressloom.operators import coverage, dictionary, listings, tagging
from pressloom.operators.leaders import LOOSE, STRICT, similar_leaders
from pressloom.plans import digests, enrich, publish, views
from pressloom.plans.catalog import base
from pressloom.plans.catalog.base import HEADLINES, NOW, SOURCES, query
from pressloom.plans.views import table
from pressloom.session import cut_lineage

TOPICS = {
    "alpha": ["thintion", "rewh", "leau"],
    "beta": ["orre", "stion", "aux"],
    "gamma": ["nicht", "cióng", "entre"],
}
PEOPLE = {
    "ana": r"\bthat\b(?! the)",
    "bo": r"(?<!de )\bleau",
    "cy": r"\brewh|\borre\b",
    "di": r"\bnicht\b",
}
STATES = {
    "AA": ("Aa", "North", ["The"], ["with"]),
    "BB": ("Bb", "North", ["In", "And"], ["from"]),
    "CC": ("Cc", "South", ["Is", "It"], ["this"]),
    "DD": ("Dd", "South", ["Of"], ["that"]),
    "EE": ("Ee", "West", ["La", "Les"], ["avec"]),
    "FF": ("Ff", "West", ["Zebra"], ["zebroid"]),
}
FRAMING = ["the", "that", "la", "les", "nicht", "para", "with-the", "und"]
CONFIG = {"topics": TOPICS, "people": PEOPLE, "states": STATES}


def joined(c):
    return F.array_join(c, ",")


def tagged(spark, sf):
    """Headlines with names and tags read from the whole text."""
    h = views.headlines(spark, sf, body=True)
    s = views.sources(spark, sf).select(F.col("id").alias("source"), F.col("name").alias("source_name"), "uf")
    h = h.join(s, "source")
    default = F.when(F.col("grupo") == "regional", F.element_at(F.array(*[F.lit(c) for c in STATES]), F.pmod(views.source_number(F.col("source")), F.lit(6)) + 1))
    return enrich.tag(h, F.concat_ws(" ", "title", "body"), F.col("title"), default, CONFIG)


def _topic_sql(x):
    tests = ", ".join(
        f"CASE WHEN regexp_matches({x}, '\\b(?:{'|'.join(text.plain_fold(k) for k in ks)})') THEN '{t}' END" for t, ks in TOPICS.items()
    )
    return f"list_filter([{tests}], lambda z: z IS NOT NULL)"


def _people_sql(x):
    return (
        f"list_filter([CASE WHEN regexp_matches(regexp_replace({x}, '\\bthat the', 'x', 'g'), '\\bthat\\b') THEN 'ana' END, "
        f"CASE WHEN regexp_matches(regexp_replace({x}, 'de leau', 'x', 'g'), '\\bleau') THEN 'bo' END, "
        f"CASE WHEN regexp_matches({x}, '\\brewh|\\borre\\b') THEN 'cy' END, "
        f"CASE WHEN regexp_matches({x}, '\\bnicht\\b') THEN 'di' END], lambda z: z IS NOT NULL)"
    )


_TERMS = ", ".join(
    f"('{term if exact else term.lower()}', {'TRUE' if exact else 'FALSE'}, {-len(term) - (100 if exact else 0)}, '{code}')"
    for code, (_, _, names, demonyms) in STATES.items()
    for exact, terms in ((True, names), (False, demonyms))
    for term in terms
)
TAGGED = f"""{HEADLINES}, {SOURCES}, terms(term, exact, rank, code) AS (VALUES {_TERMS}),
words AS (SELECT doc_id, w[i] AS w, i FROM (SELECT doc_id, regexp_extract_all(title || ' ' || body, '[A-Za-zÀ-ÖØ-öø-ÿ]+') AS w FROM h), LATERAL (SELECT unnest(range(1, len(w) + 1)) AS i)),
hits AS (SELECT doc_id, code, rank, i FROM words JOIN terms ON (exact AND w = term) OR (NOT exact AND lower(w) = term)),
firsts AS (SELECT doc_id, code, (min((rank, i)))[2] AS pos FROM hits GROUP BY doc_id, code),
named AS (SELECT doc_id, list(code ORDER BY pos) AS named FROM firsts GROUP BY doc_id),
withdef AS (SELECT h.*, src.name AS source_name, coalesce(named, []::VARCHAR[]) AS named, CASE WHEN h.grupo = 'regional' THEN ['AA','BB','CC','DD','EE','FF'][h.n % 6 + 1] ELSE '' END AS uf_fonte
  FROM h JOIN src ON src.id = h.source LEFT JOIN named USING (doc_id)),
folded AS (SELECT *, {base.fold1("title || ' ' || body")} AS ft, {base.fold1('title')} AS fti, CASE WHEN uf_fonte <> '' AND NOT list_contains(named, uf_fonte) THEN list_prepend(uf_fonte, named) ELSE named END AS allufs FROM withdef),
tagged AS MATERIALIZED (SELECT *, {_topic_sql('ft')} AS topics, {_people_sql('fti')} AS pessoas_t, {_people_sql('ft')} AS pessoas,
  CASE WHEN len(allufs) > 3 THEN CASE WHEN uf_fonte <> '' THEN [uf_fonte] ELSE []::VARCHAR[] END ELSE allufs END AS ufs,
  CASE WHEN len(named) > 3 THEN []::VARCHAR[] ELSE named END AS ufs_txt, {base.day('published')} AS day FROM folded)"""


@query("j7_topics", f"WITH {TAGGED} SELECT doc_id, array_to_string(topics, ',') AS topics FROM tagged")
def j7(spark, sf):
    h = views.headlines(spark, sf, body=True)
    return h.select("doc_id", joined(tagging.topics(F.concat_ws(" ", "title", "body"), TOPICS)).alias("topics"))


@query("j8_people", f"WITH {TAGGED} SELECT doc_id, array_to_string(pessoas_t, ',') AS pessoas_t, array_to_string(pessoas, ',') AS pessoas FROM tagged")
def j8(spark, sf):
    h = views.headlines(spark, sf, body=True)
    return h.select(
        "doc_id",
        joined(tagging.people(F.col("title"), PEOPLE)).alias("pessoas_t"),
        joined(tagging.people(F.concat_ws(" ", "title", "body"), PEOPLE)).alias("pessoas"),
    )


@query("j9_states_named", f"WITH {TAGGED} SELECT doc_id, array_to_string(named, ',') AS named FROM tagged")
def j9(spark, sf):
    from pressloom.functions import places

    h = views.headlines(spark, sf, body=True)
    return h.select("doc_id", joined(places.state_codes(F.concat_ws(" ", "title", "body"), STATES)).alias("named"))


@query("j10_states_kept", f"WITH {TAGGED} SELECT doc_id, array_to_string(ufs, ',') AS ufs, array_to_string(ufs_txt, ',') AS ufs_txt, uf_fonte FROM tagged")
def j10(spark, sf):
    return tagged(spark, sf).select("doc_id", joined("ufs").alias("ufs"), joined("ufs_txt").alias("ufs_txt"), "uf_fonte")


_FRAMING_RE = "(?:" + "|".join(sorted(FRAMING, key=len, reverse=True)) + ")"


@query(
    "f18_framing_words",
    rf"""WITH {HEADLINES}, sep AS (SELECT source, regexp_replace({base.fold1("title || ' ' || body")}, '([^a-z0-9])', '\1\1', 'g') AS t FROM h),
    m AS (SELECT source, unnest(regexp_extract_all(t, '(?:^|[^a-z0-9])({_FRAMING_RE.replace('-', '--')})(?:$|[^a-z0-9])', 1)) AS word FROM sep)
    SELECT source, replace(word, '--', '-') AS word, count(*) AS n FROM m GROUP BY ALL""",
)
def f18(spark, sf):
    h = views.headlines(spark, sf, body=True)
    return tagging.framing_counts(h, F.concat_ws(" ", "title", "body"), FRAMING)


# --- dictionaries as tables ---------------------------------------------------------------------------------------------


def dictionaries(spark):
    """Common dictionaries, and those of the channel the queries run for; another channel's rows must not be used."""
    people = {"ana": ["that"], "bo": ["leau"], "cy": ["rewh", "orre"], "di": ["nicht"]}
    rows = [(None, "framing", None, "unused", None, 0), ("other", "topic", "alpha", "the", None, 0), (None, "topic", "old", "the", None, 0)]
    rows += [("checked", "topic", key, term, None, i) for i, (key, terms) in enumerate(TOPICS.items()) for term in terms]
    rows += [("checked", "framing", None, term, None, 0) for term in FRAMING]
    rows += [(None, "people", key, term, PEOPLE[key], i) for i, (key, terms) in enumerate(people.items()) for term in terms]
    dims = spark.createDataFrame(rows, "channel string, kind string, key string, term string, pattern string, ord int")
    return dictionary.of_channel(dims, "checked")


@query("j7_topics_by_table", f"WITH {TAGGED} SELECT doc_id, array_to_string(topics, ',') AS topics FROM tagged")
def j7_by_table(spark, sf):
    h = views.headlines(spark, sf, body=True)
    listed = dictionaries(spark).where("kind = 'topic'").select("key", "term", "ord")
    return dictionary.keys_named(h, "doc_id", F.concat_ws(" ", "title", "body"), listed, "topics").select("doc_id", joined("topics").alias("topics"))


@query("j8_people_by_table", f"WITH {TAGGED} SELECT doc_id, array_to_string(pessoas, ',') AS pessoas FROM tagged")
def j8_by_table(spark, sf):
    h = views.headlines(spark, sf, body=True)
    listed = dictionaries(spark).where("kind = 'people'").select("key", "term", "pattern", "ord")
    return dictionary.patterns_named(h, "doc_id", F.concat_ws(" ", "title", "body"), listed, "pessoas").select("doc_id", joined("pessoas").alias("pessoas"))


@query("f18_framing_by_table", base.ORACLES["f18_framing_words"])
def f18_by_table(spark, sf):
    h = views.headlines(spark, sf, body=True)
    used = dictionary.words_used(h, "doc_id", F.concat_ws(" ", "title", "body"), dictionaries(spark).where("kind = 'framing'").select("term"))
    return used.join(h.select(F.col("doc_id").alias("id"), "source"), "id").groupBy("source", F.col("term").alias("word")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "j7_terms_of_turns",
    f"""WITH terms AS (SELECT DISTINCT regexp_extract(trim(regexp_replace({base.fold1('text')}, '\s+', ' ', 'g')), '^[a-z0-9]+ [a-z0-9]+') AS term FROM conversations),
    d AS (SELECT doc_id, trim(regexp_replace({base.fold1('text')}, '\s+', ' ', 'g')) AS t FROM documents)
    SELECT term, count(*) AS n_docs FROM d JOIN terms ON term <> '' AND contains(t, term) AND regexp_matches(t, '(^|[^a-z0-9])' || term || '($|[^a-z0-9])') GROUP BY term""",
)
def terms_of_turns(spark, sf):
    """Which documents hold the first two words of any turn; the dictionary grows with the conversations."""
    said = table(spark, sf, "conversations").select(F.regexp_extract(dictionary.plain(F.col("text")), "^[a-z0-9]+ [a-z0-9]+", 0).alias("term")).distinct()
    found = dictionary.hits(table(spark, sf, "documents"), "doc_id", dictionary.plain(F.col("text")), said, dictionary.ASCII_WORD, whole=True)
    return found.select("id", "term").distinct().groupBy("term").agg(F.count(F.lit(1)).alias("n_docs"))


def checks(spark, sf):
    """Fact checks whose titles carry a verdict taken from the labels."""
    labels = table(spark, sf, "labels")
    h = views.headlines(spark, sf).join(labels, "doc_id").withColumn("kind", F.lit("checagem"))
    lead = (
        F.when((F.col("toxic") == 1) & (F.col("quality") == 1), "É falso que ")
        .when(F.col("toxic") == 1, "Enganoso: não é bem assim, ")
        .when((F.col("quality") == 1) & (F.col("doc_id") % 2 == 0), "É verdade que não ")
        .when(F.col("quality") == 1, "É verdade, mas ")
        .otherwise("Fato ou Fake: ")
    )
    return h.withColumn("title", F.concat(lead, "title"))


CHECKS = f"""{HEADLINES}, chk AS (SELECT h.* EXCLUDE (title, kind), 'checagem' AS kind, quality, toxic, CASE WHEN toxic = 1 AND quality = 1 THEN 'É falso que ' WHEN toxic = 1 THEN 'Enganoso: não é bem assim, '
  WHEN quality = 1 AND doc_id % 2 = 0 THEN 'É verdade que não ' WHEN quality = 1 THEN 'É verdade, mas ' ELSE 'Fato ou Fake: ' END || title AS title FROM h JOIN labels USING (doc_id))"""


@query(
    "f17_denial_alerts",
    f"""WITH {CHECKS} SELECT id, title FROM chk WHERE published > {NOW} - INTERVAL 240 HOUR
    AND regexp_matches({base.fold1('title')}, '\\b(falso|falsa|falsos|fake|engano|enganoso|enganosa|golpe|boato|desinforma\\w*|manipulad\\w*|montagem|nao procede|sem provas?|distorc\\w*|descontextualiz\\w*|sem\\s+fundamento)\\b')
    ORDER BY published DESC, id LIMIT 10""",
)
def f17(spark, sf):
    return tagging.denial_alerts(checks(spark, sf), views.now(), hours=240).select("id", "title")


# --- grouping -------------------------------------------------------------------------------------------------------


def loose_links(spark, sf):
    h = views.headlines(spark, sf)
    return h, similar_leaders(h.select("id", F.col("published").alias("ts"), text.grouping_tokens(F.col("title")).alias("tokens")), LOOSE)


def strict_links(spark, sf):
    h = views.headlines(spark, sf)
    return h, similar_leaders(h.select("id", F.col("published").alias("ts"), text.grouping_tokens(F.col("title")).alias("tokens")), STRICT)


def _fold_sql(pairs: str) -> str:
    return f"""pairs AS MATERIALIZED ({pairs}),
    nb AS (SELECT toks.o, list(y) FILTER (WHERE y IS NOT NULL) AS nb FROM toks LEFT JOIN pairs ON x = o GROUP BY toks.o),
    folded_leads AS (SELECT list_reduce(list({{'o': o, 'nb': coalesce(nb, []::BIGINT[])}} ORDER BY o), lambda acc, z: CASE WHEN list_has_any(acc, z.nb) THEN acc ELSE list_append(acc, z.o) END, []::BIGINT[]) AS l FROM nb),
    leads AS MATERIALIZED (SELECT unnest(l) AS o FROM folded_leads)"""


TOKS = f"""numbered AS (SELECT *, row_number() OVER (ORDER BY published DESC, id) AS o FROM h),
    alltoks AS (SELECT o, id, source, published, title, {base.tokens1('title')} AS t FROM numbered),
    toks AS MATERIALIZED (SELECT * FROM alltoks WHERE len(t) >= 3)"""
LOOSE_SQL = f"""{TOKS}, """ + _fold_sql(
    """SELECT * FROM (SELECT b.o AS x, a.o AS y, len(list_intersect(a.t, b.t)) AS shared, len(a.t) + len(b.t) AS sizes FROM toks a JOIN toks b ON a.o < b.o)
    WHERE shared >= 3 AND shared / (sizes - shared) >= 0.34"""
) + """, choice AS (SELECT x, min(y) AS y FROM pairs WHERE y IN (SELECT o FROM leads) AND x NOT IN (SELECT o FROM leads) GROUP BY x),
    assigned AS MATERIALIZED (SELECT toks.*, coalesce(y, o) AS lead FROM toks LEFT JOIN choice ON x = o),
    members AS (SELECT a.*, l.id AS story FROM assigned a JOIN toks l ON l.o = a.lead)"""
STRICT_SQL = f"""{TOKS}, df AS (SELECT w, count(*) AS c FROM (SELECT unnest(t) AS w FROM toks) GROUP BY w), total AS (SELECT greatest(count(*), 2) AS n FROM toks),
    wt AS (SELECT o, list({{'w': w, 'v': ln(n / c)}} ORDER BY c, w) AS wl, sum(ln(n / c)) AS ws FROM (SELECT o, unnest(t) AS w FROM toks) JOIN df USING (w), total GROUP BY o),
    wtoks AS MATERIALIZED (SELECT toks.*, wl, ws FROM toks JOIN wt USING (o)), """ + _fold_sql(
    """SELECT x, y, shared, sizes, shared_weight, smaller FROM (SELECT b.o AS x, a.o AS y, len(list_intersect(a.t, b.t)) AS shared, len(a.t) + len(b.t) AS sizes, least(a.ws, b.ws) AS smaller,
      list_sum(list_transform(list_filter(b.wl, lambda p: list_contains(a.t, p.w)), lambda p: p.v)) AS shared_weight
      FROM wtoks a JOIN wtoks b ON a.o < b.o AND epoch(a.published) - epoch(b.published) <= 36 * 3600) WHERE shared >= 3 AND shared_weight >= 0.5 * smaller - 1e-9"""
) + """, choice AS (SELECT x, max(y) AS y FROM pairs WHERE y IN (SELECT o FROM leads) AND x NOT IN (SELECT o FROM leads) GROUP BY x),
    assigned AS MATERIALIZED (SELECT toks.*, coalesce(y, o) AS lead FROM toks LEFT JOIN choice ON x = o),
    gids AS (SELECT a.*, l.id AS gid FROM assigned a JOIN toks l ON l.o = a.lead)"""


@query(
    "j5_similar_headlines",
    f"""WITH {HEADLINES}, {LOOSE_SQL} SELECT m.id, story AS leader, shared, round(shared / (sizes - shared), 6) AS jaccard FROM members m JOIN pairs ON x = m.o AND y = m.lead""",
)
def j5(spark, sf):
    _, links = loose_links(spark, sf)
    return links.where(F.col("id") != F.col("leader")).select(
        "id", "leader", F.col("shared").cast("bigint").alias("shared"), F.round(F.col("shared") / F.col("united"), 6).alias("jaccard")
    )


@query(
    "j6_weighted_overlap_in_time",
    f"""WITH {HEADLINES}, {STRICT_SQL} SELECT m.id, gid AS leader, shared, round(shared_weight / smaller, 5) AS weight_share FROM gids m JOIN pairs ON x = m.o AND y = m.lead""",
)
def j6(spark, sf):
    _, links = strict_links(spark, sf)
    return links.where(F.col("id") != F.col("leader")).select(
        "id", "leader", F.col("shared").cast("bigint").alias("shared"), F.round(F.col("weight_shared") / F.col("weight_smaller"), 5).alias("weight_share")
    )


def members(spark, sf):
    h, links = loose_links(spark, sf)
    return h.join(links.select("id", F.col("leader").alias("story")), "id")


_COVERAGE = f"""WITH {HEADLINES}, {SOURCES}, {LOOSE_SQL}, cov AS (SELECT story, count(DISTINCT m.source) AS outlets, count(*) AS size, arg_min(m.id, m.o) AS lead_id, arg_min(m.title, m.o) AS lead_title,
    array_to_string(list_sort(list_distinct(list(name))), ', ') AS names FROM members m JOIN src ON src.id = m.source GROUP BY story HAVING count(DISTINCT m.source) >= 2)"""


def coverage_table(spark, sf):
    return coverage.story_coverage(members(spark, sf), views.sources(spark, sf))


@query("g1_story_coverage", _COVERAGE + " SELECT story, outlets, size, lead_id, lead_title, names FROM cov")
def g1(spark, sf):
    c = coverage_table(spark, sf)
    return c.select("story", "outlets", "size", "lead_id", "lead_title", F.array_join("names", ", ").alias("names")).orderBy(F.col("outlets").desc(), F.col("size").desc(), "story")


@query("a3_top_stories", _COVERAGE + " SELECT story, outlets, size, lead_id FROM cov JOIN h ON h.id = lead_id ORDER BY outlets DESC, size DESC, published DESC, story LIMIT 5")
def a3(spark, sf):
    c = coverage_table(spark, sf)
    best = c.orderBy(F.col("outlets").desc(), F.col("size").desc(), F.col("lead_published").desc(), "story").limit(5)
    return best.select("story", "outlets", "size", "lead_id")


@query(
    "a4_also_in",
    f"""WITH {HEADLINES}, {SOURCES}, {LOOSE_SQL}, named AS (SELECT m.id, m.story, m.source, name FROM members m JOIN src ON src.id = m.source),
    outl AS (SELECT DISTINCT story, source, name FROM named)
    SELECT n.id, n.story, array_to_string(list(o.name ORDER BY o.name), ', ') AS also FROM named n JOIN outl o ON o.story = n.story AND o.source <> n.source GROUP BY n.id, n.story""",
)
def a4(spark, sf):
    return coverage.also_in(members(spark, sf), views.sources(spark, sf)).select("id", "story", F.array_join("also", ", ").alias("also"))


@query(
    "w3_one_headline_per_outlet",
    f"""WITH {HEADLINES}, {LOOSE_SQL}, best AS (SELECT story, source, id, o, row_number() OVER (PARTITION BY story, source ORDER BY o) AS r FROM members)
    SELECT story, source, id, pos FROM (SELECT story, source, id, row_number() OVER (PARTITION BY story ORDER BY o) AS pos FROM best WHERE r = 1) WHERE pos <= 6""",
)
def w3(spark, sf):
    return coverage.per_outlet(members(spark, sf)).select("story", "source", "id", "pos")


@query("g2_strict_stories", f"WITH {HEADLINES}, {STRICT_SQL} SELECT h.id, coalesce(gid, h.id) AS gid FROM h LEFT JOIN gids ON gids.id = h.id")
def g2(spark, sf):
    return coverage.number_stories(views.headlines(spark, sf), text.grouping_tokens(F.col("title"))).select("id", "gid")


# the plain loops, one item a step: the groups so far are a list that the step before hands on
GROWN_LOOSE_SQL = f"""{TOKS}, seq AS (SELECT row_number() OVER (ORDER BY o) AS i, o, id, t FROM toks),
run AS (SELECT CAST(0 AS BIGINT) AS i, CAST(0 AS BIGINT) AS g, CAST([] AS STRUCT(g BIGINT, w VARCHAR[])[]) AS groups UNION ALL
  SELECT i, g, CASE WHEN g = i THEN list_append(groups, {{'g': i, 'w': t}}) ELSE list_transform(groups, lambda x: CASE WHEN x.g = g THEN {{'g': x.g, 'w': list_distinct(list_concat(x.w, t))}} ELSE x END) END
  FROM (SELECT s.i, s.t, r.groups, coalesce(list_min(list_transform(list_filter(r.groups, lambda x: len(list_intersect(x.w, s.t)) >= 3
    AND len(list_intersect(x.w, s.t)) / len(list_distinct(list_concat(x.w, s.t))) >= 0.34), lambda x: x.g)), s.i) AS g FROM run r JOIN seq s ON s.i = r.i + 1)),
members AS (SELECT toks.*, l.id AS story FROM run JOIN seq USING (i) JOIN toks ON toks.o = seq.o JOIN seq l ON l.i = run.g)"""
GROWN_STRICT_SQL = f"""{TOKS}, df AS (SELECT w, count(*) AS c FROM (SELECT unnest(t) AS w FROM alltoks) GROUP BY w), total AS (SELECT greatest(count(*), 2) AS n FROM alltoks),
wt AS (SELECT o, list({{'w': w, 'v': ln(n / c)}} ORDER BY c, w) AS wl, sum(ln(n / c)) AS ws FROM (SELECT o, unnest(t) AS w FROM alltoks) JOIN df USING (w), total GROUP BY o),
seq AS (SELECT a.o AS i, a.id, a.published AS opened, coalesce(wl, CAST([] AS STRUCT(w VARCHAR, v DOUBLE)[])) AS wl, coalesce(ws, 0) AS ws FROM alltoks a LEFT JOIN wt USING (o)),
run AS (SELECT CAST(0 AS BIGINT) AS i, CAST(0 AS BIGINT) AS g, CAST([] AS STRUCT(g BIGINT, opened TIMESTAMP, w STRUCT(w VARCHAR, v DOUBLE)[])[]) AS groups UNION ALL
  SELECT i, g, CASE WHEN g = i THEN list_append(groups, {{'g': i, 'opened': opened, 'w': wl}}) ELSE list_transform(groups, lambda x: CASE WHEN x.g = g THEN {{'g': x.g, 'opened': x.opened, 'w': list_distinct(list_concat(x.w, wl))}} ELSE x END) END
  FROM (SELECT s.i, s.opened, s.wl, r.groups, coalesce(list_max(list_transform(list_filter(r.groups[-700:], lambda x: len(s.wl) >= 3 AND epoch(x.opened) - epoch(s.opened) <= 36 * 3600 AND len(list_intersect(x.w, s.wl)) >= 3
    AND list_sum(list_transform(list_intersect(x.w, s.wl), lambda z: z.v)) >= 0.5 * least(s.ws, list_sum(list_transform(x.w, lambda z: z.v))) - 1e-9), lambda x: x.g)), s.i) AS g
    FROM run r JOIN seq s ON s.i = r.i + 1)),
gids AS (SELECT seq.id, l.id AS gid FROM run JOIN seq USING (i) JOIN seq l ON l.i = run.g)"""


@query(
    "g1_growing_stories",
    f"""WITH RECURSIVE {HEADLINES}, {GROWN_LOOSE_SQL} SELECT story, count(DISTINCT source) AS outlets, count(*) AS size FROM members GROUP BY story HAVING count(DISTINCT source) >= 2""",
)
def g1_growing(spark, sf):
    members = coverage.group_stories(views.headlines(spark, sf), text.grouping_tokens(F.col("title")), grow=True)
    return coverage.story_coverage(members, views.sources(spark, sf)).select("story", "outlets", "size")


@query("g1_growing_members", f"WITH RECURSIVE {HEADLINES}, {GROWN_LOOSE_SQL} SELECT id, story FROM members")
def g1_members(spark, sf):
    return coverage.group_stories(views.headlines(spark, sf), text.grouping_tokens(F.col("title")), grow=True).select("id", "story")


@query("g2_growing_numbers", f"WITH RECURSIVE {HEADLINES}, {GROWN_STRICT_SQL} SELECT id, gid FROM gids")
def g2_growing(spark, sf):
    return coverage.number_stories(views.headlines(spark, sf), text.grouping_tokens(F.col("title")), grow=True).select("id", "gid")


@query(
    "a7_term_weights",
    f"""WITH t AS (SELECT unnest({base.tokens1('text')}) AS term FROM documents), n AS (SELECT greatest(count(*), 2) AS n FROM documents)
    SELECT term, count(*) AS df, round(ln(any_value(n) / count(*)), 9) AS idf FROM t, n GROUP BY term""",
)
def a7(spark, sf):
    from pressloom.operators import retrieval

    d = table(spark, sf, "documents").select(F.col("doc_id").alias("doc"), text.grouping_tokens(F.col("text")).alias("terms"))
    return retrieval.term_weights(d).select("term", "df", F.round("idf", 9).alias("idf"))


# --- counts -----------------------------------------------------------------------------------------------------------


@query(
    "a1_counts",
    f"""WITH {TAGGED}, {"topic_dim(key) AS (VALUES ('alpha'), ('beta'), ('gamma'), ('delta'))"}
    SELECT 'source' AS kind, source AS key, count(*) AS n FROM tagged GROUP BY source UNION ALL SELECT 'day', day, count(*) FROM tagged GROUP BY day
    UNION ALL SELECT 'topic', key, count(doc_id) FROM topic_dim LEFT JOIN (SELECT doc_id, unnest(topics) AS t FROM tagged) ON t = key GROUP BY key""",
)
def a1(spark, sf):
    from pressloom.functions import dates

    t = tagged(spark, sf)
    dim = spark.createDataFrame([("alpha",), ("beta",), ("gamma",), ("delta",)], "key string")
    by_source = coverage.count_by(t.withColumn("key", F.col("source")), "key").withColumn("kind", F.lit("source"))
    by_day = coverage.count_by(t.withColumn("key", dates.local_day(F.col("published"))), "key").withColumn("kind", F.lit("day"))
    by_topic = coverage.count_listed(t, "topics", "key", dim).withColumn("kind", F.lit("topic"))
    return by_source.unionByName(by_day).unionByName(by_topic).select("kind", "key", "n")


_PEOPLE_DIM = [("ana", "Ana"), ("bo", "Bo"), ("cy", "Cy"), ("di", "Di"), ("ed", "Ed")]


@query(
    "a2_scoreboard",
    f"""WITH {TAGGED}, ppl(id, nome) AS (VALUES {", ".join(f"('{i}', '{n}')" for i, n in _PEOPLE_DIM)}),
    s AS (SELECT ppl.id, nome, count(*) FILTER (WHERE list_contains(pessoas_t, ppl.id) AND published > {NOW} - INTERVAL 24 HOUR) AS n24,
      count(DISTINCT source) FILTER (WHERE list_contains(pessoas_t, ppl.id) AND published > {NOW} - INTERVAL 24 HOUR) AS v24,
      count(*) FILTER (WHERE list_contains(pessoas_t, ppl.id)) AS n7, count(DISTINCT source) FILTER (WHERE list_contains(pessoas_t, ppl.id)) AS v7,
      count(*) FILTER (WHERE list_contains(pessoas, ppl.id)) AS total FROM ppl CROSS JOIN tagged GROUP BY ALL)
    SELECT id, nome, n24, v24, n7, v7, total, CAST(round_even(100.0 * n24 / (SELECT greatest(max(n24), 1) FROM s), 0) AS BIGINT) AS pct FROM s""",
)
def a2(spark, sf):
    ppl = spark.createDataFrame(_PEOPLE_DIM, "id string, nome string")
    return coverage.scoreboard(tagged(spark, sf), ppl, views.now()).withColumn("pct", F.col("pct").cast("bigint"))


@query(
    "k6_scoreboard_order",
    f"""WITH {TAGGED}, s AS (SELECT p AS id, count(*) FILTER (WHERE published > {NOW} - INTERVAL 24 HOUR) AS n24, count(*) AS n7 FROM (SELECT published, unnest(pessoas_t) AS p FROM tagged) GROUP BY p)
    SELECT id, row_number() OVER (ORDER BY n24 DESC, n7 DESC, id) AS place FROM s ORDER BY place LIMIT 3""",
)
def k6(spark, sf):
    from pyspark.sql import Window

    ppl = spark.createDataFrame(_PEOPLE_DIM, "id string, nome string")
    board = coverage.scoreboard(tagged(spark, sf), ppl, views.now()).where(F.col("n7") > 0)
    place = F.row_number().over(Window.orderBy(F.col("n24").desc(), F.col("n7").desc(), "nome"))  # one row per person
    return board.select("id", place.cast("bigint").alias("place")).where(F.col("place") <= 3)


@query(
    "j20_state_totals",
    f"""WITH {TAGGED}, st(uf, nome, regiao) AS (VALUES {", ".join(f"('{k}', '{v[0]}', '{v[1]}')" for k, v in STATES.items())})
    SELECT regiao, uf, nome, count(doc_id) AS n FROM st LEFT JOIN (SELECT doc_id, unnest(ufs) AS u FROM tagged) ON u = uf GROUP BY ALL""",
)
def j20(spark, sf):
    st = spark.createDataFrame([(k, v[0], v[1]) for k, v in STATES.items()], "uf string, nome string, regiao string")
    return coverage.state_totals(tagged(spark, sf), st)


@query(
    "j19_source_report",
    f"""WITH {HEADLINES}, {SOURCES}, rep AS (SELECT src.id, src.grupo, CASE WHEN src.grupo = 'regional' THEN uf ELSE src.grupo END AS section, count(h.id) AS n
      FROM src LEFT JOIN h ON h.source = src.id GROUP BY ALL)
    SELECT grupo, section, array_to_string(list(id || ':' || n ORDER BY id), ',') AS rows, CAST(sum(n) AS BIGINT) AS n FROM rep GROUP BY grupo, section""",
)
def j19(spark, sf):
    r = coverage.source_report(views.sources(spark, sf), views.headlines(spark, sf))
    rows = F.transform("rows", lambda x: F.concat_ws(":", x["id"], x["n"].cast("string")))
    return r.select("grupo", "section", joined(rows).alias("rows"), "n")


# --- digests and external groupings ---------------------------------------------------------------------------------------


def story_members(spark, sf):
    _, links = loose_links(spark, sf)
    return tagged(spark, sf).join(links.select("id", F.col("leader").alias("story")), "id")


_DIGESTS = f"""mem AS (SELECT t.*, m.o, m.story FROM tagged t JOIN members m ON m.id = t.id),
    summ AS (SELECT story, count(*) AS size, count(DISTINCT source) AS n, arg_min(url, (published, id)) AS first_url, arg_min(title, o) AS t, arg_min(url, o) AS u, arg_min(source_name, o) AS f, max(published) AS lead FROM mem GROUP BY story),
    chosen AS (SELECT * FROM (SELECT * FROM summ WHERE n >= 2 ORDER BY n DESC, size DESC, lead DESC, story LIMIT 40) WHERE lead >= {NOW} - INTERVAL 96 HOUR),
    votes AS (SELECT story, 'topic' AS kind, unnest(topics) AS v FROM mem UNION ALL SELECT story, 'state', unnest(ufs_txt) FROM mem UNION ALL SELECT story, 'outlet', uf_fonte FROM mem WHERE uf_fonte <> '' UNION ALL SELECT story, 'person', unnest(pessoas_t) FROM mem),
    tally AS (SELECT story, kind, v, count(*) AS c FROM votes GROUP BY ALL),
    ok AS (SELECT story, CASE WHEN kind IN ('state', 'outlet') THEN 'uf' ELSE kind END AS kind, v FROM tally JOIN chosen USING (story) WHERE kind = 'topic' OR (kind = 'state' AND c >= 2) OR (kind = 'outlet' AND c >= 2 AND c * 2 >= size) OR (kind = 'person' AND c >= 2 AND c * 3 >= size)),
    lists AS (SELECT story, kind, array_to_string(list_sort(list_distinct(list(v))), ',') AS l FROM ok GROUP BY story, kind)"""
_DIGEST_ROWS = """SELECT substr(sha1(first_url), 1, 12) AS id, t, u, f, n, coalesce((SELECT l FROM lists x WHERE x.story = c.story AND kind = 'topic'), '') AS temas,
      coalesce((SELECT l FROM lists x WHERE x.story = c.story AND kind = 'uf'), '') AS ufs, coalesce((SELECT l FROM lists x WHERE x.story = c.story AND kind = 'person'), '') AS pessoas,
      'assunto' AS k, CAST(epoch(lead) AS BIGINT) AS p FROM chosen c"""


@query("a5_story_digests", f"WITH {TAGGED}, {LOOSE_SQL}, {_DIGESTS} {_DIGEST_ROWS}")
def a5(spark, sf):
    d = coverage.story_digests(story_members(spark, sf), views.now(), fresh_hours=96)
    return d.select("id", "t", "u", "f", "n", joined("temas").alias("temas"), joined("ufs").alias("ufs"), joined("pessoas").alias("pessoas"), "k", "p")


_RECENT_SQL = LOOSE_SQL.replace("AS o FROM h)", f"AS o FROM h WHERE published > {NOW} - INTERVAL 120 HOUR AND kind = 'noticia')")
_DENIALS = f"""deny AS (SELECT chk.*, src.name AS source_name FROM chk JOIN src ON src.id = chk.source WHERE published > {NOW} - INTERVAL 240 HOUR
    AND regexp_matches({base.fold1('title')}, '\\b(falso|falsa|falsos|fake|engano|enganoso|enganosa|golpe|boato|desinforma\\w*|manipulad\\w*|montagem|nao procede|sem provas?|distorc\\w*|descontextualiz\\w*|sem\\s+fundamento)\\b')
    ORDER BY published DESC, chk.id LIMIT 10)"""


@query(
    "a5_digest_run",
    f"""WITH {TAGGED}, {CHECKS.replace(HEADLINES + ", ", "")}, {_DENIALS}, {_RECENT_SQL}, {_DIGESTS} {_DIGEST_ROWS}
    UNION ALL SELECT substr(sha1(url), 1, 12), title, url, source_name, 1, '', '', '', 'checagem', CAST(epoch(published) AS BIGINT) FROM deny""",
)
def a5_run(spark, sf):
    names = views.sources(spark, sf).select(F.col("id").alias("source"), F.col("name").alias("source_name"))
    d = digests.digest_run(tagged(spark, sf), checks(spark, sf).join(names, "source"), views.now(), story_hours=120, fresh_hours=96, check_hours=240)
    return d.select("id", "t", "u", "f", "n", joined("temas").alias("temas"), joined("ufs").alias("ufs"), joined("pessoas").alias("pessoas"), "k", "p")


def grouping(spark, sf):
    """An external grouping derived from the labels: headlines of one language and label pair form a topic.

    Each topic becomes a row of its own, so that no array outgrows a row.
    """
    h = views.headlines(spark, sf)
    return (
        table(spark, sf, "labels").join(h, "doc_id")
        .withColumn("topic", F.concat_ws("-", "lang", F.col("quality").cast("string"), F.col("toxic").cast("string"), F.date_format("published", "MMdd")))
        .select("topic", "id")
    )


EXTERNAL = f"""{HEADLINES}, {SOURCES}, ext AS (SELECT lang || '-' || quality || '-' || toxic || '-' || strftime(published, '%m%d') AS topic, h.*, src.name AS source_name FROM labels JOIN h USING (doc_id) JOIN src ON src.id = h.source)"""


@query(
    "j21_external_stories",
    f"""WITH {EXTERNAL}, numbered AS (SELECT *, row_number() OVER (ORDER BY published DESC, id) AS o FROM ext), s AS (SELECT topic AS titulo, count(DISTINCT source_name) AS n, count(*) AS size, arg_min(id, o) AS lead_id, max(published) AS lead,
      array_to_string(list_sort(list_distinct(list(source_name))), ', ') AS names FROM numbered GROUP BY topic HAVING count(DISTINCT source_name) >= 2)
    SELECT titulo, n, size, lead_id, names FROM s WHERE (SELECT count(*) FROM s) >= 3 ORDER BY n DESC, lead DESC, titulo LIMIT 5""",
)
def j21(spark, sf):
    ext = external_grouping(spark, sf)
    out = coverage.external_stories(ext, named_headlines(spark, sf), views.now())
    return out.select("titulo", "n", "size", "lead_id", F.array_join("names", ", ").alias("names"))


def named_headlines(spark, sf):
    s = views.sources(spark, sf).select(F.col("id").alias("source"), F.col("name").alias("source_name"))
    return views.headlines(spark, sf).join(s, "source")


def external_grouping(spark, sf):
    """One row for each article a topic lists."""
    topic = F.col("topic")
    return grouping(spark, sf).select(views.now().alias("gerado"), topic.alias("pos"), topic.alias("titulo"), F.lit("").alias("resumo"), "id")


@query(
    "j22_overlay",
    f"""WITH {EXTERNAL}, {LOOSE_SQL}, e AS (SELECT topic, count(DISTINCT source_name) AS n, max(published) AS lead, arg_min(ext.id, (-epoch(published), ext.id)) AS lead_id FROM ext GROUP BY topic HAVING count(DISTINCT source_name) >= 2),
    cov AS (SELECT story, count(DISTINCT source) AS n, count(*) AS size, max(published) AS lead FROM members GROUP BY story HAVING count(DISTINCT source) >= 2),
    best AS (SELECT * FROM cov ORDER BY n DESC, size DESC, lead DESC, story LIMIT 40),
    e10 AS (SELECT * FROM e ORDER BY n DESC, lead DESC, topic LIMIT 10),
    free AS (SELECT * FROM best WHERE story NOT IN (SELECT story FROM members WHERE id IN (SELECT id FROM ext WHERE topic IN (SELECT topic FROM e10))))
    SELECT 'external' AS origin, lead_id, n FROM e10 UNION ALL SELECT 'words', story, n FROM (SELECT * FROM free ORDER BY n DESC, size DESC, lead DESC, story LIMIT 30)""",
)
def j22(spark, sf):
    ext = external_grouping(spark, sf)
    articles = named_headlines(spark, sf)
    stories = coverage.external_stories(ext, articles, views.now(), limit=10)
    ids = coverage.external_members(ext, articles).join(stories.select("pos"), "pos")
    grouped = cut_lineage(members(spark, sf))
    out = coverage.overlay_stories(stories, ids, coverage.story_coverage(grouped, views.sources(spark, sf)), grouped)
    return out.select(F.when(F.col("part") == 0, "external").otherwise("words").alias("origin"), "lead_id", "n")


_CANDIDATES = f"""{HEADLINES}, {SOURCES}, recent AS (SELECT h.*, name AS source_name, row_number() OVER (ORDER BY published DESC, h.id) AS num FROM h JOIN src ON src.id = h.source WHERE published > {NOW} - INTERVAL 30 HOUR),
    cand AS (SELECT * FROM recent WHERE num <= 900)"""


@query(
    "w11_numbered_candidates",
    f"""WITH {_CANDIDATES} SELECT num, id, num || '|' || source_name || '|' || substr(trim(regexp_replace(title, '[|\\r\\n]+', ' ', 'g')), 1, 120) AS line FROM cand""",
)
def w11(spark, sf):
    return coverage.numbered_candidates(named_headlines(spark, sf), views.now()).select(F.col("num").cast("bigint").alias("num"), "id", "line")


@query(
    "w9_first_use_wins",
    f"""WITH {_CANDIDATES}, props AS (SELECT l.doc_id % 8 AS topic_pos, l.doc_id AS pos, 1 + (l.doc_id * 7) % 97 AS num FROM labels l),
    used AS (SELECT topic_pos, props.num, cand.id, source, row_number() OVER (PARTITION BY props.num ORDER BY topic_pos, pos) AS r FROM props JOIN cand ON cand.num = props.num)
    SELECT topic_pos, num, id FROM used WHERE r = 1 AND topic_pos IN (SELECT topic_pos FROM used WHERE r = 1 GROUP BY topic_pos HAVING count(DISTINCT source) >= 2)""",
)
def w9(spark, sf):
    c = coverage.numbered_candidates(named_headlines(spark, sf), views.now())
    d = F.col("doc_id")
    props = table(spark, sf, "labels").select((d % 8).alias("topic_pos"), d.alias("pos"), (1 + d * 7 % 97).alias("num"), F.lit("t").alias("titulo"))
    return coverage.first_use_wins(props, c).select("topic_pos", F.col("num").cast("bigint").alias("num"), "id")


# --- listings -------------------------------------------------------------------------------------------------------------


def blocked_hosts(spark, sf):
    """Hosts of the outlets whose checked documents are mostly toxic."""
    h = views.headlines(spark, sf).join(table(spark, sf, "labels"), "doc_id")
    return h.groupBy(F.concat("source", F.lit(".example.org")).alias("host")).agg(F.avg("toxic").alias("share")).where(F.col("share") > 0.06).select("host")


BLOCKED = "blk AS (SELECT source || '.example.org' AS host FROM documents JOIN labels USING (doc_id) GROUP BY 1 HAVING avg(toxic) > 0.06)"


def served(spark, sf):
    return listings.serve(views.headlines(spark, sf), views.sources(spark, sf), views.now(), blocked_hosts(spark, sf))


@query(
    "f16_serving_columns",
    f"""WITH {HEADLINES}, {SOURCES}, {BLOCKED}, z AS (SELECT h.id, h.source, name, {base.local('published')} AS l, CAST({base.local(NOW)} AS DATE) AS today FROM h JOIN src ON src.id = h.source),
    g AS (SELECT *, today - CAST(l AS DATE) AS gap FROM z)
    SELECT id, name AS source_name, strftime(l, '%Y-%m-%d') AS day, strftime(l, '%H:%M') AS hm, CASE WHEN gap = 0 THEN strftime(l, '%H:%M') ELSE strftime(l, '%d/%m %H:%M') END AS time_label,
      CASE WHEN gap = 0 THEN 'Hoje' WHEN gap = 1 THEN 'Ontem' ELSE ['Domingo','Segunda','Terça','Quarta','Quinta','Sexta','Sábado'][dayofweek(l) + 1] || ', ' || day(l) || ' de janeiro' END AS day_label,
      source || '.example.org' IN (SELECT host FROM blk) AS bloq FROM g""",
)
def f16(spark, sf):
    return served(spark, sf).select("id", "source_name", "day", "hm", "time_label", "day_label", "bloq")


@query("j1_source_names", f"""WITH {HEADLINES}, {SOURCES} SELECT h.id, coalesce(name, h.source) AS source_name FROM h LEFT JOIN src ON src.id = h.source AND src.grupo <> 'oficial'""")
def j1(spark, sf):
    known = views.sources(spark, sf).where(F.col("grupo") != "oficial")
    return listings.serve(views.headlines(spark, sf), known, views.now()).select("id", "source_name")


@query("f22_blocked_sources", f"""WITH {HEADLINES}, {BLOCKED} SELECT id, source FROM h WHERE source || '.example.org' NOT IN (SELECT host FROM blk)""")
def f22(spark, sf):
    return served(spark, sf).where(~F.col("bloq")).select("id", "source")


def enriched(spark, sf):
    """The store as published, descriptions being whole texts; written, as every view reads it."""
    h = views.headlines(spark, sf, body=True)
    codes = F.array(*[F.lit(c) for c in STATES])
    sources = views.sources(spark, sf)
    sources = sources.withColumn("uf", F.when(F.col("grupo") == "regional", F.element_at(codes, F.pmod(F.col("n"), F.lit(6)) + 1)))
    return cut_lineage(enrich.enrich(h.withColumn("desc", F.col("body")).drop("body"), sources, views.now(), blocked_hosts(spark, sf), CONFIG))


STRICT_NEWS = STRICT_SQL.replace("AS o FROM h)", "AS o FROM h WHERE kind = 'noticia')")
ENRICHED = f"""{TAGGED}, {STRICT_NEWS}, {BLOCKED}, enr AS MATERIALIZED (SELECT t.*, CASE WHEN kind = 'noticia' THEN coalesce(gids.gid, t.id) END AS gid FROM tagged t LEFT JOIN gids ON gids.id = t.id)"""
_VIEWS = """vw AS (SELECT 'home' AS view, '' AS key, id, published, day, gid, source FROM enr WHERE kind = 'noticia' AND grupo <> 'regional'
    UNION ALL SELECT 'estado', unnest(ufs), id, published, day, gid, source FROM enr WHERE kind = 'noticia'
    UNION ALL SELECT 'pessoa', unnest(pessoas), id, published, day, gid, source FROM enr WHERE kind = 'noticia'
    UNION ALL SELECT 'fonte', source, id, published, day, NULL, source FROM enr
    UNION ALL SELECT 'tema', unnest(topics), id, published, day, gid, source FROM enr WHERE kind = 'noticia' AND grupo <> 'regional'
    UNION ALL SELECT 'dia', day, id, published, day, gid, source FROM enr WHERE kind = 'noticia' AND grupo <> 'regional'),
    col AS (SELECT *, row_number() OVER (PARTITION BY view, key, coalesce(gid, 'id:' || id) ORDER BY published DESC, id) AS r, count(*) OVER (PARTITION BY view, key, coalesce(gid, 'id:' || id)) - 1 AS more FROM vw),
    lst AS (SELECT *, row_number() OVER (PARTITION BY view, key ORDER BY published DESC, id) AS rank FROM col WHERE r = 1)"""


@query("g5_enrichment", f"""WITH {ENRICHED} SELECT id, kind, grupo, array_to_string(topics, ',') AS topics, array_to_string(ufs, ',') AS ufs, array_to_string(pessoas, ',') AS pessoas, gid FROM enr""")
def g5(spark, sf):
    return enriched(spark, sf).select("id", "kind", "grupo", joined("topics").alias("topics"), joined("ufs").alias("ufs"), joined("pessoas").alias("pessoas"), "gid")


@query("g3_collapsed_listing", f"""WITH {ENRICHED}, {_VIEWS} SELECT id, more FROM lst WHERE view = 'home'""")
def g3(spark, sf):
    home = enriched(spark, sf).where((F.col("kind") == "noticia") & (F.col("grupo") != "regional")).withColumn("view", F.lit("home"))
    return listings.collapse(home, ["view"]).select("id", "more")


@query(
    "g3_hidden_rows",
    f"""WITH {ENRICHED}, {_VIEWS} SELECT l.id AS lead, c.id FROM col c JOIN col l ON l.view = 'home' AND c.view = 'home' AND l.r = 1 AND c.r > 1 AND c.gid = l.gid""",
)
def g3_hidden(spark, sf):
    home = enriched(spark, sf).where((F.col("kind") == "noticia") & (F.col("grupo") != "regional")).withColumn("view", F.lit("home"))
    return listings.hidden_rows(home, listings.collapse(home, ["view"]), ["view"]).select("lead", "id")


_PAGES = {"home": 15, "estado": 8, "pessoa": 5, "fonte": 3, "tema": 5, "dia": 8}
_CAP = "CASE view " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in _PAGES.items()) + " END"


@query(
    "g4_listings",
    f"""WITH {ENRICHED}, {_VIEWS} SELECT view, key, id, more, CAST(ceil(rank / 10.0) AS BIGINT) AS page, (rank - 1) % 10 + 1 AS pos FROM lst WHERE rank <= 10 * {_CAP}""",
)
def g4(spark, sf):
    return listings.listings(enriched(spark, sf), page_size=10).select("view", "key", "id", "more", "page", "pos")


@query(
    "w7_page_numbers",
    f"""WITH {HEADLINES}, r AS (SELECT source, id, row_number() OVER (PARTITION BY source ORDER BY published DESC, id) AS r FROM h)
    SELECT source, id, CAST(ceil(r / 20.0) AS BIGINT) AS page FROM r WHERE r <= 60""",
)
def w7(spark, sf):
    return listings.paged(views.headlines(spark, sf), ["source"], 3, 20).select("source", "id", "page")


@query(
    "w10_day_headers",
    f"""WITH {ENRICHED}, {_VIEWS}, pg AS (SELECT *, ceil(rank / 10.0) AS page FROM lst WHERE rank <= 10 * {_CAP})
    SELECT view, key, id, coalesce(lag(day) OVER (PARTITION BY view, key, page ORDER BY rank) <> day, TRUE) AS header FROM pg""",
)
def w10(spark, sf):
    return listings.with_day_headers(listings.listings(enriched(spark, sf), page_size=10), ["view", "key"]).select("view", "key", "id", "header")


@query(
    "s7_search_index",
    f"""WITH {TAGGED}, {BLOCKED}, r AS (SELECT *, row_number() OVER (ORDER BY published DESC, id) AS rank FROM tagged),
    d AS (SELECT *, substr("desc", 1, 110) AS c, regexp_extract(substr("desc", 1, 110), '(?s)^(.{{80,}}[.!?]) ', 1) AS s FROM r)
    SELECT title AS t, source_name AS s, url AS u, strftime({base.local('published')}, '%Y-%m-%dT%H:%M') AS p, CASE WHEN kind = 'checagem' THEN 1 END AS c, CASE WHEN grupo = 'oficial' THEN 1 END AS o,
      CASE WHEN len(pessoas) > 0 THEN array_to_string(pessoas, ',') END AS g, CASE WHEN source || '.example.org' IN (SELECT host FROM blk) THEN 1 END AS b,
      CASE WHEN rank <= 1200 AND "desc" <> '' THEN CASE WHEN length("desc") <= 110 THEN "desc" WHEN s <> '' THEN s ELSE rtrim(regexp_replace(c, ' [^ ]*$', ''), ',;:') || '…' END END AS d
    FROM d WHERE rank <= 2500""",
)
def s7(spark, sf):
    cols = listings.serve(views.headlines(spark, sf), views.sources(spark, sf), views.now(), blocked_hosts(spark, sf))
    i = listings.search_index(cols.join(tagged(spark, sf).select("id", "pessoas"), "id"))
    return i.select("t", "s", "u", "p", F.col("c").cast("bigint").alias("c"), F.col("o").cast("bigint").alias("o"), joined("g").alias("g"), F.col("b").cast("bigint").alias("b"), "d")


@query("s8_latest_headlines", f"""WITH {ENRICHED}, {_VIEWS} SELECT id, more FROM lst WHERE view = 'home' ORDER BY rank LIMIT 20""")
def s8(spark, sf):
    return listings.latest(enriched(spark, sf)).select("id", "more")


@query("s10_page_catalogue", f"""WITH {TAGGED}, enr AS (SELECT *, NULL AS gid FROM tagged), {_VIEWS.split(', ' + chr(10) + '    col AS')[0].split(chr(10) + '    col AS')[0].rstrip(',')}
    SELECT view, key, max(day) AS last, count(*) AS n, count(DISTINCT source) AS outlets FROM vw GROUP BY view, key""")
def s10(spark, sf):
    e = listings.serve(views.headlines(spark, sf), views.sources(spark, sf), views.now())
    e = e.join(tagged(spark, sf).select("id", "topics", "pessoas", "ufs"), "id").withColumn("gid", F.lit(None).cast("string"))
    return listings.page_catalogue(cut_lineage(e))


@query(
    "j23_new_since_snapshot",
    f"""WITH {HEADLINES}, before AS (SELECT url FROM h WHERE published < {NOW} - INTERVAL 1 HOUR) SELECT url FROM h WHERE url NOT IN (SELECT url FROM before)""",
)
def j23(spark, sf):
    h = views.headlines(spark, sf)
    return listings.new_since(h, h.where(F.col("published") < views.now() - F.expr("INTERVAL 1 HOUR"))).select("url")


# --- the publish run --------------------------------------------------------------------------------------------------------


def published(spark, sf):
    h = views.headlines(spark, sf, body=True)
    codes = F.array(*[F.lit(c) for c in STATES])
    sources = views.sources(spark, sf)
    sources = sources.withColumn("uf", F.when(F.col("grupo") == "regional", F.element_at(codes, F.pmod(F.col("n"), F.lit(6)) + 1)))
    return publish.publish_run(
        h.withColumn("desc", F.col("body")).drop("body"), sources, views.now(), blocked_hosts(spark, sf), external_grouping(spark, sf), CONFIG, recent_hours=120, page_size=10
    )


_OUTSIDE = f"""xn AS (SELECT lang || '-' || quality || '-' || toxic || '-' || strftime(published, '%m%d') AS topic, h.id, h.source, h.published FROM labels JOIN h USING (doc_id) WHERE h.kind = 'noticia'),
    xs AS MATERIALIZED (SELECT topic, count(DISTINCT source) AS n, count(*) AS size, max(published) AS lead FROM xn GROUP BY topic HAVING count(DISTINCT source) >= 2 ORDER BY n DESC, lead DESC, topic LIMIT 40)"""
_OVERRIDDEN = ENRICHED.replace(
    ", enr AS MATERIALIZED (SELECT t.*, CASE WHEN kind = 'noticia' THEN coalesce(gids.gid, t.id) END AS gid FROM tagged t LEFT JOIN gids ON gids.id = t.id)",
    f", {_OUTSIDE}, enr AS MATERIALIZED (SELECT t.*, CASE WHEN kind = 'noticia' THEN coalesce((SELECT 'ext:' || topic FROM xn WHERE xn.id = t.id AND topic IN (SELECT topic FROM xs)), gids.gid, t.id) END AS gid FROM tagged t LEFT JOIN gids ON gids.id = t.id)",
)


@query("i2_published_listings", f"""WITH {_OVERRIDDEN}, {_VIEWS} SELECT view, key, id, more, CAST(ceil(rank / 10.0) AS BIGINT) AS page, (rank - 1) % 10 + 1 AS pos FROM lst WHERE rank <= 10 * {_CAP}""")
def i2_listings(spark, sf):
    return published(spark, sf).listings.select("view", "key", "id", "more", "page", "pos")


@query("s8_topics_in_focus", f"""WITH {HEADLINES}, {_OUTSIDE} SELECT topic AS titulo, n FROM xs ORDER BY n DESC, lead DESC, topic LIMIT 5""")
def s8_focus(spark, sf):
    return published(spark, sf).focus.select("titulo", "n")


@query(
    "q1_run_gate",
    f"""WITH {_OVERRIDDEN}, {_VIEWS} SELECT 'articles' AS output, 'rows below minimum' AS rule, 1000000 - count(*) AS n FROM enr
    UNION ALL SELECT 'listings', 'rows below minimum', 1000000 - count(*) FROM lst WHERE rank <= 10 * {_CAP}""",
)
def q1_run(spark, sf):
    """A gate that asks for a million rows, so that it has something to say."""
    return publish.gate(published(spark, sf), least=1_000_000)
