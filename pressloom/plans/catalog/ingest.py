"""Checked queries: sources, clean-up, filters and the steps of an ingest run."""

from __future__ import annotations

from pyspark.sql import functions as F

from pressloom.functions import dates, text, urls
from pressloom.functions import fixed_values as fv
from pressloom.operators import dictionary, ingest, listings
from pressloom.plans import views
from pressloom.plans.catalog import base
from pressloom.plans.catalog.base import HEADLINES, RAW, SOURCES, query
from pressloom.plans.views import table
from pressloom.sources import feeds

TEST_PREFIXES = ["thintion", "rewh", "orre", "eaux", "stion"]
TEST_ACRONYMS = ["The", "Les", "Nicht"]
TEST_NOISE = [r"^nicht ", r"^la .+\.$"]


def ts(c):
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss")


# --- payloads -----------------------------------------------------------------------------------------------------


def payloads(spark, sf):
    """One body per document: RSS, Atom or a news sitemap by source, some with a bare ampersand or an entity declaration."""
    r = views.raw_items(spark, sf)
    n = views.source_number(F.col("source"))

    def esc(c):
        c = F.replace(c, F.lit("&"), F.lit("&amp;"))
        c = F.replace(c, F.lit("<"), F.lit("&lt;"))
        return F.regexp_replace(F.replace(c, F.lit(">"), F.lit("&gt;")), "[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f]", "")

    rss = F.concat(
        F.lit('<?xml version="1.0"?><rss version="2.0"><channel><title>c</title><item><title>'), esc(F.col("raw_title")),
        F.lit(" A & B</title><link>"), esc(F.col("raw_url")), F.lit("</link><description>"), esc(F.col("raw_desc")),
        F.lit("</description><pubDate>"), F.date_format("published", "EEE, dd MMM yyyy HH:mm:ss"), F.lit(" -0300</pubDate></item></channel></rss>"),
    )
    atom = F.concat(
        F.when(F.col("lang") == "de", F.lit('<!DOCTYPE x [<!ENTITY a "b">]>')).otherwise(""),
        F.lit('<feed xmlns="http://www.w3.org/2005/Atom"><entry><title>'), esc(F.col("raw_title")),
        F.lit('</title><link rel="self" href="http://x.example.org/"/><link href="'), esc(F.col("raw_url")), F.lit('"/><summary>'),
        esc(F.col("raw_desc")), F.lit("</summary><updated>"), F.date_format("published", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z</updated></entry></feed>"),
    )
    sitemap = F.concat(
        F.lit('<?xml version="1.0"?><urlset xmlns:news="n" xmlns:image="i"><url><loc>'), esc(F.col("raw_url")),
        F.lit("</loc><lastmod>2024-01-01</lastmod><image:image><image:title>no</image:title></image:image><news:news>"),
        F.when(F.col("lang") != "fr", F.concat(F.lit("<news:title>"), esc(F.col("raw_title")), F.lit("</news:title>"))).otherwise(""),
        F.when(F.col("lang") != "es", F.concat(F.lit("<news:publication_date>"), F.date_format("published", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("-03:00</news:publication_date>"))).otherwise(""),
        F.lit("</news:news></url></urlset>"),
    )
    body = F.when(n % 3 == 0, rss).when(n % 3 == 1, atom).otherwise(sitemap)
    return r.select("source", F.col("doc_id").alias("payload_id"), body.alias("body"))


def _entries_out(df):
    return df.select("payload_id", "source", "title", "url", "desc", F.unix_seconds("published").alias("published"))


_PARSED = f"""WITH {RAW}, parsed AS (SELECT *, n % 3 AS form, {base.clean('raw_title')} AS t0, {base.clean('raw_desc')} AS d0,
    'https://' || source || '.Example.org/' || lang || '/' || doc_id || '?utm_source=feed' AS url FROM raw),
titled AS (SELECT *, CASE WHEN form = 0 THEN trim(t0 || ' A & B') ELSE t0 END AS t1 FROM parsed
    WHERE NOT (form = 1 AND lang = 'de') AND NOT (form = 2 AND lang = 'fr')),
shorted AS (SELECT *, {base.short('t1', 300)} AS title, CASE WHEN form = 2 THEN '' ELSE d0 END AS d1 FROM titled),
blanked AS (SELECT *, CASE WHEN starts_with(lower(d1), substr(lower(title), 1, 40)) AND length(d1) < length(title) + 20 THEN '' ELSE d1 END AS d2 FROM shorted),
out AS (SELECT doc_id AS payload_id, source, title, url, {base.short('d2', 260)} AS "desc", form,
    CAST(epoch(CASE WHEN form = 1 THEN published WHEN form = 2 AND lang = 'es' THEN TIMESTAMP '2024-01-01' ELSE published + INTERVAL 3 HOUR END) AS BIGINT) AS published
    FROM blanked WHERE title <> '')
SELECT payload_id, source, title, url, "desc", published FROM out"""


@query("s2_feed_payloads", _PARSED + " WHERE form < 2")
def s2(spark, sf):
    p = payloads(spark, sf)
    return _entries_out(feeds.feed_entries(p.where(~feeds.is_sitemap(F.col("body")))))


@query("s3_news_sitemaps", _PARSED + " WHERE form = 2")
def s3(spark, sf):
    p = payloads(spark, sf)
    return _entries_out(feeds.sitemap_entries(p.where(feeds.is_sitemap(F.col("body")))))


@query("s4_payload_routing", _PARSED)
def s4(spark, sf):
    return _entries_out(feeds.entries(payloads(spark, sf)))


@query(
    "s5_source_addresses",
    f"""WITH {SOURCES}, lists AS (SELECT id, CASE WHEN n % 3 = 0 THEN [home || '/feed', home || '/news.xml'] WHEN n % 3 = 1 THEN [home]
    ELSE [] END AS l FROM src) SELECT id, unnest(l) AS address, CAST(generate_subscripts(l, 1) - 1 AS BIGINT) AS pos FROM lists""",
)
def s5(spark, sf):
    s = views.sources(spark, sf)
    many = F.when(F.col("n") % 3 == 0, F.array(F.concat("home", F.lit("/feed")), F.concat("home", F.lit("/news.xml"))))
    one = F.when(F.col("n") % 3 != 2, F.col("home"))
    return ingest.addresses(s.withColumn("urls", many).withColumn("url", one)).withColumn("pos", F.col("pos").cast("bigint"))


# --- links --------------------------------------------------------------------------------------------------------

_VARIANTS = [
    ("u", "u"),
    ("replace(u, '://', '://user:pw@')", "replace(u, '://', '://user:pw@')"),
    ("concat(u, ' x')", "u || ' x'"),
    ("concat('ftp', substring(u, instr(u, ':'), 5000))", "'ftp' || substr(u, instr(u, ':'))"),
    ("concat('http://10.1.2.', cast(page_id % 256 as string), '/a')", "'http://10.1.2.' || (page_id % 256) || '/a'"),
    ("concat('http://localhost/', cast(page_id as string))", "'http://localhost/' || page_id"),
    ("concat(u, repeat('x', 2000))", "u || repeat('x', 2000)"),
    ("regexp_replace(u, '^(https?://[^/]+)', '$1:8080')", r"regexp_replace(u, '^(https?://[^/]+)', '\1:8080')"),
    ("concat('http://printer.local/', cast(page_id as string))", "'http://printer.local/' || page_id"),
    ("concat('http://0x7f000001/', cast(page_id as string))", "'http://0x7f000001/' || page_id"),
]


def links(spark, sf):
    """Every page address in ten spellings, most of them bad."""
    p = table(spark, sf, "pages").select("page_id", F.col("url").alias("u"))
    forms = F.array(*[F.expr(s) for s, _ in _VARIANTS])
    return p.select("page_id", F.posexplode(forms).alias("form", "url")).withColumn("form", F.col("form").cast("bigint"))


_LINKS = (
    "links AS (SELECT page_id, CAST(i - 1 AS BIGINT) AS form, l[i] AS url FROM (SELECT page_id, ["
    + ", ".join(o for _, o in _VARIANTS)
    + "] AS l FROM (SELECT page_id, url AS u FROM pages)), range(1, 11) t(i))"
)


@query(
    "f1_url_admission",
    rf"""WITH {_LINKS} SELECT page_id, form, url FROM links WHERE length(trim(url)) BETWEEN 1 AND 2000 AND NOT regexp_matches(trim(url), '\s')
    AND regexp_matches(trim(url), '^https?://[^/?#@]+([/?#]|$)')""",
)
def f1(spark, sf):
    return links(spark, sf).where(urls.is_admissible(F.col("url")))


@query(
    "f2_public_hosts",
    rf"""WITH {_LINKS}, parts AS (SELECT *, regexp_extract(url, '^https?://([^/?#]*)', 1) AS a FROM links),
    hosts AS (SELECT *, lower(regexp_extract(a, '^([^:@]*)', 1)) AS hst, regexp_extract(a, ':([0-9]+)$', 1) AS port FROM parts WHERE a <> '' AND a NOT LIKE '%@%')
    SELECT page_id, form, hst AS host FROM hosts WHERE port IN ('', '80', '443') AND hst LIKE '%.%' AND hst NOT LIKE '%.local' AND hst NOT LIKE '%.internal'
    AND NOT regexp_matches(hst, '^[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+$')""",
)
def f2(spark, sf):
    return links(spark, sf).where(urls.is_public(F.col("url"))).select("page_id", "form", urls.host(F.col("url")).alias("host"))


_CANON = """canon AS (SELECT page_id, url, regexp_extract(url, '^([a-z]+)://', 1) AS sc, lower(regexp_extract(url, '^[a-z]+://([^/?#]*)', 1)) AS au,
    regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) AS pa, list_filter(string_split(regexp_extract(url, '\\?([^#]*)', 1), '&'),
    lambda p: regexp_matches(p, '^[^=]*=.') AND lower(split_part(p, '=', 1)) NOT IN ('utm_source','utm_medium','utm_campaign','utm_term','utm_content','gclid','fbclid','ref')) AS q FROM pages)"""


@query(
    "f3_canonical_url",
    "WITH " + _CANON.replace("\\\\", "\\") + """, out AS (SELECT page_id, sc || '://' || au || pa || CASE WHEN len(q) > 0 THEN '?' || array_to_string(q, '&') ELSE '' END AS canonical FROM canon)
    SELECT page_id, canonical, substr(sha1(canonical), 1, 12) AS id FROM out""",
)
def f3(spark, sf):
    p = table(spark, sf, "pages")
    return p.select("page_id", urls.canonical(F.col("url")).alias("canonical"), urls.article_id(F.col("url")).alias("id"))


@query(
    "j12_lookup_by_url",
    r"""WITH known AS (SELECT page_id, regexp_replace(url, '/$', '') AS k FROM pages),
    asked AS (SELECT page_id AS asked_id, regexp_replace(url || CASE WHEN page_id % 2 = 0 AND url NOT LIKE '%/' THEN '/' ELSE '' END, '/$', '') AS k FROM pages)
    SELECT asked_id, page_id FROM asked JOIN known USING (k)""",
)
def j12(spark, sf):
    p = table(spark, sf, "pages")
    known = p.select("page_id", urls.without_slash(F.col("url")).alias("k"))
    asked = F.when((F.col("page_id") % 2 == 0) & ~F.col("url").endswith("/"), F.concat("url", F.lit("/"))).otherwise(F.col("url"))
    return p.select(F.col("page_id").alias("asked_id"), urls.without_slash(asked).alias("k")).join(known, "k").drop("k")


# --- text clean-up --------------------------------------------------------------------------------------------------


@query(
    "f4_clean_text",
    rf"""WITH p AS (SELECT page_id, {base.clean('html')} AS c FROM pages) SELECT page_id, md5(c) AS digest, CAST(length(c) AS BIGINT) AS n FROM p""",
)
def f4(spark, sf):
    p = table(spark, sf, "pages").select("page_id", text.clean(F.col("html")).alias("c"))
    return p.select("page_id", F.md5("c").alias("digest"), F.length("c").cast("bigint").alias("n"))


@query(
    "f5_truncate",
    f"""WITH c AS (SELECT doc_id, {base.clean('text')} AS t FROM documents) SELECT doc_id, {base.short('t', 260)} AS short260, {base.short('t', 300)} AS short300 FROM c""",
)
def f5(spark, sf):
    c = table(spark, sf, "documents").select("doc_id", text.clean(F.col("text")).alias("t"))
    return c.select("doc_id", text.short(F.col("t"), 260).alias("short260"), text.short(F.col("t"), 300).alias("short300"))


@query(
    "f6_sentence_short",
    rf"""WITH c AS (SELECT doc_id, trim(regexp_replace(trim(text || CASE WHEN doc_id % 3 = 0 THEN ' Leia mais no Jornal Exemplo.' ELSE '' END),
      '\s*Leia (?:mais )?(?:no|na|em|o texto no|a matéria no)\s+[^.]{{1,40}}\.?\s*$', '')) AS d FROM documents),
    cut AS (SELECT doc_id, d, substr(d, 1, 220) AS c, regexp_extract(substr(d, 1, 220), '(?s)^(.{{80,}}[.!?]) ', 1) AS s FROM c)
    SELECT doc_id, CASE WHEN length(d) <= 220 THEN d WHEN s <> '' THEN s ELSE rtrim(regexp_replace(c, ' [^ ]*$', ''), ',;:') || '…' END AS short_desc FROM cut""",
)
def f6(spark, sf):
    d = table(spark, sf, "documents")
    tail = F.when(F.col("doc_id") % 3 == 0, " Leia mais no Jornal Exemplo.").otherwise("")
    return d.select("doc_id", text.short_description(F.concat("text", tail)).alias("short_desc"))


@query(
    "f7_blank_repeated_desc",
    f"""WITH {RAW}, p AS (SELECT doc_id, raw_title AS t, raw_title || CASE WHEN doc_id % 2 = 0 THEN ' …' ELSE substr(raw_desc, 1, 40) END AS d FROM raw)
    SELECT doc_id, CASE WHEN starts_with(lower(d), substr(lower(t), 1, 40)) AND length(d) < length(t) + 20 THEN '' ELSE d END AS "desc" FROM p""",
)
def f7(spark, sf):
    r = views.raw_items(spark, sf)
    desc = F.concat("raw_title", F.when(F.col("doc_id") % 2 == 0, " …").otherwise(F.substring("raw_desc", 1, 40)))
    return r.select("doc_id", text.blank_if_repeats(desc, F.col("raw_title")).alias("desc"))


@query(
    "f8_swap_label_title",
    f"""WITH {HEADLINES}, w AS (SELECT doc_id, n, title, body, len(regexp_extract_all(title, '\\S+')) AS wt, len(regexp_extract_all(body, '\\S+')) AS wd FROM h),
    s AS (SELECT *, n % 2 = 0 AND body <> '' AND wt <= 5 AND wd > wt AS swap FROM w)
    SELECT doc_id, CASE WHEN swap THEN {base.short('body', 300)} ELSE title END AS title, CASE WHEN swap THEN md5(title) ELSE md5(body) END AS desc_digest FROM s""",
)
def f8(spark, sf):
    h = views.headlines(spark, sf, body=True).select("doc_id", "source", "title", F.col("body").alias("desc"))
    s = views.sources(spark, sf).withColumn("titulo_na_descricao", F.col("n") % 2 == 0)
    return ingest.swap_label_titles(h, s).select("doc_id", "title", F.md5("desc").alias("desc_digest"))


_RELEVANT = (
    lambda x: f"(regexp_matches({base.fold1(x)}, '\\b(?:{'|'.join(TEST_PREFIXES)})') OR "  # noqa: E731
    f"regexp_matches({x}, '(?:^|[^A-Za-zÀ-ÿ])(?:{'|'.join(TEST_ACRONYMS)})(?:$|[^A-Za-zÀ-ÿ])'))"
)


@query(
    "f9_keep_rule",
    f"""WITH {HEADLINES}, r AS (SELECT *, regexp_matches(title, '(?i)^nicht ') OR regexp_matches(title, '(?i)^la .+\\.$') AS noisy,
    {_RELEVANT("(title || ' ' || body)")} AS relevant FROM h)
    SELECT doc_id, CASE WHEN noisy THEN FALSE WHEN n % 3 = 1 AND url LIKE '%/de/%' THEN FALSE WHEN n % 3 = 0 AND url LIKE '%/en/%' THEN TRUE
    WHEN n % 2 = 0 THEN relevant ELSE n % 3 <> 0 END AS keep FROM r""",
)
def f9(spark, sf):
    h = views.headlines(spark, sf, body=True).withColumn("n", views.source_number(F.col("source")))
    none = F.array().cast("array<string>")
    return h.select(
        "doc_id",
        ingest.keep_flag(
            F.col("url"), F.col("title"), F.col("body"),
            F.when(F.col("n") % 3 == 0, F.array(F.lit("/en/"))).otherwise(none),
            F.when(F.col("n") % 3 == 1, F.array(F.lit("/de/"))).otherwise(none),
            F.col("n") % 2 == 0,
            TEST_NOISE,
            text.is_relevant(F.concat_ws(" ", "title", "body"), TEST_PREFIXES, TEST_ACRONYMS),
        ).alias("keep"),
    )


@query("f10_relevance", f"SELECT doc_id, {_RELEVANT('text')} AS relevant FROM documents")
def f10(spark, sf):
    d = table(spark, sf, "documents")
    return d.select("doc_id", text.is_relevant(F.col("text"), TEST_PREFIXES, TEST_ACRONYMS).alias("relevant"))


@query("f10_relevance_by_table", f"SELECT doc_id, {_RELEVANT('text')} AS relevant FROM documents")
def f10_by_table(spark, sf):
    d = table(spark, sf, "documents")
    starts, names = (spark.createDataFrame([(w,) for w in words], "term string") for words in (TEST_PREFIXES, TEST_ACRONYMS))
    found = dictionary.relevant_rows(d, "doc_id", F.col("text"), starts, names).select(F.col("id").alias("doc_id"), F.lit(True).alias("found"))
    return d.join(found, "doc_id", "left").select("doc_id", F.coalesce("found", F.lit(False)).alias("relevant"))


@query(
    "f11_bad_titles",
    rf"""WITH {RAW}, t AS (SELECT doc_id, trim(CASE doc_id % 6 WHEN 0 THEN split_part(raw_title, ' ', 1) WHEN 1 THEN 'https://x.example.org/' || doc_id
      WHEN 2 THEN regexp_replace(raw_title, '[a-e]', '7', 'g') WHEN 3 THEN '------------------' ELSE raw_title END) AS t FROM raw)
    SELECT doc_id, CASE WHEN length(t) < 12 THEN 'short' WHEN regexp_matches(t, '^(\.+|-+)$') THEN 'placeholder' WHEN regexp_matches(t, '^https?://\S+$') THEN 'address'
      WHEN length(regexp_replace(t, '\P{{L}}', '', 'g')) < length(t) * 0.5 THEN 'few letters' ELSE '' END AS reason FROM t""",
)
def f11(spark, sf):
    r = views.raw_items(spark, sf)
    m = F.col("doc_id") % 6
    t = (
        F.when(m == 0, F.substring_index("raw_title", " ", 1))
        .when(m == 1, F.concat(F.lit("https://x.example.org/"), F.col("doc_id").cast("string")))
        .when(m == 2, F.regexp_replace("raw_title", "[a-e]", "7"))
        .when(m == 3, F.lit("-" * 18))
        .otherwise(F.col("raw_title"))
    )
    return r.select("doc_id", text.bad_title_reason(t).alias("reason"))


def crawl_log(spark, sf):
    """Link checks taken from the events: the last of a headline gives the answer, views were not checked."""
    h = views.headlines(spark, sf).select("doc_id", "url")
    e = last_events(spark, sf).where(F.col("event_type") != "view")
    kind = F.col("event_type")
    status = F.when(kind == "purchase", 404).when(kind == "error", 503).otherwise(200)
    final = F.when(kind == "signup", F.lit("https://x.example.org/")).otherwise(F.col("url"))
    return e.join(h, "doc_id").select("url", status.alias("status"), final.alias("final_url"))


def last_events(spark, sf):
    """The last event of each document; events are dealt out over the documents by number."""
    n = table(spark, sf, "documents").agg(F.count(F.lit(1)).alias("n"))
    dealt = table(spark, sf, "events").crossJoin(F.broadcast(n)).withColumn("doc_id", F.col("event_id") % F.col("n"))  # one row
    last = dealt.groupBy("doc_id").agg(F.max("event_id").alias("event_id"))
    return last.join(table(spark, sf, "events").select("event_id", "event_type"), "event_id").select("doc_id", "event_type")


_LAST_EVENTS = """le AS MATERIALIZED (SELECT event_id % (SELECT count(*) FROM documents) AS doc_id, arg_max(event_type, event_id) AS event_type FROM events GROUP BY 1)"""


_OUTCOME = """CASE WHEN event_type IS NULL OR event_type = 'view' THEN 'unchecked' WHEN event_type IN ('purchase', 'signup') THEN 'dead'
    WHEN event_type = 'error' THEN 'uncertain' ELSE 'ok' END"""


@query("f12_link_outcomes", f"""WITH {HEADLINES}, {_LAST_EVENTS} SELECT doc_id, {_OUTCOME} AS outcome, CASE WHEN length(title) < 12 THEN 'short'
    WHEN regexp_matches(title, '^https?://\\S+$') THEN 'address' WHEN length(regexp_replace(title, '\\P{{L}}', '', 'g')) < length(title) * 0.5 THEN 'few letters'
    WHEN event_type = 'purchase' THEN 'HTTP 404' WHEN event_type = 'signup' THEN 'landed on the home page' ELSE '' END AS reason
    FROM h LEFT JOIN le USING (doc_id)""")
def f12(spark, sf):
    return ingest.validate(views.headlines(spark, sf), crawl_log(spark, sf)).select("doc_id", "outcome", "reason")


@query(
    "f12_outcome_counts",
    f"WITH {HEADLINES}, {_LAST_EVENTS} SELECT {_OUTCOME} AS outcome, count(*) AS n FROM h LEFT JOIN le USING (doc_id) GROUP BY 1",
)
def f12_counts(spark, sf):
    return ingest.link_outcomes(views.headlines(spark, sf), crawl_log(spark, sf)).groupBy("outcome").agg(F.count(F.lit(1)).alias("n"))


# --- time ---------------------------------------------------------------------------------------------------------


@query(
    "f13_clock_repair",
    f"""WITH {RAW} SELECT doc_id, CAST(epoch(published + CASE n % 4 WHEN 1 THEN INTERVAL 3 HOUR WHEN 2 THEN INTERVAL 4 HOUR ELSE INTERVAL 0 HOUR END) AS BIGINT) AS published FROM raw""",
)
def f13(spark, sf):
    r = views.raw_items(spark, sf).withColumn("n", views.source_number(F.col("source")))
    zone = F.when(F.col("n") % 4 == 0, "utc").when(F.col("n") % 4 == 1, "-03:00").when(F.col("n") % 4 == 2, "-04:00")
    return r.select("doc_id", F.unix_seconds(dates.repair_clock(F.col("published"), zone)).alias("published"))


@query(
    "f14_mixed_dates",
    f"""WITH {RAW} SELECT doc_id, CAST(epoch(CASE doc_id % 7 WHEN 1 THEN published + INTERVAL 3 HOUR WHEN 4 THEN published - INTERVAL 2 HOUR
      WHEN 5 THEN date_trunc('day', published) WHEN 6 THEN NULL ELSE published END) AS BIGINT) AS published FROM raw""",
)
def f14(spark, sf):
    r = views.raw_items(spark, sf)
    p, m = F.col("published"), F.col("doc_id") % 7
    rfc, iso = F.date_format(p, "EEE, dd MMM yyyy HH:mm:ss"), F.date_format(p, "yyyy-MM-dd'T'HH:mm:ss")
    raw = (
        F.when(m == 0, F.concat(rfc, F.lit(" GMT")))
        .when(m == 1, F.concat(rfc, F.lit(" -0300")))
        .when(m == 2, F.concat(iso, F.lit("Z")))
        .when(m == 3, iso)
        .when(m == 4, F.concat(iso, F.lit("+02:00")))
        .when(m == 5, F.date_format(p, "yyyy-MM-dd"))
        .otherwise(F.col("raw_title"))
    )
    return r.select("doc_id", F.unix_seconds(dates.parse_mixed(raw)).alias("published"))


_SPREAD = f"""{RAW}, spread AS (SELECT *, CASE doc_id % 9 WHEN 0 THEN NULL WHEN 1 THEN {base.NOW} + to_minutes(doc_id % 240) ELSE published END AS p FROM raw)"""


def spread_dates(spark, sf):
    r = views.raw_items(spark, sf)
    m = F.col("doc_id") % 9
    ahead = views.now() + F.make_dt_interval(mins=(F.col("doc_id") % 240).cast("int"))
    return r.withColumn("published", F.when(m == 0, F.lit(None)).when(m == 1, ahead).otherwise(F.col("published")))


@query(
    "f15_admission_window",
    f"""WITH {_SPREAD}, fixed AS (SELECT doc_id, CASE WHEN p IS NULL OR p > {base.NOW} + INTERVAL 2 HOUR THEN {base.NOW} ELSE p END AS p FROM spread)
    SELECT doc_id, CAST(epoch(p) AS BIGINT) AS published FROM fixed WHERE p >= {base.NOW} - INTERVAL 7 DAY""",
)
def f15(spark, sf):
    return ingest.admit(spread_dates(spark, sf), views.now()).select("doc_id", F.unix_seconds("published").alias("published"))


# --- limits, merging and de-duplication -----------------------------------------------------------------------------


@query(
    "w1_newest_per_source",
    f"""WITH {_SPREAD} SELECT source, doc_id FROM (SELECT source, doc_id, n, row_number() OVER (PARTITION BY source ORDER BY p DESC NULLS LAST, doc_id) AS r FROM spread)
    WHERE r <= CASE WHEN n % 4 = 3 THEN 40 ELSE 10 + n END""",
)
def w1(spark, sf):
    e = spread_dates(spark, sf).withColumn("pos", F.col("doc_id"))
    limits = views.sources(spark, sf).select(F.col("id").alias("source"), F.when(F.col("n") % 4 != 3, 10 + F.col("n")).alias("limite"))
    return ingest.newest_per_source(e, limits).select("source", "doc_id")


@query(
    "w2_retention",
    f"""WITH {RAW}, ranked AS (SELECT doc_id, source, row_number() OVER (ORDER BY published DESC, substr(sha1('https://' || source || '.example.org/' || lang || '/' || doc_id), 1, 12)) AS g,
    row_number() OVER (PARTITION BY source ORDER BY published DESC, substr(sha1('https://' || source || '.example.org/' || lang || '/' || doc_id), 1, 12)) AS s FROM raw)
    SELECT doc_id, source FROM ranked WHERE g <= 300 OR s <= 25""",
)
def w2(spark, sf):
    return ingest.retain(views.headlines(spark, sf), cap=300, floor=25).select("doc_id", "source")


def feed_and_sitemap(spark, sf):
    """Each document delivered twice by its source: by a feed, sometimes undated, and by a sitemap without description."""
    h = views.headlines(spark, sf)
    link = F.concat(F.lit("https://"), "source", F.lit(".example.org/"), "lang", F.lit("/"), F.floor(F.length("desc") / 8).cast("string"))
    link = F.when(F.col("doc_id") % 11 == 0, F.lit("")).otherwise(link)
    feed = h.select("source", F.col("doc_id").alias("pos"), "title", F.concat(link, F.when(link != "", "?ref=x").otherwise("")).alias("url"), "desc",
                    F.when(F.col("doc_id") % 5 != 0, F.col("published")).alias("published"))
    sitemap = h.select("source", (F.col("doc_id") + 1_000_000_000).alias("pos"), "title", link.alias("url"), F.lit("").alias("desc"), "published")
    return feed.unionByName(sitemap)


_BOTH = f"""{HEADLINES}, lnk AS (SELECT *, CASE WHEN doc_id % 11 = 0 THEN '' ELSE 'https://' || source || '.example.org/' || lang || '/' || (length("desc") // 8) END AS u FROM h),
    e AS (SELECT source, doc_id AS pos, title, u, "desc", CASE WHEN doc_id % 5 <> 0 THEN published END AS published FROM lnk
    UNION ALL SELECT source, doc_id + 1000000000, title, u, '', published FROM lnk),
    k AS (SELECT *, CASE WHEN u <> '' THEN u ELSE 't|' || title END AS link FROM e)"""


@query(
    "w4_merge_feed_and_sitemap",
    f"""WITH {_BOTH} SELECT source, link, min(pos) AS pos, arg_min(title, pos) AS title,
    coalesce(arg_min("desc", pos) FILTER (WHERE "desc" <> ''), '') AS "desc", CAST(epoch(arg_min(published, pos) FILTER (WHERE published IS NOT NULL)) AS BIGINT) AS published
    FROM k GROUP BY source, link""",
)
def w4(spark, sf):
    m = ingest.merge_addresses(feed_and_sitemap(spark, sf))
    return m.select("source", "link", "pos", "title", "desc", F.unix_seconds("published").alias("published"))


@query("u1_union_entries", f"""WITH {_BOTH} SELECT source, count(*) AS delivered, count(DISTINCT link) AS merged FROM k GROUP BY source""")
def u1(spark, sf):
    e = feed_and_sitemap(spark, sf)
    delivered = e.groupBy("source").agg(F.count(F.lit(1)).alias("delivered"))
    return delivered.join(ingest.merge_addresses(e).groupBy("source").agg(F.count(F.lit(1)).alias("merged")), "source")


def colliding_items(spark, sf):
    """Items whose ids collide inside a source and whose titles repeat, in the order a run meets them."""
    h = views.headlines(spark, sf)
    url = F.concat(F.lit("https://"), "source", F.lit(".example.org/"), "lang", F.lit("/"), F.floor(F.length("desc") / 4).cast("string"))
    order = F.struct(views.source_number(F.col("source")).alias("n"), (-F.unix_seconds("published")).alias("t"), "doc_id")
    return h.select("doc_id", "source", "title", url.alias("url"), "published", order.alias("ord"))


_COLLIDING = f"""{HEADLINES}, items AS (SELECT doc_id, source, title, published, source || '/' || lang || '/' || (length("desc") // 4) AS a,
    source || '|' || trim(regexp_replace(lower(title), '[^a-z0-9]+', ' ', 'g')) AS b, n FROM h)"""


@query(
    "w5_first_wins_on_two_keys",
    f"""WITH {_COLLIDING}, seq AS (SELECT source, list({{'o': doc_id, 'a': a, 'b': b}} ORDER BY published DESC, doc_id) AS l FROM items GROUP BY source),
    kept AS (SELECT list_reduce(l, lambda acc, x: CASE WHEN list_contains(acc.a, x.a) OR list_contains(acc.b, x.b) THEN acc
      ELSE {{'a': list_append(acc.a, x.a), 'b': list_append(acc.b, x.b), 'o': list_append(acc.o, x.o)}} END,
      {{'a': []::VARCHAR[], 'b': []::VARCHAR[], 'o': []::BIGINT[]}}) AS s FROM seq)
    SELECT unnest(s.o) AS doc_id FROM kept""",
)
def w5(spark, sf):
    return ingest.drop_repeats(ingest.with_keys(colliding_items(spark, sf)), "ord").select("doc_id")


_STORE_CUT = "TIMESTAMP '2024-01-23 00:00:00'"


def store_and_incoming(spark, sf):
    keyed = ingest.with_keys(colliding_items(spark, sf))
    old = keyed.where(F.col("published") < F.to_timestamp(F.lit("2024-01-23 00:00:00")))
    return old, keyed


@query(
    "j2_new_by_id",
    f"""WITH {_COLLIDING} SELECT doc_id FROM items WHERE a NOT IN (SELECT a FROM items WHERE published < {_STORE_CUT})""",
)
def j2(spark, sf):
    store, incoming = store_and_incoming(spark, sf)
    return ingest.unknown(incoming, store).select("doc_id")


@query(
    "j3_new_by_title",
    f"""WITH {_COLLIDING} SELECT doc_id FROM items WHERE b NOT IN (SELECT b FROM items WHERE published < {_STORE_CUT})""",
)
def j3(spark, sf):
    store, incoming = store_and_incoming(spark, sf)
    return ingest.unknown_titles(incoming, store).select("doc_id")


def revised(spark, sf):
    """Stored headlines next to what the outlet delivers now: the same, other capitals, one letter, one word, another title."""
    h = views.headlines(spark, sf)
    m, t = F.col("doc_id") % 6, F.col("title")
    new = (
        F.when(m == 0, t)
        .when(m == 1, F.translate(t, "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
        .when(m == 2, F.regexp_replace(t, r"^(\w)(\w+)", "$1x$2"))
        .when(m == 3, F.concat(t, F.lit(" zwei neue woerter")))
        .when(m == 4, F.regexp_replace(t, r"^\S+", "Qqqq"))
        .otherwise(F.coalesce(F.nullif(F.col("desc"), F.lit("")), F.lit("nothing left of it")))
    )
    first = F.when(m == 5, F.col("desc"))
    store = h.select("id", "doc_id", "title", first.alias("anterior"), F.lit(None).cast("timestamp").alias("alterado"))
    return store, h.select("id", new.alias("title"))


def _words_sql(x):
    return f"list_distinct(regexp_extract_all({base.fold1(x)}, '[a-z0-9]+'))"


def _changed_sql(gone, came):
    """Two words differ, and not just by one letter put in: of n letters, that gives the ratio 2n / (2n + 1); other single words have no letter in common."""
    put_in = f"({came}[1] = substr({gone}[1], 1, 1) || 'x' || substr({gone}[1], 2) AND 2.0 * length({gone}[1]) / (2 * length({gone}[1]) + 1) >= 0.8)"
    return f"(len({gone}) + len({came}) >= 2 AND NOT (len({gone}) = 1 AND len({came}) = 1 AND {put_in}))"


@query(
    "j4_title_revisions",
    rf"""WITH {HEADLINES}, r AS (SELECT id, title, CASE doc_id % 6 WHEN 5 THEN "desc" ELSE title END AS first, CASE doc_id % 6 WHEN 0 THEN title WHEN 1 THEN translate(title, 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ') WHEN 2 THEN regexp_replace(title, '^(\w)(\w+)', '\1x\2')
      WHEN 3 THEN title || ' zwei neue woerter' WHEN 4 THEN regexp_replace(title, '^\S+', 'Qqqq') ELSE CASE WHEN "desc" <> '' THEN "desc" ELSE 'nothing left of it' END END AS new FROM h),
    w AS (SELECT *, {_words_sql('title')} AS a, {_words_sql('first')} AS f, {_words_sql('new')} AS b FROM r),
    d AS (SELECT *, list_filter(a, lambda x: NOT list_contains(b, x)) AS g1, list_filter(b, lambda x: NOT list_contains(a, x)) AS c1, list_filter(f, lambda x: NOT list_contains(b, x)) AS g2, list_filter(b, lambda x: NOT list_contains(f, x)) AS c2 FROM w)
    SELECT id, new AS title, first AS anterior FROM d WHERE title <> new AND {_changed_sql('g1', 'c1')} AND {_changed_sql('g2', 'c2')}""",
)
def j4(spark, sf):
    store, incoming = revised(spark, sf)
    return ingest.title_revisions(store, incoming)


@query(
    "u3_word_set_operations",
    f"""WITH {HEADLINES}, w AS (SELECT doc_id, {base.tokens1('title')} AS a, {base.tokens1('"desc"')} AS b FROM h)
    SELECT doc_id, CAST(len(list_filter(a, lambda x: NOT list_contains(b, x))) AS BIGINT) AS only_title, CAST(len(list_filter(a, lambda x: list_contains(b, x))) AS BIGINT) AS both,
    CAST(len(list_distinct(a || b)) AS BIGINT) AS united FROM w""",
)
def u3(spark, sf):
    h = views.headlines(spark, sf)
    w = h.select("doc_id", text.grouping_tokens(F.col("title")).alias("a"), text.grouping_tokens(F.col("desc")).alias("b"))
    size = lambda c: F.size(c).cast("bigint")
    return w.select(
        "doc_id", size(F.array_except("a", "b")).alias("only_title"), size(F.array_intersect("a", "b")).alias("both"), size(F.array_union("a", "b")).alias("united")
    )


def failed_sources(spark, sf):
    """A source is down when the last poll in the log is an error."""
    e = table(spark, sf, "events").withColumn("source", F.concat(F.lit("src"), (F.col("user_id") % 20).cast("string")))
    last = e.groupBy("source").agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("last"))
    return last.where(F.col("last") == "error").select("source", F.lit("HTTP 503").alias("error"))


@query(
    "a6_collection_statistics",
    f"""WITH {_COLLIDING}, {SOURCES}, u AS (SELECT source, count(*) AS items, count(*) FILTER (WHERE {_RELEVANT('title')}) AS usable,
      count(*) FILTER (WHERE a NOT IN (SELECT a FROM items WHERE published < {_STORE_CUT})) AS new FROM items GROUP BY source),
    f AS (SELECT 'src' || (user_id % 20) AS source, arg_max(event_type, (ts, event_id)) AS last FROM events GROUP BY 1)
    SELECT src.id AS source, name, items, usable, new, coalesce(last, '') <> 'error' AS ok FROM src JOIN u ON u.source = src.id LEFT JOIN f ON f.source = src.id""",
)
def a6(spark, sf):
    store, incoming = store_and_incoming(spark, sf)
    usable = incoming.where(text.is_relevant(F.col("title"), TEST_PREFIXES, TEST_ACRONYMS))
    stats = ingest.collection_stats(views.sources(spark, sf), incoming, usable, ingest.unknown(incoming, store), failed_sources(spark, sf))
    return stats.select("source", "name", "items", "usable", "new", "ok")


@query("s9_host_allow_list", f"""WITH {HEADLINES}, {SOURCES} SELECT DISTINCT regexp_replace(hst, '^www\\.', '') AS host FROM
    (SELECT {base.host('home')} AS hst FROM src UNION ALL SELECT {base.host('url')} FROM h UNION ALL SELECT {base.host('url')} FROM pages) WHERE hst <> ''""")
def s9(spark, sf):
    published = views.headlines(spark, sf).select("url").union(table(spark, sf, "pages").select("url"))
    return listings.host_allow_list(views.sources(spark, sf), published)


@query(
    "f3_lookup_form",
    rf"""WITH p AS (SELECT page_id, regexp_extract(trim(url), '^(https?)://', 1) AS sc, regexp_extract(trim(url), '^https?://([^/?#]*)', 1) AS au, regexp_extract(trim(url), '^https?://[^/?#]*([^?#]*)', 1) AS pa,
      list_filter(string_split(regexp_extract(trim(url), '^[^?#]*\?([^#]*)', 1), '&'), lambda x: x <> '' AND NOT starts_with(lower(split_part(x, '=', 1)), 'utm_') AND lower(split_part(x, '=', 1)) NOT IN ({base.quoted(fv.LOOKUP_TRACKING_KEYS)})) AS k FROM pages)
    SELECT page_id, sc || '://' || lower(au) || pa || CASE WHEN len(k) > 0 THEN '?' || array_to_string(k, '&') ELSE '' END AS link FROM p""",
)
def f3_lookup(spark, sf):
    return table(spark, sf, "pages").select("page_id", urls.lookup_form(F.col("url")).alias("link"))
