"""Checked queries: health, blocked hosts, quotas, logs, probes, pages and places."""

from __future__ import annotations

from pyspark.sql import functions as F

from pressloom.functions import fixed_values as fv
from pressloom.functions import places, text, urls
from pressloom.operators import ingest, operations, place_check
from pressloom.plans import views
from pressloom.plans.catalog import base
from pressloom.plans.catalog.base import HEADLINES, NOW, RAW, query
from pressloom.plans.catalog.evidence import CLAIMS, claims
from pressloom.plans.catalog.ingest import _RELEVANT, TEST_ACRONYMS, TEST_PREFIXES, failed_sources
from pressloom.plans.views import table
from pressloom.sources import pages as page_source
from pressloom.session import cut_lineage


def polls(spark, sf):
    """Last poll of each user id, taken as a source, before and after the middle of the log."""
    e = table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp")).withColumn("source", F.concat(F.lit("s"), F.col("user_id").cast("string")))
    middle = F.to_timestamp(F.lit("2024-01-15 12:00:00"))

    def last(df):
        return df.groupBy("source").agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("last"), F.max("ts").alias("ts"))

    return last(e.where(F.col("ts") < middle)), last(e.where(F.col("ts") >= middle))


_POLLS = """p AS (SELECT 's' || user_id AS source, ts < TIMESTAMP '2024-01-15 12:00:00' AS old, arg_max(event_type, (ts, event_id)) AS last, max(ts) AS ts FROM events GROUP BY ALL),
    prev AS (SELECT source, CASE WHEN last = 'error' THEN strftime(ts, '%Y-%m-%d %H:00') ELSE '' END AS down_since, CASE WHEN last = 'error' THEN '' ELSE strftime(ts, '%Y-%m-%d') END AS last_ok FROM p WHERE old),
    cur AS (SELECT source, last <> 'error' AS ok FROM p WHERE NOT old),
    hl AS (SELECT cur.source, CASE WHEN ok THEN '' WHEN coalesce(down_since, '') <> '' THEN down_since ELSE '2024-01-30 00:00' END AS down_since, CASE WHEN ok THEN '2024-01-30' ELSE coalesce(last_ok, '') END AS last_ok, ok FROM cur LEFT JOIN prev USING (source))"""


def health(spark, sf):
    before, after = polls(spark, sf)
    bad = F.col("last") == "error"
    previous = before.select("source", F.when(bad, F.date_format("ts", "yyyy-MM-dd HH:00")).otherwise("").alias("down_since"), F.when(bad, "").otherwise(F.date_format("ts", "yyyy-MM-dd")).alias("last_ok"))
    status = after.select("source", (~bad).alias("ok"))
    return status, operations.update_health(status, previous, views.now())


@query("h1_source_health", f"WITH {_POLLS} SELECT source, down_since, last_ok FROM hl")
def h1(spark, sf):
    return health(spark, sf)[1]


@query("j24_health_report", f"""WITH {_POLLS} SELECT source, CASE WHEN ok THEN 'ok' ELSE 'FALHOU' END AS situacao, CASE WHEN down_since <> '' THEN 'fora do ar desde ' || down_since || ' HTTP 503' ELSE '' END AS observacao FROM hl""")
def j24(spark, sf):
    status, h = health(spark, sf)
    full = status.withColumn("name", F.col("source")).withColumn("new", F.lit(0)).withColumn("error", F.when(F.col("ok"), "").otherwise("HTTP 503"))
    return operations.health_report(full, h).select("source", "situacao", "observacao")


@query("q2_live_sources", f"WITH {_POLLS} SELECT source FROM cur WHERE ok")
def q2(spark, sf):
    return operations.require_a_live_source(health(spark, sf)[0]).where("ok").select("source")


# --- blocked hosts ----------------------------------------------------------------------------------------------------


@query("w8_newest_samples_per_host", f"""WITH {HEADLINES}, r AS (SELECT source || '.example.org' AS host, id, row_number() OVER (PARTITION BY source ORDER BY published DESC, id) AS r FROM h) SELECT host, id FROM r WHERE r <= 2""")
def w8(spark, sf):
    return operations.host_samples(views.headlines(spark, sf), urls.bare_host(F.col("url"))).select("host", "id")


def probes(spark, sf):
    """Probe answers per user id, taken as a host: the event type gives the status, its value the size of the text."""
    e = table(spark, sf, "events")
    host = F.concat(F.lit("h"), F.col("user_id").cast("string"))
    status = F.when(F.col("event_type").isin("error", "view", "click"), 403).when(F.col("event_type") == "signup", 500).otherwise(200)
    last2 = e.withColumn("host", host).withColumn("published", F.col("ts")).withColumn("id", F.col("event_id"))
    sampled = operations.host_samples(last2, F.col("host"))
    return sampled.select("host", operations.probe_opened(status, F.lit(True), F.col("value") * 10, F.lit(0)).alias("opened"))


def previously_blocked(spark, sf):
    e = table(spark, sf, "events")
    return e.where(F.col("event_type") == "signup").select(F.concat(F.lit("h"), (F.col("user_id") * 2).cast("string")).alias("host")).distinct()


_BLOCK = """pr AS (SELECT 'h' || user_id AS host, CASE WHEN event_type IN ('error', 'view', 'click') THEN FALSE WHEN event_type = 'signup' THEN NULL ELSE value * 10 >= 150 END AS opened,
      row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id) AS r FROM events),
    was AS (SELECT DISTINCT 'h' || (user_id * 2) AS host FROM events WHERE event_type = 'signup'),
    dec AS (SELECT host, coalesce(bool_or(opened), FALSE) AS op, count(*) FILTER (WHERE opened = FALSE) = count(*) AS refused FROM pr WHERE r <= 2 GROUP BY host),
    blocked AS (SELECT coalesce(dec.host, was.host) AS host FROM dec FULL JOIN was ON dec.host = was.host WHERE CASE WHEN op THEN FALSE WHEN refused THEN TRUE ELSE was.host IS NOT NULL END)"""


@query("a8_blocked_hosts", f"WITH {_BLOCK} SELECT host FROM blocked")
def a8(spark, sf):
    return operations.blocked_hosts(probes(spark, sf), previously_blocked(spark, sf))


@query("u4_blocked_host_changes", f"WITH {_BLOCK} SELECT host, 'added' AS change FROM blocked WHERE host NOT IN (SELECT host FROM was) UNION ALL SELECT host, 'removed' FROM was WHERE host NOT IN (SELECT host FROM blocked)")
def u4(spark, sf):
    before = previously_blocked(spark, sf)
    return operations.state_changes(before, operations.blocked_hosts(probes(spark, sf), before))


# --- request logs -----------------------------------------------------------------------------------------------------


def requests(spark, sf):
    e = table(spark, sf, "events")
    return e.select(F.col("event_type").alias("kind"), F.date_format("ts", "yyyy-MM-dd").alias("day"), F.sha1((F.col("user_id") % 12).cast("string")).alias("caller"), "ts", F.col("event_id").alias("rid"))


@query(
    "a17_daily_quotas",
    """WITH r AS (SELECT event_type AS kind, strftime(ts, '%Y-%m-%d') AS day, user_id % 12 AS caller, ts, event_id AS rid FROM events),
    own AS (SELECT *, row_number() OVER (PARTITION BY kind, day, caller ORDER BY ts, rid) AS a FROM r), alld AS (SELECT *, row_number() OVER (PARTITION BY kind, day ORDER BY ts, rid) AS b FROM own WHERE a <= 4)
    SELECT kind, day, rid FROM alld WHERE b <= 30""",
)
def a17(spark, sf):
    return operations.allowed_requests(requests(spark, sf), 4, 30).select("kind", "day", "rid")


@query(
    "a18_sampled_counter",
    """SELECT event_type AS kind, strftime(ts, '%Y-%m-%d') AS day, count(*) AS exact, 5 * count(*) FILTER (WHERE ('0x' || substr(md5(event_id::VARCHAR), 1, 8))::UBIGINT % 5 = 0) AS estimate FROM events GROUP BY ALL""",
)
def a18(spark, sf):
    return operations.sampled_counter(requests(spark, sf))


_PATHS = ["/wp-login.php", "/api/news", "/.env.local", "/vendor/phpunit/x", "/.DS_Store", "/xmlrpc.php", "/index.html", "/CGI-BIN/test", "/config.phpx"]


@query(
    "f19_scanner_paths",
    f"""WITH r AS (SELECT [{base.quoted(_PATHS)}][event_id % 9 + 1] AS path, 'as' || (user_id % 7) AS network FROM events)
    SELECT path, network, count(*) AS n FROM r WHERE regexp_matches(lower(path), '^/(wp-|wordpress|\\.env|\\.git|\\.aws|\\.ssh|phpmyadmin|pma|administrator|vendor/phpunit|cgi-bin/|actuator|boaform)') OR lower(path) IN ('/xmlrpc.php', '/config.php', '/configuration.php', '/server-status', '/.ds_store') GROUP BY ALL""",
)
def f19(spark, sf):
    e = table(spark, sf, "events")
    path = F.array(*[F.lit(p) for p in _PATHS])[(F.col("event_id") % 9).cast("int")]
    return operations.scanner_hits(e.select(path.alias("path"), F.concat(F.lit("as"), (F.col("user_id") % 7).cast("string")).alias("network")))


_FAKE = "CASE WHEN doc_id % 10 = 0 THEN ' sk-' || md5(source) || ' Bearer ' || md5(lang) WHEN doc_id % 10 = 1 THEN ' password: \"' || md5(source) || '\"' ELSE '' END"


@query(
    "f20_secret_scan",
    "WITH d AS (SELECT doc_id, text || " + _FAKE + " AS text FROM documents), m AS ("
    + " UNION ALL ".join("SELECT doc_id, '" + n + "' AS name, regexp_extract_all(text, '" + p.replace("'", "''") + "') AS l FROM d" for n, p in operations.fv.SECRET_PATTERNS.items())
    + ") SELECT doc_id, name, CAST(len(l) AS BIGINT) AS n, CAST(length(l[1]) AS BIGINT) AS length, substr(l[1], 1, 4) AS preview FROM m WHERE len(l) > 0",
)
def f20(spark, sf):
    d = table(spark, sf, "documents")
    m = F.col("doc_id") % 10
    fake = F.when(m == 0, F.concat(F.lit(" sk-"), F.md5("source"), F.lit(" Bearer "), F.md5("lang"))).when(m == 1, F.concat(F.lit(' password: "'), F.md5("source"), F.lit('"'))).otherwise("")
    out = operations.secrets(d.select("doc_id", F.concat("text", fake).alias("text")))
    return out.select("doc_id", "name", F.col("n").cast("bigint").alias("n"), F.col("length").cast("bigint").alias("length"), "preview")


# --- feeds under probe --------------------------------------------------------------------------------------------------


def feed_entries(spark, sf):
    h = views.headlines(spark, sf)
    return h.select(F.concat_ws("/", "source", "lang").alias("feed"), "source", "lang", F.col("doc_id").alias("pos"), "title", "url", "desc", "published")


@query(
    "a13_feed_profiles",
    f"""WITH {HEADLINES} SELECT source || '/' || lang AS feed, count(*) AS itens, count(*) FILTER (WHERE "desc" <> '') AS com_descricao, CAST(epoch(max(published)) AS BIGINT) AS mais_novo, CAST(epoch(min(published)) AS BIGINT) AS mais_antigo,
    array_to_string((list(substr(title, 1, 90) ORDER BY doc_id))[1:3], ' | ') AS amostra FROM h GROUP BY ALL""",
)
def a13(spark, sf):
    p = operations.feed_profiles(feed_entries(spark, sf))
    sample = F.array_join(F.transform("amostra", lambda x: x["t"]), " | ")
    return p.select("feed", "itens", "com_descricao", F.unix_seconds("mais_novo").alias("mais_novo"), F.unix_seconds("mais_antigo").alias("mais_antigo"), sample.alias("amostra"))


@query(
    "a12_probe_report",
    f"""WITH {HEADLINES}, f AS (SELECT source AS grp, source || '/' || lang AS url, n, CASE WHEN lang = 'de' AND n % 4 = 0 THEN 'xml-quebrado' WHEN lang = 'es' THEN 'sitemap' ELSE 'feed' END AS kind, count(*) AS itens, max(published) - to_days(CAST(any_value(n) % 5 AS INT)) AS novo FROM h GROUP BY ALL),
    u AS (SELECT *, kind IN ('feed', 'sitemap') AND novo > {NOW} - INTERVAL 72 HOUR AS us FROM f)
    SELECT grp AS "group", count(*) AS testes, count(*) FILTER (WHERE us) AS usaveis, count(*) FILTER (WHERE kind IN ('feed', 'sitemap') AND NOT us) AS velhos, count(*) FILTER (WHERE kind = 'xml-quebrado') AS quebrados,
      count(*) FILTER (WHERE n % 7 = 0) AS falhas, array_to_string(coalesce((list(url ORDER BY itens DESC, url) FILTER (WHERE us))[1:3], []), ',') AS melhores FROM u GROUP BY grp""",
)
def a12(spark, sf):
    p = operations.feed_profiles(feed_entries(spark, sf)).withColumn("group", F.substring_index("feed", "/", 1))
    n, lang = views.source_number(F.col("group")), F.substring_index("feed", "/", -1)
    kind = F.when((lang == "de") & (n % 4 == 0), "xml-quebrado").when(lang == "es", "sitemap").otherwise("feed")
    probed = p.select(
        "group", F.col("feed").alias("url"), kind.alias("kind"), "itens", (F.col("mais_novo") - F.make_dt_interval(days=n % 5)).alias("mais_novo"), F.when(n % 7 == 0, 503).otherwise(200).alias("status")
    )
    return operations.probe_report(probed, views.now()).withColumn("melhores", F.array_join("melhores", ","))


_SHAPE = r"""array_to_string(list_transform(regexp_extract_all(regexp_replace(t, '\p{Nd}+', '#', 'g'), '[\p{L}\p{N}_]+|[^\p{L}\p{N}_]'), lambda w: CASE WHEN regexp_matches(w, '^[A-ZÀ-Ú][\p{L}\p{N}_]{3,}$') THEN 'X' ELSE w END), '')"""


@query(
    "a14_template_titles",
    f"""WITH {RAW}, s AS (SELECT source, {_SHAPE} AS shape FROM (SELECT source, raw_title AS t FROM raw)), c AS (SELECT source, shape, count(*) AS n FROM s GROUP BY ALL HAVING count(*) >= 4),
    k AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n DESC, encode(shape)) AS r FROM c) SELECT source, shape, n FROM k WHERE r <= 3""",
)
def a14(spark, sf):
    return operations.template_titles(views.raw_items(spark, sf).withColumnRenamed("raw_title", "title"))


@query(
    "a15_collection_rehearsal",
    f"""WITH {HEADLINES}, k AS (SELECT *, {_RELEVANT('title')} AS keep FROM h) SELECT source, count(*) AS itens, count(*) FILTER (WHERE keep) AS passaram, count(*) FILTER (WHERE NOT keep) AS barrados, count(*) FILTER (WHERE published > {NOW} - INTERVAL 24 HOUR) AS recentes,
    coalesce(array_to_string((list(substr(title, 1, 95) ORDER BY published DESC, doc_id) FILTER (WHERE keep))[1:4], ' | '), '') AS exemplos FROM k GROUP BY source""",
)
def a15(spark, sf):
    e = feed_entries(spark, sf).withColumn("keep", text.is_relevant(F.col("title"), TEST_PREFIXES, TEST_ACRONYMS))
    r = operations.rehearsal(e, views.now())
    return r.withColumn("exemplos", F.coalesce(F.array_join("exemplos", " | "), F.lit("")))


# --- pages ----------------------------------------------------------------------------------------------------------------

_OPEN = "(?is)^(.*?)(?:</p\\b|<p\\b|</?(?:div|ul|ol|table|section|article|main|h[1-6]|blockquote|pre|header|dl|fieldset|address|body|html)\\b|\\z)"


def _strip_blocks(x):
    for tag in "script style noscript svg template iframe textarea figure figcaption nav aside footer form button select".split():
        x = rf"regexp_replace({x}, '(?is)<{tag}\b[^>]*>.*?</{tag}\s*>', ' ', 'g')"
    return x


def _paragraph_sql(html):
    stripped = _strip_blocks(f"regexp_replace({html}, '(?s)<!--.*?-->', ' ', 'g')")
    return f"list_transform((string_split_regex({stripped}, '(?i)<p\\b[^>]*>'))[2:], lambda z: regexp_extract(z, '{_OPEN}', 1))"


PAGE_TEXT = f"""pg AS (SELECT page_id, url, {_paragraph_sql('html')} AS raw FROM pages), pp AS (SELECT page_id, url, unnest(raw) AS r, generate_subscripts(raw, 1) AS i FROM pg),
    pc AS (SELECT page_id, url, i, {base.clean('r')} AS t, length({base.clean("array_to_string(regexp_extract_all(r, '(?is)<a\\b[^>]*>(.*?)</a\\s*>', 1), ' ')")}) AS l FROM pp),
    pl AS (SELECT page_id, url, list(t ORDER BY i) AS ps FROM pc WHERE length(t) >= 40 AND l <= 0.5 * length(t) GROUP BY ALL),
    pf AS (SELECT page_id, url, list_reduce(ps, lambda acc, p: CASE WHEN acc.stop OR (acc.n >= 300 AND (regexp_matches(trim({base.fold2('substr(p, 1, 60)')}), '{base.fv.ARTICLE_END}') OR p LIKE '©%')) THEN {{'out': acc.out, 'keys': acc.keys, 'n': acc.n, 'stop': TRUE}}
        WHEN length(p) < 30 OR regexp_matches(trim({base.fold2('substr(p, 1, 60)')}), '{base.fv.CALL_TO_ACTION}') OR list_contains(acc.keys, substr(p, 1, 100)) THEN acc
        ELSE {{'out': list_append(acc.out, p), 'keys': list_append(acc.keys, substr(p, 1, 100)), 'n': acc.n + length(p) + 1, 'stop': acc.n + length(p) + 1 > 20000}} END,
        {{'out': []::VARCHAR[], 'keys': []::VARCHAR[], 'n': CAST(0 AS BIGINT), 'stop': FALSE}}).out AS kept FROM pl),
    pt AS MATERIALIZED (SELECT page_id, url, substr(array_to_string(kept[1:coalesce(list_max(list_transform(kept, lambda p, i: CASE WHEN length(p) >= 120 OR regexp_matches(p, '[.!?…:;"”’)»\\]]$') THEN i ELSE 1 END)), 0)], chr(10)), 1, 20000) AS text FROM pf)"""


@query("x3_page_text", f"WITH {PAGE_TEXT} SELECT page_id, md5(coalesce(text, '')) AS digest, CAST(length(coalesce(text, '')) AS BIGINT) AS n FROM pages LEFT JOIN pt USING (page_id)")
def x3(spark, sf):
    p = table(spark, sf, "pages").select("page_id", page_source.page_text(F.col("html")).alias("t"))
    return p.select("page_id", F.md5("t").alias("digest"), F.length("t").cast("bigint").alias("n"))


def marked_pages(spark, sf):
    """Pages with metadata and structured data written into their heads, longer or shorter than the visible text."""
    p = table(spark, sf, "pages")
    visible = F.regexp_replace(page_source.page_text(F.col("html")), '["\\\\\n]', " ")
    body = F.when(F.col("page_id") % 3 == 0, F.concat(visible, F.lit(" "), visible)).when(F.col("page_id") % 3 == 1, F.substring(visible, 1, 500)).otherwise(visible)
    head = F.concat(
        F.lit('<meta property="og:title" content="Page '), F.col("page_id").cast("string"), F.lit('"><meta name="description" content="About &amp; more"><script type="application/ld+json">{"@graph":[{"x":1},{"articleBody":"'),
        body, F.lit('"}]}</script></head>'),
    )
    return p.select("page_id", "url", F.replace("html", F.lit("</head>"), head).alias("html"))


@query(
    "x4_page_metadata",
    f"""WITH {PAGE_TEXT}, v AS (SELECT pages.page_id, coalesce(text, '') AS p, regexp_replace(coalesce(text, ''), '["\\\\\\n]', ' ', 'g') AS vis FROM pages LEFT JOIN pt USING (page_id)),
    b AS (SELECT *, {base.clean("CASE page_id % 3 WHEN 0 THEN vis || ' ' || vis WHEN 1 THEN substr(vis, 1, 500) ELSE vis END")} AS raw FROM v),
    s AS (SELECT *, CASE WHEN length(raw) >= 30 THEN substr(raw, 1, 20000) ELSE '' END AS b FROM b),
    w AS (SELECT *, length(b) >= 400 AND (length(p) = 0 OR CASE WHEN length(p) > 3 * length(b) OR length(b) > 3 * length(p) THEN length(p) < 600 AND length(b) >= 600 AND length(b) <= 12000 ELSE length(b) > 1.25 * length(p) END) AS ld FROM s)
    SELECT page_id, 'Page ' || page_id AS title, 'About & more' AS description, CASE WHEN ld THEN 'json-ld' ELSE 'paragrafos' END AS via, CAST(length(CASE WHEN ld THEN b ELSE p END) AS BIGINT) AS n FROM w""",
)
def x4(spark, sf):
    e = page_source.extract(marked_pages(spark, sf))
    return e.select("page_id", "title", "description", "via", F.length("text").cast("bigint").alias("n"))


@query(
    "a16_extraction_coverage",
    f"""WITH {PAGE_TEXT}, t AS (SELECT regexp_replace({base.host('pages.url')}, '^www\\.', '') AS host, length(coalesce(text, '')) AS n FROM pages LEFT JOIN pt USING (page_id))
    SELECT host, count(*) AS paginas, avg(n) AS media, count(*) FILTER (WHERE n >= 600) / count(*) AS parte FROM t GROUP BY host""",
)
def a16(spark, sf):
    p = table(spark, sf, "pages").select(urls.bare_host(F.col("url")).alias("host"), page_source.page_text(F.col("html")).alias("text"))
    return operations.extraction_report(p)


def linked_pages(spark, sf):
    p = table(spark, sf, "pages")
    k = F.col("page_id")
    extra = F.concat(
        F.when(k % 3 == 0, F.concat(F.lit('<link rel="alternate" type="application/rss+xml" href="/feed/'), (k % 5).cast("string"), F.lit('">'))).otherwise(""),
        F.when(k % 4 == 0, F.lit('<a href="news.xml">x</a><a href="#/rss">y</a>')).otherwise(""),
        F.when(k % 6 == 0, F.lit("\nSitemap: https://m.example.org/sitemap.xml\n")).otherwise(""),
    )
    return p.select(F.regexp_extract(urls.host(F.col("url")), r"\.(\w+)$", 1).alias("group"), "page_id", "url", F.concat("html", extra).alias("html"))


@query(
    "x5_feed_links",
    r"""WITH p AS (SELECT page_id, regexp_extract(url, '^(https?)://', 1) AS sc, regexp_extract(url, '^https?://([^/?#]*)', 1) AS au, regexp_extract(url, '^https?://[^/?#]*([^?#]*)', 1) AS pa FROM pages),
    f AS (SELECT regexp_extract(lower(au), '\.(\w+)$', 1) AS grp, page_id, 0 AS o, sc || '://' || au || '/feed/' || (page_id % 5) AS link FROM p WHERE page_id % 3 = 0
      UNION ALL SELECT regexp_extract(lower(au), '\.(\w+)$', 1), page_id, 1, sc || '://' || au || CASE WHEN regexp_replace(pa, '[^/]*$', '') = '' THEN '/' ELSE regexp_replace(pa, '[^/]*$', '') END || 'news.xml' FROM p WHERE page_id % 4 = 0
      UNION ALL SELECT regexp_extract(lower(au), '\.(\w+)$', 1), page_id, 2, 'https://m.example.org/sitemap.xml' FROM p WHERE page_id % 6 = 0),
    g AS (SELECT grp, link, min((page_id, o)) AS k FROM f GROUP BY ALL) SELECT grp AS "group", link, k[1] AS page_id, CAST(k[2] AS BIGINT) AS kind FROM g""",
)
def x5(spark, sf):
    return page_source.feed_links(linked_pages(spark, sf)).select("group", "link", "page_id", F.col("order").cast("bigint").alias("kind"))


# --- places ---------------------------------------------------------------------------------------------------------------


def place_list(spark, sf):
    """Distinct long words and word pairs of the benchmark as place names."""
    b = table(spark, sf, "benchmark")
    w = b.select("item_id", F.regexp_extract_all(text.fold_retrieval(F.col("text")), F.lit("[a-z]{6,}"), F.lit(0)).alias("w"))
    one = w.select(F.explode("w").alias("nome"))
    two = w.where(F.size("w") > 1).select(F.concat_ws(" ", F.col("w")[0], F.col("w")[1]).alias("nome"))
    names = one.union(two).distinct()
    return names.select("nome", F.upper(F.substring("nome", 1, 2)).alias("uf"), F.col("nome").alias("idx"))


_PLACES = rf"""bw AS (SELECT item_id, regexp_extract_all({base.fold2('text')}, '[a-z]{{6,}}') AS w FROM benchmark),
    pl AS MATERIALIZED (SELECT DISTINCT nome FROM (SELECT unnest(w) AS nome FROM bw UNION ALL SELECT w[1] || ' ' || w[2] FROM bw WHERE len(w) > 1)),
    ask AS MATERIALIZED (SELECT DISTINCT CASE WHEN x % 4 = 0 THEN w || '/SP' WHEN x % 4 = 1 THEN substr(w, 1, 2) || substr(w, 4) WHEN x % 4 = 2 THEN substr(w, 2, 1) || substr(w, 1, 1) || substr(w, 3) ELSE w END AS name FROM
      (SELECT conv_id + turn AS x, unnest(regexp_extract_all({base.fold2('text')}, '[a-z]{{7,}}')) AS w FROM conversations)),
    keyed AS MATERIALIZED (SELECT name, regexp_replace(name, '/SP$', '') AS k FROM ask)"""
_CHECKED = f"""{_PLACES}, nearest AS (SELECT k, min((damerau_levenshtein(k, nome), nome)) AS b FROM (SELECT DISTINCT k FROM keyed) q JOIN pl ON abs(length(k) - length(nome)) <= 2 AND damerau_levenshtein(k, nome) <= CASE WHEN length(replace(k, ' ', '')) >= 12 THEN 2 ELSE 1 END GROUP BY k),
    begins AS (SELECT k, min(nome) AS b FROM (SELECT DISTINCT k FROM keyed) q JOIN pl ON starts_with(nome, k || ' ') GROUP BY k)"""


def asked_places(spark, sf):
    c = table(spark, sf, "conversations")
    w = c.select((F.col("conv_id") + F.col("turn")).alias("x"), F.explode(F.regexp_extract_all(text.fold_retrieval(F.col("text")), F.lit("[a-z]{7,}"), F.lit(0))).alias("w"))
    x, word = F.col("x") % 4, F.col("w")
    name = (
        F.when(x == 0, F.concat(word, F.lit("/SP")))
        .when(x == 1, F.concat(F.substring(word, 1, 2), F.substring(word, 4, 100)))
        .when(x == 2, F.concat(F.substring(word, 2, 1), F.substring(word, 1, 1), F.substring(word, 3, 100)))
        .otherwise(word)
    )
    return w.select(name.alias("name")).distinct()


@query(
    "j17_place_check",
    f"""WITH {_CHECKED} SELECT name, pl.nome IS NOT NULL AS existe, CASE WHEN pl.nome IS NULL THEN coalesce(nearest.b[2], begins.b) END AS parecido FROM keyed LEFT JOIN pl ON pl.nome = k LEFT JOIN nearest ON nearest.k = keyed.k LEFT JOIN begins ON begins.k = keyed.k""",
)
def j17(spark, sf):
    return place_check.check_places(asked_places(spark, sf), place_list(spark, sf)).select("name", "existe", "parecido")


@query(
    "j18_mentions_resolved",
    f"""WITH {_CHECKED.replace("keyed AS MATERIALIZED (SELECT name, regexp_replace(name, '/SP$', '') AS k FROM ask)", "keyed AS MATERIALIZED (SELECT nome || CASE WHEN length(nome) % 2 = 0 THEN ' Quixote Zyx' ELSE ' de Zyxwv' END AS name, nome || CASE WHEN length(nome) % 2 = 0 THEN ' quixote zyx' ELSE ' de zyxwv' END AS k, nome FROM pl)")}
    SELECT keyed.name, CASE WHEN length(keyed.nome) % 2 = 0 THEN keyed.nome WHEN keyed.nome LIKE '% %' THEN split_part(keyed.nome, ' ', 1) ELSE keyed.name END AS lugar, length(keyed.nome) % 2 = 0 OR keyed.nome LIKE '% %' AS existe FROM keyed""",
)
def j18(spark, sf):
    p = place_list(spark, sf)
    tail = F.when(F.length("nome") % 2 == 0, " Quixote Zyx").otherwise(" de Zyxwv")
    return place_check.check_mentions(p.select(F.concat("nome", tail).alias("name")), p).select("name", "lugar", "existe")


@query(
    "x6_place_names",
    rf"""SELECT doc_id, trim(regexp_replace({base.fold2('t')}, '[^a-z0-9]+', ' ', 'g')) AS k FROM (SELECT doc_id, replace(text, chr(10), ' ') AS t FROM documents)""",
)
def x6(spark, sf):
    d = table(spark, sf, "documents")
    suffix = F.array(F.lit("/SP"), F.lit(" - RJ"), F.lit(" (mg)"), F.lit(""))[(F.col("doc_id") % 4).cast("int")]
    return d.select("doc_id", places.place_key(F.concat(F.translate("text", "\n", " "), suffix)).alias("k"))


def _norm_sql(x):
    return f"trim(regexp_replace({base.fold2(x)}, '[^a-z0-9]+', ' ', 'g'))"


_MENTION_SQL = places._MENTION.replace("'", "''")


def cited(spark, sf):
    """Whole claim texts; by number, some cite places behind their own words or before them."""
    c = claims(spark, sf).withColumn("w", F.regexp_extract(text.fold_retrieval(F.col("text")), "[a-z]{5,}", 0)).where("w != ''")
    name = F.initcap("w")
    three = F.concat(F.col("text"), F.lit(". Ontem o prefeito de "), name, F.lit(", a prefeitura de "), F.upper(name), F.lit(". e o vereador de Porto "), name, F.lit(" disseram"))
    one = F.concat(F.lit("A cidade do "), name, F.lit(", "), F.col("text"))
    return c.select("qid", "k", "w", F.when(F.col("k") % 3 == 0, three).when(F.col("k") % 3 == 1, one).otherwise(F.col("text")).alias("text"))


_CITED = f"""{CLAIMS}, nm AS (SELECT qid, k, text, w, upper(substr(w, 1, 1)) || substr(w, 2) AS nm FROM (SELECT *, regexp_extract({base.fold2('text')}, '[a-z]{{5,}}') AS w FROM clm) WHERE w <> ''),
    cited AS MATERIALIZED (SELECT qid, k, w, CASE k % 3 WHEN 0 THEN text || '. Ontem o prefeito de ' || nm || ', a prefeitura de ' || upper(nm) || '. e o vereador de Porto ' || nm || ' disseram' WHEN 1 THEN 'A cidade do ' || nm || ', ' || text ELSE text END AS text FROM nm)"""


@query(
    "x7_place_mentions",
    rf"""WITH {_CITED}, m AS (SELECT qid, list_transform(regexp_extract_all(text, '{_MENTION_SQL}', 1), lambda x: trim(regexp_replace(x, '[.''’-]+$', ''))) AS names FROM cited),
    k AS (SELECT qid, names, list_transform(names, lambda x: {_norm_sql('x')}) AS keys FROM m),
    kept AS (SELECT qid, list_filter(list_transform(range(1, len(keys) + 1), lambda i: CASE WHEN keys[i] <> '' AND list_position(keys, keys[i]) = i THEN names[i] END), lambda x: x IS NOT NULL)[:3] AS names FROM k)
    SELECT qid, array_to_string(names, '|') AS names FROM kept""",
)
def x7(spark, sf):
    return cited(spark, sf).select("qid", F.array_join(places.mentions(F.col("text")), "|").alias("names"))


@query(
    "x8_municipal_context",
    rf"""WITH {_CITED}, t AS (SELECT qid, ' ' || {_norm_sql('text')} || ' ' AS t, ' ' || w || ' ' AS n FROM cited), p AS (SELECT *, instr(t, n) - 1 AS at_ FROM t),
    a AS (SELECT *, substr(t, greatest(at_ - 60, 0) + 1, at_ + length(n) + 40 - greatest(at_ - 60, 0)) AS around FROM p)
    SELECT qid, at_ >= 0 AND regexp_matches(around, '{fv.MUNICIPAL_CONTEXT}') AS context, at_ >= 0 AS present FROM a""",
)
def x8(spark, sf):
    t, name = F.col("text"), F.col("w")
    return cited(spark, sf).select("qid", places.has_municipal_context(t, name).alias("context"), places.appears(t, name).alias("present"))


@query(
    "x17_entities",
    r"""SELECT page_id, replace(replace(replace(replace(replace(split_part(split_part(html, '<title>', 2), '</title>', 1), '&copy;', '©'), '&middot;', '·'), '&#233;', 'é'), '&#x2014;', '—'), '&amp;', '&') || ' é — € &bogus; &lt;' AS t FROM pages""",
)
def x17(spark, sf):
    p = table(spark, sf, "pages")
    t = F.regexp_extract("html", "(?s)<title>(.*?)</title>", 1)
    return p.select("page_id", text.decode_entities(F.concat(t, F.lit(" &#233; &#x2014; &euro; &bogus; &amp;lt;"))).alias("t"))


# --- gate -----------------------------------------------------------------------------------------------------------------


@query(
    "q1_publish_gate",
    f"""WITH {HEADLINES} SELECT * FROM (SELECT 'headlines' AS output, 'dangerous link' AS rule, count(*) FILTER (WHERE doc_id % 50 = 0) AS n FROM h UNION ALL SELECT 'headlines', 'empty desc', count(*) FILTER (WHERE "desc" = '') FROM h
    UNION ALL SELECT 'pages', 'rows below minimum', greatest(1000000 - count(*), 0) FROM pages) WHERE n > 0""",
)
def q1(spark, sf):
    h = views.headlines(spark, sf).withColumn("url", F.when(F.col("doc_id") % 50 == 0, "javascript:alert(1)").otherwise(F.col("url")))
    return operations.quality_problems(
        {"headlines": h, "pages": table(spark, sf, "pages")}, {"headlines": 1, "pages": 1_000_000}, {"headlines": "url"}, {"headlines": ["title", "desc"]}
    )
