"""Checked queries: subscriber preferences, alert selection, delivery ledger."""

from __future__ import annotations

from pyspark.sql import functions as F

from pressloom.functions import dates
from pressloom.operators import alerts
from pressloom.plans import views
from pressloom.plans.catalog.base import NOW, query
from pressloom.plans.catalog.coverage import TAGGED, tagged
from pressloom.plans.views import table

RUN = "2024-01-29 18:30:00"  # 15:30 local
NIGHT = "2024-01-29 04:00:00"
DIGEST_COUNT = 130  # what the run publishes; the selection takes any number


def digests(spark, sf):
    """The most covered of the tagged headlines, coverage taken from the document number."""
    t = tagged(spark, sf).withColumn("n", 1 + F.col("doc_id") % 9)
    best = t.orderBy(F.col("n").desc(), F.col("published").desc(), "id").limit(DIGEST_COUNT)
    return best.select(
        F.col("doc_id").alias("pos"), "id", F.col("title").alias("t"), F.concat(F.lit("https://x.example.org/"), F.floor(F.col("doc_id") / 2).cast("string")).alias("u"),
        F.col("source_name").alias("f"), "n", F.col("topics").alias("temas"), F.col("ufs_txt").alias("ufs"), F.col("pessoas_t").alias("pessoas"),
        F.when(F.col("kind") == "checagem", "checagem").otherwise("assunto").alias("k"), F.unix_seconds("published").alias("p"),
    )


DIGESTS = f"""{TAGGED}, dig AS MATERIALIZED (SELECT doc_id AS pos, id, title AS t, 'https://x.example.org/' || (doc_id // 2) AS u, source_name AS f, 1 + doc_id % 9 AS n, topics AS temas, ufs_txt AS ufs, pessoas_t AS pessoas,
    CASE WHEN kind = 'checagem' THEN 'checagem' ELSE 'assunto' END AS k, CAST(epoch(published) AS BIGINT) AS p FROM tagged ORDER BY 1 + doc_id % 9 DESC, published DESC, id LIMIT {DIGEST_COUNT})"""


def subscribers(spark, sf):
    """Customers as subscribers; some were never seen, some reached their daily maximum."""
    c = table(spark, sf, "customer")
    k, seg = F.col("c_custkey"), F.col("c_mktsegment")
    topic = F.when(seg == "BUILDING", F.array(F.lit("alpha"))).when(seg == "MACHINERY", F.array(F.lit("beta"), F.lit("gamma"))).otherwise(F.array().cast("array<string>"))
    state = F.element_at(F.array(*[F.lit(x) for x in ("AA", "BB", "CC", "DD", "EE", "FF")]), F.col("c_nationkey") % 6 + 1)
    person = F.when(seg == "HOUSEHOLD", F.array(F.lit("ana"), F.lit("cy"))).otherwise(F.array().cast("array<string>"))
    seen = F.transform(F.sequence(F.lit(0), (k % 70).cast("int")), lambda i: F.concat(F.lit("old"), i.cast("string")))
    return c.select(
        k.alias("key"), (k % 4 == 0).alias("geral"), topic.alias("temas"), F.array(state).alias("ufs"), person.alias("pessoas"), (k % 3 == 0).alias("checagens"),
        F.when(k % 2 == 0, "importantes").otherwise("top").alias("nivel"), (1 + k % 5).cast("int").alias("max"),
        F.when(k % 5 != 0, seen).alias("s"), F.when(k % 2 == 0, "2024-01-29").otherwise("2024-01-28").alias("d"), (k % 6).cast("int").alias("n"),
    )


SUBSCRIBERS = """sub AS MATERIALIZED (SELECT c_custkey AS key, c_custkey % 4 = 0 AS geral, CASE c_mktsegment WHEN 'BUILDING' THEN ['alpha'] WHEN 'MACHINERY' THEN ['beta', 'gamma'] ELSE []::VARCHAR[] END AS temas,
    [['AA','BB','CC','DD','EE','FF'][c_nationkey % 6 + 1]] AS ufs, CASE WHEN c_mktsegment = 'HOUSEHOLD' THEN ['ana', 'cy'] ELSE []::VARCHAR[] END AS pessoas, c_custkey % 3 = 0 AS checagens,
    CASE WHEN c_custkey % 2 = 0 THEN 'importantes' ELSE 'top' END AS nivel, 1 + c_custkey % 5 AS max, CASE WHEN c_custkey % 5 <> 0 THEN list_transform(range(0, c_custkey % 70 + 1), lambda i: 'old' || i) END AS s,
    CASE WHEN c_custkey % 2 = 0 THEN '2024-01-29' ELSE '2024-01-28' END AS d, c_custkey % 6 AS n FROM customer)"""
_SELECTED = f"""{DIGESTS}, {SUBSCRIBERS}, sc AS (SELECT sub.key, sub.s, sub.max, CASE WHEN d = '2024-01-29' THEN sub.n ELSE 0 END AS sent, dig.pos, dig.id, dig.u, dig.p, CASE WHEN k = 'checagem' THEN CASE WHEN checagens THEN 100 + dig.n ELSE 0 END
      WHEN geral AND dig.n >= CASE nivel WHEN 'top' THEN 7 ELSE 5 END THEN dig.n WHEN list_has_any(sub.temas, dig.temas) AND dig.n >= CASE nivel WHEN 'top' THEN 5 ELSE 3 END THEN dig.n - 1
      WHEN list_has_any(sub.pessoas, dig.pessoas) AND dig.n >= CASE nivel WHEN 'top' THEN 5 ELSE 3 END THEN dig.n - 1 WHEN list_has_any(sub.ufs, dig.ufs) AND dig.n >= CASE nivel WHEN 'top' THEN 3 ELSE 2 END THEN dig.n - 2 ELSE 0 END AS score FROM sub, dig),
    once AS (SELECT *, row_number() OVER (PARTITION BY key, u ORDER BY score DESC, p DESC, pos) AS ru FROM sc WHERE score > 0 AND s IS NOT NULL),
    rk AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY score DESC, p DESC, pos) AS r FROM once WHERE ru = 1),
    sel AS MATERIALIZED (SELECT key, id, r FROM rk WHERE r <= least(2, max - sent))"""


def runs(spark, sf, at=RUN):
    return alerts.select(subscribers(spark, sf), digests(spark, sf), dates.moment(at))


@query("n1_alert_selection", f"WITH {_SELECTED} SELECT key, id, r AS pos FROM sel")
def n1(spark, sf):
    r = runs(spark, sf)
    return r.select("key", F.posexplode("enviar").alias("pos", "id")).select("key", "id", (F.col("pos") + 1).cast("bigint").alias("pos"))


@query(
    "n1_state_after_run",
    f"""WITH {_SELECTED}, a AS (SELECT key, list(id ORDER BY r) AS ids FROM sel GROUP BY key), alld AS (SELECT list(id ORDER BY pos) AS ids FROM (SELECT * FROM dig ORDER BY pos DESC LIMIT 60)),
    st AS (SELECT sub.key, CASE WHEN s IS NULL THEN (SELECT ids FROM alld) ELSE s || coalesce(a.ids, []::VARCHAR[]) END AS full_s, CASE WHEN s IS NULL THEN 0 ELSE CASE WHEN d = '2024-01-29' THEN n ELSE 0 END + coalesce(len(a.ids), 0) END AS n FROM sub LEFT JOIN a ON a.key = sub.key)
    SELECT key, array_to_string(CASE WHEN len(full_s) > 60 THEN full_s[len(full_s) - 59:] ELSE full_s END, ',') AS s, '2024-01-29' AS d, n FROM st""",
)
def n1_state(spark, sf):
    return runs(spark, sf).select("key", F.array_join("s", ",").alias("s"), "d", F.col("n").cast("bigint").alias("n"))


@query("x15_local_hour_and_day", """SELECT event_id, CAST(hour(ts - INTERVAL 3 HOUR) AS BIGINT) AS h, strftime(ts - INTERVAL 3 HOUR, '%Y-%m-%d') AS d FROM events""")
def x15(spark, sf):
    e = table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return e.select("event_id", dates.local_hour(F.col("ts")).cast("bigint").alias("h"), dates.local_day(F.col("ts")).alias("d"))


@query(
    "x16_notification_texts",
    f"""WITH {DIGESTS} SELECT id, CASE WHEN k = 'checagem' THEN 'Checagem: pode ser falso' WHEN n >= 2 THEN 'Em ' || n || ' veículos' ELSE 'Notícias' END AS t,
    CASE WHEN length(t) > 180 THEN rtrim(substr(t, 1, 179)) || '…' ELSE t END AS b, u, f FROM dig""",
)
def x16(spark, sf):
    return alerts.payload(digests(spark, sf))


def receipts(spark, sf):
    """Answers of the push service per chosen alert, by subscriber number."""
    r = runs(spark, sf).select("key", F.posexplode("enviar").alias("pos", "id"))
    status = F.when(F.col("key") % 17 == 0, 410).when((F.col("key") + F.col("pos")) % 5 == 0, 500).otherwise(201)
    return r.withColumn("status", status)


@query(
    "n2_ledger_after_delivery",
    f"""WITH {_SELECTED}, rc AS (SELECT key, id, r, CASE WHEN key % 17 = 0 THEN 410 WHEN (key + r - 1) % 5 = 0 THEN 500 ELSE 201 END AS status FROM sel),
    pk AS (SELECT key, bool_or(status = 410) AS gone, list(id ORDER BY r) FILTER (WHERE status = 201) AS ok FROM rc GROUP BY key), alld AS (SELECT list(id ORDER BY pos) AS ids FROM (SELECT * FROM dig ORDER BY pos DESC LIMIT 60)),
    st AS (SELECT sub.key, CASE WHEN len(ok) > 0 THEN coalesce(s, []::VARCHAR[]) || ok WHEN s IS NULL THEN (SELECT ids FROM alld) ELSE s END AS full_s, len(ok) > 0 AS sent,
      CASE WHEN len(ok) > 0 THEN CASE WHEN d = '2024-01-29' THEN n ELSE 0 END + len(ok) WHEN s IS NULL THEN 0 ELSE n END AS n, CASE WHEN len(ok) > 0 OR s IS NULL THEN '2024-01-29' ELSE d END AS d
      FROM sub LEFT JOIN pk ON pk.key = sub.key WHERE NOT coalesce(gone, FALSE))
    SELECT key, array_to_string(CASE WHEN len(full_s) > 60 AND sent THEN full_s[len(full_s) - 59:] ELSE full_s END, ',') AS s, d, n FROM st""",
)
def n2(spark, sf):
    first = runs(spark, sf).where("primeira").select("key", "s", "d")
    out = alerts.merge_receipts(subscribers(spark, sf), receipts(spark, sf), first, dates.moment(RUN))
    return out.select("key", F.array_join("s", ",").alias("s"), "d", F.col("n").cast("bigint").alias("n"))


@query("n1_quiet_hours", f"""WITH {SUBSCRIBERS} SELECT key, CAST(0 AS BIGINT) AS sent FROM sub""")
def n1_night(spark, sf):
    return runs(spark, sf, NIGHT).select("key", F.size("enviar").cast("bigint").alias("sent"))


@query(
    "n3_subscription_upsert",
    f"""WITH {SUBSCRIBERS}, cur AS (SELECT key, geral, '2024-01-01' AS c, n FROM sub WHERE key % 3 <> 0), inc AS (SELECT key, NOT geral AS geral, key % 7 = 0 AS gone FROM sub WHERE key % 2 = 0)
    SELECT coalesce(cur.key, inc.key) AS key, coalesce(inc.geral, cur.geral) AS geral, coalesce(c, '2024-01-30') AS c, n FROM cur FULL JOIN inc ON cur.key = inc.key WHERE NOT coalesce(gone, FALSE)""",
)
def n3(spark, sf):
    s = subscribers(spark, sf)
    current = s.where(F.col("key") % 3 != 0).select("key", "geral", F.lit("2024-01-01").alias("c"), F.col("n").cast("bigint").alias("n"))
    incoming = s.where(F.col("key") % 2 == 0).select("key", (~F.col("geral")).alias("geral"), F.when(F.col("key") % 7 == 0, "remover").otherwise("salvar").alias("acao"))
    return alerts.upsert(current, incoming, views.now()).select("key", "geral", "c", "n")


_HOSTS = ["fcm.googleapis.com", "updates.push.services.mozilla.com", "web.push.apple.com", "evil.example.org", "fcm.googleapis.com:8443", "db5.notify.windows.com", "user@fcm.googleapis.com"]


@query(
    "f21_clean_preferences",
    f"""WITH raw AS (SELECT c_custkey AS key, CASE WHEN c_custkey % 9 = 0 THEN 'http' ELSE 'https' END || '://' || ['{"', '".join(_HOSTS)}'][c_custkey % 7 + 1] || '/send/' || c_custkey AS e, c_custkey % 4 = 0 AS geral,
      CASE WHEN c_mktsegment = 'BUILDING' THEN ['alpha', 'alpha', 'Not A Slug', 'beta'] ELSE []::VARCHAR[] END AS temas, CASE WHEN c_nationkey < 6 THEN ['SP', 'XX', 'RJ', 'SP'] ELSE []::VARCHAR[] END AS ufs, c_custkey % 11 = 0 AS checagens,
      CASE c_custkey % 3 WHEN 0 THEN 'importantes' WHEN 1 THEN 'top' ELSE 'other' END AS nivel, CASE WHEN c_custkey % 8 <> 0 THEN c_custkey % 10 - 2 END AS mx FROM customer),
    cl AS (SELECT key, geral, checagens, CASE WHEN len(temas) > 0 THEN 'alpha,beta' ELSE '' END AS temas, CASE WHEN len(ufs) > 0 THEN 'SP,RJ' ELSE '' END AS ufs, CASE WHEN nivel = 'other' THEN 'top' ELSE nivel END AS nivel,
      least(5, greatest(1, CASE WHEN coalesce(mx, 0) = 0 THEN 3 ELSE mx END)) AS max FROM raw WHERE e LIKE 'https%' AND key % 7 IN (0, 1, 2, 5))
    SELECT * FROM cl WHERE geral OR checagens OR temas <> '' OR ufs <> ''""",
)
def f21(spark, sf):
    c = table(spark, sf, "customer")
    k = F.col("c_custkey")
    none = F.array().cast("array<string>")
    host = F.array(*[F.lit(h) for h in _HOSTS])[(k % 7).cast("int")]
    raw = c.select(
        k.alias("key"), F.concat(F.when(k % 9 == 0, "http").otherwise("https"), F.lit("://"), host, F.lit("/send/"), k.cast("string")).alias("e"), (k % 4 == 0).alias("geral"),
        F.when(F.col("c_mktsegment") == "BUILDING", F.array(*[F.lit(x) for x in ("alpha", "alpha", "Not A Slug", "beta")])).otherwise(none).alias("temas"),
        F.when(F.col("c_nationkey") < 6, F.array(*[F.lit(x) for x in ("SP", "XX", "RJ", "SP")])).otherwise(none).alias("ufs"), none.alias("pessoas"), (k % 11 == 0).alias("checagens"),
        F.array(F.lit("importantes"), F.lit("top"), F.lit("other"))[(k % 3).cast("int")].alias("nivel"), F.when(k % 8 != 0, k % 10 - 2).alias("max"),
    )
    out = alerts.clean_preferences(raw)
    return out.select("key", "geral", "checagens", F.array_join("temas", ",").alias("temas"), F.array_join("ufs", ",").alias("ufs"), "nivel", F.col("max").cast("bigint").alias("max"))
