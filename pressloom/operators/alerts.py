"""Alerts per subscriber: preferences, selection under quotas, delivery ledger."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pressloom.functions import dates, urls
from pressloom.functions import fixed_values as fv
from pressloom.operators.ranking import first_per_group, top_per_group
from pressloom.session import cut_lineage


def valid_endpoint(endpoint: Column) -> Column:
    host = urls.host(endpoint)
    allowed = host.rlike("|".join(f"(?:{p})" for p in fv.PUSH_HOSTS))
    authority = urls.authority(endpoint)
    return (F.length(endpoint) <= 700) & (urls.scheme(endpoint) == "https") & ~authority.contains("@") & ~authority.rlike(":[0-9]+$") & allowed


def clean_preferences(subscriptions: DataFrame, known_topics: list[str] | None = None) -> DataFrame:
    """Allowed endpoints; distinct, valid and capped choices; defaults; rows that choose nothing are dropped.

    ``subscriptions``: e, geral, temas[], ufs[], pessoas[], checagens, nivel, max and any other columns.
    """
    slug = lambda x: x.rlike("^[a-z0-9-]{1,30}$")

    def listed(name: str, ok, cap: int) -> Column:
        return F.slice(F.filter(F.array_distinct(F.coalesce(name, F.array().cast("array<string>"))), ok), 1, cap)

    topic_ok = (lambda x: slug(x) & x.isin(*known_topics)) if known_topics else slug
    states = [c.upper() for c in fv.STATE_CODES]
    rounded = F.round("max").cast("int")
    top = F.when(F.coalesce(rounded, F.lit(0)) == 0, 3).otherwise(rounded)
    out = (
        subscriptions.where(valid_endpoint(F.col("e")))
        .withColumn("geral", F.coalesce("geral", F.lit(False)))
        .withColumn("checagens", F.coalesce("checagens", F.lit(False)))
        .withColumn("temas", listed("temas", topic_ok, 12))
        .withColumn("ufs", listed("ufs", lambda x: x.isin(*states), 27))
        .withColumn("pessoas", listed("pessoas", slug, 12))
        .withColumn("nivel", F.when(F.col("nivel").isin(*fv.ALERT_THRESHOLDS), F.col("nivel")).otherwise("top"))
        .withColumn("max", F.least(F.lit(5), F.greatest(F.lit(1), top)))
    )
    chosen = F.col("geral") | F.col("checagens") | (F.size("temas") > 0) | (F.size("ufs") > 0) | (F.size("pessoas") > 0)
    return out.where(chosen)


def _last(ids: Column) -> Column:
    return F.slice(ids, F.greatest(F.size(ids) - (fv.LEDGER_LENGTH - 1), F.lit(1)), fv.LEDGER_LENGTH)


def _offers(digests: DataFrame) -> DataFrame:
    """What a digest can interest someone by: kind of rule, value, and the points it gives; the highest rule that holds decides."""
    n = F.coalesce("n", F.lit(0))
    check = F.col("k") == "checagem"

    def listed(kind: str, name: str, less: int) -> Column:
        values = F.coalesce(F.array_distinct(F.col(name)), F.array().cast("array<string>"))
        return F.transform(values, lambda v: F.struct(F.lit(kind).alias("kind"), v.alias("value"), (n - less).alias("points")))

    def single(kind: str, points: Column) -> Column:
        return F.array(F.struct(F.lit(kind).alias("kind"), F.lit("").alias("value"), points.alias("points")))

    story = F.concat(single("geral", n), listed("tema", "temas", 1), listed("pessoa", "pessoas", 1), listed("uf", "ufs", 2))
    offers = F.when(F.coalesce(check, F.lit(False)), single("checagem", F.greatest(n, F.lit(1)) + 100)).otherwise(story)
    offered = digests.withColumn("offers", offers).select("pos", "id", "u", n.alias("n"), F.coalesce("p", F.lit(0)).alias("p"), "offers")
    return offered.select("pos", "id", "u", "n", "p", F.explode("offers").alias("o")).select("pos", "id", "u", "n", "p", "o.*")


def _wishes(subscribers: DataFrame) -> DataFrame:
    """key, kind, value and the coverage from which that rule holds for the subscriber."""

    def least(kind: str) -> Column:
        return F.when(F.col("nivel") == "importantes", fv.ALERT_THRESHOLDS["importantes"][kind]).otherwise(fv.ALERT_THRESHOLDS["top"][kind])

    def listed(kind: str, name: str, least_n: Column) -> Column:
        values = F.coalesce(F.array_distinct(F.col(name)), F.array().cast("array<string>"))
        return F.transform(values, lambda v: F.struct(F.lit(kind).alias("kind"), v.alias("value"), least_n.alias("least")))

    def single(kind: str, wanted: Column, least_n: Column) -> Column:
        one = F.array(F.struct(F.lit(kind).alias("kind"), F.lit("").alias("value"), least_n.cast("int").alias("least")))
        return F.when(wanted, one).otherwise(F.slice(one, 1, 0))

    wishes = F.concat(
        single("geral", F.col("geral"), least("geral")), single("checagem", F.col("checagens"), F.lit(0)), listed("tema", "temas", least("tema")),
        listed("pessoa", "pessoas", least("tema")), listed("uf", "ufs", least("uf")),
    )
    return subscribers.withColumn("wishes", wishes).select("key", F.explode("wishes").alias("w")).select("key", "w.*")


def select(subscribers: DataFrame, digests: DataFrame, now: Column, per_run: int = fv.ALERTS_PER_RUN) -> DataFrame:
    """What each subscriber gets in this run (``enviar``) and the state after a full delivery (``s``, ``d``, ``n``).

    ``subscribers``: key, the preference columns, s (null on first sight), d, n. Digests and wishes meet by an equi join on the
    kind of rule and its value; what the ledger holds is taken off, and the best few of each subscriber are left. Any number of digests will do.
    Ledgers grow with the subscribers times their length, which the size of the subscribers' file does not show: they are merged, never broadcast.
    """
    digests = cut_lineage(digests)  # read three times, and small beside the wishes: their files tell the planner
    today, hour = dates.local_day(now), dates.local_hour(now)
    first_sight = F.col("s").isNull()
    sent_today = F.when(F.col("d") == today, F.coalesce("n", F.lit(0))).otherwise(0)
    awake = (hour >= fv.ALERT_HOUR_START) & (hour < fv.ALERT_HOUR_END)
    room = F.least(F.lit(per_run), F.col("max") - sent_today)
    due = subscribers.where(~first_sight & awake & (room > 0))
    met = _offers(digests).join(_wishes(due), ["kind", "value"]).where((F.col("n") >= F.col("least")) & (F.col("points") > 0))
    scored = met.groupBy("key", "pos", "id", "u", "p").agg(F.max("points").alias("points"))
    unseen = scored.join(due.select("key", F.explode("s").alias("id")).hint("merge"), ["key", "id"], "left_anti")
    best = [F.col("points").desc(), F.col("p").desc(), F.col("pos").asc()]
    once = first_per_group(unseen, ["key", "u"], best)
    places = top_per_group(once, ["key"], best, per_run, rank="place")
    chosen = places.groupBy("key").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "id"))), lambda x: x["id"]).alias("best"))
    latest = digests.orderBy(F.col("pos").desc()).limit(fv.LEDGER_LENGTH)
    marks = latest.agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "id"))), lambda x: x["id"]).alias("mark"))
    none = F.array().cast("array<string>")
    return (
        subscribers.join(chosen, "key", "left")
        .crossJoin(F.broadcast(marks))  # one row of at most LEDGER_LENGTH ids
        .withColumn("enviar", F.coalesce(F.slice("best", F.lit(1), F.greatest(room, F.lit(0))), none))
        .withColumn("n_after", F.when(first_sight, 0).otherwise(sent_today + F.size("enviar")))
        .withColumn("s_after", F.when(first_sight, F.col("mark")).otherwise(_last(F.concat("s", "enviar"))))
        .select("key", "enviar", first_sight.alias("primeira"), F.col("s_after").alias("s"), today.alias("d"), F.col("n_after").alias("n"))
    )


def payload(digest: DataFrame) -> DataFrame:
    """Short texts for a notification."""

    def cut(value: Column, n: int) -> Column:
        return F.when(F.length(value) > n, F.concat(F.rtrim(F.substring(value, 1, n - 1)), F.lit("…"))).otherwise(value)

    title = (
        F.when(F.col("k") == "checagem", "Checagem: pode ser falso")
        .when(F.col("n") >= 2, F.concat(F.lit("Em "), F.col("n").cast("string"), F.lit(" veículos")))
        .otherwise("Notícias")
    )
    return digest.select(
        "id", cut(title, 60).alias("t"), cut(F.col("t"), 180).alias("b"), "u", cut(F.coalesce("f", F.lit("")), 60).alias("f")
    )


def merge_receipts(subscribers: DataFrame, receipts: DataFrame, first_marks: DataFrame, now: Column) -> DataFrame:
    """The ledger after a delivery run.

    ``receipts``: key, pos, id, status (at most a few per subscriber and run). Accepted ids are appended, gone
    subscriptions removed, the counter restarts each local day. ``first_marks``: key and the state of subscribers seen for
    the first time.
    """
    today = dates.local_day(now)
    ok = F.col("status").between(200, 299)
    per_key = receipts.groupBy("key").agg(
        F.bool_or(F.col("status").isin(404, 410)).alias("gone"),
        F.transform(F.array_sort(F.collect_list(F.when(ok, F.struct("pos", "id")))), lambda x: x["id"]).alias("accepted"),
    )
    marks = first_marks.select("key", F.col("s").alias("mark"), F.col("d").alias("mark_d"))
    merged = subscribers.join(per_key, "key", "left").join(marks, "key", "left").where(~F.coalesce("gone", F.lit(False)))
    none = F.array().cast("array<string>")
    accepted = F.coalesce("accepted", none)
    delivered = F.size(accepted) > 0
    first = F.col("s").isNull() & F.col("mark").isNotNull()
    before = F.when(F.col("d") == today, F.coalesce("n", F.lit(0))).otherwise(0)
    return (
        merged.withColumn("__s", F.when(delivered, _last(F.concat(F.coalesce("s", none), accepted))).when(first, F.col("mark")).otherwise(F.col("s")))
        .withColumn("__n", F.when(delivered, before + F.size(accepted)).when(first, F.lit(0)).otherwise(F.col("n")))
        .withColumn("__d", F.when(delivered, today).when(first, F.col("mark_d")).otherwise(F.col("d")))
        .drop("s", "d", "n", "gone", "accepted", "mark", "mark_d")
        .withColumnsRenamed({"__s": "s", "__d": "d", "__n": "n"})
    )


def upsert(current: DataFrame, incoming: DataFrame, now: Column) -> DataFrame:
    """New preferences over the old row, which keeps its creation day and its ledger; removals leave.

    ``incoming``: key, acao and the preference columns, one row per key.
    """
    prefs = [c for c in incoming.columns if c not in ("key", "acao")]
    new = incoming.select("key", "acao", F.struct(*prefs).alias("new"))
    kept = [c for c in current.columns if c not in ("key", *prefs)]
    joined = current.withColumn("known", F.lit(True)).join(new, "key", "full").where(F.coalesce("acao", F.lit("salvar")) != "remover")
    chosen = [F.when(F.col("new").isNotNull(), F.col(f"new.{c}")).otherwise(F.col(c)).alias(c) for c in prefs]
    created = F.coalesce("c", F.date_format(now, "yyyy-MM-dd")).alias("c")
    return joined.select("key", *chosen, *[created if c == "c" else F.col(c) for c in kept])
