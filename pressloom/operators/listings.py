"""Published views: serving columns, collapsed and paged listings, exports."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from pressloom.functions import dates, text, urls
from pressloom.functions import fixed_values as fv
from pressloom.operators.coverage import newest_first
from pressloom.operators.ranking import top_per_group

VIEW_PAGES = {"home": 15, "estado": 8, "pessoa": 5, "fonte": 3, "tema": 5, "dia": 8}
_WEEKDAYS = ["Segunda", "Terça", "Quarta", "Quinta", "Sexta", "Sábado", "Domingo"]
_MONTHS = ["janeiro", "fevereiro", "março", "abril", "maio", "junho", "julho", "agosto", "setembro", "outubro", "novembro", "dezembro"]


def serve(articles: DataFrame, sources: DataFrame, now: Column, blocked: DataFrame | None = None) -> DataFrame:
    """Usable rows with the source's name and group, local time columns and the blocked-host flag."""
    usable = articles.where(urls.is_admissible(F.col("url")) & (F.coalesce("title", F.lit("")) != "") & F.col("published").isNotNull())
    named = usable.drop("grupo").join(
        sources.select(F.col("id").alias("source"), F.col("name").alias("source_name"), "grupo", "uf"), "source", "left"
    )
    local, local_now = dates.local(F.col("published")), dates.local(now)
    gap = F.datediff(local_now, local)
    weekday = F.array(*[F.lit(w) for w in _WEEKDAYS])[F.weekday(local)]
    month = F.array(*[F.lit(m) for m in _MONTHS])[F.month(local) - 1]
    out = (
        named.withColumn("source_name", F.coalesce("source_name", "source"))
        .withColumn("grupo", F.coalesce("grupo", F.lit("nacional")))
        .withColumn("day", F.date_format(local, "yyyy-MM-dd"))
        .withColumn(
            "day_label",
            F.when(gap == 0, "Hoje").when(gap == 1, "Ontem").otherwise(
                F.concat(weekday, F.lit(", "), F.dayofmonth(local).cast("string"), F.lit(" de "), month)
            ),
        )
        .withColumn("hm", F.date_format(local, "HH:mm"))
        .withColumn("time_label", F.when(gap == 0, F.date_format(local, "HH:mm")).otherwise(F.date_format(local, "dd/MM HH:mm")))
        .withColumn("host", urls.bare_host(F.col("url")))
    )
    return flag_blocked(out, blocked)


def flag_blocked(df: DataFrame, blocked: DataFrame | None) -> DataFrame:
    """``bloq``: does the row's host refuse automatic reading? ``blocked`` has one row per host."""
    if blocked is None:
        return df.withColumn("bloq", F.lit(False))
    flags = blocked.select("host", F.lit(True).alias("bloq")).distinct()
    return df.join(flags, "host", "left").withColumn("bloq", F.coalesce("bloq", F.lit(False)))


def collapse(rows: DataFrame, keys: list[str], gid: str = "gid") -> DataFrame:
    """The newest row of each story per listing, with the number of rows it hides; rows without story stay.

    The hidden rows are ``hidden_rows``; they are not packed into one array, whose size no one could bound.
    """
    alone = F.coalesce(F.col(gid), F.concat(F.lit("id:"), F.col("id")))
    order = F.struct("published", F.translate(F.col("id"), "0123456789abcdef", "fedcba9876543210"))
    value = F.struct(*[c for c in rows.columns if c not in keys])
    leads = (
        rows.withColumn("__story", alone)
        .groupBy(*keys, "__story")
        .agg(F.max_by(value, order).alias("lead"), (F.count(F.lit(1)) - 1).alias("more"))
    )
    return leads.select(*keys, "lead.*", "more")


def hidden_rows(rows: DataFrame, collapsed: DataFrame, keys: list[str], gid: str = "gid") -> DataFrame:
    """(keys, lead, id) of every row that stands behind a collapsed one."""
    leads = collapsed.where(F.col("more") > 0).select(*keys, gid, F.col("id").alias("lead"))
    return rows.join(leads, [*keys, gid]).where(F.col("id") != F.col("lead")).select(*keys, "lead", "id")


def view_memberships(enriched: DataFrame) -> DataFrame:
    """Long table (view, key, article): national news, states, people, sources, topics and days."""
    news = enriched.where(F.col("kind") == "noticia")
    national = news.where(F.col("grupo") != "regional")
    parts = [
        national.withColumn("view", F.lit("home")).withColumn("key", F.lit("")),
        news.withColumn("view", F.lit("estado")).withColumn("key", F.explode("ufs")),
        news.withColumn("view", F.lit("pessoa")).withColumn("key", F.explode("pessoas")),
        enriched.withColumn("view", F.lit("fonte")).withColumn("key", F.col("source")).withColumn("gid", F.lit(None).cast("string")),
        national.withColumn("view", F.lit("tema")).withColumn("key", F.explode("topics")),
        national.withColumn("view", F.lit("dia")).withColumn("key", F.col("day")),
    ]
    columns = ["view", "key", "id", "title", "url", "source", "source_name", "published", "day", "day_label", "gid"]
    return reduce(DataFrame.unionByName, [p.select(*columns) for p in parts])


def paged(rows: DataFrame, keys: list[str], max_pages: int | Column, page_size: int = fv.PAGE_SIZE) -> DataFrame:
    """Page and position of each row, newest first, up to the view's page cap."""
    ranked = top_per_group(rows, keys, newest_first(), max_pages * page_size, rank="rank")
    return (
        ranked.withColumn("page", F.ceil(F.col("rank") / page_size).cast("bigint"))
        .withColumn("pos", (F.pmod(F.col("rank") - 1, F.lit(page_size)) + 1).cast("bigint"))
        .drop("rank")
    )


def listings(enriched: DataFrame, pages: dict[str, int] | None = None, page_size: int = fv.PAGE_SIZE) -> DataFrame:
    """All listings as one long table, to be written partitioned by ``view``. ``enriched`` should be a written table."""
    caps = F.create_map(*[F.lit(x) for view, cap in (pages or VIEW_PAGES).items() for x in (view, cap)])
    rows = collapse(view_memberships(enriched), ["view", "key"])
    return paged(rows, ["view", "key"], caps[F.col("view")], page_size)


def with_day_headers(listed: DataFrame, keys: list[str]) -> DataFrame:
    """``header``: is this the first row of its day label on its page? ``listed`` comes from ``listings``."""
    w = Window.partitionBy(*keys, "page").orderBy("pos")  # at most one page of rows
    return listed.withColumn("header", F.coalesce(F.lag("day_label").over(w) != F.col("day_label"), F.lit(True)))


def search_index(enriched: DataFrame, limit: int = 2500, described: int = 1200) -> DataFrame:
    """The newest rows for search: flags only when true, short descriptions only for the newest of them."""
    ranked = top_per_group(enriched, [], newest_first(), limit, rank="rank")
    flag = lambda c: F.when(c, F.lit(1))
    return ranked.select(
        "rank",
        F.col("title").alias("t"),
        F.col("source_name").alias("s"),
        F.col("source").alias("i"),
        F.col("url").alias("u"),
        F.date_format(dates.local(F.col("published")), "yyyy-MM-dd'T'HH:mm").alias("p"),
        flag(F.col("kind") == "checagem").alias("c"),
        flag(F.col("grupo") == "oficial").alias("o"),
        F.when(F.size("pessoas") > 0, F.col("pessoas")).alias("g"),
        flag(F.col("bloq")).alias("b"),
        F.when((F.col("rank") <= described) & (F.coalesce("desc", F.lit("")) != ""), text.short_description(F.col("desc"), 110)).alias("d"),
    )


def latest(enriched: DataFrame, limit: int = 20) -> DataFrame:
    """The newest national headlines, one per story, with the number of headlines each hides."""
    national = enriched.where((F.col("kind") == "noticia") & (F.col("grupo") != "regional")).withColumn("view", F.lit("home"))
    return collapse(national, ["view"]).orderBy(*newest_first()).limit(limit)


def page_catalogue(enriched: DataFrame) -> DataFrame:
    """One row per published view with the day of its newest headline."""
    return (
        view_memberships(enriched)
        .groupBy("view", "key")
        .agg(F.max("day").alias("last"), F.count(F.lit(1)).alias("n"), F.count_distinct("source").alias("outlets"))
    )


def host_allow_list(sources: DataFrame, articles: DataFrame) -> DataFrame:
    hosts = sources.select(urls.bare_host(F.col("home")).alias("host")).union(articles.select(urls.bare_host(F.col("url"))))
    return hosts.where(F.col("host") != "").distinct()


def new_since(current: DataFrame, previous: DataFrame) -> DataFrame:
    return current.join(previous.select("url"), "url", "left_anti")
