"""Raw feed payloads (RSS 2.0, RSS 1.0, Atom, news sitemaps) to entries.

A payload table has ``source``, ``payload_id`` and ``body``; parsing is ``from_xml`` with one explicit schema.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pressloom.functions import dates, text, urls
from pressloom.functions import fixed_values as fv

_TEXTS = "array<string>"
_LINKS = "array<struct<_VALUE: string, _href: string, _rel: string>>"
_ITEM = (
    f"array<struct<title: {_TEXTS}, link: {_LINKS}, description: {_TEXTS}, summary: {_TEXTS}, content: {_TEXTS}, "
    f"pubDate: {_TEXTS}, published: {_TEXTS}, updated: {_TEXTS}, date: {_TEXTS}>>"
)
FEED_SCHEMA = f"channel struct<item: {_ITEM}>, item {_ITEM}, entry {_ITEM}"
SITEMAP_SCHEMA = (
    "url array<struct<loc: string, lastmod: string, news: struct<title: string, publication_date: string>>>"
)
_OPTIONS = {"mode": "PERMISSIVE"}


def prepared(body: Column) -> Column:
    """Null for bodies that declare entities; control characters out, bare ampersands escaped."""
    visible = F.regexp_replace(body, "[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f]", "")
    escaped = F.regexp_replace(visible, r"&(?!(?:amp|lt|gt|quot|apos|#\d+|#x[0-9a-fA-F]+);)", "&amp;")
    return F.when(~body.rlike("(?i)<!ENTITY"), escaped)


def _local_names(body: Column) -> Column:
    """Drop namespace prefixes, which differ from feed to feed, and settle on one spelling of the date tag."""
    outside = F.regexp_replace(body, r"<(/?)(?:dc|atom|content|rss|rdf|a10|dcterms):([A-Za-z])", "<$1$2")
    return F.regexp_replace(outside, r"(?i)<(/?)pubdate\b", "<$1pubDate")


def is_sitemap(body: Column) -> Column:
    """The root element decides."""
    return body.rlike(r"(?s)^﻿?\s*(?:<\?.*?\?>\s*|<!--.*?-->\s*|<!DOCTYPE[^>]*>\s*)*<(?:[A-Za-z0-9]+:)?urlset\b")


def _first_text(*fields: Column) -> Column:
    stripped = [F.filter(F.transform(f, lambda x: F.trim(x)), lambda x: x != "") for f in fields]
    return F.coalesce(*[F.try_element_at(s, F.lit(1)) for s in stripped], F.lit(""))


def _entry(title: Column, url: Column, desc: Column, published: Column) -> list[Column]:
    u = F.trim(F.coalesce(url, F.lit("")))
    return [
        title.alias("title"),
        F.when(urls.is_admissible(u), u).otherwise(F.lit("")).alias("url"),
        desc.alias("desc"),
        published.alias("published"),
    ]


def feed_entries(payloads: DataFrame) -> DataFrame:
    """RSS and Atom bodies to ``(source, payload_id, pos, title, url, desc, published)``."""
    parsed = payloads.select(
        "source", "payload_id", F.from_xml(_local_names(prepared(F.col("body"))), FEED_SCHEMA, _OPTIONS).alias("x")
    )
    empty = F.array().cast(_ITEM)
    items = parsed.select(
        "source",
        "payload_id",
        F.posexplode(
            F.concat(
                F.coalesce(F.col("x.channel.item"), empty), F.coalesce(F.col("x.item"), empty), F.coalesce(F.col("x.entry"), empty)
            )
        ).alias("pos", "i"),
    )
    links = F.col("i.link")
    plain = F.filter(F.transform(links, lambda x: F.trim(F.coalesce(x["_VALUE"], F.lit("")))), lambda v: v != "")
    alternate = F.filter(
        links, lambda x: (F.coalesce(x["_href"], F.lit("")) != "") & (F.coalesce(x["_rel"], F.lit("alternate")) == "alternate")
    )
    url = F.coalesce(F.try_element_at(plain, F.lit(1)), F.try_element_at(alternate, F.lit(1))["_href"], F.lit(""))
    raw = items.select(
        "source",
        "payload_id",
        "pos",
        text.short(text.clean(_first_text(F.col("i.title"))), fv.MAX_TITLE).alias("title"),
        url.alias("url"),
        text.clean(_first_text(F.col("i.description"), F.col("i.summary"), F.col("i.content"))).alias("desc"),
        dates.parse_mixed(
            _first_text(F.col("i.pubDate"), F.col("i.published"), F.col("i.updated"), F.col("i.date"))
        ).alias("published"),
    )
    desc = text.short(text.blank_if_repeats(F.col("desc"), F.col("title")))
    return raw.select("source", "payload_id", "pos", *_entry(F.col("title"), F.col("url"), desc, F.col("published")))


def sitemap_entries(payloads: DataFrame) -> DataFrame:
    """News sitemaps to entries without description; rows without a news title are dropped."""
    parsed = payloads.select(
        "source",
        "payload_id",
        F.from_xml(
            F.regexp_replace(prepared(F.col("body")), r"<(/?)news:(title|publication_date|news)\b", "<$1$2"), SITEMAP_SCHEMA, _OPTIONS
        ).alias("x"),
    )
    rows = parsed.select("source", "payload_id", F.posexplode("x.url").alias("pos", "u"))
    published = F.coalesce(dates.parse_mixed(F.col("u.news.publication_date")), dates.parse_mixed(F.col("u.lastmod")))
    raw = rows.select(
        "source",
        "payload_id",
        "pos",
        text.short(text.clean(F.col("u.news.title")), fv.MAX_TITLE).alias("title"),
        F.col("u.loc").alias("url"),
        published.alias("published"),
    )
    out = raw.select("source", "payload_id", "pos", *_entry(F.col("title"), F.col("url"), F.lit(""), F.col("published")))
    return out.where(F.col("title") != "")


def entries(payloads: DataFrame) -> DataFrame:
    """Any payload: the root element routes it to the feed or the sitemap branch."""
    flag = F.coalesce(is_sitemap(F.col("body")), F.lit(False))
    return feed_entries(payloads.where(~flag)).unionByName(sitemap_entries(payloads.where(flag)))
