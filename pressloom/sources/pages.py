"""Crawled pages: article text, metadata, feed links. Everything happens inside the row, without a shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pressloom.functions import fixed_values as fv
from pressloom.functions import text, urls
from pressloom.operators.ranking import top_per_group

_SKIPPED = "script|style|noscript|svg|template|iframe|textarea|figure|figcaption|nav|aside|footer|form|button|select"
_BLOCKS = "div|ul|ol|table|section|article|main|h[1-6]|blockquote|pre|header|dl|fieldset|address|body|html"


def paragraphs(html: Column) -> Column:
    """Plain paragraphs of at least 40 characters, at most half of them links, in page order."""
    body = F.regexp_replace(html, r"(?s)<!--.*?-->", " ")
    body = F.regexp_replace(body, rf"(?is)<({_SKIPPED})\b[^>]*>.*?</\1\s*>", " ")
    raw = F.regexp_extract_all(body, F.lit(rf"(?is)<p\b[^>]*>(.*?)(?=</p\b|<p\b|</?(?:{_BLOCKS})\b|\z)"), F.lit(1))

    def plain(fragment: Column) -> Column:
        return text.clean(fragment)

    def linked(fragment: Column) -> Column:
        return F.length(plain(F.array_join(F.regexp_extract_all(fragment, F.lit(r"(?is)<a\b[^>]*>(.*?)</a\s*>"), F.lit(1)), " ")))

    measured = F.transform(raw, lambda r: F.struct(plain(r).alias("t"), linked(r).alias("l")))
    good = F.filter(measured, lambda m: (F.length(m["t"]) >= fv.MIN_PARAGRAPH) & (m["l"] <= F.length(m["t"]) * fv.MAX_LINK_SHARE))
    return F.transform(good, lambda m: m["t"])


def joined_text(parts: Column) -> Column:
    """Calls to action, captions and repeats out, stop at an end marker, drop an unpunctuated tail, cap the length."""

    def step(acc: Column, p: Column) -> Column:
        head = F.trim(text.fold_retrieval(F.substring(p, 1, 60)))
        ends = (acc["n"] >= 300) & (head.rlike(fv.ARTICLE_END) | F.startswith(p, F.lit("©")))
        tail = text.fold_retrieval(F.substring(p, F.greatest(F.length(p) - 129, F.lit(1)), F.lit(130)))
        caption = (F.length(p) < 400) & (((F.length(p) < 160) & head.rlike(fv.CAPTION_START)) | tail.rlike(fv.CAPTION_END))
        key = F.substring(p, 1, 100)
        skip = (F.length(p) < 30) | head.rlike(fv.CALL_TO_ACTION) | caption | F.array_contains(acc["keys"], key)
        stopped = acc["stop"] | ends
        take = ~stopped & ~skip
        return F.struct(
            F.when(take, F.array_append(acc["out"], p)).otherwise(acc["out"]).alias("out"),
            F.when(take, F.array_append(acc["keys"], key)).otherwise(acc["keys"]).alias("keys"),
            F.when(take, acc["n"] + F.length(p) + 1).otherwise(acc["n"]).alias("n"),
            (stopped | (take & (acc["n"] + F.length(p) + 1 > fv.MAX_PAGE_TEXT))).alias("stop"),
        )

    none = F.array().cast("array<string>")
    start = F.struct(none.alias("out"), none.alias("keys"), F.lit(0).alias("n"), F.lit(False).alias("stop"))
    kept = F.aggregate(parts, start, step)["out"]
    solid = F.transform(kept, lambda p, i: F.when((F.length(p) >= 120) | p.rlike("[.!?…:;\"”’)»\\]]$"), i + 1).otherwise(1))
    return F.substring(F.array_join(F.slice(kept, F.lit(1), F.greatest(F.coalesce(F.array_max(solid), F.lit(0)), F.lit(0))), "\n"), 1, fv.MAX_PAGE_TEXT)


def page_text(html: Column) -> Column:
    return joined_text(paragraphs(html))


def _meta(html: Column, key: str) -> Column:
    tags = F.regexp_extract_all(html, F.lit(r"(?is)<meta\b[^>]*>"), F.lit(0))
    named = F.filter(tags, lambda t: t.rlike(rf"""(?i)(?:property|name)\s*=\s*["']{key}["']"""))
    value = F.regexp_extract(F.coalesce(F.try_element_at(named, F.lit(1)), F.lit("")), r"""(?is)content\s*=\s*(?:"([^"]*)"|'([^']*)')""", 1)
    other = F.regexp_extract(F.coalesce(F.try_element_at(named, F.lit(1)), F.lit("")), r"""(?is)content\s*=\s*'([^']*)'""", 1)
    return F.nullif(F.coalesce(F.nullif(value, F.lit("")), other), F.lit(""))


def title(html: Column) -> Column:
    tag = F.regexp_extract(html, r"(?is)<title\b[^>]*>(.*?)</title\s*>", 1)
    return text.clean(F.coalesce(_meta(html, "og:title"), F.nullif(tag, F.lit("")), _meta(html, "twitter:title"), F.lit("")))


def description(html: Column) -> Column:
    return text.clean(
        F.coalesce(_meta(html, "og:description"), _meta(html, "description"), _meta(html, "twitter:description"), F.lit(""))
    )


def _bodies_in_tree(tree: Column) -> Column:
    """All ``articleBody`` strings of a parsed JSON value, level by level down to ``MAX_LD_DEPTH``."""

    def children(v: Column) -> Column:
        members = F.map_values(F.try_variant_get(v, "$", "map<string,variant>"))
        return F.coalesce(F.try_variant_get(v, "$", "array<variant>"), members, F.array().cast("array<variant>"))

    def body(v: Column) -> Column:
        own = F.try_variant_get(v, "$.articleBody", "variant")
        return F.when(F.schema_of_variant(own) == "STRING", F.try_variant_get(own, "$", "string"))

    def deeper(acc: Column, level: Column) -> Column:
        found = F.concat(acc["found"], F.array_compact(F.transform(acc["nodes"], body)))
        return F.struct(F.flatten(F.transform(acc["nodes"], children)).alias("nodes"), found.alias("found"))

    start = F.struct(F.array(tree).alias("nodes"), F.array().cast("array<string>").alias("found"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(fv.MAX_LD_DEPTH)), start, deeper, lambda acc: acc["found"])


def _body_by_pattern(block: Column) -> Column:
    """The first ``articleBody`` of a block that is no valid JSON, as for line breaks inside a string."""
    # a lazy dot instead of a repeated group, which would recurse once per character in the regex engine
    raw = F.regexp_extract_all(block, F.lit(r'(?s)"articleBody"\s*:\s*"(.*?(?<!\\)(?:\\\\){0,64})"'), F.lit(1))
    quoted = F.transform(F.slice(raw, 1, 1), lambda b: F.concat(F.lit('["'), F.regexp_replace(F.regexp_replace(b, r"\r?\n", "\\\\n"), "[\\x00-\\x1f]", " "), F.lit('"]')))
    return F.array_compact(F.transform(quoted, lambda q: F.from_json(q, "array<string>")[0]))


def structured_body(html: Column) -> Column:
    """The longest ``articleBody`` of the page's JSON-LD, as clean lines."""
    blocks = F.regexp_extract_all(html, F.lit(r"""(?is)<script\b[^>]*application/ld\+json[^>]*>(.*?)</script\s*>"""), F.lit(1))
    named = F.filter(blocks, lambda b: F.contains(b, F.lit("articleBody")))
    trees = F.transform(named, lambda b: F.struct(b.alias("block"), F.try_parse_json(b).alias("tree")))
    values = F.flatten(F.transform(trees, lambda t: F.when(t["tree"].isNull(), _body_by_pattern(t["block"])).otherwise(_bodies_in_tree(t["tree"]))))
    longest = F.array_max(F.transform(values, lambda v: F.struct(F.length(v).alias("n"), v.alias("v"))))["v"]
    lined = F.regexp_replace(F.coalesce(longest, F.lit("")), r"(?i)</(?:p|div|li|h\d)>|<br\s*/?>", "\n")
    lines = F.filter(F.transform(F.split(lined, r"\n+"), lambda x: text.clean(x)), lambda x: x != "")
    return joined_text(lines)


def chosen_text(from_paragraphs: Column, from_structure: Column) -> tuple[Column, Column]:
    """(text, via): structured data wins only when it has clearly more, and is plausible when lengths differ widely."""
    a, b = F.length(from_paragraphs), F.length(from_structure)
    far_apart = (a > b * 3) | (b > a * 3)
    structured = (b >= fv.MIN_LD_BODY) & (
        (a == 0) | F.when(far_apart, (a < 600) & (b >= 600) & (b <= 12000)).otherwise(b > a * 1.25)
    )
    return F.when(structured, from_structure).otherwise(from_paragraphs), F.when(structured, "json-ld").otherwise("paragrafos")


def extract(pages: DataFrame) -> DataFrame:
    """``pages``: page_id, url, html → title, description, text and where the text came from."""
    read = pages.select(
        "page_id", "url", title(F.col("html")).alias("title"), description(F.col("html")).alias("description"),
        page_text(F.col("html")).alias("__p"), structured_body(F.col("html")).alias("__s"),
    )
    chosen, via = chosen_text(F.col("__p"), F.col("__s"))
    return read.withColumn("text", chosen).withColumn("via", via).drop("__p", "__s")


def absolute(base: Column, href: Column) -> Column:
    """A link as written on a page, resolved against the page's address."""
    origin = F.concat(urls.scheme(base), F.lit("://"), urls.authority(base))
    folder = F.regexp_replace(urls.path(base), "[^/]*$", "")
    folder = F.when(folder == "", "/").otherwise(folder)
    return (
        F.when(href.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), href)
        .when(F.startswith(href, F.lit("//")), F.concat(urls.scheme(base), F.lit(":"), href))
        .when(F.startswith(href, F.lit("/")), F.concat(origin, href))
        .otherwise(F.concat(origin, folder, href))
    )


def feed_links(pages: DataFrame, per_page: tuple[int, int, int] | None = None, per_group: int | None = None) -> DataFrame:
    """Feeds announced by pages, links that look like feeds, sitemaps named by robots files.

    ``pages``: group, page_id, url, html. Each address once per group, announced feeds first.
    A probing budget may limit the announced feeds, links and sitemaps taken from a page, and the addresses of a group; by default all are given.
    """
    html, base = F.col("html"), F.col("url")
    tags = F.regexp_extract_all(html, F.lit(r"(?is)<link\b[^>]*>"), F.lit(0))
    types = "|".join(t.replace("+", r"\+") for t in fv.FEED_LINK_TYPES)
    attr = lambda t, n: F.regexp_extract(t, rf"""(?is)\b{n}\s*=\s*["']([^"']*)["']""", 1)
    announced = F.filter(tags, lambda t: attr(t, "rel").rlike("(?i)alternate") & attr(t, "type").rlike(f"(?i)^(?:{types})$") & (attr(t, "href") != ""))
    alternates = F.transform(announced, lambda t: attr(t, "href"))
    anchors = F.filter(
        F.regexp_extract_all(html, F.lit(r"""(?is)<a\b[^>]*href=["']([^"']+)["']"""), F.lit(1)),
        lambda h: h.rlike(r"(?i)(/rss|/feed|\.xml$|\.rss$|rss\.)") & ~h.rlike("^(?:#|javascript)"),
    )
    sitemaps = F.regexp_extract_all(html, F.lit(r"(?im)^\s*sitemap:\s*(\S+)"), F.lit(1))
    some = lambda links, i: F.slice(F.array_distinct(links), 1, per_page[i]) if per_page else F.array_distinct(links)
    kinds = F.array(
        F.struct(F.lit(0).alias("order"), some(alternates, 0).alias("links")),
        F.struct(F.lit(1).alias("order"), some(anchors, 1).alias("links")),
        F.struct(F.lit(2).alias("order"), some(sitemaps, 2).alias("links")),
    )
    found = (
        pages.select("group", "page_id", base.alias("base"), F.explode(kinds).alias("k"))
        .select("group", "page_id", "base", "k.order", F.posexplode("k.links").alias("pos", "href"))
        .select("group", "page_id", "order", "pos", absolute(F.col("base"), F.col("href")).alias("link"))
    )
    first = found.groupBy("group", "link").agg(F.min(F.struct("page_id", "order", "pos")).alias("f"))
    order = [F.col("f.page_id").asc(), F.col("f.order").asc(), F.col("f.pos").asc(), F.col("link").asc()]
    if per_group is not None:
        first = top_per_group(first, ["group"], order, per_group)
    return first.select("group", "link", "f.page_id", "f.order", "f.pos")
