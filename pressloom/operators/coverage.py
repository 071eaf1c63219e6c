"""How widely stories are covered: counts, scoreboards, story digests, external groupings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pressloom.functions import dates, urls
from pressloom.operators import growing
from pressloom.operators.leaders import LOOSE, STRICT, similar_leaders
from pressloom.operators.ranking import top_per_group


def group_stories(items: DataFrame, tokens: Column, grow: bool = False, **options) -> DataFrame:
    """``items`` with ``story`` (id of its newest headline); headlines with too few words are left out.

    ``grow``: a story is compared by the words of all its headlines so far, otherwise by those of its newest alone.
    """
    told = items.select("id", F.col("published").alias("ts"), tokens.alias("tokens"))
    links = growing.growing_groups(told, growing.LOOSE) if grow else similar_leaders(told, LOOSE, **options)
    return items.join(links.select("id", F.col("leader").alias("story")), "id")


def number_stories(items: DataFrame, tokens: Column, grow: bool = False, **options) -> DataFrame:
    """``items`` with ``gid``, the strict story used to hide repeats; headlines with too few words stay alone.

    ``grow``: as in ``group_stories``; then a headline also joins only one of the stories opened last.
    """
    told = items.select("id", F.col("published").alias("ts"), tokens.alias("tokens"))
    links = growing.growing_groups(told, growing.STRICT) if grow else similar_leaders(told, STRICT, **options)
    joined = items.join(links.select("id", F.col("leader").alias("gid")), "id", "left")
    return joined.withColumn("gid", F.coalesce("gid", "id"))


def story_coverage(members: DataFrame, names: DataFrame, min_sources: int = 2) -> DataFrame:
    """Per story: outlets, size, lead and outlet names; one aggregation per (story, source) first, so big stories combine early."""
    per_source = members.groupBy("story", "source").agg(F.count(F.lit(1)).alias("n"), F.max(_newest()).alias("newest"))
    named = per_source.join(names.select(F.col("id").alias("source"), "name"), "source", "left").withColumn(
        "name", F.coalesce("name", "source")
    )
    return (
        named.groupBy("story")
        .agg(
            F.count(F.lit(1)).alias("outlets"),
            F.sum("n").alias("size"),
            F.max("newest").alias("lead"),
            F.array_sort(F.collect_set("name")).alias("names"),
        )
        .where(F.col("outlets") >= min_sources)
        .select("story", "outlets", "size", F.col("lead.row.id").alias("lead_id"), F.col("lead.row.title").alias("lead_title"),
                F.col("lead.published").alias("lead_published"), "names")
    )


def _newest() -> Column:
    """Comparable by time, then by smaller id (ids are hexadecimal, so the complement sorts the other way round)."""
    return F.struct(
        "published", F.translate(F.col("id"), "0123456789abcdef", "fedcba9876543210").alias("tie"), F.struct("id", "title", "url", "source").alias("row")
    )


def newest_first() -> list[Column]:
    return [F.col("published").desc(), F.col("id").asc()]


def per_outlet(members: DataFrame, key: str = "story", cap: int = 6) -> DataFrame:
    """The newest headline of each outlet in each story, at most ``cap`` outlets, with its position."""
    newest = members.groupBy(key, "source").agg(F.max(_newest()).alias("m"))
    flat = newest.select(key, "source", F.col("m.row.id").alias("id"), F.col("m.row.title").alias("title"), F.col("m.published").alias("published"))
    return top_per_group(flat, [key], newest_first(), cap, rank="pos")


def also_in(members: DataFrame, names: DataFrame) -> DataFrame:
    """Per article: the other outlets of its story. Outlet lists are built once per story, not per article."""
    named = names.select(F.col("id").alias("source"), "name")
    outlets = (
        members.select("story", "source")
        .distinct()
        .join(named, "source", "left")
        .groupBy("story")
        .agg(F.collect_set(F.struct("source", F.coalesce("name", "source").alias("name"))).alias("outlets"))
        .where(F.size("outlets") > 1)
    )
    others = F.array_sort(
        F.array_distinct(F.transform(F.filter("outlets", lambda o: o["source"] != F.col("source")), lambda o: o["name"]))
    )
    return members.join(outlets, "story").select("id", "story", others.alias("also"))


def count_by(df: DataFrame, key: str, keys: DataFrame | None = None) -> DataFrame:
    """Rows per key; with ``keys`` every listed key appears, also with zero."""
    counts = df.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    if keys is None:
        return counts
    return keys.select(key).join(counts, key, "left").fillna(0, ["n"])


def count_listed(df: DataFrame, array: str, name: str, keys: DataFrame) -> DataFrame:
    """Rows per element of an array column, zeros included."""
    return count_by(df.select(F.explode(array).alias(name)), name, keys)


def state_totals(df: DataFrame, states: DataFrame) -> DataFrame:
    """``states``: uf, nome, regiao. Headlines per state and region, states without any included."""
    counts = df.select(F.explode("ufs").alias("uf")).groupBy("uf").agg(F.count(F.lit(1)).alias("n"))
    return states.join(counts, "uf", "left").fillna(0, ["n"]).select("regiao", "uf", "nome", "n")


def source_report(sources: DataFrame, articles: DataFrame) -> DataFrame:
    """Sources by group (and state for regional ones) with their number of articles, silent sources included."""
    counts = articles.groupBy(F.col("source").alias("id")).agg(F.count(F.lit(1)).alias("n"))
    section = F.when(F.col("grupo") == "regional", F.col("uf")).otherwise(F.col("grupo"))
    return (
        sources.select("id", "grupo", "uf")
        .join(counts, "id", "left")
        .fillna(0, ["n"])
        .groupBy(F.coalesce("grupo", F.lit("nacional")).alias("grupo"), section.alias("section"))
        .agg(F.array_sort(F.collect_list(F.struct("id", "n"))).alias("rows"), F.sum("n").alias("n"))
    )


def scoreboard(articles: DataFrame, people: DataFrame, now: Column, board: list[str] | None = None) -> DataFrame:
    """Appearances per person: titles and outlets in 24 hours and in the window, mentions, percent of the leader.

    ``articles``: source, published, pessoas_t, pessoas. ``people``: id, nome. Counts combine per (person, source) first.
    """
    recent = dates.age_hours(F.col("published"), now) < 24
    rows = articles.select("source", recent.alias("recent"), F.explode(F.array_union("pessoas", "pessoas_t")).alias("id"), "pessoas_t", "pessoas")
    in_title = F.array_contains("pessoas_t", F.col("id"))
    per_source = rows.groupBy("id", "source").agg(
        F.count_if(in_title & F.col("recent")).alias("t24"),
        F.count_if(in_title).alias("t7"),
        F.count_if(F.array_contains("pessoas", F.col("id"))).alias("all"),
    )
    counts = per_source.groupBy("id").agg(
        F.sum("t24").alias("n24"),
        F.count_if(F.col("t24") > 0).alias("v24"),
        F.sum("t7").alias("n7"),
        F.count_if(F.col("t7") > 0).alias("v7"),
        F.sum("all").alias("total"),
    )
    full = people.join(counts, "id", "left").fillna(0, ["n24", "v24", "n7", "v7", "total"])
    on_board = F.col("id").isin(*board) if board else F.lit(True)
    top = full.where(on_board).agg(F.greatest(F.max("n24"), F.lit(1)).alias("top"))
    return (
        full.crossJoin(F.broadcast(top))  # one row
        .withColumn("pct", F.when(on_board, F.bround(100 * F.col("n24") / F.col("top"), 0).cast("int")))
        .drop("top")
        .orderBy(F.col("n24").desc(), F.col("n7").desc(), F.col("nome"))
    )


def story_digests(
    members: DataFrame, now: Column, fresh_hours: int = 6, max_stories: int = 40, min_sources: int = 2
) -> DataFrame:
    """Alert digests of the most covered fresh stories.

    ``members``: story, id, title, url, source, source_name, published, topics, ufs_txt, uf_fonte, pessoas_t. A state
    counts when two texts name it, or when two regional outlets, half of the story, come from it; a person when two
    titles, a third of the story, name them.
    """
    summary = members.groupBy("story").agg(
        F.count(F.lit(1)).alias("size"),
        F.count_distinct("source").alias("n"),
        F.min_by("url", F.struct("published", "id")).alias("first_url"),
        F.max_by(F.struct("title", "url", "source_name", "published"), F.struct("published", F.translate("id", "0123456789abcdef", "fedcba9876543210"))).alias("lead"),
    )
    chosen = (
        summary.where(F.col("n") >= min_sources)
        .orderBy(F.col("n").desc(), F.col("size").desc(), F.col("lead.published").desc(), "story")
        .limit(max_stories)
        .where(dates.age_hours(F.col("lead.published"), now) <= fresh_hours)
    )
    votes = (
        members.select("story", F.explode(_votes()).alias("v"))
        .groupBy("story", "v.kind", "v.name")
        .agg(F.count(F.lit(1)).alias("c"))
        .join(F.broadcast(chosen.select("story", "size")), "story")  # at most max_stories rows
        .where(
            (F.col("kind") == "topic")
            | ((F.col("kind") == "state") & (F.col("c") >= 2))
            | ((F.col("kind") == "outlet") & (F.col("c") >= 2) & (F.col("c") * 2 >= F.col("size")))
            | ((F.col("kind") == "person") & (F.col("c") >= 2) & (F.col("c") * 3 >= F.col("size")))
        )
        .groupBy("story")
        .agg(
            _names(F.col("kind") == "topic").alias("temas"),
            _names(F.col("kind").isin("state", "outlet")).alias("ufs"),
            _names(F.col("kind") == "person").alias("pessoas"),
        )
    )
    none = F.array().cast("array<string>")
    return chosen.join(votes, "story", "left").select(
        urls.url_id(F.col("first_url")).alias("id"),
        F.col("lead.title").alias("t"),
        F.col("lead.url").alias("u"),
        F.col("lead.source_name").alias("f"),
        "n",
        *[F.coalesce(F.col(c), none).alias(c) for c in ("temas", "ufs", "pessoas")],
        F.lit("assunto").alias("k"),
        F.unix_seconds(F.col("lead.published")).alias("p"),
    )


def _votes() -> Column:
    def of(kind: str, values: Column) -> Column:
        return F.transform(F.coalesce(values, F.array().cast("array<string>")), lambda v: F.struct(F.lit(kind).alias("kind"), v.alias("name")))

    outlet = F.when(F.coalesce("uf_fonte", F.lit("")) != "", F.array("uf_fonte"))
    return F.concat(of("topic", F.col("topics")), of("state", F.col("ufs_txt")), of("outlet", outlet), of("person", F.col("pessoas_t")))


def _names(condition: Column) -> Column:
    return F.array_sort(F.collect_set(F.when(condition, F.col("name"))))


def alert_digests(alerts: DataFrame) -> DataFrame:
    none = F.array().cast("array<string>")
    return alerts.select(
        urls.url_id(F.col("url")).alias("id"), F.col("title").alias("t"), F.col("url").alias("u"), F.col("source_name").alias("f"),
        F.lit(1).cast("bigint").alias("n"), none.alias("temas"), none.alias("ufs"), none.alias("pessoas"), F.lit("checagem").alias("k"),
        F.unix_seconds("published").alias("p"),
    )


def external_stories(
    grouping: DataFrame, articles: DataFrame, now: Column, limit: int = 5, valid_hours: int = 36, min_stories: int = 3
) -> DataFrame:
    """Stories grouped elsewhere, matched to live articles.

    ``grouping``: gerado, pos, titulo, resumo, id, one row for each article of a story. A story needs two outlets; the whole grouping is
    used only while younger than ``valid_hours`` and if ``min_stories`` of its stories survive.
    """
    live = grouping.where(dates.age_hours(F.col("gerado"), now) <= valid_hours)
    stories = live.select("pos", "titulo", "resumo", "id").distinct()
    matched = stories.join(articles.select("id", "title", "url", "source", "source_name", "published"), "id")
    summary = (
        matched.groupBy("pos", "titulo", "resumo")
        .agg(
            F.count_distinct("source_name").alias("n"),
            F.count(F.lit(1)).alias("size"),
            F.array_sort(F.collect_set("source_name")).alias("names"),
            F.max(_newest()).alias("lead"),
        )
        .where(F.col("n") >= 2)
    )
    survivors = summary.agg(F.count(F.lit(1)).alias("survivors"))
    return (
        summary.crossJoin(F.broadcast(survivors))  # one row
        .where(F.col("survivors") >= min_stories)
        .orderBy(F.col("n").desc(), F.col("lead.published").desc(), "pos")
        .limit(limit)
        .select("pos", "titulo", "resumo", "n", "size", "names", F.col("lead.row.id").alias("lead_id"), F.col("lead.published").alias("lead_published"))
    )


def external_members(grouping: DataFrame, articles: DataFrame) -> DataFrame:
    """(pos, id) of the live articles of each external story."""
    return grouping.select("pos", "id").distinct().join(articles.select("id"), "id")


def overlay_stories(external: DataFrame, external_ids: DataFrame, word_stories: DataFrame, word_members: DataFrame, limit: int = 40) -> DataFrame:
    """External stories first; word-based stories follow if they share no article with one of them.

    ``external``: pos, n, lead_id, lead_published. ``word_stories``: story, outlets, size, lead_id, lead_published. The
    ``limit`` best word stories are considered; with external stories present the result stops at ``limit`` rows.
    """
    best = word_stories.orderBy(F.col("outlets").desc(), F.col("size").desc(), F.col("lead_published").desc(), "story").limit(limit)
    shared = word_members.join(external_ids.select("id").distinct(), "id", "left_semi").select("story").distinct()
    free = best.join(shared, "story", "left_anti")
    first = external.select(F.lit(0).alias("part"), F.col("pos").cast("string").alias("key"), "n", F.lit(0).cast("bigint").alias("size"), "lead_id", "lead_published")
    second = free.select(F.lit(1).alias("part"), F.col("story").alias("key"), F.col("outlets").alias("n"), "size", "lead_id", "lead_published")
    return first.unionByName(second).orderBy("part", F.col("n").desc(), F.col("size").desc(), F.col("lead_published").desc(), "key").limit(limit)


def numbered_candidates(articles: DataFrame, now: Column, hours: int = 30, limit: int = 900) -> DataFrame:
    """The newest recent headlines as numbered lines for an external grouper."""
    recent = articles.where(dates.age_hours(F.col("published"), now) < hours)
    ranked = top_per_group(recent, [], newest_first(), limit, rank="num")
    title = F.substring(F.trim(F.regexp_replace("title", r"[|\r\n]+", " ")), 1, 120)
    return ranked.select("num", "id", "source", F.concat_ws("|", F.col("num").cast("string"), "source_name", title).alias("line"))


def first_use_wins(proposals: DataFrame, candidates: DataFrame, min_sources: int = 2) -> DataFrame:
    """External answers checked: known numbers only, each number in the first story that uses it, two outlets per story.

    ``proposals``: topic_pos, pos, num, titulo. ``candidates``: num, id, source.
    """
    known = proposals.join(candidates.select("num", "id", "source"), "num")
    first = known.groupBy("num").agg(F.min_by(F.struct("topic_pos", "pos", "titulo", "id", "source"), F.struct("topic_pos", "pos")).alias("f"))
    used = first.select("num", "f.*")
    valid = used.groupBy("topic_pos").agg(F.count_distinct("source").alias("outlets")).where((F.col("outlets") >= min_sources))
    return used.where(F.trim("titulo") != "").join(valid, "topic_pos")
