"""Running the service on data: source health, blocked hosts, quotas, request logs, probes, quality gates."""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from pressloom.functions import dates, text
from pressloom.functions import fixed_values as fv
from pressloom.operators.ranking import top_per_group
from pressloom.sources import store


class GateFailed(RuntimeError):
    """The new output may not replace the old one."""


# --- source health ------------------------------------------------------------------------------------------------------


def update_health(status: DataFrame, previous: DataFrame, now: Column) -> DataFrame:
    """``down_since`` is set once and cleared on recovery; sources absent from this run are dropped.

    ``status``: source, ok. ``previous``: source, down_since, last_ok.
    """
    old = previous.select("source", F.col("down_since").alias("was_down"), F.col("last_ok").alias("was_ok"))
    hour = F.date_format(now, "yyyy-MM-dd HH:00")
    return status.join(old, "source", "left").select(
        "source",
        F.when(F.col("ok"), "").otherwise(F.coalesce(F.nullif(F.col("was_down"), F.lit("")), hour)).alias("down_since"),
        F.when(F.col("ok"), F.date_format(now, "yyyy-MM-dd")).otherwise(F.coalesce("was_ok", F.lit(""))).alias("last_ok"),
    )


def health_report(status: DataFrame, health: DataFrame) -> DataFrame:
    """One line per source of the last run, with the time it went down."""
    down = F.coalesce("down_since", F.lit(""))
    note = F.trim(F.concat_ws(" ", F.when(down != "", F.concat(F.lit("fora do ar desde "), down)), F.col("error")))
    return (
        status.join(health.select("source", "down_since"), "source", "left")
        .select("source", "name", F.when(F.col("ok"), "ok").otherwise("FALHOU").alias("situacao"), "new", note.alias("observacao"))
        .orderBy("source")
    )


def require_a_live_source(status: DataFrame) -> DataFrame:
    """Zero answering sources means a network problem: the run fails and the history stays."""
    if status.where(F.col("ok")).isEmpty():
        raise GateFailed("no source answered; the store was left as it is")
    return status


# --- blocked hosts ------------------------------------------------------------------------------------------------------


def host_samples(articles: DataFrame, host: Column, n: int = 2) -> DataFrame:
    """The newest articles of each host, to be probed."""
    order = [F.col("published").desc(), F.col("id").asc()]
    return top_per_group(articles.withColumn("host", host), ["host"], order, n)


def probe_opened(status: Column, is_page: Column, text_chars: Column, desc_chars: Column) -> Column:
    """True: readable; false: refused or practically empty; null: says nothing (network trouble, other answers)."""
    return (
        F.when(status.isin(401, 403, 451), F.lit(False))
        .when(~status.between(200, 299) | ~is_page, F.lit(None).cast("boolean"))
        .otherwise((text_chars >= 150) | (desc_chars >= 60))
    )


def blocked_hosts(probes: DataFrame, previous: DataFrame) -> DataFrame:
    """Hosts that refuse reading. Any open sample frees a host, only refusals block it, anything else keeps its state.

    ``probes``: host, opened. ``previous``: host. Hosts without samples keep their state.
    """
    opened = F.col("opened")
    decided = probes.groupBy("host").agg(
        F.coalesce(F.bool_or(opened), F.lit(False)).alias("any_open"),
        (F.count_if(~opened) == F.count(F.lit(1))).alias("all_refused"),
    )
    was = previous.select("host", F.lit(True).alias("was")).distinct()
    stays = (
        F.when(F.col("any_open"), F.lit(False))
        .when(F.col("all_refused"), F.lit(True))
        .otherwise(F.coalesce("was", F.lit(False)))
    )
    return decided.join(was, "host", "full").where(stays).select("host")


def state_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """Added and removed rows; an empty result means there is nothing to write."""
    added = after.exceptAll(before).withColumn("change", F.lit("added"))
    return added.unionByName(before.exceptAll(after).withColumn("change", F.lit("removed")))


# --- quotas and request logs ------------------------------------------------------------------------------------------------


def allowed_requests(
    requests: DataFrame, per_caller: int = fv.QUOTA_PER_CALLER, per_day: int = fv.QUOTA_PER_DAY
) -> DataFrame:
    """The requests a daily quota lets through: the first of each caller, and of those the first of the day.

    ``requests``: kind, day, caller, ts, rid.
    """
    order = [F.col("ts").asc(), F.col("rid").asc()]
    own = top_per_group(requests, ["kind", "day", "caller"], order, per_caller)
    return top_per_group(own, ["kind", "day"], order, per_day)


def sampled_counter(requests: DataFrame, step: int = fv.SAMPLE_STEP) -> DataFrame:
    """Exact uses per day next to a counter that adds ``step`` for one use in ``step``, chosen by hash."""
    picked = F.pmod(F.conv(F.substring(F.md5(F.col("rid").cast("string")), 1, 8), 16, 10).cast("bigint"), F.lit(step)) == 0
    return requests.groupBy("kind", "day").agg(F.count(F.lit(1)).alias("exact"), (F.count_if(picked) * step).alias("estimate"))


def scanner_pattern(paths: list[str] | None = None) -> str:
    escaped = [text._quote(p.replace("*", "\0")).replace("\0", ".*") for p in (fv.SCANNER_PATHS if paths is None else paths)]
    return "(?i)^(?:" + "|".join(escaped) + ")$"


def scanner_hits(requests: DataFrame) -> DataFrame:
    """Requests for addresses only scanners visit, by path and network; no caller is kept."""
    hits = requests.where(F.col("path").rlike(scanner_pattern()))
    return hits.groupBy("path", "network").agg(F.count(F.lit(1)).alias("n"))


def secrets(documents: DataFrame, patterns: dict[str, str] | None = None) -> DataFrame:
    """Published texts that contain a secret: pattern, matches, and a preview of four characters."""
    found = F.array(
        *[
            F.struct(F.lit(name).alias("name"), F.regexp_extract_all("text", F.lit(p), F.lit(0)).alias("hits"))
            for name, p in (fv.SECRET_PATTERNS if patterns is None else patterns).items()
        ]
    )
    return (
        documents.select("doc_id", F.explode(F.filter(found, lambda x: F.size(x["hits"]) > 0)).alias("f"))
        .select("doc_id", "f.name", F.size("f.hits").alias("n"), F.length(F.col("f.hits")[0]).alias("length"), F.substring(F.col("f.hits")[0], 1, 4).alias("preview"))
    )


# --- feeds under probe ------------------------------------------------------------------------------------------------------


def feed_profiles(entries: DataFrame, key: str = "feed") -> DataFrame:
    """Per feed: items, items with description, newest, oldest, and the first three titles and links."""
    sample = top_per_group(entries, [key], [F.col("pos").asc()], 3).groupBy(key).agg(
        F.array_sort(F.collect_list(F.struct("pos", F.substring("title", 1, 90).alias("t"), F.substring("url", 1, 110).alias("u")))).alias("amostra")
    )
    facts = entries.groupBy(key).agg(
        F.count(F.lit(1)).alias("itens"),
        F.count_if(F.col("desc") != "").alias("com_descricao"),
        F.max("published").alias("mais_novo"),
        F.min("published").alias("mais_antigo"),
    )
    return facts.join(sample, key)


def probe_report(probes: DataFrame, now: Column, best: int = 3) -> DataFrame:
    """Per group: usable feeds, the best of them by items, stale ones, broken ones and failures.

    ``probes``: group, url, kind, itens, mais_novo, status. Usable: a feed or sitemap with items, the newest under three days.
    """
    is_feed = F.coalesce(F.col("kind").isin("feed", "sitemap"), F.lit(False))
    usable = is_feed & (F.coalesce("itens", F.lit(0)) > 0) & F.coalesce(dates.age_hours(F.col("mais_novo"), now) < 72, F.lit(False))
    marked = probes.withColumn("usable", usable)
    top = (
        top_per_group(marked.where("usable"), ["group"], [F.col("itens").desc(), F.col("url").asc()], best, rank="r")
        .groupBy("group")
        .agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "url"))), lambda x: x["url"]).alias("melhores"))
    )
    counts = marked.groupBy("group").agg(
        F.count(F.lit(1)).alias("testes"),
        F.count_if("usable").alias("usaveis"),
        F.count_if(is_feed & ~F.col("usable")).alias("velhos"),
        F.count_if(F.col("kind") == "xml-quebrado").alias("quebrados"),
        F.count_if(F.coalesce(F.col("status") != 200, F.lit(True))).alias("falhas"),
    )
    return counts.join(top, "group", "left").withColumn("melhores", F.coalesce("melhores", F.array().cast("array<string>")))


_WORD = r"[\p{L}\p{N}_]"


def title_shape(title: Column) -> Column:
    digits = F.regexp_replace(title, r"\p{Nd}+", "#")
    return F.regexp_replace(digits, f"(?<!{_WORD})[A-ZÀ-Ú]{_WORD}{{3,}}(?!{_WORD})", "X")


def template_titles(entries: DataFrame, min_count: int = 4, top: int = 3) -> DataFrame:
    """Title shapes a source repeats: candidates for a noise rule."""
    shapes = entries.groupBy("source", title_shape(F.col("title")).alias("shape")).agg(F.count(F.lit(1)).alias("n"))
    return top_per_group(shapes.where(F.col("n") >= min_count), ["source"], [F.col("n").desc(), F.col("shape").asc()], top)


def rehearsal(entries: DataFrame, now: Column, samples: int = 4) -> DataFrame:
    """What a run would take, per source. ``entries``: source, title, published, pos, keep."""
    recent = F.coalesce(dates.age_hours(F.col("published"), now) < 24, F.lit(False))
    counts = entries.groupBy("source").agg(
        F.count(F.lit(1)).alias("itens"),
        F.count_if("keep").alias("passaram"),
        F.count_if(~F.col("keep")).alias("barrados"),
        F.count_if(recent).alias("recentes"),
    )
    order = [F.col("published").desc_nulls_last(), F.col("pos").asc()]
    kept = (
        top_per_group(entries.where("keep"), ["source"], order, samples, rank="r")
        .groupBy("source")
        .agg(F.transform(F.array_sort(F.collect_list(F.struct("r", F.substring("title", 1, 95).alias("t")))), lambda x: x["t"]).alias("exemplos"))
    )
    return counts.join(kept, "source", "left")


def extraction_report(pages: DataFrame, min_chars: int = fv.MIN_FULL_TEXT) -> DataFrame:
    """Per host: pages, mean text length, share with enough text. ``pages``: host, text."""
    n = F.length("text")
    return pages.groupBy("host").agg(
        F.count(F.lit(1)).alias("paginas"), F.avg(n).alias("media"), (F.count_if(n >= min_chars) / F.count(F.lit(1))).alias("parte")
    )


# --- publish gate -----------------------------------------------------------------------------------------------------------

_DANGEROUS = r"(?i)^\s*(?:javascript|data|vbscript):"


@dataclass(frozen=True)
class Rules:
    """What an output must be like: rows, a column of links without dangerous schemes, columns that are never empty, columns that hold JSON."""

    minimum: int = 0
    link: str | None = None
    required: tuple[str, ...] = ()
    json: tuple[str, ...] = ()

    def counts(self) -> dict[str, Column]:
        """One aggregate for each rule: how often it is broken. A null is empty, and is no JSON."""
        out = {"rows below minimum": F.greatest(F.lit(self.minimum) - F.count(F.lit(1)), F.lit(0))}
        if self.link:
            out["dangerous link"] = F.count_if(F.coalesce(F.col(self.link).rlike(_DANGEROUS), F.lit(False)))
        for column in self.required:
            out[f"empty {column}"] = F.count_if(F.coalesce(F.col(column).cast("string"), F.lit("")) == "")
        for column in self.json:
            out[f"no JSON in {column}"] = F.count_if(F.try_parse_json(F.col(column)).isNull())
        return out


def quality_problems(outputs: dict[str, DataFrame], minimum: dict[str, int], links: dict[str, str], required: dict[str, list[str]]) -> DataFrame:
    """Problems found in the outputs of a run, as rows (output, rule, n); no rows means it may be published.

    Every output is read once, by one aggregate.
    """
    spark = next(iter(outputs.values())).sparkSession
    checks = spark.createDataFrame([], "output string, rule string, n bigint")
    for name, df in outputs.items():
        rules = Rules(minimum.get(name, 0), links.get(name), tuple(required.get(name, ())))
        counted = F.array(*[F.struct(F.lit(rule).alias("rule"), n.alias("n")) for rule, n in rules.counts().items()])
        found = df.agg(counted.alias("r")).select(F.lit(name).alias("output"), F.explode("r").alias("r")).select("output", "r.rule", "r.n")
        checks = checks.unionByName(found)
    return checks.where(F.col("n") > 0)


def publish_checked(outputs: dict[str, DataFrame], root: str, rules: dict[str, Rules], partition_by: dict[str, str] | None = None) -> dict[str, str]:
    """Write all outputs and count what breaks the rules while they are written; only if nothing does, readers are pointed to them.

    ``rules`` names the outputs that must be there. No output is read for its check: the counts are observed on the write itself.
    """
    problems = [(name, "missing", 1) for name in sorted(rules.keys() - outputs.keys())]
    versions = {}
    for name, df in outputs.items() if not problems else ():
        seen = Observation(f"{name}-{uuid.uuid4().hex}")
        counts = rules.get(name, Rules()).counts()
        watched = df.observe(seen, *[n.alias(f"n{i}") for i, n in enumerate(counts.values())])
        versions[name] = store.write_version(watched, f"{root}/{name}", (partition_by or {}).get(name))
        problems += [(name, rule, seen.get[f"n{i}"]) for i, rule in enumerate(counts) if seen.get[f"n{i}"]]
    if problems:
        raise GateFailed("; ".join(f"{name}: {rule} ({n})" for name, rule, n in problems))
    for name, version in versions.items():
        store.point_to(outputs[name].sparkSession, f"{root}/{name}", version)
    return versions


def require_quality(problems: DataFrame) -> None:
    """Raise with the first problems; the table has one row per output and rule at most."""
    found = problems.limit(20).collect()
    if found:
        raise GateFailed("; ".join(f"{r.output}: {r.rule} ({r.n})" for r in found))
