"""One ingest run: delivered entries to the next state of the store."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pressloom.functions import dates
from pressloom.functions import fixed_values as fv
from pressloom.operators import ingest
from pressloom.session import cut_lineage


@dataclass(frozen=True)
class Run:
    store: DataFrame
    added: DataFrame
    rejected: DataFrame
    revisions: DataFrame
    usable: DataFrame


def collect(
    entries: DataFrame, sources: DataFrame, store: DataFrame, crawl_log: DataFrame, now: Column, *,
    window_days: int = fv.WINDOW_DAYS, per_source: int = fv.PER_SOURCE_LIMIT, cap: int = fv.STORE_CAP,
    floor: int = fv.STORE_FLOOR_PER_SOURCE, noise: list[str] | None = None, relevant: Column | None = None,
) -> Run:
    """Adjust, filter, take the newest per source, admit, de-duplicate, validate, merge, retain.

    ``entries``: source, pos, title, url, desc, published. ``sources``: id, n (order), kind, include[], exclude[], politica,
    limite, relogio, titulo_na_descricao. ``store``: id, title, desc, url, source, kind, published, seen, anterior, alterado.
    """
    rules = sources.select(F.col("id").alias("source"), "n", "kind", "include", "exclude", "politica", "relogio")
    adjusted = ingest.swap_label_titles(entries, sources).join(rules, "source")
    keep = ingest.keep_flag(
        F.col("url"), F.col("title"), F.col("desc"), F.col("include"), F.col("exclude"), F.col("politica"), noise, relevant
    )
    usable = adjusted.where((F.col("url") != "") & (F.col("title") != "") & keep)
    newest = ingest.newest_per_source(usable, sources.select(F.col("id").alias("source"), "limite"), per_source)
    keyed = cut_lineage(ingest.with_keys(newest))
    repaired = keyed.withColumn("published", dates.repair_clock(F.col("published"), F.col("relogio")))
    fresh = ingest.unknown_titles(ingest.unknown(repaired, store), store)
    admitted = ingest.admit(fresh, now, window_days)
    order = F.struct("n", (-F.unix_micros(F.coalesce("delivered", F.lit("1970-01-01").cast("timestamp")))).alias("t"), "pos")
    ordered = admitted.join(keyed.select("source", "pos", F.col("published").alias("delivered")), ["source", "pos"]).withColumn("ord", order)
    pending = cut_lineage(ingest.drop_repeats(ordered, "ord"))
    checked = cut_lineage(ingest.validate(pending, crawl_log))
    added = checked.where("accepted").select(
        "id", "title", "desc", "url", "source", "kind", "published", now.alias("seen"),
        F.lit(None).cast("string").alias("anterior"), F.lit(None).cast("timestamp").alias("alterado"),
    )
    delivered = F.struct("n", (-F.unix_micros(F.coalesce("published", F.lit("1970-01-01").cast("timestamp")))).alias("t"), "pos")
    last = keyed.groupBy("id").agg(F.max_by("title", delivered).alias("title"))  # deliveries apply in order, so the last title stays
    revisions = ingest.title_revisions(store, last)
    updated = ingest.apply_revisions(store, revisions, now)
    merged = updated.unionByName(added).where(F.col("published") >= now - F.make_dt_interval(days=F.lit(window_days)))
    return Run(ingest.retain(merged, cap, floor), added, checked.where(~F.col("accepted")).select("id", "reason"), revisions, usable)
