"""Streaming forms of the stateful jobs. Each has a batch twin that defines its result."""

from __future__ import annotations

import heapq
import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from pressloom.functions import dates, urls
from pressloom.functions import fixed_values as fv
from pressloom.operators import ingest
from pressloom.session import cut_lineage

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_rocksdb(spark: SparkSession) -> None:
    """Keyed state lives in RocksDB, on the executors' disks, with checkpoints in the stream's checkpoint folder."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


def deduplicated(entries: DataFrame, delay: str = f"{fv.WINDOW_DAYS} days") -> DataFrame:
    """Continuous ingest: each article id once while its duplicates can still arrive."""
    keyed = entries.withColumn("id", urls.article_id(F.col("url")))
    return keyed.withWatermark("published", delay).dropDuplicatesWithinWatermark(["id"])


def first_on_two_keys(entries: DataFrame, folder: str, order: str, stored: DataFrame | None = None):
    """Continuous ingest on both keys: an entry is kept if no earlier kept one, and none of ``stored``, has its id or its source and title.

    ``entries``: source, title, url and any columns; inside a batch they come in the order of the column ``order`` (unique), batches in
    that of their arrival. What a batch keeps is a folder of its own below ``folder``/kept, written anew if the batch is repeated.
    """
    spark = entries.sparkSession
    keyed = ingest.with_keys(entries)
    target = f"{folder}/kept"
    known = ingest.with_keys(stored) if stored is not None else spark.createDataFrame([], "id string, title_key string")
    known.select("id", "title_key").write.mode("overwrite").parquet(f"{target}/batch=-1")

    def step(batch: DataFrame, number: int) -> None:
        before = spark.read.schema("id string, title_key string, batch long").parquet(target).where(F.col("batch") < number)
        new = ingest.with_keys(batch).join(before.select("id"), "id", "left_anti").join(before.select("title_key"), "title_key", "left_anti")
        ingest.drop_repeats(new.select(keyed.columns), order).write.mode("overwrite").parquet(f"{target}/batch={number}")

    return entries.writeStream.foreachBatch(step).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()


def kept_on_two_keys(spark: SparkSession, folder: str, schema) -> DataFrame:
    """What the stream has kept so far, with the number of its batch; ``schema`` is that of the entries."""
    full = ingest.with_keys(spark.createDataFrame([], schema)).withColumn("batch", F.lit(0).cast("long")).schema
    return spark.read.schema(full).parquet(f"{folder}/kept").where(F.col("batch") >= 0)


def admitted(entries: DataFrame, now: Column | None = None, window_days: int = fv.WINDOW_DAYS) -> DataFrame:
    """Undated and future rows count as now, rows older than the window are dropped; without ``now`` the clock is read per batch.

    The admitted time carries a watermark of the same length, for stateful jobs that follow.
    """
    moment = F.current_timestamp() if now is None else now
    fixed = entries.withColumn("published", dates.admitted_time(F.col("published"), moment)).withWatermark("published", f"{window_days} days")
    return fixed.where(F.col("published") >= moment - F.make_dt_interval(days=F.lit(window_days)))


def coverage_windows(tagged: DataFrame, width: str = "1 hour", slide: str | None = None, delay: str = "2 hours") -> DataFrame:
    """Headlines and outlets per topic in tumbling (or, with ``slide``, sliding) windows. ``tagged``: published, source, topic."""
    span = F.window("published", width, slide) if slide else F.window("published", width)
    return (
        tagged.withWatermark("published", delay)
        .groupBy(span.alias("w"), "topic")
        .agg(F.count(F.lit(1)).alias("headlines"), F.size(F.collect_set("source")).alias("outlets"))  # a set of outlets, as many as there are
        .select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "topic", "headlines", "outlets")
    )


def coverage_bursts(tagged: DataFrame, gap: str = f"{fv.STRICT_WINDOW_HOURS} hours", delay: str = "2 hours") -> DataFrame:
    """Uninterrupted coverage of a topic."""
    return (
        tagged.withWatermark("published", delay)
        .groupBy(F.session_window("published", gap).alias("w"), "topic")
        .agg(F.count(F.lit(1)).alias("headlines"))
        .select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "topic", "headlines")
    )


class _SourceHealth(StatefulProcessor):
    """State of one source: the last success, and per hour the last failure after it; it is as long as an outage has hours."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._state = handle.getValueState("health", "last_ok long, hours string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        last_ok, hours = 0, {}
        if self._state.exists():
            stored = self._state.get()
            last_ok, hours = stored[0], {int(h): t for h, t in json.loads(stored[1]).items()}
        for chunk in rows:
            good = chunk.loc[chunk["ok"], "t"]
            if len(good):
                last_ok = max(last_ok, int(good.max()))
            bad = chunk.loc[~chunk["ok"] & (chunk["t"] > last_ok), "t"]
            for hour, latest in bad.groupby(bad // 3_600_000_000).max().items():
                hours[int(hour)] = max(hours.get(int(hour), 0), int(latest))
        hours = {h: t for h, t in hours.items() if t > last_ok}
        self._state.update((last_ok, json.dumps(hours)))
        yield pd.DataFrame({"source": [key[0]], "down_hour": [min(hours) if hours else None], "last_ok": [last_ok or None]}).astype(
            {"down_hour": "Int64", "last_ok": "Int64"}
        )

    def close(self) -> None:
        pass


def source_health(polls: DataFrame) -> DataFrame:
    """Up or down per source after every batch. ``polls``: source, ts, ok."""
    use_rocksdb(polls.sparkSession)
    states = (
        polls.select("source", F.unix_micros("ts").alias("t"), "ok")
        .groupBy("source")
        .transformWithStateInPandas(
            statefulProcessor=_SourceHealth(), outputStructType="source string, down_hour long, last_ok long", outputMode="Update", timeMode="None"
        )
    )
    hour = F.date_format(F.timestamp_seconds(F.col("down_hour") * 3600), "yyyy-MM-dd HH:00")
    return states.select(
        "source", F.coalesce(hour, F.lit("")).alias("down_since"), F.coalesce(F.date_format(F.timestamp_micros("last_ok"), "yyyy-MM-dd"), F.lit("")).alias("last_ok")
    )


def _quota_processor(limit: int, forget: bool) -> StatefulProcessor:
    class _Quota(StatefulProcessor):
        """Uses of one caller on one day; a batch is scanned once and only the earliest free slots are held."""

        def init(self, handle: StatefulProcessorHandle) -> None:
            self._used = handle.getValueState("used", "n int", ttlDurationMs=90_000_000 if forget else None)

        def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
            used = self._used.get()[0] if self._used.exists() else 0
            free = limit - used
            earliest: list[tuple[int, int]] = []
            for chunk in rows:
                if free > 0:
                    earliest = heapq.nsmallest(free, [*earliest, *zip(chunk["t"].tolist(), chunk["rid"].tolist())])
            if earliest:
                self._used.update((used + len(earliest),))
                yield pd.DataFrame({"kind": key[0], "day": key[1], "caller": key[2], "rid": [rid for _, rid in earliest]})

        def close(self) -> None:
            pass

    return _Quota()


def allowed_requests(requests: DataFrame, per_caller: int = fv.QUOTA_PER_CALLER, forget: bool = True) -> DataFrame:
    """The first uses of each caller and day, as they arrive; with ``forget`` a count is dropped after 25 hours.

    Forgetting needs processing time, which keeps a stream alive: a run over what is there now goes without.
    """
    use_rocksdb(requests.sparkSession)
    return (
        requests.select("kind", "day", "caller", F.unix_micros("ts").alias("t"), "rid")
        .groupBy("kind", "day", "caller")
        .transformWithStateInPandas(
            statefulProcessor=_quota_processor(per_caller, forget), outputStructType="kind string, day string, caller string, rid long",
            outputMode="Append", timeMode="ProcessingTime" if forget else "None",
        )
    )


class AlertLedger:
    """Subscribers and what each was sent, kept in a folder: a batch adds the rows it changed, and the latest row of a subscriber counts."""

    def __init__(self, subscribers: DataFrame, folder: str):
        self.spark, self.folder = subscribers.sparkSession, folder
        first = subscribers.withColumn("gone", F.lit(False))
        first.write.mode("overwrite").parquet(f"{folder}/batch=-1")
        self.columns, self.schema = subscribers.columns, first.withColumn("batch", F.lit(0).cast("long")).schema

    def read(self, before: int | None = None) -> DataFrame:
        """The state before a batch, or the latest."""
        rows = self.spark.read.schema(self.schema).parquet(self.folder)
        rows = rows if before is None else rows.where(F.col("batch") < before)
        latest = rows.groupBy("key").agg(F.max_by(F.struct(*[c for c in rows.columns if c != "key"]), "batch").alias("row"))
        return latest.where("not row.gone").select(*[F.col(c) if c == "key" else F.col(f"row.{c}").alias(c) for c in self.columns])

    def write(self, touched: DataFrame, after: DataFrame, number: int) -> None:
        """``touched`` (key): the subscribers a batch sent to or saw first. Those no longer in ``after`` are gone."""
        rows = touched.select("key").distinct().join(after.withColumn("gone", F.lit(False)), "key", "left").withColumn("gone", F.coalesce("gone", F.lit(True)))
        rows.select(*self.columns, "gone").write.mode("overwrite").parquet(f"{self.folder}/batch={number}")


def run_alerts(digests: DataFrame, ledger: AlertLedger, deliver: Callable[[DataFrame], DataFrame], now: Callable[[int], Column], checkpoint: str):
    """Alerts per micro-batch of digests: select, hand over for delivery, add the receipts to the ledger.

    A batch that is repeated after a failure reads the ledger as it was before the batch and writes the same folder, so it changes nothing;
    ``deliver`` gets the same alerts again.
    """
    from pressloom.operators import alerts

    def step(batch: DataFrame, number: int) -> None:
        at = now(number)
        subscribers = cut_lineage(ledger.read(number))
        chosen = cut_lineage(alerts.select(subscribers, batch, at))
        receipts = cut_lineage(deliver(chosen.select("key", F.posexplode("enviar").alias("pos", "id"))))
        first = chosen.where("primeira").select("key", "s", "d")
        ledger.write(receipts.select("key").unionByName(first.select("key")), alerts.merge_receipts(subscribers, receipts, first, at), number)

    return digests.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def advance(stream: DataFrame, folder: str) -> str | None:
    """Run an append stream over what is there now; the watermark it reached, behind which rows no longer count."""
    query = stream.writeStream.outputMode("append").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).format("parquet").option("path", f"{folder}/out").start()
    query.awaitTermination()
    if query.exception() is not None:
        raise query.exception()
    marks = [p["eventTime"]["watermark"] for p in query.recentProgress if "watermark" in p["eventTime"]]
    return max(marks) if marks else None


def too_late(rows: DataFrame, watermark: str | None, width: str) -> DataFrame:
    """Rows that a run leaves out because their window had closed by the watermark of the run before."""
    if watermark is None:
        return rows.limit(0)
    spans = rows.withColumn("__span", F.window("published", width)).where(F.col("__span.end") <= F.to_timestamp(F.lit(watermark)))
    return spans.select(rows.columns)


def drain(stream: DataFrame, folder: str, mode: str = "append", keys: list[str] | None = None) -> DataFrame:
    """Run a stream over what is there now and read back what it wrote.

    Complete mode gives the last batch; update mode the last row of each of ``keys``, as a batch holds only what changed. A batch that
    is repeated after a failure writes to the same place.
    """
    spark = stream.sparkSession
    target = f"{folder}/out"
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True)
    if mode == "append":
        query = writer.format("parquet").option("path", target).start()
    else:
        query = writer.foreachBatch(lambda df, n: df.write.mode("overwrite").parquet(f"{target}/batch={n}")).start()
    query.awaitTermination()
    if query.exception() is not None:
        raise query.exception()
    written = spark.read.schema(stream.schema).parquet(target)
    if mode == "append":
        return written
    written = written.select("*", F.element_at(F.regexp_extract_all(F.col("_metadata.file_path"), F.lit("batch=([0-9]+)"), F.lit(1)), -1).cast("long").alias("__batch"))
    if mode == "complete":
        return written.join(written.agg(F.max("__batch").alias("__batch")), "__batch").drop("__batch")
    return written.join(written.groupBy(*keys).agg(F.max("__batch").alias("__batch")), [*keys, "__batch"]).select(*stream.columns)
