"""The tracker's keyed state as Structured Streaming jobs."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from adledger import fixed
from adledger.criteria import Criteria
from adledger.operators.upsert import upsert
from adledger.sources.state import BUCKETS, Folder, State, bucket_of

MARGIN = f"{fixed.WINDOW_MARGIN_DAYS} days"
HOLD_MS = fixed.HOLD_DAYS * 24 * 3600 * 1000


def run_available(stream: DataFrame, start: Callable) -> None:
    """Runs a stream over what is there now and waits for it."""
    query = start(stream.writeStream.trigger(availableNow=True)).start()
    query.awaitTermination()


def stream_upsert(ads: DataFrame, state: State, crit: Criteria, order: list[Column],
                  pages: DataFrame, verdicts: DataFrame, checkpoint: str,
                  run_date: Callable[[int], dt.date]) -> None:
    """Merges every micro-batch of ads into the tracker.

    A micro-batch reads and writes the buckets its URLs fall in. The batch id
    names the run, so a batch that is replayed after a failure finds its run
    published and changes nothing.
    """
    def merge(batch: DataFrame, batch_id: int) -> None:
        run_id = f"batch-{batch_id:09d}"
        if state.has_run(run_id) or batch.isEmpty():
            return
        day, part = run_date(batch_id), state.part(batch)
        out = upsert(batch, state.tracker(part), state.pending(part), verdicts, pages, crit, day, order)
        state.write(out.tracker, out.pending, run_id, dt.datetime.combine(day, dt.time()), part)

    run_available(ads, lambda w: w.foreachBatch(merge).option("checkpointLocation", checkpoint))


HELD_OUT = "url STRING, arrived_ms BIGINT, released_ms BIGINT, how STRING"
HELD_STATE = "arrived_ms BIGINT, read_ms BIGINT, done BOOLEAN"
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Hold(StatefulProcessor):
    """Three numbers of state per key, and one event-time timer: to release it, then to forget it.

    A released key is remembered for ``KEEP_MS`` longer, which keeps late rows from releasing
    it again; then its state is cleared. What comes later still is held back by the sink
    (``append_unreported``), which knows all it has released.
    """

    KEEP_MS = HOLD_MS

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", HELD_STATE)

    def _release(self, key: tuple, arrived: int, read: int | None, watermark: int) -> pd.DataFrame:
        due = arrived + HOLD_MS
        at, how = (read, "read") if read is not None and read < due else (due, "overdue")
        self.held.update((arrived, read, True))
        self._wake_at(max(at + self.KEEP_MS, watermark + 1))
        return pd.DataFrame({"url": [key[0]], "arrived_ms": [arrived], "released_ms": [at], "how": [how]})

    def _wake_at(self, ms: int) -> None:
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(ms)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        arrived, read, done = self.held.get() if self.held.exists() else (None, None, False)
        for chunk in rows:  # folded, never gathered
            ms = chunk["ts_ms"]
            arrived = int(min(v for v in (arrived, ms.min()) if v is not None))
            reads = ms[chunk["is_read"]]
            if len(reads):
                read = int(min(v for v in (read, reads.min()) if v is not None))
        if done:
            return
        watermark = timerValues.getCurrentWatermarkInMs()
        if read is not None:
            yield self._release(key, arrived, read, watermark)
        else:
            self.held.update((arrived, None, False))
            self._wake_at(max(arrived + HOLD_MS, watermark + 1))

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        arrived, read, done = self.held.get()
        if done:
            self.held.clear()
        else:
            yield self._release(key, arrived, read, timerValues.getCurrentWatermarkInMs())

    def close(self) -> None:
        pass


def hold_release(sightings: DataFrame) -> DataFrame:
    """Releases each key once: when its page is read, or seven days after it arrived.

    ``sightings`` is a stream of ``url``, ``ts`` and ``is_read``. State of a released key
    leaves once the time to remember it has passed.
    """
    # timers and typed state live in this store only
    sightings.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    rows = sightings.withWatermark("ts", MARGIN).select(
        "url", "ts", F.unix_millis("ts").alias("ts_ms"), F.coalesce("is_read", F.lit(False)).alias("is_read"))
    held = rows.groupBy("url").transformWithStateInPandas(
        statefulProcessor=Hold(), outputStructType=HELD_OUT, outputMode="Append", timeMode="EventTime")
    return held.select("url", F.timestamp_millis("arrived_ms").alias("arrived"),
                       F.timestamp_millis("released_ms").alias("released"), "how")


def report_once(sightings: DataFrame) -> DataFrame:
    """A key once per watermark horizon; ``append_unreported`` covers the time beyond."""
    return sightings.withWatermark("ts", MARGIN).dropDuplicatesWithinWatermark(["url"])


def append_unreported(stream: DataFrame, path: str, checkpoint: str, buckets: int = BUCKETS) -> None:
    """Appends rows whose ``url`` no earlier output holds.

    The output lies in hash buckets of the URL, so a micro-batch reads the history of the
    buckets it falls in and no other. Its own files are named after it: a batch that is
    replayed is not hidden by its first attempt, and replaces it.
    """
    spark: SparkSession = stream.sparkSession

    def write(batch: DataFrame, batch_id: int) -> None:
        rows = batch.withColumn("bucket", bucket_of(F.col("url"), buckets))
        wanted = {f"bucket={r.bucket}" for r in rows.select("bucket").distinct().collect()}
        known = [f"{path}/{n}" for n in Folder(spark, path).names("") if n in wanted]
        if known:
            earlier = (spark.read.option("basePath", path).schema("url STRING, bucket INT, batch BIGINT").parquet(*known)
                       .where(F.col("batch") != batch_id).select("bucket", "url").distinct())
            rows = rows.join(earlier, ["bucket", "url"], "left_anti")
        (rows.withColumn("batch", F.lit(batch_id)).repartition("bucket").write.mode("overwrite")
         .option("partitionOverwriteMode", "dynamic").partitionBy("bucket", "batch").parquet(path))

    run_available(stream, lambda w: w.foreachBatch(write).option("checkpointLocation", checkpoint))


def daily_arrivals(sightings: DataFrame) -> DataFrame:
    """Arrivals per day, closed only once the two-day margin for late rows has passed."""
    return (sightings.withWatermark("ts", MARGIN)
            .groupBy(F.window("ts", "1 day").alias("w"))
            .agg(F.count("*").alias("n")).select(F.col("w.start").alias("day"), "n"))


def write_stream(stream: DataFrame, path: str, checkpoint: str) -> None:
    run_available(stream, lambda w: w.format("parquet").outputMode("append")
                  .option("path", path).option("checkpointLocation", checkpoint))
