"""Live outputs of the job stream: X1-X8, K5 (per-batch overwrite), K6 (summary).

Two streaming queries share one parsed source:

* ``live``: one ``foreachBatch`` computes the platform counts (X1), keyword
  top 20 (X2) and newest 50 postings (X3) of the micro-batch from one
  persisted copy of the batch (the topic is read once, not three times);
  each non-empty batch replaces the three live tables, an empty batch
  leaves them (K5), and so is one summary row per table (K6).
* ``windowed``: tumbling 1-minute counts per platform with a 2-minute
  watermark, update mode (X4); each batch's updated windows are added to the
  window log and the 20 newest windows replace the live view (X5).

Tables are replaced by versions (``sinks.snapshots``): a reader sees one whole
version, whatever a writer does. A batch replayed after a failure writes the same
data again, or nothing: restarts from the checkpoint are idempotent.
A batch is persisted while it is written; ``maxFilesPerTrigger`` (files) or
``maxOffsetsPerTrigger`` (Kafka) of the source bound its size.
"""

from __future__ import annotations

import datetime as _dt
import os
from contextlib import contextmanager
from dataclasses import dataclass
from typing import Iterator, Optional

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobsight.operators.ordering import recent_k, top_k
from jobsight.schemas import RECENT_COLUMNS
from jobsight.sinks.snapshots import WindowLog, current_folder, read_table, replace_table
from jobsight.streaming.events import parse_events, utc_wall_clock

#: Partitions of the windows' state. Each task reports the state metrics of all partitions
#: to the driver, so these bytes follow the square of this number. The state holds a
#: count a window and platform within the watermark, whatever the number of events.
STATE_PARTITIONS = 16

LIVE_TABLES = ("platform_counts", "keyword_counts", "recent_jobs")


def platform_counts(batch: DataFrame) -> DataFrame:
    """Events per platform in the batch, most first."""
    out = batch.groupBy("platform").agg(F.count(F.lit(1)).alias("stream_count"))
    return out.orderBy(F.col("stream_count").desc(), F.col("platform").asc())


def keyword_counts(batch: DataFrame, n: int = 20) -> DataFrame:
    """Top ``n`` keywords of the batch (ties by keyword)."""
    out = batch.groupBy("keyword").agg(F.count(F.lit(1)).alias("stream_count"))
    return top_k(out, n, "stream_count", "keyword")


def recent_jobs(batch: DataFrame, n: int = 50) -> DataFrame:
    """X3 (T2 + P11): the ``n`` newest events by ``event_time`` TEXT, descending
    (ties by url, which carries the event id)."""
    cols = RECENT_COLUMNS + ["job_url"]
    return recent_k(batch.select(*cols), n, "event_time", "job_url").select(*RECENT_COLUMNS)


def windowed_counts(events: DataFrame, window: str = "1 minute",
                    watermark: str = "2 minutes") -> DataFrame:
    """Tumbling windows per platform; events older than the watermark
    (max event time seen minus ``watermark``) are dropped once it passes
    them; rows without a parsable event time are in no window."""
    w = (events.where(F.col("event_ts").isNotNull())
         .withWatermark("event_ts", watermark)
         .groupBy(F.window("event_ts", window), F.col("platform"))
         .agg(F.count(F.lit(1)).alias("jobs_per_minute")))
    return w.select(utc_wall_clock(F.col("window.start")).alias("window_start"),
                    utc_wall_clock(F.col("window.end")).alias("window_end"),
                    "platform", "jobs_per_minute")


def latest_windows(batch: DataFrame, n: int = 20) -> DataFrame:
    """The ``n`` newest windows of a batch."""
    return batch.orderBy(F.col("window_start").desc(), F.col("platform").asc()).limit(n)


@dataclass
class LivePaths:
    out_dir: str
    checkpoint_dir: str

    def table(self, name: str) -> str:
        return f"{self.out_dir}/{name}"

    @property
    def summary(self) -> str:
        return f"{self.out_dir}/summary"

    @property
    def window_history(self) -> str:
        return f"{self.out_dir}/windowed_history"

    @property
    def window_live(self) -> str:
        return f"{self.out_dir}/windowed_latest"


def _now_iso() -> str:
    return _dt.datetime.now(_dt.timezone.utc).isoformat()


def _write_summary(paths: LivePaths, batch_id: int, outputs: dict) -> None:
    """K6: one row per metric (rows written) with the update time, in a table
    of its own that every batch replaces: the summary never grows, and the
    two queries, which own different metrics, never touch each other's."""
    now = _now_iso()
    for metric, out in outputs.items():
        row = out.agg(F.count(F.lit(1)).alias("value")).select(
            F.lit(metric).alias("metric"), "value", F.lit(now).alias("last_updated"), F.lit(int(batch_id)).cast("long").alias("batch_id"))
        replace_table(row.coalesce(1), f"{paths.summary}/{metric}")


def live_batch_writer(paths: LivePaths, keywords_n: int = 20, recent_n: int = 50):
    """K5 for X1-X3: the foreachBatch function of the ``live`` query."""
    def write(batch: DataFrame, batch_id: int) -> None:
        batch.persist()                 # before any action: the batch is computed once
        if batch.isEmpty():
            batch.unpersist()
            return                      # an empty batch leaves the live tables
        outputs = {"platform_counts": platform_counts(batch),
                   "keyword_counts": keyword_counts(batch, keywords_n),
                   "recent_jobs": recent_jobs(batch, recent_n)}
        try:
            for name, out in outputs.items():
                out.persist()           # small: <= platforms, 20 and 50 rows
                replace_table(out.coalesce(1), paths.table(name))
            _write_summary(paths, batch_id, outputs)
        finally:
            for out in outputs.values():
                out.unpersist()
            batch.unpersist()
    return write


def windowed_batch_writer(paths: LivePaths, n: int = 20):
    """K5 for X4/X5: the foreachBatch function of the ``windowed`` query."""
    def write(batch: DataFrame, batch_id: int) -> None:
        # persist before any action: the stateful aggregation behind this
        # batch must not be evaluated twice (emptiness check, then writes)
        batch.persist()
        if batch.isEmpty():
            batch.unpersist()
            return
        latest = latest_windows(batch, n).persist()
        try:
            WindowLog(batch.sparkSession, paths.window_history).append(batch, batch_id)
            replace_table(latest.coalesce(1), paths.window_live)
            _write_summary(paths, batch_id, {"windowed_platform": latest})
        finally:
            latest.unpersist()
            batch.unpersist()
    return write


@contextmanager
def state_partitions(spark: SparkSession, n: int) -> Iterator[None]:
    """A streaming query copies the session's configuration when it starts (and keeps the
    number of its state's partitions in its checkpoint): queries started inside have at
    most ``n``; the session has its own number back behind it."""
    name = "spark.sql.shuffle.partitions"
    own = spark.conf.get(name)
    spark.conf.set(name, str(min(n, int(own))))
    try:
        yield
    finally:
        spark.conf.set(name, own)


def start_live(spark: SparkSession, raw_stream: DataFrame, paths: LivePaths,
               available_now: bool = False, live_trigger: str = "5 seconds",
               window_trigger: str = "10 seconds", window: str = "1 minute",
               watermark: str = "2 minutes"):
    """Start both queries on one parsed source; each has its own
    checkpoint under ``paths.checkpoint_dir`` (X7). ``available_now`` drains
    what is there and stops (tests, replays); otherwise processing-time
    triggers as in the live job."""
    events = parse_events(raw_stream)
    trig = (lambda _: {"availableNow": True}) if available_now else (lambda t: {"processingTime": t})
    q_live = (events.writeStream.foreachBatch(live_batch_writer(paths))
              .outputMode("append")
              .option("checkpointLocation", f"{paths.checkpoint_dir}/live")
              .trigger(**trig(live_trigger)).queryName(f"live_{os.path.basename(paths.out_dir)}")
              .start())
    with state_partitions(spark, STATE_PARTITIONS):
        q_win = (windowed_counts(events, window, watermark).writeStream
                 .foreachBatch(windowed_batch_writer(paths))
                 .outputMode("update")
                 .option("checkpointLocation", f"{paths.checkpoint_dir}/windowed")
                 .trigger(**trig(window_trigger)).queryName(f"windowed_{os.path.basename(paths.out_dir)}")
                 .start())
    return [q_live, q_win]


def run_until_idle(queries, timeout_s: Optional[float] = None) -> None:
    """Wait for every query (they stop by themselves under availableNow);
    on the first failure, or when ``timeout_s`` runs out, stop the rest and raise."""
    try:
        for q in queries:
            ended = q.awaitTermination(timeout_s) if timeout_s is not None else q.awaitTermination()
            if q.exception() is not None:
                raise q.exception()
            if ended is False:
                raise TimeoutError(f"stream {q.name} still has input after {timeout_s} s; its tables are not complete")
    finally:
        for q in queries:
            if q.isActive:
                q.stop()


def run_live_forever(spark: SparkSession, queries) -> None:
    """X8 for the processing-time mode: await any termination, stop all."""
    try:
        spark.streams.awaitAnyTermination()
    finally:
        for q in queries:
            if q.isActive:
                q.stop()


# --- readers -------------------------------------------------------------------------

def read_live(spark: SparkSession, paths: LivePaths, name: str) -> DataFrame:
    return read_table(spark, paths.table(name))


def read_summary(spark: SparkSession, paths: LivePaths) -> DataFrame:
    """Latest value per metric and its update time."""
    metrics = [*LIVE_TABLES, "windowed_platform"]
    folders = [f for f in (current_folder(spark, f"{paths.summary}/{m}") for m in metrics) if f]
    return spark.read.parquet(*(folders or [f"{paths.summary}/data"])).select("metric", "value", "last_updated")


def read_windowed_final(spark: SparkSession, paths: LivePaths) -> DataFrame:
    """Final count per (window, platform)."""
    return WindowLog(spark, paths.window_history).read()


def read_windowed_latest(spark: SparkSession, paths: LivePaths) -> DataFrame:
    return read_table(spark, paths.window_live)
