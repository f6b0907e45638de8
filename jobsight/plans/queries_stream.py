"""Streaming queries (X1-X6, A19) and the event encode/parse queries (P10,
P11, T2), over job events derived from the ``events`` table.

A registered streaming query publishes the whole events table as JSON
messages, consumes them with an ``availableNow`` trigger in micro-batches of
bounded size, then returns the live tables the foreachBatch writers produced. Checkpoints and outputs go to a fresh folder
under ``spark.checkpoint.dir``.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from jobsight.operators import filters as W
from jobsight.operators.aggregates import stream_total
from jobsight.operators.normalize import recent_projection
from jobsight.plans.catalog import register
from jobsight.plans.jobs import cached
from jobsight.schemas import NOT_STATED
from jobsight.session import app_key, read_table, scratch_path
from jobsight.sinks.snapshots import current_folder
from jobsight.sources import testbed as TB
from jobsight.streaming import live as L
from jobsight.streaming.message_log import log_job_stream, publish
from jobsight.streaming.events import file_job_stream, iso_utc, parse_events, utc_wall_clock, write_events

#: Message files (the topic's stand-in) of one micro-batch.
FILES_PER_BATCH = 64

_RUNS: dict = {}
job_event_values = cached("events", TB.job_event_values)


def _run_stepwise(spark, sf_dir):
    """The events released in ``BATCHES`` steps of many files each; the job takes a step
    as one micro-batch, stops, and goes on from its checkpoint with the next (X7)."""
    key = (app_key(spark), sf_dir, "steps")
    if key not in _RUNS:
        base = scratch_path(spark, "steps")
        paths = L.LivePaths(f"{base}/out", f"{base}/checkpoints")
        rows = TB.job_event_rows(spark, sf_dir)
        step = F.pmod(F.col("event_id"), F.lit(BATCHES))
        for i in range(BATCHES):                   # steps in the order of release
            write_events(TB.job_event_values_from(rows.where(step == i)), f"{base}/events/step={i}")
            stream = file_job_stream(spark, f"{base}/events/*")
            L.run_until_idle(L.start_live(spark, stream, paths, available_now=True), timeout_s=600)
        _RUNS[key] = paths
    return _RUNS[key]


#: Micro-batches of the stepwise run; the last one holds the events whose id leaves BATCHES - 1.
BATCHES = 4


def live_run(spark, sf_dir):
    """Run the live job once per (application, tables) and return its paths.

    The events are first published as JSON messages (K4, one file per
    partition, standing in for the topic), then consumed by the live job."""
    key = (app_key(spark), sf_dir)
    if key not in _RUNS:
        base = scratch_path(spark, "live")
        events_dir = f"{base}/events"
        write_events(job_event_values(spark, sf_dir), events_dir)
        paths = L.LivePaths(f"{base}/out", f"{base}/checkpoints")
        stream = file_job_stream(spark, events_dir, max_files_per_trigger=FILES_PER_BATCH)
        queries = L.start_live(spark, stream, paths, available_now=True)
        L.run_until_idle(queries)
        _RUNS[key] = paths
    return _RUNS[key]


def _ns(x):
    return f"'{NOT_STATED}'" if x is None else x


EVENTS_PARSED = f"""SELECT event_id,
 CASE WHEN bad THEN NULL ELSE 'Job ' || event_type END AS job_title,
 CASE WHEN bad THEN NULL ELSE 'Company ' || CAST(mod(user_id, 50) AS VARCHAR) END AS company_name,
 CASE WHEN bad THEN NULL ELSE (CASE mod(event_id, 4) WHEN 0 THEN NULL WHEN 1 THEN 'Jakarta' WHEN 2 THEN 'Manila' ELSE 'TOKYO' END) END AS location,
 coalesce(CASE WHEN bad OR mod(event_id, 7) = 0 THEN NULL
   ELSE (CASE mod(event_id, 4) WHEN 0 THEN NULL WHEN 1 THEN 'Indonesia' WHEN 2 THEN 'Philippines' ELSE 'Japan' END) END, 'Unknown') AS country,
 CASE WHEN bad THEN NULL ELSE 'Full-time' END AS job_type,
 CASE WHEN bad THEN NULL ELSE {_ns(None)} END AS experience,
 CASE WHEN bad THEN NULL ELSE {_ns(None)} END AS education,
 CASE WHEN bad OR mod(event_id, 5) = 0 THEN NULL ELSE value * CAST(1000000 AS DOUBLE) END AS salary_min,
 CASE WHEN bad OR mod(event_id, 5) = 0 THEN NULL ELSE value * CAST(1000000 AS DOUBLE) * 2 END AS salary_max,
 coalesce(CASE WHEN bad OR mod(user_id, 13) = 0 THEN NULL ELSE CAST(user_id AS VARCHAR) END, 'Unknown') AS keyword,
 coalesce(CASE WHEN bad OR mod(event_id, 11) = 0 THEN NULL ELSE event_type END, 'Unknown') AS platform,
 CASE WHEN bad THEN NULL ELSE strftime(ts, '%Y-%m-%d') END AS post_date,
 CASE WHEN bad THEN NULL ELSE 'event://' || CAST(event_id AS VARCHAR) END AS job_url,
 CASE WHEN bad THEN NULL WHEN mod(event_id, 17) = 0 THEN 'not-a-time'
      ELSE strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') || '+00:00' END AS event_time,
 CASE WHEN bad OR mod(event_id, 17) = 0 THEN NULL ELSE ts END AS event_ts
FROM (SELECT *, mod(event_id, 19) = 0 AS bad FROM events) e"""

_EV = f"WITH evp AS ({EVENTS_PARSED})\n"
_RECENT = ("SELECT event_time, job_title, company_name, platform, keyword, country, salary_min, salary_max "
           "FROM evp ORDER BY event_time DESC NULLS LAST, job_url ASC NULLS FIRST LIMIT 50")
_WINDOWS = ("SELECT date_trunc('minute', event_ts) AS window_start, "
            "date_trunc('minute', event_ts) + INTERVAL 1 MINUTE AS window_end, platform, "
            "count(*) AS jobs_per_minute FROM evp WHERE event_ts IS NOT NULL GROUP BY 1, 2, 3")


def _parsed(spark, sf_dir):
    p = parse_events(job_event_values(spark, sf_dir))
    return p.withColumn("event_ts", utc_wall_clock("event_ts"))


@register("p10_parse_events", _EV + "SELECT * EXCLUDE (event_id) FROM evp")
def p10_parse_events(spark, sf_dir):
    return _parsed(spark, sf_dir)


@register("p11_recent_projection", _EV + "SELECT event_time, job_title, company_name, platform, keyword, "
          "country, salary_min, salary_max FROM evp")
def p11_recent_projection(spark, sf_dir):
    return recent_projection(_parsed(spark, sf_dir))


@register("t02_recent_k", _EV + _RECENT)
def t02_recent_k(spark, sf_dir):
    return L.recent_jobs(_parsed(spark, sf_dir), 50)


@register("x01_stream_platform_counts", _EV + "SELECT platform, count(*) AS stream_count FROM evp GROUP BY platform")
def x01_stream_platform_counts(spark, sf_dir):
    return L.read_live(spark, live_run(spark, sf_dir), "platform_counts")


@register("x02_stream_keyword_counts", _EV + "SELECT keyword, count(*) AS stream_count FROM evp GROUP BY keyword "
          "ORDER BY stream_count DESC, keyword ASC NULLS FIRST LIMIT 20")
def x02_stream_keyword_counts(spark, sf_dir):
    return L.read_live(spark, live_run(spark, sf_dir), "keyword_counts")


@register("x03_stream_recent_jobs", _EV + _RECENT)
def x03_stream_recent_jobs(spark, sf_dir):
    return L.read_live(spark, live_run(spark, sf_dir), "recent_jobs")


@register("x04_stream_windowed_counts", _EV + _WINDOWS)
def x04_stream_windowed_counts(spark, sf_dir):
    return L.read_windowed_final(spark, live_run(spark, sf_dir))


@register("x05_latest_windows", _EV + f"SELECT * FROM ({_WINDOWS}) w ORDER BY window_start DESC, platform ASC LIMIT 20")
def x05_latest_windows(spark, sf_dir):
    return L.read_windowed_latest(spark, live_run(spark, sf_dir))


@register("x06_stream_summary", _EV + f"""SELECT 'platform_counts' AS metric, count(DISTINCT platform) AS value FROM evp
UNION ALL SELECT 'keyword_counts', least(20, count(DISTINCT keyword)) FROM evp
UNION ALL SELECT 'recent_jobs', least(50, count(*)) FROM evp
UNION ALL SELECT 'windowed_platform', least(20, count(*)) FROM ({_WINDOWS}) w""")
def x06_stream_summary(spark, sf_dir):
    return L.read_summary(spark, live_run(spark, sf_dir)).select("metric", "value")


@register("a19_stream_total", "SELECT count(*) AS stream_total FROM events")
def a19_stream_total(spark, sf_dir):
    return stream_total(L.read_live(spark, live_run(spark, sf_dir), "platform_counts"))


# --- several micro-batches with a restart: per-batch tables show the last batch only,
# windows and the summary all of them --------------------------------------------------

_LAST = f"WITH evp AS (SELECT * FROM ({EVENTS_PARSED}) WHERE mod(event_id, {BATCHES}) = {BATCHES - 1})\n"


@register("x01_platform_counts_last_batch", _LAST + "SELECT platform, count(*) AS stream_count FROM evp GROUP BY platform")
def x01_platform_counts_last_batch(spark, sf_dir):
    return L.read_live(spark, _run_stepwise(spark, sf_dir), "platform_counts")


@register("x02_keyword_counts_last_batch", _LAST + "SELECT keyword, count(*) AS stream_count FROM evp GROUP BY keyword "
          "ORDER BY stream_count DESC, keyword ASC NULLS FIRST LIMIT 20")
def x02_keyword_counts_last_batch(spark, sf_dir):
    return L.read_live(spark, _run_stepwise(spark, sf_dir), "keyword_counts")


@register("x03_recent_jobs_last_batch", _LAST + _RECENT)
def x03_recent_jobs_last_batch(spark, sf_dir):
    return L.read_live(spark, _run_stepwise(spark, sf_dir), "recent_jobs")


@register("x07_recovered_batches", f"""SELECT metric, CAST({BATCHES - 1} AS BIGINT) AS last_batch FROM
(VALUES ('platform_counts'), ('keyword_counts'), ('recent_jobs')) t(metric)""")
def x07_recovered_batches(spark, sf_dir):
    """After each restart the batch ids go on where the run before stopped, one
    step a batch."""
    path = _run_stepwise(spark, sf_dir).summary
    s = spark.read.parquet(*[current_folder(spark, f"{path}/{m}") for m in L.LIVE_TABLES])
    return s.select("metric", F.col("batch_id").alias("last_batch"))


@register("x08_live_job_tables", _EV + f"""SELECT 'platform_counts' AS name, count(DISTINCT platform) AS rows FROM evp
UNION ALL SELECT 'keyword_counts', least(20, count(DISTINCT keyword)) FROM evp
UNION ALL SELECT 'recent_jobs', least(50, count(*)) FROM evp
UNION ALL SELECT 'windows', count(*) FROM ({_WINDOWS}) w""")
def x08_live_job_tables(spark, sf_dir):
    """What one run of the whole live job leaves behind."""
    paths = live_run(spark, sf_dir)
    counts = [L.read_live(spark, paths, t).agg(F.count(F.lit(1)).alias("rows")).select(F.lit(t).alias("name"), "rows") for t in L.LIVE_TABLES]
    counts.append(L.read_windowed_final(spark, paths).agg(F.count(F.lit(1)).alias("rows")).select(F.lit("windows").alias("name"), "rows"))
    return counts[0].unionByName(counts[1]).unionByName(counts[2]).unionByName(counts[3])


@register("s06_read_job_stream", _EV + "SELECT count(*) AS messages, count(job_url) AS parsed FROM evp")
def s06_read_job_stream(spark, sf_dir):
    """S6, file form: the stream's messages as they are read, counted in a sink table."""
    key = (app_key(spark), sf_dir, "raw")
    if key not in _RUNS:
        base = scratch_path(spark, "raw")
        write_events(job_event_values(spark, sf_dir), f"{base}/events")
        q = (file_job_stream(spark, f"{base}/events", max_files_per_trigger=2).writeStream.format("parquet")
             .option("checkpointLocation", f"{base}/checkpoint").option("path", f"{base}/out").trigger(availableNow=True).start())
        L.run_until_idle([q], timeout_s=600)
        _RUNS[key] = f"{base}/out"
    parsed = parse_events(spark.read.schema("value string").parquet(_RUNS[key]))
    return parsed.agg(F.count(F.lit(1)).alias("messages"), F.count("job_url").alias("parsed"))


# One event of every minute comes again ten minutes late, in a second batch: the watermark
# (two minutes) has passed its window by then, unless the window is one of the last.
_LATE = """(SELECT max(ts) - INTERVAL 2 MINUTE FROM events)"""


@register("x06_late_rows_dropped", f"""SELECT date_trunc('minute', ts) AS window_start, event_type AS platform,
  CAST(count(*) + count(*) FILTER (WHERE mod(event_id, 10) = 0 AND date_trunc('minute', ts) + INTERVAL 1 MINUTE > {_LATE}) AS BIGINT) AS jobs_per_minute
FROM events GROUP BY ALL""")
def x06_late_rows_dropped(spark, sf_dir):
    """Rows that come after the watermark passed their window do not count."""
    key = (app_key(spark), sf_dir, "late")
    if key not in _RUNS:
        base = scratch_path(spark, "late")
        paths = L.LivePaths(f"{base}/out", f"{base}/checkpoints")
        ev = read_table(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("platform"), "ts")
        late = ev.where(F.col("event_id") % 10 == 0)
        for i, part in enumerate((ev, late)):
            value = F.to_json(F.struct("platform", iso_utc(F.col("ts")).alias("event_time")))
            write_events(part.select(value.alias("value")), f"{base}/events/step={i}")
            stream = file_job_stream(spark, f"{base}/events/*")
            L.run_until_idle(L.start_live(spark, stream, paths, available_now=True), timeout_s=600)
        _RUNS[key] = paths
    return L.read_windowed_final(spark, _RUNS[key]).select("window_start", "platform", "jobs_per_minute")


@register("w12_stream_is_live", """SELECT o_orderkey AS id, mod(o_orderkey, 5) IN (1, 2) AS is_live FROM orders""")
def w12_stream_is_live(spark, sf_dir):
    """W12 over update times of every kind: none, fresh (UTC and with an offset), old, without a zone."""
    now = F.lit("2024-05-01T12:00:00Z").cast("timestamp")
    k = F.pmod(F.col("o_orderkey"), F.lit(5))
    text = (F.when(k == 1, "2024-05-01T11:59:00+00:00").when(k == 2, "2024-05-01T18:58:01+07:00")
            .when(k == 3, "2024-05-01T11:58:00+00:00").when(k == 4, "2024-05-01T11:59:59"))
    rows = read_table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), text.alias("last_updated"))
    return W.stream_is_live(rows, now).select("id", "is_live")


@register("s06_message_log_latest", f"""SELECT platform, count(*) AS events FROM ({EVENTS_PARSED}) e
WHERE mod(event_id, {BATCHES}) <> 0 GROUP BY platform""")
def s06_message_log_latest(spark, sf_dir):
    """S6 + X9 over the message log: the first step lies there before the job starts at
    ``latest``, the second comes while it runs, the others before it goes on from its
    checkpoint; offsets a trigger are bounded."""
    key = (app_key(spark), sf_dir, "log")
    if key not in _RUNS:
        base = scratch_path(spark, "message-log")
        rows = TB.job_event_rows(spark, sf_dir)
        parts = [TB.job_event_values_from(rows.where(F.pmod(F.col("event_id"), F.lit(BATCHES)) == i)) for i in range(BATCHES)]

        def run(before, during):
            for part in before:
                publish(part, f"{base}/log")
            stream = log_job_stream(spark, f"{base}/log", max_offsets_per_trigger=50_000, progress=f"{base}/progress")
            query = (parse_events(stream).writeStream.format("parquet").option("path", f"{base}/out")
                     .option("checkpointLocation", f"{base}/checkpoint").trigger(processingTime="0 seconds").start())
            try:
                query.processAllAvailable()
                for part in during:
                    publish(part, f"{base}/log")
                    query.processAllAvailable()
            finally:
                query.stop()
        run(parts[:1], parts[1:2])
        run(parts[2:], [])
        _RUNS[key] = f"{base}/out"
    return spark.read.parquet(_RUNS[key]).groupBy("platform").agg(F.count(F.lit(1)).alias("events"))
