"""Job events: encoding rows as JSON events (K4), the stream sources (S6), and
parsing (P10).

A Kafka topic is the production source (``kafka_job_stream``); a directory of
JSON-lines files is the replayable stand-in used by tests and the bench
(``file_job_stream``), with ``maxFilesPerTrigger`` as the rate limit (X9) in
place of the producer's per-event pause.
"""

from __future__ import annotations

from typing import Optional

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from jobsight.operators.normalize import fill_stream_unknown
from jobsight.schemas import JOB_EVENT

EVENT_FIELDS = [f.name for f in JOB_EVENT.fields if f.name != "event_time"]


def utc_wall_clock(ts) -> Column:
    """A TIMESTAMP instant as its UTC wall-clock TIMESTAMP_NTZ, whatever the
    session time zone: microseconds added to the epoch, so no zone rule (and no
    hour that a zone skips or repeats) takes part."""
    t = F.col(ts) if isinstance(ts, str) else ts
    micros = F.unix_micros(t)
    seconds = (F.pmod(micros, F.lit(86_400_000_000)).cast("decimal(18,0)") / F.lit(1_000_000)).cast("decimal(18,6)")
    return F.lit("1970-01-01").cast("timestamp_ntz") + F.make_dt_interval(
        F.floor(micros / F.lit(86_400_000_000)).cast("int"), F.lit(0), F.lit(0), seconds)


def iso_utc(ts: Column) -> Column:
    """ISO-8601 text of a UTC wall-clock TIMESTAMP_NTZ with microseconds and
    offset, the format of ``datetime.now(timezone.utc).isoformat()``."""
    return F.concat(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("+00:00"))


def to_events(jobs: DataFrame, event_time: Optional[Column] = None,
              limit: Optional[int] = None, keep=(), order_by=None) -> DataFrame:
    """K4: one JSON event (``value``) per row: the 13 event fields plus
    ``event_time`` (now, UTC, unless a column is given). NaN and infinite
    salaries become null. ``limit`` keeps the first n rows in the order of
    ``order_by`` (all columns unless given); ``keep`` columns are passed
    through next to ``value``."""
    src = jobs.orderBy(*(order_by or jobs.columns)).limit(limit) if limit else jobs
    fields = []
    for f in EVENT_FIELDS:
        c = F.col(f) if f in src.columns else F.lit(None).cast("string")
        if f in ("salary_min", "salary_max") and f in src.columns:
            c = F.when(~F.isnan(c) & (F.abs(c) != float("inf")), c)
        fields.append(c.alias(f))
    et = event_time if event_time is not None else iso_utc(utc_wall_clock(F.current_timestamp()))
    return src.select(*keep, F.to_json(F.struct(*fields, et.alias("event_time"))).alias("value"))


def write_events(events: DataFrame, path: str, files: Optional[int] = None) -> None:
    """K4 sink stand-in: JSON lines under ``path`` (one file per partition;
    ``files`` repartitions first so a replay can release them in steps)."""
    out = events.repartition(files) if files else events
    out.write.mode("overwrite").text(path)


def kafka_options(servers: str, topic: str, starting: str = "latest") -> dict:
    """S6 options of the topic reader (as the live job uses them)."""
    return {
        "kafka.bootstrap.servers": servers,
        "subscribe": topic,
        "startingOffsets": starting,
        "failOnDataLoss": "false",
    }


def kafka_job_stream(spark: SparkSession, servers: str, topic: str,
                     max_offsets_per_trigger: Optional[int] = None) -> DataFrame:
    """Raw events from a Kafka topic (needs the spark-sql-kafka package)."""
    r = spark.readStream.format("kafka").options(**kafka_options(servers, topic))
    if max_offsets_per_trigger:
        r = r.option("maxOffsetsPerTrigger", str(max_offsets_per_trigger))
    return r.load()


def write_kafka(events: DataFrame, servers: str, topic: str) -> None:
    """K4 to a topic (batch write of the ``value`` column)."""
    (events.write.format("kafka").option("kafka.bootstrap.servers", servers)
     .option("topic", topic).save())


def file_job_stream(spark: SparkSession, path: str, max_files_per_trigger: Optional[int] = None) -> DataFrame:
    """S6 stand-in: each line of each new file under ``path`` is one event value."""
    r = spark.readStream.format("text")
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", str(max_files_per_trigger))
    return r.load(path)


def parse_events(raw: DataFrame) -> DataFrame:
    """P10: value -> text -> JSON (D8) -> columns, ``event_ts`` parsed from
    ``event_time`` (unparsable -> null, never an error), and null platform /
    keyword / country -> "Unknown". A malformed message becomes an all-null
    row, then "Unknown" in those three columns."""
    job = F.from_json(F.col("value").cast("string"), JOB_EVENT)
    parsed = raw.select(job.alias("job")).select("job.*")
    parsed = parsed.withColumn("event_ts", F.try_to_timestamp(F.col("event_time")))
    return fill_stream_unknown(parsed)
