"""Streaming: event parsing, per-batch live tables, late data, recovery."""

import datetime as dt
import json
import os

from pyspark.sql import functions as F

from testkit import rows
from jobsight.operators.filters import stream_is_live
from jobsight.streaming import live as L
from jobsight.streaming.events import file_job_stream, parse_events, to_events


def _event(platform, t, keyword="k", title="Dev", **extra):
    e = {"job_title": title, "platform": platform, "keyword": keyword, "event_time": t, "salary_min": 5}
    e.update(extra)
    return json.dumps(e)


def _write_lines(path, lines):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w", encoding="utf-8") as f:
        f.write("\n".join(lines) + "\n")


def test_parse_events_golden(spark):
    raw = spark.createDataFrame([
        (_event("L", "2026-01-01T10:00:30.123456+00:00", title="Dev"),),
        ("not json at all",),
        (_event(None, "yesterday", keyword=None),),
    ], "value string")
    out = parse_events(raw).select("job_title", "platform", "keyword", "country", "salary_min",
                                   F.col("event_ts").cast("timestamp_ntz").alias("ts")).collect()
    assert tuple(out[0]) == ("Dev", "L", "k", "Unknown", 5.0, dt.datetime(2026, 1, 1, 10, 0, 30, 123456))
    assert tuple(out[1]) == (None, "Unknown", "Unknown", "Unknown", None, None)
    assert tuple(out[2])[:4] == ("Dev", "Unknown", "Unknown", "Unknown") and out[2]["ts"] is None


def test_to_events_roundtrip_and_nan(spark):
    jobs = spark.createDataFrame([("Dev", "L", float("nan"), 2.0)],
                                 "job_title string, platform string, salary_min double, salary_max double")
    ev = to_events(jobs, event_time=F.lit("2026-01-01T00:00:00+00:00"))
    back = parse_events(ev).select("job_title", "platform", "salary_min", "salary_max", "event_time").collect()[0]
    assert tuple(back) == ("Dev", "L", None, 2.0, "2026-01-01T00:00:00+00:00")
    stamped = parse_events(to_events(jobs)).select("event_ts").collect()[0][0]
    assert stamped is not None


def _run(spark, src, paths, max_files=None):
    qs = L.start_live(spark, file_job_stream(spark, src, max_files), paths, available_now=True)
    L.run_until_idle(qs, 300)


def test_live_tables_hold_last_batch_only(spark, tmp_path):
    src = str(tmp_path / "in")
    _write_lines(f"{src}/a.json", [_event("A", "2026-01-01T10:00:00+00:00")] * 3)
    _write_lines(f"{src}/b.json", [_event("B", "2026-01-01T10:01:00+00:00")] * 2)
    paths = L.LivePaths(str(tmp_path / "out"), str(tmp_path / "ckpt"))
    _run(spark, src, paths, max_files=1)
    # two batches ran; the live counts show only the second
    assert rows(L.read_live(spark, paths, "platform_counts")) == [("B", 2)]
    # an empty batch leaves the tables as they are (K5)
    writer = L.live_batch_writer(paths)
    writer(spark.createDataFrame([], parse_events(spark.createDataFrame([], "value string")).schema), 99)
    assert rows(L.read_live(spark, paths, "platform_counts")) == [("B", 2)]
    summary = {r["metric"]: r["value"] for r in L.read_summary(spark, paths).collect()}
    assert summary["platform_counts"] == 1 and summary["recent_jobs"] == 2
    windows = sorted(rows(L.read_windowed_final(spark, paths), "platform", "jobs_per_minute"))
    assert windows == [("A", 3), ("B", 2)]


def test_late_rows_are_dropped_after_watermark(spark, tmp_path):
    src = str(tmp_path / "in")
    _write_lines(f"{src}/1.json", [_event("A", f"2026-01-01T10:0{m}:00+00:00") for m in range(6)])
    _write_lines(f"{src}/2.json", [_event("A", "2026-01-01T10:10:00+00:00")])
    _write_lines(f"{src}/3.json", [_event("A", "2026-01-01T10:11:00+00:00")])
    _write_lines(f"{src}/4.json", [_event("A", "2026-01-01T10:01:30+00:00")])   # late by far
    paths = L.LivePaths(str(tmp_path / "out"), str(tmp_path / "ckpt"))
    _run(spark, src, paths, max_files=1)
    final = {r["window_start"].strftime("%H:%M"): r["jobs_per_minute"]
             for r in L.read_windowed_final(spark, paths).collect()}
    assert final["10:01"] == 1          # the late 10:01:30 row was not counted
    assert final["10:10"] == 1 and final["10:11"] == 1


def test_restart_from_checkpoint_processes_only_new_files(spark, tmp_path):
    src = str(tmp_path / "in")
    paths = L.LivePaths(str(tmp_path / "out"), str(tmp_path / "ckpt"))
    _write_lines(f"{src}/a.json", [_event("A", "2026-01-01T10:00:00+00:00")] * 2)
    _run(spark, src, paths)
    _write_lines(f"{src}/b.json", [_event("C", "2026-01-01T10:00:10+00:00")])
    _run(spark, src, paths)             # same checkpoint: resumes after a.json
    assert rows(L.read_live(spark, paths, "platform_counts")) == [("C", 1)]
    final = sorted(rows(L.read_windowed_final(spark, paths), "platform", "jobs_per_minute"))
    assert final == [("A", 2), ("C", 1)]


def test_stream_is_live_and_total(spark):
    now = dt.datetime(2026, 1, 1, 12, 0, 0, tzinfo=dt.timezone.utc)
    df = spark.createDataFrame([("2026-01-01T11:59:00+00:00",), ("2026-01-01T11:50:00+00:00",), ("garbage",), (None,),
                                ("2026-01-01T11:59:30Z",), ("2026-01-01T11:59:30",)], "last_updated string")
    got = [r[0] for r in stream_is_live(df, now=F.lit(now)).select("is_live").collect()]
    assert got == [True, False, False, False, True, False]
    counts = spark.createDataFrame([("A", 3), ("B", 4)], "platform string, stream_count long")
    from jobsight.operators.aggregates import stream_total
    assert rows(stream_total(counts)) == [(7,)]


def test_kafka_source_options():
    from jobsight.streaming.events import kafka_options
    assert kafka_options("broker:9092", "it-jobs") == {
        "kafka.bootstrap.servers": "broker:9092", "subscribe": "it-jobs",
        "startingOffsets": "latest", "failOnDataLoss": "false"}


def test_outputs_independent_of_session_time_zone(spark):
    from jobsight.streaming.events import utc_wall_clock
    old = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "Asia/Jakarta")
        raw = spark.createDataFrame([(_event("L", "2026-01-01T10:00:30+00:00"),)], "value string")
        ts = parse_events(raw).select(utc_wall_clock("event_ts")).collect()[0][0]
        assert ts == dt.datetime(2026, 1, 1, 10, 0, 30)
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)


def test_events_table_as_stream_source(spark, tmp_path):
    from testkit import SF_SMALL
    from jobsight.sources import testbed as TB
    values = TB.job_event_values_from(TB.job_event_rows_from(TB.events_stream(spark, SF_SMALL)))
    paths = L.LivePaths(str(tmp_path / "out"), str(tmp_path / "ckpt"))
    L.run_until_idle(L.start_live(spark, values, paths, available_now=True), 300)
    total = L.read_live(spark, paths, "platform_counts").agg(F.sum("stream_count")).collect()[0][0]
    assert total == spark.read.parquet(f"{SF_SMALL}/events.parquet").count()
