"""Partitions of the windows' state."""

import json

from jobsight.streaming import live as L
from jobsight.streaming.events import file_job_stream


def test_a_windows_state_has_few_partitions(spark, tmp_path):
    name = "spark.sql.shuffle.partitions"
    own = spark.conf.get(name)
    (tmp_path / "events").mkdir()
    (tmp_path / "events" / "a").write_text('{"platform": "A", "event_time": "2026-01-01T00:00:05+00:00"}\n')
    paths = L.LivePaths(str(tmp_path / "out"), str(tmp_path / "checkpoints"))
    try:
        spark.conf.set(name, "50")
        L.run_until_idle(L.start_live(spark, file_job_stream(spark, str(tmp_path / "events")), paths, available_now=True))
        assert spark.conf.get(name) == "50"
    finally:
        spark.conf.set(name, own)
    told = json.loads((tmp_path / "checkpoints" / "windowed" / "offsets" / "0").read_text().split("\n")[1])
    assert told["conf"][name] == str(L.STATE_PARTITIONS)
    assert [tuple(r)[2:] for r in L.read_windowed_final(spark, paths).collect()] == [("A", 1)]
