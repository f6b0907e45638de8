"""Start at latest, restarts, lost segments, offsets a trigger."""

import os

import pytest

from jobsight.streaming import message_log as M


def messages(spark, lo, hi, parts=2):
    return spark.range(lo, hi, numPartitions=parts).selectExpr("concat('m', id) AS value")


class Run:
    """A query over the log that keeps what each micro-batch brought."""

    def __init__(self, spark, path, checkpoint, **options):
        self.batches = []
        frame = M.log_job_stream(spark, path, **options)
        self.query = (frame.writeStream.foreachBatch(lambda df, i: self.batches.append(sorted((r["offset"], r["value"]) for r in df.collect())))
                      .option("checkpointLocation", checkpoint).trigger(processingTime="0 seconds").start())

    def drain(self):
        self.query.processAllAvailable()
        return [r for b in self.batches for r in b]

    def stop(self):
        self.query.stop()


def want(lo, hi):
    return [(i, f"m{i}") for i in range(lo, hi)]


def test_latest_skips_and_a_restart_goes_on(spark, tmp_path):
    path, checkpoint = str(tmp_path / "log"), str(tmp_path / "check")
    assert M.publish(messages(spark, 0, 10), path) == 10
    run = Run(spark, path, checkpoint)
    try:
        assert run.drain() == []
        M.publish(messages(spark, 10, 15), path)
        assert run.drain() == want(10, 15)
    finally:
        run.stop()
    M.publish(messages(spark, 15, 19, 3), path)
    run = Run(spark, path, checkpoint)
    try:
        assert run.drain() == want(15, 19)
    finally:
        run.stop()
    assert [s[0] for s in M.segments(path)] == sorted(s[0] for s in M.segments(path)) and M.log_end(path) == 19


def test_lost_segments(spark, tmp_path):
    path = str(tmp_path / "log")
    for lo in range(0, 12, 4):
        M.publish(messages(spark, lo, lo + 4, 1), path)
    os.remove(f"{path}/{0:020d}-4.jsonl")
    for name in os.listdir(path):
        if name.endswith(".crc"):
            os.remove(f"{path}/{name}")
    run = Run(spark, path, str(tmp_path / "a"), starting="0")
    try:
        assert run.drain() == want(4, 12)
    finally:
        run.stop()
    run = Run(spark, path, str(tmp_path / "b"), starting="0", fail_on_data_loss=True)
    with pytest.raises(Exception, match="are gone"):
        run.drain()
    run = Run(spark, path, str(tmp_path / "c"), starting="earliest")
    try:
        assert run.drain() == want(4, 12)
    finally:
        run.stop()


def test_offsets_a_trigger(spark, tmp_path):
    path, options = str(tmp_path / "log"), {"max_offsets_per_trigger": 3, "progress": str(tmp_path / "progress")}
    M.publish(messages(spark, 0, 8), path)
    run = Run(spark, path, str(tmp_path / "check"), starting="earliest", **options)
    try:
        assert run.drain() == want(0, 8) and [len(b) for b in run.batches if b] == [3, 3, 2]
    finally:
        run.stop()
    M.publish(messages(spark, 8, 12), path)
    run = Run(spark, path, str(tmp_path / "check"), starting="earliest", **options)
    try:
        assert run.drain() == want(8, 12) and [len(b) for b in run.batches if b] == [3, 1]
    finally:
        run.stop()
    with pytest.raises(ValueError):
        M.MessageLogReader({"path": path, "maxOffsetsPerTrigger": "3"})
    assert M.log_end(str(tmp_path / "nothing")) == 0
