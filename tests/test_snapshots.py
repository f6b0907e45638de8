"""Replaced tables are whole at any time; the window log writes what a batch updates."""

import os
import random
import threading

import pytest
from pyspark.sql import functions as F

from jobsight.sinks import snapshots as S
from jobsight.sinks.files import replace_documents
from jobsight.sources.files import read_documents
from testkit import rows


def version(spark, n, size=50):
    return spark.range(size, numPartitions=3).select("id", F.lit(n).alias("v"))


def seen(spark, path):
    got = rows(S.read_table(spark, path), "v")
    assert len(got) == 50 and len(set(got)) == 1, "a mixed or partial version"
    return got[0][0]


def test_versions_and_readers(spark, tmp_path):
    path = str(tmp_path / "t")
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        S.read_table(spark, path)
    assert S.replace_table(version(spark, 1), path) == 1 and seen(spark, path) == 1
    begun = S.read_table(spark, path)
    S.replace_table(version(spark, 2), path)
    S.replace_table(S.read_table(spark, path).withColumn("v", F.col("v") + 1), path)      # from itself
    assert seen(spark, path) == 3 and begun.count() == 50               # a reader that had begun ends
    for n in range(4, 9):
        S.replace_table(version(spark, n), path)
    assert len(os.listdir(f"{path}/data")) == S.KEEP and S.versions(spark, path) == [6, 7, 8]


def test_a_writer_that_dies_leaves_the_version_before(spark, tmp_path):
    path = str(tmp_path / "t")
    S.replace_table(version(spark, 1), path)

    def dies(df, folder):
        df.limit(7).write.parquet(folder)
        raise KeyboardInterrupt

    def dies_before_rename(spark, path, content):
        raise KeyboardInterrupt

    with pytest.raises(KeyboardInterrupt):
        S.replace_table(version(spark, 2), path, dies)
    assert seen(spark, path) == 1 and len(os.listdir(f"{path}/data")) == 2
    kept, S.commit = S.commit, dies_before_rename
    try:
        with pytest.raises(KeyboardInterrupt):
            S.replace_table(version(spark, 2), path)
    finally:
        S.commit = kept
    assert seen(spark, path) == 1
    S.replace_table(version(spark, 3), path)
    assert seen(spark, path) == 3 and len(os.listdir(f"{path}/data")) == 2     # leftovers are gone


def test_readers_beside_a_writer(spark, tmp_path):
    path, found, stop = str(tmp_path / "t"), [], threading.Event()
    S.replace_table(version(spark, 0), path)

    def read():
        while not stop.is_set():
            try:
                found.append(seen(spark, path))
            except Exception as e:                                      # noqa: BLE001
                found.append(e)
    reader = threading.Thread(target=read)
    reader.start()
    for n in range(1, 6):
        S.replace_table(version(spark, n), path)
    stop.set()
    reader.join()
    assert found and all(isinstance(x, int) for x in found) and found == sorted(found)


def test_documents_are_replaced_whole(spark, tmp_path):
    docs = spark.createDataFrame([("Dev", "Glints", "ID", "k"), ("QA", "Indeed", "SG", "k")],
                                 "job_title string, platform string, country string, keyword string")
    path = str(tmp_path / "docs")
    replace_documents(docs.limit(1), path)
    replace_documents(docs, path)
    assert sorted(rows(read_documents(spark, path), "job_title")) == [("Dev",), ("QA",)]
    folder = S.current_folder(spark, path)
    assert {d for d in os.listdir(folder) if d.startswith("platform")} == {"platform=Glints", "platform=Indeed"}


def test_window_log(spark, tmp_path):
    log, r, want = S.WindowLog(spark, str(tmp_path / "w")), random.Random(3), {}
    schema = "window_start string, window_end string, platform string, jobs_per_minute long"
    for batch_id in range(S.FAN * 2 + 3):
        updated = {(f"{m:02d}", p): r.randrange(99) for m in range(batch_id, batch_id + 3) for p in "ab" if r.random() < .7}
        data = [(m, m + "e", p, n) for (m, p), n in updated.items()]
        log.append(spark.createDataFrame(data, schema), batch_id)
        want.update(updated)
        runs = S.manifest(spark, log.path)["runs"]
        assert len(runs) < 2 * S.FAN
        if runs[-1]["level"] == 0:                                       # a batch writes its own windows
            assert spark.read.parquet(f"{log.path}/data/{runs[-1]['folder']}").count() == len(data)
        log.append(spark.createDataFrame([("99", "x", "replayed", 1)], schema), batch_id)
    got = {(a, c): n for a, _, c, n in rows(log.read(), "window_start", "window_end", "platform", "jobs_per_minute")}
    assert got == want and {x["level"] for x in runs} == {0, 1}


def test_counts_taken_while_writing(spark, tmp_path):
    from jobsight.operators.aggregates import integration_report
    from jobsight.sinks.observed import write_documents_observed

    r = random.Random(8)
    data = [(r.choice(["Glints", "Indeed", "LinkedIn"]), r.choice(["Indonesia", "Japan", "Singapore"]), r.choice([None, 1.0]), "k") for _ in range(400)]
    schema = "platform string, country string, salary_min double, keyword string"
    for extra in ([], [("Another board", "Japan", 1.0, "k"), (None, None, None, None)]):
        docs = spark.createDataFrame(data + extra, schema).repartition(5)
        counts = write_documents_observed(docs, str(tmp_path / f"t{len(extra)}"))
        assert (counts.total, counts.elsewhere) == (len(data + extra), len(extra))
        assert sorted(rows(counts.report(spark)), key=repr) == sorted(rows(integration_report(docs)), key=repr)
        assert spark.read.parquet(counts.path).count() == counts.total
    empty = write_documents_observed(spark.createDataFrame([], schema), str(tmp_path / "empty"))
    assert (empty.total, rows(empty.report(spark))) == (0, [("salary", "with_salary", 0, None)])
