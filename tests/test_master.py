"""The bucketed master against merging everything again."""

import random

import pytest
from pyspark.sql import functions as F

from jobsight.operators import master as M
from jobsight.operators.joins import not_yet_ingested
from jobsight.operators.normalize import merge_master
from testkit import rows

SCHEMA = "seq long, title string, company string, pay int"


def batch(spark, seed, n=120):
    r = random.Random(seed)
    return spark.createDataFrame([(seed * 1000 + i, r.choice([None, "a", "b", "c", "d"]), r.choice([None, "x", "y"] + ["c%d" % j for j in range(30)]),
                                   r.choice([None, 1, 2])) for i in range(n)], SCHEMA).repartition(3)


@pytest.fixture
def no_broadcast(spark):
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)


def test_updates_equal_merging_everything(spark, tmp_path, no_broadcast, monkeypatch):
    monkeypatch.setattr(M, "FAN", 4)
    master, whole = M.Master(spark, str(tmp_path / "m"), ["title", "company"], buckets=4), None
    for i in range(6):
        new = batch(spark, i + 1)
        fresh = master.not_yet_ingested(new)
        known = set() if whole is None else {(r["title"], r["company"]) for r in whole.collect()}
        assert sorted(rows(fresh), key=repr) == sorted((t for t in rows(new) if (t[1], t[2]) not in known), key=repr)
        master.update(new, "seq")
        whole = new if whole is None else merge_master(whole, new, ["title", "company"], "seq")
        whole = merge_master(whole.limit(0), whole, ["title", "company"], "seq")
        whole = spark.createDataFrame(whole.collect(), SCHEMA)
        assert sorted(rows(master.read()), key=repr) == sorted(rows(whole), key=repr)
        assert len(M.S.manifest(spark, master.path)["folders"]) < 4


def test_old_rows_are_not_exchanged(spark, tmp_path, no_broadcast):
    master = M.Master(spark, str(tmp_path / "m"), ["title", "company"], buckets=4)
    for i in range(3):
        master.update(batch(spark, i + 1), "seq")
    plan = master.read()._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Exchange" not in plan and "Bucketed: true" in plan
    again = M.Master(spark.newSession(), master.path, ["title", "company"], buckets=4)      # another session reads it
    assert again.read().count() == master.read().count()


def test_single_key_and_misfit(spark, tmp_path):
    master = M.Master(spark, str(tmp_path / "m"), ["title"], buckets=2)
    new = batch(spark, 9)
    assert master.not_yet_ingested(new).count() == new.count()
    master.update(new.limit(0), "seq")
    assert master.read().count() == 0
    master.update(new, "seq")
    got = master.not_yet_ingested(batch(spark, 10).withColumn("title", F.concat("title", "company")))
    want = not_yet_ingested(batch(spark, 10).withColumn("title", F.concat("title", "company")), new, "title")
    assert sorted(rows(got.where("title IS NOT NULL")), key=repr) == sorted(rows(want.where("title IS NOT NULL").select(*new.columns)), key=repr)
    with pytest.raises(ValueError):
        master.update(new.drop("pay"), "seq")
