"""Joins that several jobs write take no table through the driver."""

from jobsight.sources.testbed import raw_jobs
from testkit import SF_SMALL


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_customers_of_repeated_joins_are_no_broadcast(spark):
    once, many = raw_jobs(spark, SF_SMALL), raw_jobs(spark, SF_SMALL, many=True)
    assert _plan(many).count("BroadcastHashJoin") == 1 and "SortMergeJoin" in _plan(many)       # the nations'
    assert sorted(once.collect(), key=repr) == sorted(many.collect(), key=repr)


def test_source_files_are_written_without_a_broadcast_of_customers(spark, monkeypatch, tmp_path):
    from jobsight.plans import queries_io as Q

    seen = []
    monkeypatch.setattr(Q, "write_csv", lambda df, path: seen.append(_plan(df)))
    monkeypatch.setattr(Q, "_once", lambda spark, sf_dir, name, write: write(str(tmp_path / name)))
    Q._source_files(spark, SF_SMALL)
    assert len(seen) == 5 and all("SortMergeJoin" in p for p in seen)
