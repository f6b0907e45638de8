"""Plan-shape checks: the physical properties the operators are built for."""

from pyspark.sql import functions as F

from testkit import SF_SMALL
from jobsight.operators import aggregates as A
from jobsight.operators import filters as W
from jobsight.operators.dedup import dedup_keep_first
from jobsight.plans.jobs import cached_raw_jobs, unified_jobs


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def optimized(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_salary_parser_pruned_when_unused(spark):
    p = plan(A.jobs_by_platform(unified_jobs(spark, SF_SMALL)))
    assert "SPARK_PARTITION_ID" not in p and "_s_txt" not in p


def test_salary_filter_stays_above_parser(spark):
    df = W.with_salary(unified_jobs(spark, SF_SMALL))
    o = optimized(df)
    # the filter references the parsed columns, never the parser's expressions
    filters = [line for line in o.split("\n") if "Filter" in line]
    assert filters and all("regexp" not in line and "_s_txt" not in line for line in filters)


def test_scans_read_only_needed_columns(spark):
    p = plan(A.salary_by_role(unified_jobs(spark, SF_SMALL)))
    assert "o_totalprice" not in p and "o_orderstatus" not in p and "c_acctbal" not in p
    assert "c_name" not in p                   # company is not needed for salary by role


def test_dedup_is_an_aggregate_not_a_window(spark):
    df = spark.range(1000).select((F.col("id") % 7).alias("k"), F.col("id").alias("seq"))
    p = plan(dedup_keep_first(df, "k", "seq"))
    assert "Window" not in p and "partial_min" in p


def test_top_k_is_take_ordered(spark):
    p = plan(A.job_demand(unified_jobs(spark, SF_SMALL), 15))
    assert "TakeOrderedAndProject" in p


def test_nation_is_broadcast_and_orders_probe(spark):
    p = plan(cached_raw_jobs(spark, SF_SMALL))
    assert "BroadcastHashJoin" in p
    # orders is never the broadcast (build) side
    build_sides = [seg for seg in p.split("BroadcastExchange")[1:]]
    assert all("o_orderkey" not in seg.split("Scan")[1][:200] for seg in build_sides if "Scan" in seg)


def test_platform_filter_prunes_document_partitions(spark, tmp_path):
    from jobsight.plans.jobs import job_documents
    from jobsight.sinks.files import write_documents
    from jobsight.sources.files import read_documents
    path = str(tmp_path / "docs")
    write_documents(job_documents(spark, SF_SMALL), path)
    p = plan(read_documents(spark, path).where(F.col("platform") == "Glints").select("job_title"))
    assert "PartitionFilters: [isnotnull(platform" in p and "(platform" in p and "Glints" in p


def test_no_round_robin_exchange(spark):
    """No registered batch query shuffles its input only to spread it."""
    from __spark_entry__ import queries

    for name in ("p01_normalize_glints", "p12_flatten_search_hits", "j02_enrich_with_detail", "f08_strip_html", "p10_parse_events",
                 "w07_text_search_documents", "p14_card_records"):
        key = name if name in queries() else next(k for k in queries() if k.startswith(name[:4]))
        plan = queries()[key](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert "RoundRobin" not in plan, name


def test_integration_report_reads_its_input_once(spark):
    from jobsight.operators.aggregates import integration_report

    path = "/root/testdata/sf0.001/orders.parquet"
    jobs = spark.read.parquet(path).selectExpr("o_orderstatus AS platform", "o_orderpriority AS country", "o_totalprice AS salary_min")
    plan = integration_report(jobs)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("parquet") == 1
