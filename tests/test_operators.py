"""Operators: dedup, argmax, heatmap, paging, search, joins, normalisation."""

from pyspark.sql import functions as F

from testkit import SF_SMALL, rows
from jobsight.operators import aggregates as A
from jobsight.operators import filters as W
from jobsight.operators import ordering as T
from jobsight.operators.dedup import dedup_keep_first, dedup_keep_last, dedup_normalized
from jobsight.operators.joins import enrich_with_detail, not_yet_ingested
from jobsight.operators.normalize import merge_master, nullify_na, to_documents
from jobsight.plans.jobs import unified_jobs, unified_jobs_by_union


def test_dedup_first_last_null_keys_equal(spark):
    df = spark.createDataFrame([(1, "a", None, "x"), (2, "a", None, "y"), (3, None, None, "z"),
                                (4, None, None, "w"), (5, "b", "c", "v")], "seq int, t string, c string, v string")
    first = sorted(rows(dedup_keep_first(df, ["t", "c"], "seq")))
    last = sorted(rows(dedup_keep_last(df, ["t", "c"], "seq")))
    assert first == [(1, "a", None, "x"), (3, None, None, "z"), (5, "b", "c", "v")]
    assert last == [(2, "a", None, "y"), (4, None, None, "w"), (5, "b", "c", "v")]


def test_dedup_hot_key_matches_window(spark):
    # one key holds most rows: the aggregate form must still give the window's answer
    df = spark.range(20000).select(
        F.col("id").alias("seq"),
        F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise((F.col("id") % 50).cast("string")).alias("k"),
        (F.col("id") * 7 % 13).alias("v")).repartition(8)
    got = sorted(rows(dedup_keep_last(df, "k", "seq")))
    from pyspark.sql import Window
    w = Window.partitionBy("k").orderBy(F.col("seq").desc())
    want = sorted(rows(df.withColumn("rn", F.row_number().over(w)).where("rn = 1").drop("rn")))
    assert got == want


def test_dedup_normalized_case_insensitive(spark):
    df = spark.createDataFrame([(1, "Dev", "PT A", "java"), (2, "DEV", "pt a", "Java"), (3, "Dev", "PT B", "java")],
                               "seq int, t string, c string, k string")
    assert sorted(r[0] for r in rows(dedup_normalized(df, ["t", "c", "k"], "seq"))) == [1, 3]


def test_merge_master_new_beats_old(spark):
    old = spark.createDataFrame([(9, "a", "x", "old")], "seq int, t string, c string, v string")
    new = spark.createDataFrame([(1, "a", "x", "new"), (2, "b", "y", "new")], "seq int, t string, c string, v string")
    out = sorted(rows(merge_master(old, new, ["t", "c"], "seq")))
    assert out == [(1, "a", "x", "new"), (2, "b", "y", "new")]


def test_first_per_group_ties_and_top_company(spark):
    df = spark.createDataFrame([("ID", "B")] * 2 + [("ID", "A")] * 2 + [("SG", None)] * 3 + [("SG", "Z")],
                               "country string, company_name string")
    out = sorted(rows(A.top_company_per_country(df, 10)))
    assert out == [("ID", "A", 2), ("SG", None, 3)]


def test_heatmap_null_pairs_use_slots(spark):
    data = [("L", "ID")] * 5 + [(None, "ID")] * 4 + [("G", None)] * 3 + [("G", "JP")] * 2 + [("L", "JP")]
    df = spark.createDataFrame(data, "platform string, country string")
    out = A.platform_country_heatmap(df, pairs=3, rows=10)
    # top 3 pairs: (L,ID)=5, (null,ID)=4, (G,null)=3 -> only (L,ID) survives the pivot
    assert out.columns == ["country", "L"]
    assert rows(out) == [("ID", 5)]


def test_paginate_null_and_repeated_keys(spark):
    df = spark.createDataFrame([(None if i % 10 == 0 else i // 7, i) for i in range(1000)], "k int, v int").repartition(7)
    want = sorted(((k is not None, k or 0, v) for k, v in rows(df)))
    got, last = [], None
    for page in range(1, 7):
        own = T.paginate(df, "k", page, 200).collect()
        step = T.next_page(df, "k", last, 200).collect()
        assert own == step
        got += [(r["k"] is not None, r["k"] or 0, r["v"]) for r in own]
        last = own[-1] if own else last
    assert got == want


def test_page_info(spark):
    df = spark.range(1201)
    assert rows(T.page_info(df, 3, 500)) == [(1201, 3, 3, 1000, 1201)]
    assert rows(T.page_info(df.limit(0), 5, 500)) == [(0, 1, 1, 0, 0)]


def test_salary_filters(spark):
    df = spark.createDataFrame([(1, 5e6, None), (2, None, 2e7), (3, None, None), (4, 1e6, 2e6)],
                               "id int, salary_min double, salary_max double")
    assert sorted(r[0] for r in rows(W.salary_at_least(df, 5e6), "id")) == [1, 2]
    assert W.salary_at_least(df, 0).count() == 4
    assert sorted(r[0] for r in rows(W.with_salary(df), "id")) == [4]


def _jobs_frame(spark):
    return spark.createDataFrame([
        (1, "Data Engineer", "PT Data", "<p>SQL &amp; Spark</p>", "Glints", "Indonesia", 1e7, 2e7),
        (2, "QA Engineer", "Éclair Ltd", "Python", "Indeed", None, None, None),
        (3, "Web Developer", None, "remote work", None, "Japan", 5e6, 6e6),
        (4, "Data Analyst", "The Analytics Co", None, "LinkedIn", "Japan", None, None),
    ], "id int, job_title string, company_name string, skills string, platform string, country string, "
       "salary_min double, salary_max double")


def test_text_search(spark):
    j = _jobs_frame(spark)
    ids = lambda q: sorted(r[0] for r in rows(W.text_search(j, q), "id"))
    assert ids("engineer") == [1, 2]
    assert ids("engineer -qa") == [1]
    assert ids('"data engineer"') == [1]
    assert ids("eclair") == [2]            # accents folded
    assert ids("the") == []                # stop word only
    assert ids("-qa") == []                # exclusion only selects nothing
    assert ids("spark analyst") == [1, 4]


def test_search_jobs_modes(spark):
    j = _jobs_frame(spark)
    plats = ["Glints", "Indeed", "LinkedIn"]
    # documents: a full selection means no filter, so the null platform stays
    docs = W.search_jobs(j, platforms=plats, all_platforms=plats)
    assert docs.count() == 4
    # table: plain IN filters, nulls never match, empty selection -> no rows
    tab = W.search_jobs(j, platforms=plats, countries=["Indonesia", "Japan"], mode="table")
    assert sorted(r[0] for r in rows(tab, "id")) == [1, 4]
    assert W.search_jobs(j, platforms=[], countries=["Japan"], mode="table").count() == 0
    regex = W.search_jobs(j, query="DATA|web", platforms=plats + [None], countries=["Indonesia", "Japan"],
                          mode="table")
    assert sorted(r[0] for r in rows(regex, "id")) == [1, 4]


def test_not_yet_ingested_and_enrich(spark):
    new = spark.createDataFrame([(1, "java"), (2, "go"), (3, None), (4, "rust")], "id int, keyword string")
    done = spark.createDataFrame([("java",), (None,), ("go",)], "keyword string")
    assert sorted(r[0] for r in rows(not_yet_ingested(new, done, "keyword"), "id")) == [3, 4]
    listing = spark.createDataFrame([(1, "a", "L1"), (2, "b", "L2")], "id long, job_position string, location string")
    detail = spark.createDataFrame([(1, "D1")], "id long, location string")
    out = rows(enrich_with_detail(listing, detail))
    assert out == [(1, "a", "L1", "D1")]


def test_fused_normalisation_equals_union(spark):
    a = unified_jobs(spark, SF_SMALL)
    b = unified_jobs_by_union(spark, SF_SMALL)
    assert a.count() == b.count()
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_nullify_na_and_documents(spark):
    df = spark.createDataFrame([("NA", float("nan"), 1.0), ("x", float("inf"), 3.0), ("None", None, 2.0)],
                               "s string, salary_min double, salary_max double")
    n = rows(nullify_na(df, ["s"]), "s")
    assert n == [(None,), ("x",), (None,)]
    docs = to_documents(df, imported_at=F.lit(None).cast("timestamp"))
    sal = rows(docs.select("salary.min", "salary.max", "salary.avg"))
    assert sal == [(None, 1.0, None), (None, 3.0, None), (None, 2.0, None)]
    ok = to_documents(spark.createDataFrame([(2.0, 4.0)], "salary_min double, salary_max double"))
    assert rows(ok.select("salary.avg")) == [(3.0,)]


def test_aggregate_edge_cases(spark):
    empty = spark.createDataFrame([], "platform string, salary_min double, salary_max double")
    assert rows(A.salary_coverage(empty)) == [(0, 0, None)]
    df = spark.createDataFrame([("A", 1.005, 1.005), ("A", 1.0, 1.0)], "keyword string, salary_min double, salary_max double")
    out = rows(A.salary_by_role(df))
    assert out == [("A", 2, 1.0, 1.0, 1.0)]   # 1.0025 -> 1.0 (half-up at 2 decimals)


def test_materialized_jobs_table_equals_lazy(spark):
    from jobsight.plans.jobs import jobs_table, materialize_jobs
    t = jobs_table(spark, materialize_jobs(spark, SF_SMALL))
    lazy = unified_jobs(spark, SF_SMALL)
    assert t.columns == lazy.columns
    assert t.exceptAll(lazy).count() == 0 and lazy.exceptAll(t).count() == 0


def test_sql_surface_views(spark):
    from jobsight.plans.jobs import register_views
    register_views(spark, SF_SMALL)
    by_sql = sorted(rows(spark.sql("SELECT platform, count(*) AS total_jobs FROM jobs GROUP BY platform")))
    assert by_sql == sorted(rows(A.jobs_by_platform(unified_jobs(spark, SF_SMALL))))
    n = spark.sql("SELECT count(*) FROM job_documents WHERE salary.avg IS NOT NULL").collect()[0][0]
    assert n == W.with_salary(unified_jobs(spark, SF_SMALL)).count()


def test_merge_sources_and_event_limit(spark):
    import pytest
    from jobsight.operators.normalize import merge_sources
    from jobsight.streaming.events import to_events
    with pytest.raises(ValueError):
        merge_sources([None, None])
    a = spark.createDataFrame([("Dev", "L")], "job_title string, platform string")
    assert merge_sources([a, None, a]).count() == 2
    jobs = spark.range(10).select(F.col("id").cast("string").alias("job_title"))
    assert to_events(jobs, limit=3).count() == 3


def test_text_search_phrase_and_accents(spark):
    j = _jobs_frame(spark)
    ids = lambda q: sorted(r[0] for r in rows(W.text_search(j, q), "id"))
    assert ids('"analytics co"') == [4]      # phrase over the raw text
    assert ids("ÉCLAIR") == [2]              # query folded like the text
    assert ids("sql") == [1]                 # token inside markup
    assert ids("sq") == []                   # whole tokens only


def test_blocked_pages_and_selector_boundaries(spark):
    from jobsight.operators import pages as PG
    pages = spark.createDataFrame([
        (1, "https://x.example/jobs?page=3", "<html>Please complete the CAPTCHA</html>"),
        (2, "https://x.example/jobs", "<html>nothing here</html>"),
        (3, "https://x.example/jobs?page=2", "<html>nothing here</html>"),
        (4, "https://x.example/jobs", '<div class="job_seen_beacon big">card</div>'),
    ], "page_id int, url string, html string")
    fams = list(PG.INDEED_CARD_FAMILIES) + [PG.INDEED_SLIDER_ITEM]
    p = pages.select("page_id", "url", "html", PG.card_count("html", fams).alias("n_cards"),
                     PG.page_number("url").alias("page_no"))
    assert sorted(r[0] for r in rows(W.blocked_pages(p), "page_id")) == [1, 2]
    counts = spark.createDataFrame([
        (1, '<a class="x tapItem y" href="#">a</a><a class="tapItemX">b</a><div class="jobsearch-SerpJobCard">c</div>'),
    ], "page_id int, html string")
    out = rows(PG.selector_counts(counts))
    assert out == [(1, 1, 1, 0, 0)]


def test_card_with_a_long_opening_tag(spark):
    from jobsight.operators import pages as PG

    link = '<a data-link="/rc/clk?q=' + "x" * 900 + '" class="tapItem"><h2 class="title">%s</h2></a>'
    pages = spark.createDataFrame(
        [(1, "https://x.example/jobs", "<p>top</p>" + link % "One" + '<a class="tapItem"><h2 class="title">Two</h2></a>' + link % "Three")],
        "page_id int, url string, html string")
    assert rows(PG.card_records(pages, "Indeed"), "card_no", "job_title") == [(0, "One"), (1, "Two"), (2, "Three")]
