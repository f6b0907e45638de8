"""Batch queries over the unified jobs table: aggregations (A*), filters (W*),
windows-as-aggregates (N*), ordering (T*) and set operations (U*).

Each builder reads the driver tables through ``unified_jobs`` (one scan of
orders/customer/nation); each oracle is DuckDB SQL over the same tables.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from jobsight.functions import default_text
from jobsight.operators import aggregates as A
from jobsight.operators import filters as W
from jobsight.operators import ordering as T
from jobsight.operators.dedup import dedup_keep_first, dedup_keep_last, dedup_normalized
from jobsight.operators.master import Master
from jobsight.operators.normalize import flatten_documents, merge_master
from jobsight.operators.page_index import PageIndex
from jobsight.plans.catalog import register
from jobsight.plans.jobs import cached_raw_jobs, cleaned_jobs, job_documents, jobs_index, unified_jobs, unified_jobs_by_union
from jobsight.plans.oracle import JOB_COLS, docs_cte, money, q, strip, top, with_jobs
from jobsight.schemas import PLATFORMS, UNDISCLOSED_COMPANY
from jobsight.session import read_table, scratch_path
from jobsight.sinks.observed import write_documents_observed
from jobsight.sources.testbed import source_frame


def _jobs(spark, sf_dir):
    return unified_jobs(spark, sf_dir)


def _table(spark, sf_dir):
    return cleaned_jobs(spark, sf_dir)


def _docs(spark, sf_dir):
    return flatten_documents(job_documents(spark, sf_dir))


def _count_sql(key, name="total_jobs", n=None, where=""):
    return with_jobs(f"SELECT {key}, count(*) AS {name} FROM jobs {where} GROUP BY {key} "
                     f"{top(name, key, n=n)}")


# --- A1-A6: the batch job's aggregates and the dashboard's counts -------------------

@register("a01_job_demand", _count_sql("keyword"))
def a01_job_demand(spark, sf_dir):
    return A.job_demand(_jobs(spark, sf_dir))


@register("a01_job_demand_top15", _count_sql("keyword", n=15))
def a01_job_demand_top15(spark, sf_dir):
    return A.job_demand(_jobs(spark, sf_dir), 15)


_SALARY_BY_ROLE = f"""
SELECT keyword, count(*) AS total_jobs_with_salary,
  {money('avg(salary_min)')} AS avg_salary_min,
  {money('avg(salary_max)')} AS avg_salary_max,
  {money('avg((salary_min + salary_max) / 2)')} AS avg_salary_overall
FROM jobs WHERE salary_min IS NOT NULL AND salary_max IS NOT NULL
GROUP BY keyword"""


@register("a02_salary_by_role", with_jobs(_SALARY_BY_ROLE))
def a02_salary_by_role(spark, sf_dir):
    return A.salary_by_role(_jobs(spark, sf_dir))


@register("a02_salary_by_role_top10", with_jobs(
    f"SELECT * FROM ({_SALARY_BY_ROLE}) s {top('avg_salary_overall', 'keyword', n=10)}"))
def a02_salary_by_role_top10(spark, sf_dir):
    return A.salary_by_role(_jobs(spark, sf_dir), 10)


@register("a03_jobs_by_platform", _count_sql("platform"))
def a03_jobs_by_platform(spark, sf_dir):
    return A.jobs_by_platform(_jobs(spark, sf_dir))


@register("a04_jobs_by_country", _count_sql("country"))
def a04_jobs_by_country(spark, sf_dir):
    return A.jobs_by_country(_jobs(spark, sf_dir))


@register("a04_jobs_by_country_top10", _count_sql("country", n=10))
def a04_jobs_by_country_top10(spark, sf_dir):
    return A.jobs_by_country(_jobs(spark, sf_dir), 10)


@register("a05_jobs_by_type", _count_sql("job_type"))
def a05_jobs_by_type(spark, sf_dir):
    return A.jobs_by_type(_jobs(spark, sf_dir))


@register("a06_top_companies", _count_sql("company_name", n=10, where="WHERE company_name IS NOT NULL"))
def a06_top_companies(spark, sf_dir):
    return A.top_companies(_jobs(spark, sf_dir), 10)


# --- A7: heatmap ---------------------------------------------------------------------

def _heatmap_sql():
    cells = ", ".join(f'coalesce(max(CASE WHEN platform = {q(p)} THEN n END), 0) AS "{p}"'
                      for p in PLATFORMS)
    total = " + ".join(f'"{p}"' for p in PLATFORMS)
    return with_jobs(
        f"SELECT * FROM grid ORDER BY ({total}) DESC, country ASC LIMIT 10",
        "pairs AS (SELECT platform, country, count(*) AS n FROM jobs GROUP BY platform, country)",
        f"kept AS (SELECT * FROM pairs {top('n', 'platform', 'country', n=50)})",
        f"grid AS (SELECT country, {cells} FROM kept WHERE platform IS NOT NULL "
        f"AND country IS NOT NULL GROUP BY country)",
    )


@register("a07_platform_country_heatmap", _heatmap_sql())
def a07_platform_country_heatmap(spark, sf_dir):
    return A.platform_country_heatmap(_jobs(spark, sf_dir), 50, 10)


# --- A8-A18 over documents ------------------------------------------------------------

@register("a08_salary_by_platform", with_jobs(
    f"SELECT platform, {money('avg(salary_min)')} AS avg_min, {money('avg(salary_max)')} AS avg_max, "
    f"count(*) AS count FROM docs WHERE salary_avg IS NOT NULL GROUP BY platform", docs_cte()))
def a08_salary_by_platform(spark, sf_dir):
    return A.salary_by_platform(_docs(spark, sf_dir))


@register("a09_top_keywords", _count_sql("keyword", "count", n=20))
def a09_top_keywords(spark, sf_dir):
    return A.top_keywords(_jobs(spark, sf_dir), 20)


@register("a09_top_keywords_top5", _count_sql("keyword", "count", n=5))
def a09_top_keywords_top5(spark, sf_dir):
    return A.top_keywords(_jobs(spark, sf_dir), 5)


@register("a10_top_paying_locations", with_jobs(
    f"SELECT * FROM (SELECT location, {money('avg(salary_avg)')} AS avg_salary, count(*) AS job_count "
    f"FROM docs WHERE salary_avg IS NOT NULL GROUP BY location) g WHERE job_count >= 2 "
    f"{top('avg_salary', 'location', n=15)}", docs_cte()))
def a10_top_paying_locations(spark, sf_dir):
    return A.top_paying_locations(_docs(spark, sf_dir), 2, 15)


@register("a11_top_company_per_country", with_jobs(
    f"SELECT country, top_company, job_count FROM best {top('job_count', 'country', n=10)}",
    "pairs AS (SELECT country, company_name, count(*) AS n FROM jobs GROUP BY country, company_name)",
    "ranked AS (SELECT *, row_number() OVER (PARTITION BY country ORDER BY n DESC, "
    "company_name ASC NULLS FIRST) AS rn FROM pairs)",
    "best AS (SELECT country, company_name AS top_company, n AS job_count FROM ranked WHERE rn = 1)"))
def a11_top_company_per_country(spark, sf_dir):
    return A.top_company_per_country(_jobs(spark, sf_dir), 10)


@register("a12_experience_distribution", _count_sql("experience", "count", n=15))
def a12_experience_distribution(spark, sf_dir):
    return A.experience_distribution(_jobs(spark, sf_dir), 15)


@register("a13_platform_share", with_jobs(
    "SELECT platform, count, CAST(count AS DOUBLE) * 100.0 / sum(count) OVER () AS pct "
    "FROM (SELECT platform, count(*) AS count FROM jobs GROUP BY platform) g"))
def a13_platform_share(spark, sf_dir):
    return A.platform_share(_jobs(spark, sf_dir))


@register("a14_top_countries", _count_sql("country", "count", n=5))
def a14_top_countries(spark, sf_dir):
    return A.top_countries(_jobs(spark, sf_dir), 5)


@register("a15_salary_stats", with_jobs(
    f"SELECT {money('avg(salary_avg)')} AS avg_salary, min(salary_min) AS min_salary, "
    f"max(salary_max) AS max_salary FROM docs WHERE salary_avg IS NOT NULL", docs_cte()))
def a15_salary_stats(spark, sf_dir):
    return A.salary_stats(_docs(spark, sf_dir))


_COVERAGE = ("SELECT count(salary_min) AS with_salary, count(*) AS total, "
             "CAST(count(salary_min) AS DOUBLE) * 100.0 / count(*) AS pct FROM jobs")


@register("a16_salary_coverage", with_jobs(_COVERAGE))
def a16_salary_coverage(spark, sf_dir):
    return A.salary_coverage(_jobs(spark, sf_dir))


@register("a17_dashboard_kpis", with_jobs(
    f"""SELECT total_jobs, jobs_with_salary,
  CAST(jobs_with_salary AS DOUBLE) * 100.0 / total_jobs AS salary_pct,
  {money('(amin + amax) / 2.0')} AS avg_salary, top_platform, top_platform_count,
  CAST(top_platform_count AS DOUBLE) * 100.0 / total_jobs AS top_platform_pct
FROM (SELECT count(*) AS total_jobs, count(salary_min) AS jobs_with_salary,
        avg(CASE WHEN salary_min IS NOT NULL AND salary_max IS NOT NULL THEN salary_min END) AS amin,
        avg(CASE WHEN salary_min IS NOT NULL AND salary_max IS NOT NULL THEN salary_max END) AS amax
      FROM jobs) t,
     (SELECT platform AS top_platform, count(*) AS top_platform_count FROM jobs
      GROUP BY platform {top('count(*)', 'platform', n=1)}) p"""))
def a17_dashboard_kpis(spark, sf_dir):
    return A.dashboard_kpis(_jobs(spark, sf_dir))


_REPORT = with_jobs(
    f"""SELECT 'platform' AS section, platform AS item, count(*) AS count, CAST(NULL AS DOUBLE) AS pct
FROM jobs GROUP BY platform
UNION ALL
SELECT * FROM (SELECT 'country' AS section, country AS item, count(*) AS count, CAST(NULL AS DOUBLE) AS pct
  FROM jobs GROUP BY country {top('count', 'item', n=5)})
UNION ALL
SELECT 'salary' AS section, 'with_salary' AS item, with_salary AS count, pct FROM ({_COVERAGE}) c""")


@register("a18_integration_report", _REPORT)
def a18_integration_report(spark, sf_dir):
    return A.integration_report(_jobs(spark, sf_dir), 5)


@register("a18_report_while_writing", _REPORT)
def a18_report_while_writing(spark, sf_dir):
    """The same report from the counts that the clean write takes."""
    return write_documents_observed(_jobs(spark, sf_dir), scratch_path(spark, "observed")).report(spark, 5)


def _glints_dedup(spark, sf_dir):
    """Glints cards with the scraper's company default, deduplicated by the
    lower-cased (title, company, keyword) key, first card wins (N4)."""
    g = source_frame(cached_raw_jobs(spark, sf_dir), "Glints")
    g = g.withColumn("Nama Perusahaan", default_text(F.col("`Nama Perusahaan`"), UNDISCLOSED_COMPANY))
    return dedup_normalized(g, ["Judul Posisi", "Nama Perusahaan", "Keyword"], "job_id")


_GLINTS_DEDUP_CTES = (
    f"g AS (SELECT job_id, job_title AS \"Judul Posisi\", "
    f"coalesce({strip('company_name')}, {q(UNDISCLOSED_COMPANY)}) AS \"Nama Perusahaan\", "
    f"location AS \"Lokasi\", job_type_raw AS \"Tipe Pekerjaan\", experience_raw AS \"Pengalaman\", "
    f"education_raw AS \"Pendidikan\", salary_raw AS \"Gaji\", post_date_raw AS \"Tanggal Posting\", "
    f"keyword AS \"Keyword\" FROM jobs_raw WHERE platform = 'Glints')",
    "gr AS (SELECT *, row_number() OVER (PARTITION BY lower(\"Judul Posisi\"), "
    "lower(\"Nama Perusahaan\"), lower(\"Keyword\") ORDER BY job_id) AS rn FROM g)",
    "gd AS (SELECT * EXCLUDE (rn) FROM gr WHERE rn = 1)",
)


@register("a21_keyword_yield", with_jobs(
    f"SELECT \"Keyword\" AS keyword, count(*) AS records FROM gd GROUP BY \"Keyword\"", *_GLINTS_DEDUP_CTES))
def a21_keyword_yield(spark, sf_dir):
    d = _glints_dedup(spark, sf_dir).withColumnRenamed("Keyword", "keyword")
    return A.keyword_yield(d)


# --- W1-W10 ---------------------------------------------------------------------------

_ALL = f"job_id, {JOB_COLS}"


@register("w01_with_salary", with_jobs(
    f"SELECT {_ALL} FROM jobs WHERE salary_min IS NOT NULL AND salary_max IS NOT NULL"))
def w01_with_salary(spark, sf_dir):
    return W.with_salary(_table(spark, sf_dir))


@register("w02_with_avg_salary", with_jobs(
    f"SELECT {_ALL}, salary_avg FROM docs WHERE salary_avg IS NOT NULL", docs_cte()))
def w02_with_avg_salary(spark, sf_dir):
    return flatten_documents(W.with_avg_salary(job_documents(spark, sf_dir)))


@register("w03_company_known", with_jobs(f"SELECT {_ALL} FROM jobs WHERE company_name IS NOT NULL"))
def w03_company_known(spark, sf_dir):
    return W.company_known(_table(spark, sf_dir))


@register("w04_platform_country_in", with_jobs(
    f"SELECT {_ALL} FROM jobs WHERE platform IN ('LinkedIn', 'Glints') AND country IN ('Japan', 'Indonesia')"))
def w04_platform_country_in(spark, sf_dir):
    j = W.value_in(_table(spark, sf_dir), "platform", ["LinkedIn", "Glints"])
    return W.value_in(j, "country", ["Japan", "Indonesia"])


@register("w05_salary_at_least", with_jobs(
    f"SELECT {_ALL} FROM jobs WHERE coalesce(salary_min >= 10000000, false) OR coalesce(salary_max >= 10000000, false)"))
def w05_salary_at_least(spark, sf_dir):
    return W.salary_at_least(_table(spark, sf_dir), 10_000_000)


@register("w06_contains_ci", with_jobs(
    f"SELECT {_ALL} FROM jobs WHERE coalesce(regexp_matches(job_title, 'DATA|qa', 'i'), false) "
    f"OR coalesce(regexp_matches(company_name, 'DATA|qa', 'i'), false)"))
def w06_contains_ci(spark, sf_dir):
    return W.contains_ci(_table(spark, sf_dir), "DATA|qa")


# The oracle folds by stripping accents of decomposed letters and lists, for each
# searched word, the forms that share its plain form in the given texts.

def _has(fields, *words):
    text = " || ' ' || ".join(f"coalesce({f}, '')" for f in fields)
    return f"regexp_matches(lower(strip_accents({text})), '(^|[^\\p{{L}}\\p{{N}}])({'|'.join(words)})([^\\p{{L}}\\p{{N}}]|$)')"


def _phrase(fields, phrase):
    return "(" + " OR ".join(f"contains(lower(strip_accents(coalesce({f}, ''))), {q(phrase)})" for f in fields) + ")"


_TF = ["job_title", "company_name", "skills"]
_SEARCH = 'Engineers analysts web-developers "data" -qa'


@register("w07_text_search", with_jobs(
    f"SELECT {_ALL} FROM jobs WHERE {_has(_TF, 'engineers?', 'analysts?', 'web', 'developers?')} "
    f"AND {_phrase(_TF, 'data')} AND NOT {_has(_TF, 'qa')}"))
def w07_text_search(spark, sf_dir):
    return W.text_search(_table(spark, sf_dir), _SEARCH)


@register("w07_indexed_search", with_jobs(
    f"SELECT {_ALL} FROM jobs WHERE {_has(_TF, 'engineers?', 'analysts?', 'web', 'developers?')} "
    f"AND {_phrase(_TF, 'data')} AND NOT {_has(_TF, 'qa')}"))
def w07_indexed_search(spark, sf_dir):
    """The same search through the inverted index."""
    return jobs_index(spark, sf_dir).search(_table(spark, sf_dir), _SEARCH)


# accented titles, and a phrase that only the seam of two fields would hold
_RESUME = ("SELECT job_id, CASE mod(job_id, 3) WHEN 0 THEN 'Résumé Writers' WHEN 1 THEN 'Senior Data' ELSE 'Full stack dev' END AS job_title, "
           "CASE mod(job_id, 2) WHEN 0 THEN 'Engineer Works' END AS company_name, CAST(NULL AS VARCHAR) AS skills FROM jobs_raw")


@register("w07_text_search_phrases", with_jobs(
    f"SELECT job_id, job_title, company_name FROM ({_RESUME}) r WHERE ({_has(_TF, 'full', 'stack')}) OR "
    f"{_phrase(_TF, 'resume writer')} OR {_phrase(_TF, 'data engineer')}"))
def w07_text_search_phrases(spark, sf_dir):
    k = F.col("job_id")
    r = cached_raw_jobs(spark, sf_dir).select(
        "job_id", F.when(k % 3 == 0, "Résumé Writers").when(k % 3 == 1, "Senior Data").otherwise("Full stack dev").alias("job_title"),
        F.when(k % 2 == 0, "Engineer Works").alias("company_name"), F.lit(None).cast("string").alias("skills"))
    found = [W.text_search(r, query) for query in ("full-stacks", '"résumé writer"', '"data engineer"')]
    return found[0].unionByName(found[1]).unionByName(found[2]).select("job_id", "job_title", "company_name")


@register("w07_text_search_documents",
          f"SELECT doc_id, lang, source, n_chars FROM documents WHERE {_has(['text'], 'les', 'der')} AND NOT {_has(['text'], 'und', 'unds', 'unde')}")
def w07_text_search_documents(spark, sf_dir):
    """W7 over whole document texts (the volume case of the text search)."""
    docs = read_table(spark, sf_dir, "documents")
    return W.text_search(docs, "les der -und", fields=["text"]).select("doc_id", "lang", "source", "n_chars")


@register("w08_search_jobs_documents", with_jobs(
    f"SELECT {_ALL}, salary_avg FROM docs WHERE platform IN ('Karir.com', 'Glints') AND country IN ('Indonesia', 'Japan') "
    f"AND (coalesce(salary_min >= 5000000, false) OR coalesce(salary_max >= 5000000, false)) "
    f"AND {_has(_TF, 'spark', 'python')}", docs_cte()))
def w08_search_jobs_documents(spark, sf_dir):
    docs = _docs(spark, sf_dir)
    countries = [r[0] for r in T.facet_values(docs, "country").collect()]       # the facet's real values
    return W.search_jobs(docs, query="spark python", platforms=["Karir.com", "Glints"],
                         countries=["Indonesia", "Japan"], min_salary=5_000_000,
                         all_platforms=PLATFORMS, all_countries=countries)


@register("w08_search_jobs_indexed", with_jobs(
    f"SELECT {_ALL} FROM jobs WHERE platform IN ('Karir.com', 'Glints') AND country IN ('Indonesia', 'Japan') "
    f"AND (coalesce(salary_min >= 5000000, false) OR coalesce(salary_max >= 5000000, false)) "
    f"AND {_has(_TF, 'spark', 'python')}"))
def w08_search_jobs_indexed(spark, sf_dir):
    """The job finder over the cleaned table and its index."""
    return W.search_jobs(_table(spark, sf_dir), query="spark python", platforms=["Karir.com", "Glints"],
                         countries=["Indonesia", "Japan"], min_salary=5_000_000, index=jobs_index(spark, sf_dir))


@register("w08_search_jobs_table", with_jobs(
    f"SELECT {_ALL} FROM jobs WHERE platform IN ('Karir.com', 'Glints', 'Indeed') "
    f"AND country IN ('Indonesia', 'Japan', 'Singapore') "
    f"AND (coalesce(regexp_matches(job_title, 'engineer', 'i'), false) "
    f"OR coalesce(regexp_matches(company_name, 'engineer', 'i'), false)) "
    f"AND (coalesce(salary_min >= 1000000, false) OR coalesce(salary_max >= 1000000, false))"))
def w08_search_jobs_table(spark, sf_dir):
    return W.search_jobs(_table(spark, sf_dir), query="engineer",
                         platforms=["Karir.com", "Glints", "Indeed"],
                         countries=["Indonesia", "Japan", "Singapore"], min_salary=1_000_000,
                         mode="table")


@register("w09_having_count", with_jobs(
    "SELECT company_name, count(*) AS count FROM jobs GROUP BY company_name HAVING count(*) >= 15"))
def w09_having_count(spark, sf_dir):
    return W.having_count(A.count_by(_table(spark, sf_dir), "company_name", "count"), 15)


# every third title is white space of another kind: newline, tab, no-break space
@register("w10_title_required", with_jobs(
    f"SELECT * FROM (SELECT * REPLACE (CASE mod(job_id, 9) WHEN 0 THEN chr(10) || chr(9) WHEN 3 THEN chr(160) WHEN 6 THEN '' "
    f"ELSE job_title END AS job_title) FROM (SELECT {_ALL} FROM jobs)) "
    f"WHERE regexp_matches(job_title, '[^\\s\\x{{a0}}]') AND company_name IS NOT NULL"))
def w10_title_required(spark, sf_dir):
    k = F.pmod(F.col("job_id"), F.lit(9))
    title = F.when(k == 0, "\n\t").when(k == 3, "\u00a0").when(k == 6, "").otherwise(F.col("job_title"))
    return W.title_required(_table(spark, sf_dir).withColumn("job_title", title), also=("company_name",))


# --- N2-N5 ----------------------------------------------------------------------------

_LINKEDIN = ("li AS (SELECT job_id, keyword AS searched_keyword, job_title, company_name, location, "
             "post_date_raw AS posted_date, platform AS source_platform FROM jobs_raw WHERE platform = 'LinkedIn')")


@register("n02_dedup_keep_first", with_jobs(
    "SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY job_title, company_name "
    "ORDER BY job_id) AS rn FROM li) r WHERE rn = 1", _LINKEDIN))
def n02_dedup_keep_first(spark, sf_dir):
    li = source_frame(cached_raw_jobs(spark, sf_dir), "LinkedIn")
    return dedup_keep_first(li, ["job_title", "company_name"], "job_id")


_KARIR = ("ka AS (SELECT job_id, job_title, company_name, location, job_type_raw AS job_type, "
          "experience_raw AS experience_level, education_raw AS education_req, salary_raw AS salary_range, "
          "skills_html AS job_requirements, post_date_raw AS posted_date, platform AS source_platform "
          "FROM jobs_raw WHERE platform = 'Karir.com')")


@register("n03_dedup_keep_last", with_jobs(
    "SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY job_title, company_name, location "
    "ORDER BY job_id DESC) AS rn FROM ka) r WHERE rn = 1", _KARIR))
def n03_dedup_keep_last(spark, sf_dir):
    ka = source_frame(cached_raw_jobs(spark, sf_dir), "Karir.com")
    return dedup_keep_last(ka, ["job_title", "company_name", "location"], "job_id")


@register("n04_dedup_normalized", with_jobs("SELECT * FROM gd", *_GLINTS_DEDUP_CTES))
def n04_dedup_normalized(spark, sf_dir):
    return _glints_dedup(spark, sf_dir)


@register("n05_page_info", with_jobs(
    "SELECT total_rows, greatest(1, CAST(ceil(total_rows / 500) AS BIGINT)) AS total_pages, "
    "least(3, greatest(1, CAST(ceil(total_rows / 500) AS BIGINT))) AS page, "
    "(least(3, greatest(1, CAST(ceil(total_rows / 500) AS BIGINT))) - 1) * 500 AS start_idx, "
    "least((least(3, greatest(1, CAST(ceil(total_rows / 500) AS BIGINT))) - 1) * 500 + 500, total_rows) AS end_idx "
    "FROM (SELECT count(*) AS total_rows FROM jobs WHERE platform IN ('Glints', 'Karir.com')) c"))
def n05_page_info(spark, sf_dir):
    return T.page_info(W.value_in(_table(spark, sf_dir), "platform", ["Glints", "Karir.com"]), 3, 500)


# --- T3, T4 ---------------------------------------------------------------------------

@register("t03_paginate", with_jobs(f"SELECT {_ALL} FROM jobs ORDER BY job_id LIMIT 500 OFFSET 1000"))
def t03_paginate(spark, sf_dir):
    return T.paginate(_table(spark, sf_dir), "job_id", page=3, page_size=500)


@register("t03_paginate_deep", with_jobs(
    "SELECT job_id, salary_min FROM jobs ORDER BY salary_min NULLS FIRST, job_id LIMIT 500 OFFSET 9500"))
def t03_paginate_deep(spark, sf_dir):
    """A page deep in an order with null and repeated keys."""
    return T.paginate(_table(spark, sf_dir).select("job_id", "salary_min"), "salary_min", page=20, page_size=500)


@register("t03_next_page", with_jobs(
    "SELECT job_id, salary_min FROM jobs ORDER BY salary_min NULLS FIRST, job_id LIMIT 500 OFFSET 500"))
def t03_next_page(spark, sf_dir):
    """The page that follows the first one, by position."""
    j = _table(spark, sf_dir).select("job_id", "salary_min")
    last = T.next_page(j, "salary_min").collect()[-1]
    return T.next_page(j, "salary_min", after=last)


@register("t04_head", _count_sql("keyword", n=3))
def t04_head(spark, sf_dir):
    return T.head(A.job_demand(_jobs(spark, sf_dir)), 3)


# --- U1-U3 ----------------------------------------------------------------------------

@register("u01_merge_sources", with_jobs(f"SELECT {_ALL} FROM jobs"))
def u01_merge_sources(spark, sf_dir):
    return unified_jobs_by_union(spark, sf_dir)


@register("u01_merge_sources_one_scan", with_jobs(f"SELECT {_ALL} FROM jobs"))
def u01_merge_sources_one_scan(spark, sf_dir):
    """The same merge with the five source rules fused into one projection."""
    return unified_jobs(spark, sf_dir)


@register("u02_merge_master", with_jobs(
    "SELECT * EXCLUDE (rn, batch) FROM (SELECT *, row_number() OVER (PARTITION BY job_title, company_name, "
    "location ORDER BY batch DESC, job_id DESC) AS rn FROM "
    "(SELECT *, CASE WHEN coalesce(posted_date < '1998-01-01', false) THEN 0 ELSE 1 END AS batch FROM ka) b) r "
    "WHERE rn = 1", _KARIR))
def u02_merge_master(spark, sf_dir):
    ka = source_frame(cached_raw_jobs(spark, sf_dir), "Karir.com")
    old_rows = F.coalesce(F.col("posted_date") < "1998-01-01", F.lit(False))
    return merge_master(ka.where(old_rows), ka.where(~old_rows),
                        ["job_title", "company_name", "location"], "job_id")


@register("u02_merge_master_incremental", with_jobs(
    "SELECT * EXCLUDE (rn, batch) FROM (SELECT *, row_number() OVER (PARTITION BY job_title, company_name, "
    "location ORDER BY batch DESC, job_id DESC) AS rn FROM "
    "(SELECT *, mod(job_id, 3) AS batch FROM ka) b) r WHERE rn = 1", _KARIR))
def u02_merge_master_incremental(spark, sf_dir):
    """U2 by the bucketed master: three batches, of which only the new rows move."""
    ka = source_frame(cached_raw_jobs(spark, sf_dir), "Karir.com")
    master = Master(spark, scratch_path(spark, "master"), ["job_title", "company_name", "location"])
    for i in range(3):
        master.update(ka.where(F.pmod("job_id", F.lit(3)) == i), "job_id")
    return master.read()


@register("t03_page_index", with_jobs(
    "SELECT job_id, salary_min FROM jobs ORDER BY salary_min NULLS FIRST, job_id LIMIT 500 OFFSET 9500"))
def t03_page_index(spark, sf_dir):
    """Page 20 through the page index: opens the files that hold it."""
    j = _table(spark, sf_dir).select("job_id", "salary_min")
    return PageIndex(spark, scratch_path(spark, "pages"), "salary_min").build(j).page(20, 500)


@register("u03_facet_values", with_jobs(
    "SELECT DISTINCT country FROM jobs WHERE country IS NOT NULL"))
def u03_facet_values(spark, sf_dir):
    return T.facet_values(_table(spark, sf_dir), "country")
