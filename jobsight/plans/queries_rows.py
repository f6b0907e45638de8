"""Row-level queries: scalar rules (F*), per-source projections (P*), joins (J*)
and page / payload extraction, each over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from jobsight import functions as R
from jobsight.operators import elements as EL
from jobsight.operators import filters as W
from jobsight.operators import pages as PG
from jobsight.operators.joins import enrich_with_detail, not_yet_ingested
from jobsight.operators.normalize import (
    NORMALIZERS,
    display_projection,
    flatten_detail,
    nullify_na,
    tag_positions,
)
from jobsight.operators.payloads import flatten_search_hits
from jobsight.plans.catalog import register
from jobsight.plans.jobs import cached, cached_raw_jobs, job_documents, unified_jobs
from jobsight.plans.oracle import (
    DETAIL,
    JOB_COLS,
    LISTING,
    PAYLOADS,
    country,
    job_type,
    q,
    snippet_job_type,
    strip,
    strip_html,
    unstated,
    with_jobs,
    years,
)
from jobsight.schemas import NOT_STATED, UNDISCLOSED_COMPANY, UNKNOWN_TAG
from jobsight.session import read_table
from jobsight.sources import testbed as TB
from jobsight.sources.testbed import card_pages, source_frame

karir_listing = cached("listing", TB.karir_listing)
karir_detail = cached("detail", TB.karir_detail)
search_payloads = cached("payloads", TB.search_payloads)


def _raw(spark, sf_dir):
    return cached_raw_jobs(spark, sf_dir)


# --- F1-F7, F17, F19, F20 over the raw postings --------------------------------------

@register("f01_parse_salary", with_jobs("SELECT job_id, salary_raw, salary_min, salary_max FROM jobs_sal"))
def f01_parse_salary(spark, sf_dir):
    s = R.with_parsed_salary(_raw(spark, sf_dir).select("job_id", "salary_raw"), "salary_raw", "_s")
    return s.select("job_id", "salary_raw", F.col("_s.min").alias("salary_min"),
                    F.col("_s.max").alias("salary_max"))


@register("f02_detect_country", with_jobs(f"SELECT job_id, location, {country('location')} AS country FROM jobs_raw"))
def f02_detect_country(spark, sf_dir):
    return _raw(spark, sf_dir).select("job_id", "location", R.detect_country("location").alias("country"))


@register("f03_clean_experience", with_jobs(
    f"SELECT job_id, experience_raw, {unstated('experience_raw')} AS experience FROM jobs_raw"))
def f03_clean_experience(spark, sf_dir):
    return _raw(spark, sf_dir).select("job_id", "experience_raw",
                                      R.clean_experience("experience_raw").alias("experience"))


@register("f04_clean_education", with_jobs(
    f"SELECT job_id, education_raw, {unstated('education_raw')} AS education FROM jobs_raw"))
def f04_clean_education(spark, sf_dir):
    return _raw(spark, sf_dir).select("job_id", "education_raw",
                                      R.clean_education("education_raw").alias("education"))


@register("f05_normalize_job_type", with_jobs(
    f"SELECT job_id, job_type_raw, {job_type('job_type_raw')} AS job_type FROM jobs_raw"))
def f05_normalize_job_type(spark, sf_dir):
    return _raw(spark, sf_dir).select("job_id", "job_type_raw",
                                      R.normalize_job_type("job_type_raw").alias("job_type"))


@register("f06_indeed_job_type", with_jobs(
    f"SELECT job_id, salary_raw, job_type_raw, {snippet_job_type('salary_raw', 'job_type_raw')} AS job_type "
    f"FROM jobs_raw"))
def f06_indeed_job_type(spark, sf_dir):
    return _raw(spark, sf_dir).select("job_id", "salary_raw", "job_type_raw",
                                      R.indeed_job_type("salary_raw", "job_type_raw").alias("job_type"))


@register("f07_map_years", with_jobs(
    f"SELECT job_id, experience_years_raw, {years('experience_years_raw')} AS experience FROM jobs_raw"))
def f07_map_years(spark, sf_dir):
    return _raw(spark, sf_dir).select("job_id", "experience_years_raw",
                                      R.map_years("experience_years_raw").alias("experience"))


@register("f08_strip_html", f"SELECT page_id, {strip_html('html')} AS text FROM pages")
def f08_strip_html(spark, sf_dir):
    return read_table(spark, sf_dir, "pages").select("page_id", R.strip_html("html").alias("text"))


@register("f08_strip_html_skills", with_jobs(
    f"SELECT job_id, {strip_html('skills_html')} AS skills FROM jobs_raw"))
def f08_strip_html_skills(spark, sf_dir):
    return _raw(spark, sf_dir).select("job_id", R.strip_html("skills_html").alias("skills"))


_RUPIAH = "replace(format('{{:,}}', CAST({x} AS BIGINT)), ',', '.')"


@register("f09_format_salary_range", f"""SELECT id, salary_lower, salary_upper,
 CASE WHEN salary_lower IS NOT NULL AND salary_upper IS NOT NULL AND salary_lower <> 0 AND salary_upper <> 0
   THEN 'Rp ' || {_RUPIAH.format(x='salary_lower')} || ' - Rp ' || {_RUPIAH.format(x='salary_upper')}
   ELSE {q(NOT_STATED)} END AS salary_range
FROM ({LISTING}) l""")
def f09_format_salary_range(spark, sf_dir):
    return karir_listing(spark, sf_dir).select(
        "id", "salary_lower", "salary_upper",
        R.format_salary_range("salary_lower", "salary_upper").alias("salary_range"))


# besides the jobs' own amounts: one that is a tie or beside one for every job (6,250,000; 12,350,000; ...)
_TIE_SQL = "(CAST(mod(job_id, 400) AS DOUBLE) * 50000)"


@register("f10_format_millions", with_jobs(
    "SELECT job_id, CASE WHEN salary_min IS NULL THEN '-' ELSE format('Rp {:.1f} Jt', salary_min / 1000000.0::DOUBLE) END "
    "AS salary_min_text, CASE WHEN salary_max IS NULL THEN '-' ELSE format('Rp {:.2f} Jt', salary_max / 1000000.0::DOUBLE) END "
    f"AS salary_max_text, format('Rp {{:.1f}} Jt', {_TIE_SQL} / 1000000.0::DOUBLE) AS tie_text FROM jobs"))
def f10_format_millions(spark, sf_dir):
    j = unified_jobs(spark, sf_dir)
    return j.select("job_id", R.format_millions("salary_min").alias("salary_min_text"),
                    R.format_millions("salary_max", 2).alias("salary_max_text"),
                    R.format_millions((F.col("job_id") % 400).cast("double") * 50000).alias("tie_text"))


@register("f11_date_part", f"SELECT id, posted_at, split_part(posted_at, 'T', 1) AS posted_date FROM ({LISTING}) l")
def f11_date_part(spark, sf_dir):
    return karir_listing(spark, sf_dir).select("id", "posted_at", R.date_part("posted_at").alias("posted_date"))


@register("f12_first_truthy", f"""SELECT l.id, coalesce(nullif(d.location, ''), nullif(l.location_name, ''), {q(NOT_STATED)}) AS location
FROM ({LISTING}) l JOIN ({DETAIL}) d ON l.id = d.id""")
def f12_first_truthy(spark, sf_dir):
    j = enrich_with_detail(karir_listing(spark, sf_dir), karir_detail(spark, sf_dir))
    return j.select("id", R.first_truthy("location", "location_name", default=NOT_STATED).alias("location"))


@register("f16_years_label_degrees", f"""SELECT id, coalesce(CAST(work_experience AS VARCHAR), '0') || ' Tahun' AS experience_level,
 coalesce(array_to_string(degrees, ', '), '') AS education_req FROM ({DETAIL}) d""")
def f16_years_label_degrees(spark, sf_dir):
    d = karir_detail(spark, sf_dir)
    return d.select("id", R.years_label("work_experience").alias("experience_level"),
                    R.join_degrees("degrees").alias("education_req"))


_REMOTE = "lower(coalesce(location, '') || ' ' || coalesce(skills_html, ''))"


@register("f17_remote_flag", with_jobs(
    f"SELECT job_id, CASE WHEN contains({_REMOTE}, 'remote') OR contains({_REMOTE}, 'wfh') "
    f"OR contains({_REMOTE}, 'work from home') OR contains({_REMOTE}, 'kerja dari rumah') "
    f"THEN 'Remote' ELSE '' END AS remote_flag FROM jobs_raw"))
def f17_remote_flag(spark, sf_dir):
    return _raw(spark, sf_dir).select("job_id", R.remote_flag("location", "skills_html").alias("remote_flag"))


_BLANKED = "CASE WHEN mod(job_id, 3) = 0 THEN chr(10) || ' ' || chr(9) ELSE location END"   # blank but present


@register("f19_default_text", with_jobs(
    f"SELECT job_id, coalesce({strip('company_name')}, {q(UNDISCLOSED_COMPANY)}) AS company_name, "
    f"coalesce({strip(_BLANKED)}, {q(UNKNOWN_TAG)}) AS location FROM jobs_raw"))
def f19_default_text(spark, sf_dir):
    return _raw(spark, sf_dir).select(
        "job_id", R.default_text("company_name", UNDISCLOSED_COMPANY).alias("company_name"),
        R.default_text(F.when(F.col("job_id") % 3 == 0, "\n \t").otherwise(F.col("location")), UNKNOWN_TAG).alias("location"))


@register("f20_midpoint", with_jobs("SELECT job_id, (salary_min + salary_max) / 2 AS salary_mid FROM jobs"))
def f20_midpoint(spark, sf_dir):
    return unified_jobs(spark, sf_dir).select("job_id", R.midpoint("salary_min", "salary_max").alias("salary_mid"))


# --- P1-P9, P13, P16 ------------------------------------------------------------------

def _per_source(platform):
    def build(spark, sf_dir):
        src = source_frame(_raw(spark, sf_dir), platform)
        return NORMALIZERS[platform](src, keep=["job_id"])
    return build


for _i, _p in enumerate(["Glints", "Karir.com", "LinkedIn", "Tech In Asia", "Indeed"], start=1):
    _key = _p.lower().replace(".com", "").replace(" ", "")
    register(f"p0{_i}_normalize_{_key}",
             with_jobs(f"SELECT job_id, {JOB_COLS} FROM jobs WHERE platform = {q(_p)}"))(_per_source(_p))


@register("p06_to_documents", with_jobs(
    "SELECT job_id, salary_min, salary_max, CASE WHEN salary_min IS NOT NULL AND salary_max IS NOT NULL "
    "THEN (salary_min + salary_max) / 2 END AS salary_avg FROM jobs"))
def p06_to_documents(spark, sf_dir):
    d = job_documents(spark, sf_dir)
    return d.select("job_id", F.col("salary.min").alias("salary_min"), F.col("salary.max").alias("salary_max"),
                    F.col("salary.avg").alias("salary_avg"))


@register("p07_nullify_na", with_jobs(
    "SELECT job_id, " + ", ".join(
        f"CASE WHEN {c} IN ('', 'NA', 'N/A', 'n/a', 'NULL', 'null', 'None', 'NaN', 'nan', '#N/A', '#N/A N/A', "
        f"'#NA', '-1.#IND', '-1.#QNAN', '-NaN', '-nan', '1.#IND', '1.#QNAN', '<NA>') THEN NULL ELSE {c} END AS {c}"
        for c in ["job_title", "company_name", "location", "country", "skills", "keyword", "post_date"])
    + " FROM jobs"))
def p07_nullify_na(spark, sf_dir):
    j = unified_jobs(spark, sf_dir).select("job_id", "job_title", "company_name", "location", "country",
                                           "skills", "keyword", "post_date")
    return nullify_na(j)


@register("p08_flatten_documents", with_jobs(
    f"SELECT job_id, {JOB_COLS}, CASE WHEN salary_min IS NOT NULL AND salary_max IS NOT NULL "
    f"THEN (salary_min + salary_max) / 2 END AS salary_avg FROM jobs"))
def p08_flatten_documents(spark, sf_dir):
    from jobsight.operators.normalize import flatten_documents
    return flatten_documents(job_documents(spark, sf_dir))


@register("p09_display_projection", with_jobs(
    "SELECT job_title, company_name, location, country, job_type, experience, education, salary_min, "
    "salary_max, platform, post_date FROM jobs"))
def p09_display_projection(spark, sf_dir):
    return display_projection(unified_jobs(spark, sf_dir, keep_id=False))


_D2 = f"""SELECT l.id,
 {strip_html('l.job_position')} AS job_title,
 {strip_html('l.company_name')} AS company_name,
 {strip_html(f"coalesce(nullif(d.location, ''), nullif(l.location_name, ''))")} AS location,
 {strip_html('d.job_type')} AS job_type,
 coalesce(CAST(d.work_experience AS VARCHAR), '0') || ' Tahun' AS experience_level,
 coalesce(array_to_string(d.degrees, ', '), '') AS education_req,
 CASE WHEN l.salary_lower IS NOT NULL AND l.salary_upper IS NOT NULL AND l.salary_lower <> 0 AND l.salary_upper <> 0
   THEN 'Rp ' || {_RUPIAH.format(x='l.salary_lower')} || ' - Rp ' || {_RUPIAH.format(x='l.salary_upper')}
   ELSE {q(NOT_STATED)} END AS salary_range,
 {strip_html('d.requirements')} AS job_requirements,
 {strip_html('d.responsibilities')} AS job_responsibilities,
 coalesce(split_part(l.posted_at, 'T', 1), '') AS posted_date,
 'Karir.com' AS source_platform
FROM ({LISTING}) l JOIN ({DETAIL}) d ON l.id = d.id"""


@register("j02_enrich_with_detail", _D2)
def j02_enrich_with_detail(spark, sf_dir):
    j = enrich_with_detail(karir_listing(spark, sf_dir), karir_detail(spark, sf_dir))
    return flatten_detail(j, keep=("id",))


@register("p13_flatten_detail", _D2)
def p13_flatten_detail(spark, sf_dir):
    j = enrich_with_detail(karir_listing(spark, sf_dir), karir_detail(spark, sf_dir))
    return flatten_detail(j, keep=("id",))


@register("j01_not_yet_ingested", with_jobs(
    "SELECT * FROM ind WHERE keyword IS NULL OR keyword NOT IN "
    "(SELECT keyword FROM ind WHERE keyword IN ('1-URGENT', '2-HIGH') AND keyword IS NOT NULL)",
    "ind AS (SELECT job_id, job_title, company_name, location, job_type_raw AS job_type, "
    "experience_raw AS experience, education_raw AS education, salary_raw, skills_html AS skills, keyword, "
    "post_date_raw AS post_date, platform FROM jobs_raw WHERE platform = 'Indeed')"))
def j01_not_yet_ingested(spark, sf_dir):
    ind = source_frame(_raw(spark, sf_dir), "Indeed")
    done = ind.where(F.col("keyword").isin("1-URGENT", "2-HIGH"))
    return not_yet_ingested(ind, done, "keyword")


# --- P12: payloads ----------------------------------------------------------------------

_HITS = f"""WITH p AS ({PAYLOADS}),
h AS (SELECT payload_id, payload, unnest(range(CAST(json_array_length(payload, '$.results[0].hits') AS BIGINT))) AS hit_no FROM p),
hh AS (SELECT payload_id, hit_no, json_extract(payload, '$.results[0].hits[' || hit_no || ']') AS hit FROM h),
arr AS (SELECT *, CASE WHEN coalesce(json_array_length(hit, '$.job_skills'), 0) > 0 THEN json_extract(hit, '$.job_skills')
                       WHEN coalesce(json_array_length(hit, '$.skills'), 0) > 0 THEN json_extract(hit, '$.skills') END AS sk FROM hh)
SELECT payload_id, CAST(hit_no AS INTEGER) AS hit_no,
 coalesce(nullif(hit->>'title', ''), nullif(hit->>'name', ''), {q(NOT_STATED)}) AS job_title,
 CASE WHEN json_type(hit, '$.company.name') IS NULL THEN {q(NOT_STATED)} ELSE hit->'company'->>'name' END AS company_name,
 coalesce(nullif(hit->'city'->>'country_name', ''), nullif(hit->>'work_country_name', ''), {q(NOT_STATED)}) AS location,
 CASE WHEN sk IS NULL THEN {q(NOT_STATED)} ELSE array_to_string(list_transform(
   list_filter(CAST(sk AS JSON[]), lambda x: json_type(x) = 'OBJECT'), lambda x: coalesce(x->>'name', '')), ', ') END AS skills_required,
 CASE WHEN json_type(hit, '$.experience_min') IS NULL THEN '0' ELSE hit->>'experience_min' END AS experience_years_min,
 CASE WHEN json_type(hit, '$.job_type') = 'OBJECT' THEN
        (CASE WHEN json_type(hit, '$.job_type.name') IS NULL THEN {q(NOT_STATED)} ELSE hit->'job_type'->>'name' END)
      WHEN json_type(hit, '$.job_type') IS NULL THEN {q(NOT_STATED)} ELSE hit->>'job_type' END AS job_type,
 coalesce(nullif(hit->>'published_at', ''), {q(NOT_STATED)}) AS published_at,
 'Tech In Asia' AS source_platform
FROM arr"""


@register("p12_flatten_search_hits", _HITS)
def p12_flatten_search_hits(spark, sf_dir):
    return flatten_search_hits(search_payloads(spark, sf_dir))


# --- P14-P16, A20, W11, F18 over pages ----------------------------------------------------

CARD_FAMILIES = [(PG.NAV_CARD, 1, 2), (PG.SECTION_CARD, None, 1)]

_CARDS = f"""WITH x AS (SELECT page_id, url,
   regexp_extract_all(html, {q(PG.NAV_CARD)}, 1) AS h1, regexp_extract_all(html, {q(PG.NAV_CARD)}, 2) AS t1,
   regexp_extract_all(html, {q(PG.SECTION_CARD)}, 1) AS t2 FROM pages),
y AS (SELECT page_id, url, CASE WHEN len(t1) > 0 THEN h1 ELSE list_transform(t2, lambda z: NULL::VARCHAR) END AS hrefs,
        CASE WHEN len(t1) > 0 THEN t1 ELSE t2 END AS titles FROM x),
z AS (SELECT page_id, url, hrefs, titles, unnest(range(len(titles))) AS card_no FROM y),
c AS (SELECT page_id, url, CAST(card_no AS INTEGER) AS card_no, hrefs[card_no + 1] AS href, {strip('titles[card_no + 1]')} AS title FROM z)
"""


@register("p14_extract_cards", _CARDS + "SELECT * FROM c WHERE coalesce(title <> '', false)")
def p14_extract_cards(spark, sf_dir):
    return PG.extract_cards(read_table(spark, sf_dir, "pages"), CARD_FAMILIES)


@register("f18_absolute_url", _CARDS + (
    "SELECT *, CASE WHEN starts_with(href, '/') THEN regexp_extract(url, '^(https?://[^/?#]+)', 1) || href "
    "WHEN starts_with(href, 'http') THEN href END AS job_url FROM c WHERE coalesce(title <> '', false)"))
def f18_absolute_url(spark, sf_dir):
    return PG.cards_with_links(PG.extract_cards(read_table(spark, sf_dir, "pages"), CARD_FAMILIES))


_FIELDS = [r"<h1>([^<]*)</h1>", r"<title>([^<]*)</title>"]


def _first_sql(patterns):
    vals = [f"nullif({strip(f'regexp_extract(html, {q(p)}, 1)')}, '')" for p in patterns]
    return f"coalesce({', '.join(vals)}, {q(NOT_STATED)})"


_AD = [r'<div class="ad">([^<]*)</div>']


@register("p15_card_field",
          f"SELECT page_id, {_first_sql(_FIELDS)} AS heading, {_first_sql(_AD)} AS ad_text FROM pages")
def p15_card_field(spark, sf_dir):
    p = read_table(spark, sf_dir, "pages")
    return p.select("page_id", PG.card_field("html", _FIELDS, NOT_STATED).alias("heading"),
                    PG.card_field("html", _AD, NOT_STATED).alias("ad_text"))


_TAGS = f"regexp_extract_all(html, {q(PG.NAV_CARD)}, 2)"


@register("p16_tag_positions", "SELECT page_id, " + ", ".join(
    f"coalesce(list_filter(list_transform(list_prepend(chr(10) || chr(9), {_TAGS}), lambda x: {strip('x')}), lambda x: x <> '' AND NOT contains(x, '+'))[{i + 1}], "
    f"{q(UNKNOWN_TAG)}) AS {n}" for i, n in enumerate(["job_type", "experience", "education"])) + " FROM pages")
def p16_tag_positions(spark, sf_dir):
    p = read_table(spark, sf_dir, "pages")
    # a tag of newline and tab only stands before the page's own tags
    tags = F.concat(F.array(F.lit("\n\t")), F.regexp_extract_all(F.col("html"), F.lit(PG.NAV_CARD), 2))
    jt, ex, ed = tag_positions(tags)
    return p.select("page_id", jt.alias("job_type"), ex.alias("experience"), ed.alias("education"))


def _count_sql(rx):
    return f"CAST(len(regexp_extract_all(html, {q(rx)})) AS INTEGER)"


def _open_sql(tag, cls):
    """Oracle's own reading of "an opening tag with this class word"."""
    return f"<{tag} ([^>]* )?class=([\"']|[\"'][^\"'>]* ){cls}([\"']| [^\"'>]*[\"'])"


_SELECTORS_SQL = [("a_tapItem", _open_sql("a", "tapItem")), ("div_jobsearch_SerpJobCard", _open_sql("div", "jobsearch-SerpJobCard")),
                  ("li_css_5lfssm", _open_sql("li", "css-5lfssm")), ("testid_job_title", 'data-testid="job-title"')]


@register("a20_selector_counts", "SELECT page_id, " + ", ".join(
    f"{_count_sql(rx)} AS {n}" for n, rx in _SELECTORS_SQL) + " FROM pages")
def a20_selector_counts(spark, sf_dir):
    return PG.selector_counts(read_table(spark, sf_dir, "pages"))


def _w11_sql():
    fams = [_open_sql("div", "job_seen_beacon"), _open_sql("li", "css-5lfssm"), _open_sql("a", "tapItem"),
            _open_sql("div", "jobsearch-SerpJobCard"), 'data-testid="slider_item"']
    counts = [_count_sql(r) for r in fams]
    n = "0"
    for c in reversed(counts):
        n = f"(CASE WHEN {c} > 0 THEN {c} ELSE {n} END)"
    marker = "regexp_matches(lower(html), 'cloudflare|security check|challenge|captcha')"
    page_no = "coalesce(TRY_CAST(nullif(regexp_extract(url, '[?&]page=(\\d+)', 1), '') AS INTEGER), 0)"
    return (f"SELECT page_id, url, n_cards, page_no FROM (SELECT page_id, url, html, {n} AS n_cards, "
            f"{page_no} AS page_no FROM pages) p WHERE n_cards = 0 AND (({marker}) OR page_no = 0)")


def _blocked(p):
    fams = list(PG.INDEED_CARD_FAMILIES) + [PG.INDEED_SLIDER_ITEM]
    p = p.select("page_id", "url", "html", PG.card_count("html", fams).alias("n_cards"),
                 PG.page_number("url").alias("page_no"))
    return W.blocked_pages(p).select("page_id", "url", "n_cards", "page_no")


@register("w11_blocked_pages", _w11_sql())
def w11_blocked_pages(spark, sf_dir):
    return _blocked(read_table(spark, sf_dir, "pages"))


# --- the same operators over listing pages with cards; the oracle derives what the
# cards hold from the orders they are made of, not from markup -----------------------------

_PAGE_ROWS = """SELECT o_custkey AS c, o_orderkey AS k, o_custkey % 4 AS board, o_orderkey % 11 = 0 AND o_custkey % 4 = 0 AS alike,
  o_custkey % 17 = 0 AS marker, o_custkey % 17 <> 0 AND o_custkey % 19 <> 0 AS shown, o_orderstatus AS st, o_orderdate AS dt,
  o_orderpriority AS pr FROM orders"""

_CARD_RECORDS = f"""
WITH o AS ({_PAGE_ROWS}),
n AS (SELECT *, CAST(row_number() OVER (PARTITION BY c ORDER BY k) - 1 AS INTEGER) AS card_no FROM o WHERE shown AND NOT alike),
f AS (SELECT *, 'https://board' || board || '.example' AS origin FROM n)
SELECT c AS page_id, card_no,
  CASE WHEN board = 0 AND k % 5 = 4 THEN NULL WHEN board = 1 THEN 'Old role ' || k ELSE 'Role ' || k END AS job_title,
  CASE WHEN board = 1 OR (board IN (0, 2) AND k % 3 = 0) OR (board = 2 AND k % 5 = 0) OR (board = 3 AND k % 4 = 0) THEN NULL ELSE 'PT & ' || st END AS company_name,
  CASE WHEN board = 3 THEN 'Jakarta' WHEN board = 0 AND k % 7 = 0 THEN 'Remote in Jakarta' WHEN board = 0 AND k % 2 = 0 THEN 'Bandung' END AS location,
  CASE WHEN board = 0 AND k % 4 = 0 THEN 'Rp 5 jt' WHEN board = 0 AND k % 4 = 1 THEN 'Rp 7 jt' END AS salary_raw,
  CASE WHEN board = 0 AND k % 6 = 0 THEN 'Posted 3 days ago' WHEN board = 3 AND k % 3 <> 0 THEN strftime(dt, '%Y-%m-%d') END AS post_date,
  CASE board WHEN 0 THEN (CASE k % 5 WHEN 1 THEN origin || '/rc/' || k WHEN 2 THEN 'https://ex.org/' || k WHEN 3 THEN origin || '/viewjob?jk=' || k END)
    WHEN 1 THEN origin || '/old/' || k WHEN 2 THEN origin || '/jobs/' || k ELSE 'https://li.example/' || k END AS job_url,
  CASE WHEN board <> 0 THEN {q(NOT_STATED)} WHEN k % 13 = 0 THEN 'Work from home & more' ELSE 'Work ' || pr END AS snippet,
  CASE WHEN board = 0 AND (k % 7 = 0 OR k % 13 = 0) THEN 'Remote' ELSE '' END AS remote,
  CASE board WHEN 2 THEN 'Glints' WHEN 3 THEN 'LinkedIn' ELSE 'Indeed' END AS platform
FROM f WHERE NOT (board = 0 AND k % 5 = 4)
"""


@register("p14_card_records", _CARD_RECORDS)
def p14_card_records(spark, sf_dir):
    """Records of the cards of all boards, every field by its fallback patterns."""
    p = card_pages(spark, sf_dir)
    out = [PG.card_records(p, board).drop("tags") for board in PG.BOARDS]
    return out[0].unionByName(out[1]).unionByName(out[2])


@register("p14_card_tags", f"""WITH o AS ({_PAGE_ROWS})
SELECT c AS page_id, CAST(row_number() OVER (PARTITION BY c ORDER BY k) - 1 AS INTEGER) AS card_no, 'Penuh Waktu' AS job_type,
  CASE WHEN k % 2 = 0 THEN '1 - 3 tahun' ELSE {q(UNKNOWN_TAG)} END AS experience, CASE WHEN k % 2 = 0 THEN 'S1' ELSE {q(UNKNOWN_TAG)} END AS education
FROM o WHERE shown AND board = 2""")
def p14_card_tags(spark, sf_dir):
    """P16 inside cards: a blank tag of newline and tab does not shift the positions."""
    jt, ex, ed = tag_positions("tags")
    return PG.card_records(card_pages(spark, sf_dir), "Glints").select(
        "page_id", "card_no", jt.alias("job_type"), ex.alias("experience"), ed.alias("education"))


@register("a20_selector_counts_cards", f"""WITH o AS ({_PAGE_ROWS})
SELECT c AS page_id, CAST(0 AS INTEGER) AS a_tapItem, CAST(count(*) FILTER (WHERE shown AND board = 1) AS INTEGER) AS div_jobsearch_SerpJobCard,
  CAST(0 AS INTEGER) AS li_css_5lfssm, CAST(0 AS INTEGER) AS testid_job_title FROM o GROUP BY c""")
def a20_selector_counts_cards(spark, sf_dir):
    return PG.selector_counts(card_pages(spark, sf_dir))


@register("w11_blocked_pages_cards", f"""WITH o AS ({_PAGE_ROWS}),
p AS (SELECT c, any_value(board) AS board, bool_or(marker) AS marker,
        CAST(count(*) FILTER (WHERE shown AND board <= 1 AND NOT alike) AS INTEGER) AS n_cards FROM o GROUP BY c)
SELECT c AS page_id, 'https://board' || board || '.example/jobs?q=x&page=' || (c % 3) AS url, n_cards, CAST(c % 3 AS INTEGER) AS page_no
FROM p WHERE n_cards = 0 AND (marker OR c % 3 = 0)""")
def w11_blocked_pages_cards(spark, sf_dir):
    return _blocked(card_pages(spark, sf_dir))


# --- P14, P15 over nested markup: element intervals ----------------------------------------

_NESTED = """WITH o AS (SELECT o_orderkey AS k, o_custkey AS page_id, o_orderstatus AS st, o_orderpriority AS pr FROM orders),
all_cards AS (
  SELECT page_id, k, 0 AS inside, CASE WHEN k % 4 = 0 THEN 'Role ' || k || ' & more' WHEN k % 4 = 1 THEN 'Leadrole' || k WHEN k % 4 = 2 THEN 'Plain ' || k
      WHEN k % 7 = 0 THEN 'Inner ' || k END AS job_title,
    CASE WHEN k % 3 <> 0 THEN 'PT' || st END AS company_name, CASE WHEN k % 5 = 0 THEN 'Remote inJakarta' END AS location,
    CASE WHEN k % 2 = 0 THEN 'Rp 5jt' END AS salary_raw, CASE WHEN k % 6 = 0 THEN 'Posted' WHEN k % 7 = 0 THEN 'today' END AS post_date,
    CASE WHEN k % 4 = 0 THEN 'https://id.indeed.com/rc/' || k WHEN k % 4 = 2 THEN 'https://ex.org/?a=1&k=' || k END AS job_url,
    'Work ' || pr || ' daily tasks' AS skills, CASE WHEN k % 5 = 0 THEN 'Remote' ELSE '' END AS remote_flag FROM o
  UNION ALL
  SELECT page_id, k, 1 AS inside, 'Inner ' || k, NULL, NULL, NULL, 'today', NULL, NULL, '' FROM o WHERE k % 7 = 0),
numbered AS (SELECT *, CAST(row_number() OVER (PARTITION BY page_id ORDER BY k, inside) - 1 AS INTEGER) AS card_no FROM all_cards)
"""


@register("p14_nested_card_records", _NESTED + "SELECT * EXCLUDE (k, inside) FROM numbered WHERE job_title IS NOT NULL")
def p14_nested_card_records(spark, sf_dir):
    """The board's records where cards hold cards, and titles and companies hold tags."""
    return EL.indeed_records(EL.element_table(TB.nested_card_pages(spark, sf_dir)))


@register("a20_element_counts", _NESTED + """SELECT page_id, CAST(count(*) AS INTEGER) AS cards, CAST(sum(inside) AS INTEGER) AS nested_cards,
  CAST(2 * sum(1 - inside) AS INTEGER) AS items FROM numbered GROUP BY page_id""")
def a20_element_counts(spark, sf_dir):
    """Selector counts over elements: markup in comments and scripts does not count."""
    t = EL.element_table(TB.nested_card_pages(spark, sf_dir))
    count = lambda s: F.size(F.array_distinct(EL.Selector(s).within(F.col("elements"))))
    return t.select("page_id", count("div.job_seen_beacon").alias("cards"),
                    count("div.job_seen_beacon div.job_seen_beacon").alias("nested_cards"), count(".job-snippet ul li").alias("items"))


def _element_sql(name):
    text = f"regexp_extract(html, '<{name}>([^<]*)</{name}>', 1)"
    for reference, char in [("&nbsp;", "chr(160)"), ("&lt;", "'<'"), ("&gt;", "'>'"), ("&quot;", "chr(34)"), ("&#39;", "chr(39)"), ("&amp;", "'&'")]:
        text = f"replace({text}, '{reference}', {char})"
    return f"nullif({strip(text)}, '')"


@register("p15_element_text", f"SELECT page_id, {_element_sql('h1')} AS heading, {_element_sql('title')} AS title FROM pages")
def p15_element_text(spark, sf_dir):
    """First heading and title of the given pages, as texts of elements."""
    t = EL.element_table(read_table(spark, sf_dir, "pages"))
    text = lambda s: F.nullif(EL.text_of(F.col("texts"), EL.first_of(F.col("elements"), None, [s]), None), F.lit(""))
    return t.select("page_id", text("h1").alias("heading"), text("title").alias("title"))
