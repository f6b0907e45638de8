"""DuckDB SQL for the oracle check: an independent formulation of the same
rules, run by DuckDB over the same parquet tables (pre-registered views).

Only the fixed vocabularies (marker lists, country keys) are shared with the
Spark side; the rule logic is written here again, in SQL.
"""

from __future__ import annotations

from jobsight.functions.salary import (
    CURRENCY_FACTORS,
    MILLION_MARKERS,
    SALARY_MISSING_MARKERS,
    THOUSAND_MARKERS,
    UNIT_REPAIR,
)
from jobsight.functions.text import (
    COUNTRY_KEYS,
    HTML_ENTITIES,
    JOB_TYPE_MARKERS,
    PY_SPACE,
    SNIPPET_JOB_TYPE_MARKERS,
)
from jobsight.schemas import FRESH_GRADUATE, NOT_STATED, UNSTATED_TEXTS


def q(s: str) -> str:
    """SQL string literal."""
    return "'" + s.replace("'", "''") + "'"


def strip(x: str) -> str:
    return f"regexp_replace({x}, {q('^' + PY_SPACE + '+|' + PY_SPACE + '+$')}, '', 'g')"


def any_in(x: str, needles) -> str:
    return "(" + " OR ".join(f"contains({x}, {q(n)})" for n in needles) + ")"


def country(x: str) -> str:
    low = f"lower({x})"
    whens = " ".join(f"WHEN contains({low}, {q(k)}) THEN {q(v)}" for k, v in COUNTRY_KEYS)
    return f"(CASE WHEN {x} IS NULL THEN 'Indonesia' {whens} ELSE 'Indonesia' END)"


def job_type(x: str) -> str:
    low = f"lower({x})"
    whens = " ".join(f"WHEN {any_in(low, ns)} THEN {q(lbl)}" for lbl, ns in JOB_TYPE_MARKERS)
    return f"(CASE WHEN {x} IS NULL THEN 'Full-time' {whens} ELSE 'Full-time' END)"


def snippet_job_type(s: str, jt: str) -> str:
    low = f"lower({s})"
    whens = " ".join(f"WHEN {any_in(low, ns)} THEN {q(lbl)}" for lbl, ns in SNIPPET_JOB_TYPE_MARKERS)
    return (f"(CASE WHEN {s} IS NULL OR {strip(low)} = '' OR {low} = 'nan' THEN {job_type(jt)} "
            f"{whens} ELSE {job_type(jt)} END)")


def unstated(x: str) -> str:
    lst = ", ".join(q(t) for t in UNSTATED_TEXTS)
    return f"(CASE WHEN {x} IS NULL OR lower({strip(x)}) IN ({lst}) THEN {q(NOT_STATED)} ELSE {strip(x)} END)"


def years(x: str) -> str:
    d = f"TRY_CAST({x} AS DOUBLE)"
    ok = f"({d} IS NOT NULL AND NOT isnan({d}) AND NOT isinf({d}))"
    y = f"CAST(trunc({d}) AS BIGINT)"
    return (f"(CASE WHEN {x} IS NULL THEN {q(NOT_STATED)} WHEN {ok} AND {y} = 0 THEN {q(FRESH_GRADUATE)} "
            f"WHEN {ok} THEN CAST({y} AS VARCHAR) || ' tahun' ELSE {x} END)")


def strip_html(x: str) -> str:
    s = f"regexp_replace({x}, '<[^\\n]*?>', ' ', 'g')"
    for ent, rep in HTML_ENTITIES:
        s = f"replace({s}, {q(ent)}, {q(rep)})"
    s = strip(f"regexp_replace({s}, ' {{2,}}', ' ', 'g')")
    return f"coalesce(nullif({s}, ''), {q(NOT_STATED)})"


# --- the raw postings adapter (FIXTURES.md section 5) ------------------------------
RAW_JOBS = """SELECT o.o_orderkey AS job_id,
 CASE mod(o.o_orderkey,4) WHEN 0 THEN 'Data Engineer' WHEN 1 THEN 'Web Developer' WHEN 2 THEN 'QA Engineer' ELSE 'Data Analyst' END AS job_title,
 CASE WHEN mod(o.o_custkey,11)=0 THEN NULL ELSE c.c_name END AS company_name,
 CASE mod(o.o_custkey,7) WHEN 0 THEN NULL WHEN 1 THEN 'Nusa Dua, Bali' WHEN 2 THEN 'London, Singapore' WHEN 3 THEN 'Indianapolis' WHEN 4 THEN 'Jakarta' WHEN 5 THEN 'Manila' ELSE 'TOKYO ' || n.n_name END AS location,
 CASE mod(o.o_orderkey,9) WHEN 0 THEN NULL WHEN 1 THEN 'Penuh Waktu' WHEN 2 THEN 'Kontrak' WHEN 3 THEN 'International' WHEN 4 THEN 'Freelance' WHEN 5 THEN 'part-time' WHEN 6 THEN 'Remote' WHEN 7 THEN 'Full-time contract' ELSE 'Shift' END AS job_type_raw,
 CASE mod(o.o_orderkey,6) WHEN 0 THEN NULL WHEN 1 THEN ' Apa Saja ' WHEN 2 THEN 'tidak diketahui' WHEN 3 THEN ' 1 - 3 tahun' WHEN 4 THEN '3 Tahun' ELSE 'Fresh Graduate' END AS experience_raw,
 CASE mod(o.o_custkey,4) WHEN 0 THEN NULL WHEN 1 THEN 'S1' WHEN 2 THEN 'Tidak Disebutkan' ELSE 'SMA ' END AS education_raw,
 CASE mod(o.o_orderkey,8) WHEN 0 THEN NULL WHEN 1 THEN '0' WHEN 2 THEN 'abc' ELSE CAST(mod(o.o_orderkey,8) AS VARCHAR(4)) END AS experience_years_raw,
 CASE mod(o.o_orderkey,13) WHEN 0 THEN NULL WHEN 1 THEN 'Gaji Tidak Ditampilkan' WHEN 2 THEN '6,5 jt - 7,5 jt' WHEN 3 THEN '5 jt'
  WHEN 4 THEN 'Rp ' || CAST(1 + mod(o.o_orderkey,9) AS VARCHAR(4)) || '.000.000 - Rp 12.500.000' WHEN 5 THEN '$1,000 - $2,000'
  WHEN 6 THEN 'Rp 3,000,000' WHEN 7 THEN '500 rb - 700' WHEN 8 THEN '5 - 10 rb' WHEN 9 THEN 'Rp 50.000 per jam' WHEN 10 THEN '10.000.000 ₫' WHEN 11 THEN '5 million' ELSE 'SGD 5k – 7k' END AS salary_raw,
 CASE mod(o.o_orderkey,3) WHEN 0 THEN '<p>SQL &amp; Spark</p>' WHEN 1 THEN NULL ELSE '<b>Python</b>  <i>remote</i>' END AS skills_html,
 o.o_orderpriority AS keyword,
 CASE mod(o.o_orderkey,5) WHEN 0 THEN 'Glints' WHEN 1 THEN 'Karir.com' WHEN 2 THEN 'LinkedIn' WHEN 3 THEN 'Tech In Asia' ELSE 'Indeed' END AS platform,
 CASE WHEN mod(o.o_orderkey,10)=0 THEN NULL ELSE CAST(CAST(o.o_orderdate AS DATE) AS VARCHAR(10)) END AS post_date_raw
FROM orders o JOIN customer c ON o.o_custkey=c.c_custkey JOIN nation n ON c.c_nationkey=n.n_nationkey"""


def _part_layers(i: int) -> tuple[str, str, str]:
    """SQL column expressions for range part ``i`` (0-based), split in layers."""
    p = f"sp{i}"
    layer1 = f"{strip(f's_parts[{i + 1}]')} AS {p}, s_parts[{i + 1}] AS sr{i}"
    unit = (f"(CASE WHEN {any_in(p, MILLION_MARKERS)} THEN CAST(1000000 AS DOUBLE) "
            f"WHEN {any_in(p, THOUSAND_MARKERS)} THEN CAST(1000 AS DOUBLE) ELSE CAST(1 AS DOUBLE) END)")
    runs = f"regexp_extract_all({p}, '\\d+')"
    norm = (f"(CASE WHEN contains({p}, ',') THEN replace(replace({p}, '.', ''), ',', '.') "
            f"WHEN len({runs}) > 1 AND len(list_filter({runs}[2:], lambda r: length(r) <> 3)) = 0 "
            f"THEN array_to_string({runs}, '') ELSE {p} END)")
    layer2 = f"{unit} AS su{i}, regexp_extract({norm}, '\\d+(\\.\\d+)?', 0) AS sn{i}"
    layer3 = (f"(CASE WHEN sp{i} = '' OR sn{i} = '' THEN NULL "
              f"ELSE CAST(sn{i} AS DOUBLE) * su{i} * s_cur END) AS sv{i}")
    return layer1, layer2, layer3


def _repair(a: str, b: str) -> str:
    whens = " ".join(f"WHEN contains({a}, {q(u)}) AND NOT contains({b}, {q(u)}) THEN CAST({f} AS DOUBLE)"
                     for u, f in UNIT_REPAIR)
    return f"(CASE {whens} ELSE CAST(1 AS DOUBLE) END)"


def salary_ctes(src: str, col: str, out: str) -> str:
    """CTEs ``{out}_a`` .. ``{out}`` adding ``salary_min``/``salary_max`` parsed
    from ``col`` to every row of ``src``."""
    st = strip(f"lower({col})")
    missing = any_in("s_txt", SALARY_MISSING_MARKERS)
    cur = " ".join(f"WHEN {any_in('s_txt', ns)} THEN CAST({f} AS DOUBLE)" for ns, f in CURRENCY_FACTORS)
    l0, m0, v0 = _part_layers(0)
    l1, m1, v1 = _part_layers(1)
    both = "sv0 IS NOT NULL AND sv1 IS NOT NULL"
    lo = f"(CASE WHEN {both} AND NOT (sv0 > sv1) AND sv1 > sv0 * 1000 THEN sv0 * {_repair('sr1', 'sr0')} ELSE sv0 END)"
    hi = f"(CASE WHEN {both} AND sv0 > sv1 THEN sv1 * {_repair('sr0', 'sr1')} ELSE sv1 END)"
    pick = lambda e: (f"(CASE WHEN s_txt IS NULL OR s_missing THEN NULL WHEN len(s_parts) = 1 THEN sv0 "
                      f"WHEN len(s_parts) = 2 THEN {e} ELSE NULL END)")
    return f"""{out}_a AS (SELECT *, {st} AS s_txt FROM {src}),
{out}_b AS (SELECT *, ({missing} OR s_txt = '') AS s_missing,
   (CASE {cur} ELSE CAST(1 AS DOUBLE) END) AS s_cur,
   regexp_split_to_array(s_txt, '[-–—to]') AS s_parts FROM {out}_a),
{out}_c AS (SELECT *, {l0}, {l1} FROM {out}_b),
{out}_d AS (SELECT *, {m0}, {m1} FROM {out}_c),
{out}_e AS (SELECT *, {v0}, {v1} FROM {out}_d),
{out} AS (SELECT *, {pick(lo)} AS salary_min, {pick(hi)} AS salary_max FROM {out}_e)"""


JOB_COLS = ("job_title, company_name, location, country, job_type, experience, education, "
            "salary_min, salary_max, skills, keyword, platform, post_date, job_url")


def jobs_cte(name: str = "jobs") -> str:
    """CTE text defining ``{name}``: unified jobs (D6 + job_id) from the adapter."""
    ns = q(NOT_STATED)
    gk = "platform IN ('Glints', 'Karir.com')"
    body = f"""SELECT job_id, job_title, company_name, location, {country('location')} AS country,
  CASE WHEN platform = 'Indeed' THEN {snippet_job_type('salary_raw', 'job_type_raw')}
       WHEN platform = 'LinkedIn' THEN 'Full-time' ELSE {job_type('job_type_raw')} END AS job_type,
  CASE WHEN {gk} THEN {unstated('experience_raw')}
       WHEN platform = 'Tech In Asia' THEN {years('experience_years_raw')} ELSE {ns} END AS experience,
  CASE WHEN {gk} THEN {unstated('education_raw')} ELSE {ns} END AS education,
  CASE WHEN {gk} THEN salary_min END AS salary_min,
  CASE WHEN {gk} THEN salary_max END AS salary_max,
  CASE WHEN platform IN ('Karir.com', 'Tech In Asia') THEN coalesce(skills_html, '') ELSE '' END AS skills,
  CASE WHEN platform IN ('Karir.com', 'Tech In Asia') THEN job_title ELSE keyword END AS keyword,
  platform,
  CASE WHEN platform = 'Indeed' THEN {ns} ELSE coalesce(post_date_raw, {ns}) END AS post_date,
  {ns} AS job_url
FROM {name}_sal"""
    return f"""{name}_raw AS ({RAW_JOBS}),
{salary_ctes(f'{name}_raw', 'salary_raw', f'{name}_sal')},
{name} AS ({body})"""


def with_jobs(select_sql: str, *ctes: str) -> str:
    """A full query: the jobs CTE (plus ``ctes``), then ``select_sql``."""
    extra = "".join(f",\n{c}" for c in ctes)
    return f"WITH {jobs_cte()}{extra}\n{select_sql}"


def docs_cte(name: str = "docs") -> str:
    """Flattened documents: jobs plus salary_avg (avg only with both ends)."""
    return (f"{name} AS (SELECT *, CASE WHEN salary_min IS NOT NULL AND salary_max IS NOT NULL "
            f"THEN (salary_min + salary_max) / 2 END AS salary_avg FROM jobs)")


def top(metric: str, *keys: str, n=None) -> str:
    order = ", ".join([f"{metric} DESC"] + [f"{k} ASC NULLS FIRST" for k in keys])
    return f"ORDER BY {order}" + (f" LIMIT {n}" if n else "")


def money(x: str) -> str:
    return f"CAST(round(CAST({x} AS DECIMAL(38,6)), 2) AS DOUBLE)"


# --- twins of the other adapters in sources/testbed.py -------------------------------
TITLES = "CASE mod({k},4) WHEN 0 THEN 'Data Engineer' WHEN 1 THEN 'Web Developer' WHEN 2 THEN 'QA Engineer' ELSE 'Data Analyst' END"

LISTING = f"""SELECT o.o_orderkey AS id,
 '<b>' || {TITLES.format(k='o.o_orderkey')} || '</b>&nbsp;' AS job_position,
 c.c_name AS company_name,
 'Kota ' || o.o_orderstatus AS location_name,
 CASE mod(o.o_orderkey,3) WHEN 0 THEN NULL WHEN 1 THEN 0 ELSE CAST(floor(o.o_totalprice / 100) AS BIGINT) * 1000 END AS salary_lower,
 CAST(floor(o.o_totalprice / 100) AS BIGINT) * 1000 * 2 AS salary_upper,
 CASE WHEN mod(o.o_orderkey,7) = 0 THEN NULL ELSE strftime(o.o_orderdate, '%Y-%m-%dT%H:%M:%S') END AS posted_at
FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey"""

DETAIL = """SELECT l_orderkey AS id,
 CASE mod(l_orderkey,4) WHEN 0 THEN NULL WHEN 1 THEN '' ELSE 'Gedung ' || status END AS location,
 CASE WHEN mod(l_orderkey,5) = 0 THEN NULL ELSE '<p>Kontrak</p>' || '&amp; ' || status END AS job_type,
 CASE WHEN mod(l_orderkey,6) = 0 THEN NULL ELSE CAST(n_lines AS BIGINT) END AS work_experience,
 list_transform(flags, lambda f: 'S' || f) AS degrees,
 '<ul><li>' || CAST(CAST(floor(qty) AS BIGINT) AS VARCHAR) || ' unit</li>  <li>&quot;SQL&quot;</li></ul>' AS requirements,
 CASE WHEN mod(l_orderkey,2) = 0 THEN '<p></p>' ELSE '<p>Build &amp; ship</p>' END AS responsibilities
FROM (SELECT l_orderkey, max(l_linenumber) AS n_lines, list_sort(list_distinct(list(l_returnflag))) AS flags,
        min(l_linestatus) AS status, sum(l_quantity) AS qty FROM lineitem GROUP BY l_orderkey) g"""


def _hit_sql(k: str) -> str:
    t = "('Engineer ' || o.o_orderpriority)"
    return f"""('{{' ||
 CASE mod({k},4) WHEN 0 THEN '"title":null,"name":"Alt ' || {t} || '",' WHEN 1 THEN '"title":"","name":"Alt ' || {t} || '",'
   WHEN 2 THEN '"title":"' || {t} || '",' ELSE '' END ||
 CASE mod({k},4) WHEN 0 THEN '"company":{{"name":"' || c.c_name || '"}},' WHEN 1 THEN '"company":{{}},'
   WHEN 2 THEN '"company":null,' ELSE '"company":{{"name":null}},' END ||
 CASE mod({k},2) WHEN 0 THEN '"city":{{"country_name":"' || n.n_name || '"}},' ELSE '"city":{{"country_name":null}},' END ||
 CASE mod({k},3) WHEN 0 THEN '"work_country_name":"Singapore",' ELSE '' END ||
 CASE mod({k},3) WHEN 0 THEN '"job_type":{{"name":"Full-time"}},' WHEN 1 THEN '"job_type":"Kontrak",' ELSE '' END ||
 CASE mod({k},3) WHEN 0 THEN '"job_skills":[{{"name":"SQL"}},{{"name":"Spark"}}],'
   WHEN 1 THEN '"job_skills":[],"skills":[{{"name":"Python"}},"Go"],' ELSE '' END ||
 CASE WHEN mod({k},7) = 0 THEN '' ELSE '"experience_min":' || CAST(mod({k},5) AS VARCHAR) || ',' END ||
 CASE WHEN mod({k},10) = 0 THEN '"published_at":null' ELSE '"published_at":"' || CAST(CAST(o.o_orderdate AS DATE) AS VARCHAR) || '"' END ||
 '}}')"""


PAYLOADS = f"""SELECT o.o_orderkey AS payload_id,
 '{{"results":[{{"hits":[' || {_hit_sql('o.o_orderkey')} || ',' || {_hit_sql('(o.o_orderkey + 1)')} || ']}}]}}' AS payload
FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey JOIN nation n ON c.c_nationkey = n.n_nationkey"""
