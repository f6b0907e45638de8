"""Projections and row normalisation: P1-P9, P11, P13, P16; merge U1/U2.

Each source's mapping to the unified jobs table (D6) is written once, as a list
of (output column, Column expression) over that source's own column names.
``normalize_<source>(df)`` applies it to a per-source frame; ``normalize_mixed``
applies all five in ONE projection over a frame that carries a ``platform``
column, so the five sources cost one scan instead of five scans plus a union.
"""

from __future__ import annotations

from functools import reduce
from typing import Callable, Optional

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobsight.functions.text import shared_rules
from jobsight.functions import (
    py_strip,
    clean_education,
    clean_experience,
    clean_number,
    date_part,
    detect_country,
    first_truthy,
    format_salary_range,
    indeed_job_type,
    join_degrees,
    map_years,
    midpoint,
    normalize_job_type,
    with_parsed_salary,
    strip_html,
    years_label,
)
from jobsight.schemas import (
    DEFAULT_JOB_TYPE,
    DISPLAY_COLUMNS,
    JOB_COLUMNS,
    NA_TOKENS,
    NOT_STATED,
    PLATFORMS,
    RECENT_COLUMNS,
    STREAM_UNKNOWN,
    UNKNOWN_TAG,
)

Getter = Callable[[str], Optional[Column]]

def _null_str() -> Column:
    return F.lit(None).cast("string")


def _or_null(c: Optional[Column]) -> Column:
    return _null_str() if c is None else c


def _fill(c: Optional[Column], default: str) -> Column:
    return F.lit(default) if c is None else F.coalesce(c, F.lit(default))


def _common(g: Getter, location: str, title="job_title", company="company_name"):
    loc = _or_null(g(location))
    return [
        ("job_title", _or_null(g(title))),
        ("company_name", _or_null(g(company))),
        ("location", loc),
        ("country", detect_country(loc)),
    ]


def glints_rules(g: Getter):
    """P1."""
    return _common(g, "Lokasi", "Judul Posisi", "Nama Perusahaan") + [
        ("job_type", normalize_job_type(_or_null(g("Tipe Pekerjaan")))),
        ("experience", clean_experience(_or_null(g("Pengalaman")))),
        ("education", clean_education(_or_null(g("Pendidikan")))),
        ("_salary_text", _or_null(g("Gaji"))),
        ("skills", F.lit("")),
        ("keyword", _or_null(g("Keyword"))),
        ("platform", F.lit("Glints")),
        ("post_date", _fill(g("Tanggal Posting"), NOT_STATED)),
        ("job_url", F.lit(NOT_STATED)),
    ]


def karir_rules(g: Getter):
    """Keyword is the job title; skills are the requirements."""
    return _common(g, "location") + [
        ("job_type", normalize_job_type(_or_null(g("job_type")))),
        ("experience", clean_experience(_or_null(g("experience_level")))),
        ("education", clean_education(_or_null(g("education_req")))),
        ("_salary_text", _or_null(g("salary_range"))),
        ("skills", _fill(g("job_requirements"), "")),
        ("keyword", _or_null(g("job_title"))),
        ("platform", F.lit("Karir.com")),
        ("post_date", _fill(g("posted_date"), NOT_STATED)),
        ("job_url", F.lit(NOT_STATED)),
    ]


def linkedin_rules(g: Getter):
    """Constants for type/experience/education, no salary."""
    return _common(g, "location") + [
        ("job_type", F.lit(DEFAULT_JOB_TYPE)),
        ("experience", F.lit(NOT_STATED)),
        ("education", F.lit(NOT_STATED)),
        ("_salary_text", _null_str()),
        ("skills", F.lit("")),
        ("keyword", _or_null(g("searched_keyword"))),
        ("platform", F.lit("LinkedIn")),
        ("post_date", _fill(g("posted_date"), NOT_STATED)),
        ("job_url", _fill(g("job_link"), NOT_STATED)),
    ]


def techinasia_rules(g: Getter):
    """Keyword is the job title; experience from minimum years."""
    return _common(g, "location") + [
        ("job_type", normalize_job_type(_or_null(g("job_type")))),
        ("experience", map_years(_or_null(g("experience_years_min")))),
        ("education", F.lit(NOT_STATED)),
        ("_salary_text", _null_str()),
        ("skills", _fill(g("skills_required"), "")),
        ("keyword", _or_null(g("job_title"))),
        ("platform", F.lit("Tech In Asia")),
        ("post_date", _fill(g("published_at"), NOT_STATED)),
        ("job_url", F.lit(NOT_STATED)),
    ]


def indeed_rules(g: Getter):
    """P5: job type from the salary snippet (F6); scraped salary, skills and
    post date are discarded."""
    return _common(g, "location") + [
        ("job_type", indeed_job_type(_or_null(g("salary_raw")), _or_null(g("job_type")))),
        ("experience", F.lit(NOT_STATED)),
        ("education", F.lit(NOT_STATED)),
        ("_salary_text", _null_str()),
        ("skills", F.lit("")),
        ("keyword", _or_null(g("keyword"))),
        ("platform", F.lit("Indeed")),
        ("post_date", F.lit(NOT_STATED)),
        ("job_url", _fill(g("job_url"), NOT_STATED)),
    ]


RULES = {
    "Glints": glints_rules,
    "Karir.com": karir_rules,
    "LinkedIn": linkedin_rules,
    "Tech In Asia": techinasia_rules,
    "Indeed": indeed_rules,
}


def _flatten_salary(df: DataFrame, keep) -> DataFrame:
    df = with_parsed_salary(df, "_salary_text", "_salary")
    out = []
    for c in JOB_COLUMNS:
        if c == "salary_min":
            out.append(F.col("_salary.min").alias("salary_min"))
        elif c == "salary_max":
            out.append(F.col("_salary.max").alias("salary_max"))
        else:
            out.append(F.col(c))
    return df.select(*keep, *out)


def _apply(df: DataFrame, rules, keep=()) -> DataFrame:
    cols = set(df.columns)
    getter: Getter = lambda name: F.col(f"`{name}`") if name in cols else None
    exprs = [e.alias(n) for n, e in rules(getter)]
    keep = [c for c in keep if c in cols]
    return _flatten_salary(df.select(*keep, *exprs), keep)


def normalize_glints(df: DataFrame, keep=()) -> DataFrame:
    return _apply(df, glints_rules, keep)


def normalize_karir(df: DataFrame, keep=()) -> DataFrame:
    return _apply(df, karir_rules, keep)


def normalize_linkedin(df: DataFrame, keep=()) -> DataFrame:
    return _apply(df, linkedin_rules, keep)


def normalize_techinasia(df: DataFrame, keep=()) -> DataFrame:
    return _apply(df, techinasia_rules, keep)


def normalize_indeed(df: DataFrame, keep=()) -> DataFrame:
    return _apply(df, indeed_rules, keep)


NORMALIZERS = {
    "Glints": normalize_glints,
    "Karir.com": normalize_karir,
    "LinkedIn": normalize_linkedin,
    "Tech In Asia": normalize_techinasia,
    "Indeed": normalize_indeed,
}


def normalize_mixed(df: DataFrame, column_maps: dict, platform_col: str = "platform",
                    keep=()) -> DataFrame:
    """All five normalisers fused into one projection.

    ``column_maps[platform]`` lists (column in ``df``, source column name)
    pairs, i.e. how that source's columns appear in the mixed frame. Rows whose
    platform is not one of the five are dropped, as a per-source filter would.
    Branches with identical expressions are merged into one ``isin`` test, so
    e.g. the salary parser appears once for the two sources that have one.
    """
    plat = F.col(platform_col)
    key = (_session_key(df), tuple(df.columns), repr(sorted(column_maps.items())), platform_col)
    if key not in _FUSED:
        _FUSED[key] = _fused_exprs(df.columns, column_maps, plat)
    keep = [c for c in keep if c in df.columns]
    staged = df.where(plat.isin(PLATFORMS)).select(*keep, *_FUSED[key])
    return _flatten_salary(staged, keep)


# Fused rule expressions reference input columns by name only, so they are
# built once per session and input layout, then reused for any input frame.
_FUSED: dict = {}


def _session_key(df: DataFrame):
    from jobsight.session import app_key
    return app_key(df.sparkSession)


def _fused_exprs(columns, column_maps: dict, plat: Column) -> list:
    cols = {c: F.col(f"`{c}`") for c in columns}        # one Column object per input column
    per_source = {}
    with shared_rules():
        for p, rules in RULES.items():
            m = {src: cols[col] for col, src in column_maps.get(p, [])}
            per_source[p] = dict(rules(lambda name, m=m: m.get(name)))
    names = [n for n, _ in next(iter(per_source.values())).items()]
    exprs = []
    for n in names:
        groups: dict = {}
        by_id: dict = {}
        for p in PLATFORMS:
            e = per_source[p][n]
            key = by_id.setdefault(id(e), str(e))        # shared objects: one toString
            groups.setdefault(key, (e, []))[1].append(p)
        expr = None
        for e, ps in groups.values():
            cond = plat == ps[0] if len(ps) == 1 else plat.isin(ps)
            expr = F.when(cond, e) if expr is None else expr.when(cond, e)
        exprs.append(expr.alias(n))
    return exprs


# --- U1 / U2 ------------------------------------------------------------------------

def merge_sources(frames) -> DataFrame:
    """UNION ALL by column name of the given (non-None) frames; no dedup."""
    frames = [f for f in frames if f is not None]
    if not frames:
        raise ValueError("no source frames")
    return reduce(lambda a, b: a.unionByName(b), frames)


def merge_master(old: DataFrame, new: DataFrame, keys, seq: str) -> DataFrame:
    """Old UNION ALL new, then keep the last row per key (new beats old,
    later ``seq`` beats earlier within each)."""
    from jobsight.operators.dedup import dedup_keep_last

    both = (old.withColumn("_batch", F.lit(0))
            .unionByName(new.withColumn("_batch", F.lit(1))))
    return dedup_keep_last(both, keys, ["_batch", seq]).drop("_batch")


# --- P6-P9, P11, P13, P16 ---------------------------------------------------------

def to_documents(jobs: DataFrame, imported_at: Optional[Column] = None) -> DataFrame:
    """Nest the salary as {min, max, avg}; avg only when both ends exist;
    NaN and infinities become null; stamp ``imported_at``."""
    lo = clean_number(F.col("salary_min"))
    hi = clean_number(F.col("salary_max"))
    salary = F.struct(lo.alias("min"), hi.alias("max"),
                      F.when(lo.isNotNull() & hi.isNotNull(), midpoint(lo, hi)).alias("avg"))
    keep = [c for c in jobs.columns if c not in ("salary_min", "salary_max")]
    stamp = imported_at if imported_at is not None else F.current_timestamp()
    return jobs.select(*keep, salary.alias("salary"), stamp.alias("imported_at"))


def nullify_na(df: DataFrame, columns=None, tokens=NA_TOKENS) -> DataFrame:
    """pandas' NA tokens in string columns and NaN in double columns -> null."""
    types = dict(df.dtypes)
    columns = columns or df.columns
    out = []
    for c in df.columns:
        col = F.col(f"`{c}`")
        if c in columns and types[c] == "string":
            col = F.when(~col.isin(tokens), col)
        elif c in columns and types[c] in ("double", "float"):
            col = F.when(~F.isnan(col), col)
        out.append(col.alias(c))
    return df.select(*out)


def flatten_documents(docs: DataFrame, with_avg: bool = True) -> DataFrame:
    """Salary.min/max(/avg) -> flat columns; drops ``imported_at``."""
    keep = [c for c in docs.columns if c not in ("salary", "imported_at", "_id")]
    flat = [F.col("salary.min").alias("salary_min"), F.col("salary.max").alias("salary_max")]
    if with_avg:
        flat.append(F.col("salary.avg").alias("salary_avg"))
    return docs.select(*keep, *flat)


def display_projection(df: DataFrame, columns=DISPLAY_COLUMNS) -> DataFrame:
    """The display columns that exist, in display order."""
    return df.select(*[c for c in columns if c in df.columns])


def recent_projection(df: DataFrame) -> DataFrame:
    """The newest-postings columns."""
    return df.select(*RECENT_COLUMNS)


def flatten_detail(joined: DataFrame, keep=()) -> DataFrame:
    """A listing joined with its detail -> the Karir raw record.

    Detail location is preferred to the listing's when truthy; missing years
    count as 0; missing degrees and a missing or null ``posted_at`` give "" (a
    stated difference for the explicit null)."""
    loc = "detail_location" if "detail_location" in joined.columns else "location"
    return joined.select(
        *keep,
        strip_html(F.col("job_position")).alias("job_title"),
        strip_html(F.col("company_name")).alias("company_name"),
        strip_html(first_truthy(F.col(loc), F.col("location_name"))).alias("location"),
        strip_html(F.col("job_type")).alias("job_type"),
        years_label(F.col("work_experience")).alias("experience_level"),
        join_degrees(F.col("degrees")).alias("education_req"),
        format_salary_range(F.col("salary_lower"), F.col("salary_upper")).alias("salary_range"),
        strip_html(F.col("requirements")).alias("job_requirements"),
        strip_html(F.col("responsibilities")).alias("job_responsibilities"),
        F.coalesce(date_part(F.col("posted_at")), F.lit("")).alias("posted_date"),
        F.lit("Karir.com").alias("source_platform"),
    )


def tag_positions(tags) -> list:
    """Drop empty tags and tags with "+", then element 0/1/2 ->
    (job type, experience, education), missing -> "Tidak diketahui"."""
    t = F.col(tags) if isinstance(tags, str) else tags
    kept = F.filter(F.transform(t, lambda x: py_strip(x)),
                    lambda x: (x != "") & ~x.contains("+"))
    return [F.coalesce(F.get(kept, i), F.lit(UNKNOWN_TAG)) for i in range(3)]


def fill_stream_unknown(df: DataFrame) -> DataFrame:
    """Stream rule: null platform / keyword / country -> "Unknown"."""
    return df.fillna({"platform": STREAM_UNKNOWN, "keyword": STREAM_UNKNOWN,
                      "country": STREAM_UNKNOWN})
