"""Schemas, sentinels and the fixed vocabularies the job data is normalised with.

Everything in the "fixed values" blocks must keep these exact spellings: they
are group keys and display values, so results only agree when they match.
"""

from __future__ import annotations

from pyspark.sql.types import (
    ArrayType,
    DoubleType,
    LongType,
    StringType,
    StructField,
    StructType,
    TimestampType,
)

# --- fixed values: sentinels and defaults -------------------------------------
NOT_STATED = "Tidak dicantumkan"          # experience, education, post date, url, skills
UNKNOWN_TAG = "Tidak diketahui"           # missing card tags / location on a card
UNDISCLOSED_COMPANY = "Dirahasiakan"      # missing company on a card
DEFAULT_COUNTRY = "Indonesia"
DEFAULT_JOB_TYPE = "Full-time"
STREAM_UNKNOWN = "Unknown"                # stream nulls in platform / keyword / country
FRESH_GRADUATE = "Fresh Graduate / Tanpa Pengalaman"

# --- fixed values: platform literals, in source order ---------------------------
PLATFORMS = ["Glints", "Karir.com", "LinkedIn", "Tech In Asia", "Indeed"]

# --- fixed values: experience / education texts that mean "not stated" ----------
UNSTATED_TEXTS = ["tidak diketahui", "tidak dicantumkan", "tidak disebutkan", "apa saja"]

# --- fixed values: pandas' default NA tokens (read_csv without na_values) -------
NA_TOKENS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
    "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None",
    "n/a", "nan", "null",
]

# --- fixed values: dashboard display columns, in display order ------------------
DISPLAY_COLUMNS = [
    "job_title", "company_name", "location", "country", "job_type",
    "experience", "education", "salary_min", "salary_max", "platform", "post_date",
]

# --- fixed values: newest-postings columns of the live view ---------------------
RECENT_COLUMNS = [
    "event_time", "job_title", "company_name", "platform",
    "keyword", "country", "salary_min", "salary_max",
]


def _strings(*names: str) -> StructType:
    return StructType([StructField(n, StringType(), True) for n in names])


# Glints cards, Indonesian headers
GLINTS_RAW = _strings(
    "Judul Posisi", "Nama Perusahaan", "Lokasi", "Tipe Pekerjaan", "Pengalaman",
    "Pendidikan", "Gaji", "Tanggal Posting", "Keyword",
)

# Karir.com listing + detail records
KARIR_RAW = _strings(
    "job_title", "company_name", "location", "job_type", "experience_level",
    "education_req", "salary_range", "job_requirements", "job_responsibilities",
    "posted_date", "source_platform",
)

# D3: LinkedIn cards
LINKEDIN_RAW = _strings(
    "searched_keyword", "job_title", "company_name", "location", "job_link",
    "posted_date", "source_platform",
)

# Tech in Asia search hits (years kept as text, parsed with try_cast)
TECHINASIA_RAW = _strings(
    "job_title", "company_name", "location", "skills_required",
    "experience_years_min", "job_type", "published_at", "source_platform",
)

# Indeed cards
INDEED_RAW = _strings(
    "job_title", "company_name", "location", "country", "job_type", "experience",
    "education", "salary_min", "salary_max", "salary_raw", "skills", "keyword",
    "post_date", "job_url", "platform", "remote_flag",
)

# The unified jobs table
# --- fixed values: columns of the unified table, in order
JOBS = StructType([
    StructField("job_title", StringType(), True),
    StructField("company_name", StringType(), True),
    StructField("location", StringType(), True),
    StructField("country", StringType(), True),
    StructField("job_type", StringType(), True),
    StructField("experience", StringType(), True),
    StructField("education", StringType(), True),
    StructField("salary_min", DoubleType(), True),
    StructField("salary_max", DoubleType(), True),
    StructField("skills", StringType(), True),
    StructField("keyword", StringType(), True),
    StructField("platform", StringType(), True),
    StructField("post_date", StringType(), True),
    StructField("job_url", StringType(), True),
])
JOB_COLUMNS = [f.name for f in JOBS.fields]

SALARY = StructType([
    StructField("min", DoubleType(), True),
    StructField("max", DoubleType(), True),
    StructField("avg", DoubleType(), True),
])

# Job event as published on the topic
JOB_EVENT = StructType(
    [f for f in JOBS.fields if f.name != "skills"]
    + [StructField("event_time", StringType(), True)]
)
