"""Source / sink queries (S1-S5, S7, S8; K1, K3 by round trip): the given
tables are written as the files the reference exchanges, then read back with
the readers under test. Files go to fresh folders under spark.checkpoint.dir."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from jobsight import schemas as S
from jobsight.operators.normalize import NORMALIZERS, flatten_documents
from jobsight.plans.catalog import register
from jobsight.plans.jobs import job_documents, unified_jobs
from jobsight.plans.oracle import JOB_COLS, q, with_jobs
from jobsight.session import app_key, scratch_path
from jobsight.sinks.files import append_records, replace_documents, write_csv, write_documents
from jobsight.sources import files as SRC
from jobsight.sources.testbed import raw_jobs, source_frame_full

_FILES: dict = {}

RAW_SCHEMAS = {
    "Glints": S.GLINTS_RAW, "Karir.com": S.KARIR_RAW, "LinkedIn": S.LINKEDIN_RAW,
    "Tech In Asia": S.TECHINASIA_RAW, "Indeed": S.INDEED_RAW,
}
SLUGS = {"Glints": "glints", "Karir.com": "karir", "LinkedIn": "linkedin",
         "Tech In Asia": "techinasia", "Indeed": "indeed"}
# delimiters used to write the per-source files of the sniffing check
SNIFF_DELIMITERS = {"Glints": ";", "Karir.com": ",", "LinkedIn": "\t", "Tech In Asia": "|", "Indeed": ";"}


def _with_id(schema: StructType) -> StructType:
    return StructType([StructField("job_id", LongType(), True)] + list(schema.fields))


def _once(spark, sf_dir, name, write):
    key = (app_key(spark), sf_dir, name)
    if key not in _FILES:
        path = scratch_path(spark, name)
        write(path)
        _FILES[key] = path
    return _FILES[key]


def _jobs_csv(spark, sf_dir):
    return _once(spark, sf_dir, "jobs_csv", lambda p: write_csv(unified_jobs(spark, sf_dir), p))


_NA = ("('', 'NA', 'N/A', 'n/a', 'NULL', 'null', 'None', 'NaN', 'nan', '#N/A', '#N/A N/A', '#NA', "
       "'-1.#IND', '-1.#QNAN', '-NaN', '-nan', '1.#IND', '1.#QNAN', '<NA>')")
_STR_COLS = [f.name for f in S.JOBS.fields if f.dataType.simpleString() == "string"]
_NA_SQL = with_jobs("SELECT job_id, " + ", ".join(
    f"CASE WHEN {c} IN {_NA} THEN NULL ELSE {c} END AS {c}" if c in _STR_COLS else c
    for c in [f.name for f in S.JOBS.fields]) + " FROM jobs")


@register("s01_read_jobs_csv", _NA_SQL)
def s01_read_jobs_csv(spark, sf_dir):
    return SRC.read_jobs_csv(spark, _jobs_csv(spark, sf_dir), _with_id(S.JOBS))


# Spark's CSV reader with default options reads an empty field as null but
# keeps "NA"-like text (unlike pandas): that is the batch job's view.
# (inferred types: ids below 2^31 are read as int)
_EMPTY_SQL = with_jobs("SELECT CAST(job_id AS INTEGER) AS job_id, " + ", ".join(
    f"nullif({c}, '') AS {c}" if c in _STR_COLS else c
    for c in [f.name for f in S.JOBS.fields]) + " FROM jobs")


@register("s02_read_jobs_csv_inferred", _EMPTY_SQL)
def s02_read_jobs_csv_inferred(spark, sf_dir):
    return SRC.read_jobs_csv_inferred(spark, _jobs_csv(spark, sf_dir))


def _source_files(spark, sf_dir):
    def write(base):
        raw = raw_jobs(spark, sf_dir, many=True)
        for p, schema in RAW_SCHEMAS.items():
            df = source_frame_full(raw, p, schema)
            if p == "LinkedIn":                    # columns in another order, and one more
                df = df.select(F.lit("x;y").alias("scraped_by"), *reversed(df.columns))
            write_csv(df, f"{base}/{SLUGS[p]}")
        # a source with a record of too many fields
        glints = source_frame_full(raw, "Glints", RAW_SCHEMAS["Glints"])
        last = glints.columns[-1]
        many = F.when(F.col("job_id") % 100 == 0, F.concat(F.coalesce(f"`{last}`", F.lit("")), F.lit(";too;many"))).otherwise(F.col(f"`{last}`"))
        (glints.withColumn(last, many).write.options(sep=";", header="true", quote="\u0000").csv(f"{base}/broken"))
    return _once(spark, sf_dir, "sources", write)


@register("s03_read_sources", with_jobs(f"SELECT job_id, {JOB_COLS} FROM jobs"))
def s03_read_sources(spark, sf_dir):
    base = _source_files(spark, sf_dir)
    specs = [(p, f"{base}/{SLUGS[p]}", _with_id(schema),
              (lambda df, p=p: NORMALIZERS[p](df, keep=["job_id"])))
             for p, schema in RAW_SCHEMAS.items()]
    specs.append(("missing", f"{base}/not-there", _with_id(S.GLINTS_RAW), NORMALIZERS["Glints"]))
    specs.append(("wrong header", f"{base}/karir", _with_id(S.GLINTS_RAW), NORMALIZERS["Glints"]))
    specs.append(("broken record", f"{base}/broken", _with_id(S.GLINTS_RAW), NORMALIZERS["Glints"]))
    return SRC.read_sources(spark, specs)


@register("s04_load_first_available", _NA_SQL)
def s04_load_first_available(spark, sf_dir):
    missing = scratch_path(spark, "no-documents")
    return SRC.load_first_available(spark, [
        lambda: SRC.read_documents(spark, missing),
        lambda: SRC.read_jobs_csv(spark, _jobs_csv(spark, sf_dir), _with_id(S.JOBS)),
    ], _with_id(S.JOBS))


@register("s05_read_replaced_documents", with_jobs(
    f"SELECT job_id, {JOB_COLS}, CASE WHEN salary_min IS NOT NULL AND salary_max IS NOT NULL "
    f"THEN (salary_min + salary_max) / 2 END AS salary_avg FROM jobs"))
def s05_read_replaced_documents(spark, sf_dir):
    """K3 + S5 by versions: the collection is put in place, then replaced by its next version."""
    def write(path):
        docs = job_documents(spark, sf_dir)
        replace_documents(docs.where("job_id % 2 = 0"), path)
        replace_documents(docs, path)
    path = _once(spark, sf_dir, "replaced", write)
    return flatten_documents(SRC.read_documents(spark, path))


@register("s05_read_documents", with_jobs(
    f"SELECT job_id, {JOB_COLS}, CASE WHEN salary_min IS NOT NULL AND salary_max IS NOT NULL "
    f"THEN (salary_min + salary_max) / 2 END AS salary_avg FROM jobs"))
def s05_read_documents(spark, sf_dir):
    path = _once(spark, sf_dir, "documents", lambda p: write_documents(job_documents(spark, sf_dir), p))
    return flatten_documents(SRC.read_documents(spark, path))


@register("s07_record_counts", with_jobs(
    "SELECT platform AS dataset, count(*) AS rows, 'ok' AS status FROM jobs_raw GROUP BY platform "
    "UNION ALL SELECT 'merged' AS dataset, count(*) AS rows, 'ok' AS status FROM jobs "
    "UNION ALL SELECT 'archive' AS dataset, CAST(NULL AS BIGINT) AS rows, 'missing' AS status "
    "UNION ALL SELECT 'TOTAL' AS dataset, count(*) AS rows, 'ok' AS status FROM jobs_raw"))
def s07_record_counts(spark, sf_dir):
    """Counts of the five source files (as written by the scrapers), the merged
    table, and one expected file that does not exist."""
    base = _source_files(spark, sf_dir)
    named = [(p, SRC.read_if_present(spark, f"{base}/{SLUGS[p]}", _with_id(schema)))
             for p, schema in RAW_SCHEMAS.items()]
    named.append(("archive", SRC.read_if_present(spark, f"{base}/archive", _with_id(S.GLINTS_RAW))))
    named.append(("merged", unified_jobs(spark, sf_dir)))
    return SRC.record_counts(named, exclude_from_total=["merged"])


def _sniff_files(spark, sf_dir):
    def write(base):
        raw = raw_jobs(spark, sf_dir, many=True)
        for p, d in SNIFF_DELIMITERS.items():
            df = source_frame_full(raw, p, RAW_SCHEMAS[p])
            df.write.mode("overwrite").options(sep=d, header="true", escape='"').csv(f"{base}/{SLUGS[p]}")
    return _once(spark, sf_dir, "sniff", write)


@register("s08_count_records_detect_delim", with_jobs(
    "SELECT CASE platform " + " ".join(f"WHEN {q(p)} THEN {q(SLUGS[p])}" for p in SNIFF_DELIMITERS)
    + " END AS dataset, CASE platform " + " ".join(
        f"WHEN {q(p)} THEN {q(d) if d != chr(9) else 'chr(9)'}" for p, d in SNIFF_DELIMITERS.items())
    + " END AS delimiter, count(*) AS records FROM jobs_raw WHERE platform IN ("
    + ", ".join(q(p) for p in SNIFF_DELIMITERS) + ") GROUP BY platform"))
def s08_count_records_detect_delim(spark, sf_dir):
    base = _sniff_files(spark, sf_dir)
    return SRC.count_records_detect_delim(spark, [f"{base}/{SLUGS[p]}" for p in SNIFF_DELIMITERS])


# --- K2, K7 by round trip -----------------------------------------------------------------

@register("k07_append_records", with_jobs("SELECT job_id, searched_keyword, job_title FROM (SELECT job_id, keyword AS searched_keyword, job_title "
          "FROM jobs_raw WHERE platform = 'LinkedIn')"))
def k07_append_records(spark, sf_dir):
    """K7: a source's records appended page by page (three writes), read back."""
    def write(path):
        rows = source_frame_full(raw_jobs(spark, sf_dir, many=True), "LinkedIn", S.LINKEDIN_RAW)
        for page in range(3):
            append_records(rows.where(F.pmod("job_id", F.lit(3)) == page), path)
    path = _once(spark, sf_dir, "appended", write)
    return SRC.read_jobs_csv(spark, path, _with_id(S.LINKEDIN_RAW)).select("job_id", "searched_keyword", "job_title")
