"""File sources S1-S5, S7, S8.

CSV files of the scrapers are ``;``-separated, have a header, may start with a
UTF-8 BOM (Spark drops it) and may hold quoted multi-line text with ``"`` as the
escape of a quote. Records are put together by ``quoted_csv``, so one file is read
by many tasks. pandas' default NA tokens become null on read (P7), like the
cleaning job's reader.
"""

from __future__ import annotations

from functools import reduce
from typing import Callable, Iterable, Optional, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType
from pyspark.sql.utils import AnalysisException

from jobsight.operators.normalize import nullify_na
from jobsight.sinks.snapshots import current_folder
from jobsight.sources.quoted_csv import csv_records

CSV_OPTIONS = {"sep": ";", "header": "true", "multiLine": "true", "escape": '"',
               "encoding": "UTF-8"}

# --- fixed values: delimiters of the scrapers' files, the usual one first -------------
CANDIDATE_DELIMITERS = [";", ",", "\t", "|"]


def header_schema(columns: Sequence[str], schema: StructType) -> StructType:
    """The file's columns in the file's order: known ones with the schema's
    types, others as text."""
    kinds = {f.name: f.dataType for f in schema.fields}
    return StructType([StructField(c, kinds.get(c, StringType()), True) for c in columns])


def _ddl(schema: StructType) -> str:
    return ", ".join("`{}` {}".format(f.name.replace("`", "``"), f.dataType.simpleString()) for f in schema.fields)


def _body(records: DataFrame, columns: Sequence[str], sep: str) -> DataFrame:
    """The records behind each file's header; a header that differs from ``columns``
    stops the reading."""
    fields = StructType([StructField(f"c{i}", StringType()) for i in range(len(columns) + 1)])
    head = F.from_csv("value", _ddl(fields), {"sep": sep, "escape": '"', "multiLine": "true"})
    same = F.array(*[F.lower(head[f"c{i}"]) for i in range(len(columns) + 1)]).eqNullSafe(
        F.array(*[F.lit(c.lower()) for c in columns], F.lit(None).cast("string")))
    wrong = F.raise_error(F.concat(F.lit("CSV header does not conform to the first file's: "), "value")).cast("boolean")
    return records.where(F.when(F.col("first"), F.when(same, F.lit(False)).otherwise(wrong)).otherwise(F.lit(True)))


def _parsed(records: DataFrame, columns: Sequence[str], schema: StructType, sep: str = ";") -> DataFrame:
    row = F.from_csv("value", _ddl(schema), {"sep": sep, "escape": '"', "multiLine": "true", "columnNameOfCorruptRecord": "_broken"})
    return _body(records, columns, sep).select(row.alias("row")).select("row.*")


def _columns_of(spark: SparkSession, path: str, schema: StructType) -> list:
    columns = header_columns(spark, path)
    missing = [f.name for f in schema.fields if f.name not in columns]
    if missing:
        raise ValueError(f"{path} has no column {missing}")
    return columns


def read_jobs_csv(spark: SparkSession, path: str, schema: StructType, na_tokens: bool = True,
                  multi_line: bool = True, records: Optional[DataFrame] = None) -> DataFrame:
    """A ``;`` CSV read by header name: columns may stand in any order and
    further ones are left out; a missing one is an error. NA tokens -> null.

    Quoted fields may hold newlines and a file is still read by many tasks
    (``quoted_csv.csv_records``, whose result may be given as ``records``). For files
    known to hold none, ``multi_line=False`` spares the pass over quote states."""
    columns = _columns_of(spark, path, schema)
    if multi_line:
        records = csv_records(spark, path, ";") if records is None else records
        df = _parsed(records, columns, header_schema(columns, schema))
    else:                                                   # every part file's header must agree with the first one's
        options = {**CSV_OPTIONS, "multiLine": "false", "enforceSchema": "false"}
        df = spark.read.options(**options).schema(header_schema(columns, schema)).csv(path)
    df = df.select(*[f"`{f.name}`" for f in schema.fields])
    return nullify_na(df) if na_tokens else df


def has_broken_rows(spark: SparkSession, path: str, schema: StructType, records: Optional[DataFrame] = None) -> bool:
    """Whether a record has more fields than the header (which stops the batch
    reader, so the source counts as unreadable). Ended by the first hit."""
    columns = header_columns(spark, path)
    records = csv_records(spark, path, ";") if records is None else records
    full = StructType(header_schema(columns, schema).fields + [StructField("_broken", StringType(), True)])
    fields = F.regexp_count(F.regexp_replace("_broken", '"[^"]*"', ""), F.lit(";")) + 1
    # the parser keeps a broken record's text only beside other columns
    rows = (_parsed(records, columns, full)
            .where(F.col("_broken").isNotNull() & (fields > len(columns)) & (F.length(F.concat_ws("", *[f"`{c}`" for c in columns])) >= 0)))
    return not rows.isEmpty()


def read_jobs_csv_inferred(spark: SparkSession, path: str) -> DataFrame:
    """The same file with types inferred (an extra pass over the data, as
    the batch job's reader does)."""
    return spark.read.options(header="true", delimiter=";", inferSchema="true").csv(path)


def header_columns(spark: SparkSession, path: str) -> list:
    """Column names of a CSV header (reads the header line only)."""
    return spark.read.options(**CSV_OPTIONS).csv(path).columns


def read_sources(spark: SparkSession, specs: Sequence[tuple]) -> Optional[DataFrame]:
    """S3 + U1: ``specs`` = (name, path, schema, normalizer). Each source is
    optional: a missing file, a header without the expected columns, or a
    record that cannot be read drops that source whole; the others are
    normalised and merged (UNION ALL by name, no dedup). Returns None when no
    source is readable."""
    frames = []
    for name, path, schema, normalize in specs:
        try:
            header_columns(spark, path)                     # a missing file ends here
            records = csv_records(spark, path, ";")
            if not has_broken_rows(spark, path, schema, records):
                frames.append(normalize(read_jobs_csv(spark, path, schema, records=records)))
        except (AnalysisException, ValueError):
            continue
    return reduce(lambda a, b: a.unionByName(b), frames) if frames else None


def load_first_available(spark: SparkSession, loaders: Iterable[Callable[[], DataFrame]],
                         schema: StructType) -> DataFrame:
    """The first loader that succeeds with a non-empty result (document
    store, then CSV, ...); otherwise an empty table with ``schema``."""
    for load in loaders:
        try:
            df = load()
        except AnalysisException:
            continue
        if df is not None and not df.isEmpty():
            return df
    return spark.createDataFrame([], schema)


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """The job documents (of a plain folder, or the last version of a replaced
    collection) without store id and import stamp."""
    df = spark.read.parquet(current_folder(spark, path) or path)
    return df.drop(*[c for c in ("_id", "imported_at") if c in df.columns])


def record_counts(named: Sequence[tuple], exclude_from_total: Sequence[str] = ()) -> DataFrame:
    """Rows per named dataset plus a TOTAL row over the datasets not
    excluded (e.g. the merged set). A dataset given as None (its file is
    missing) is listed with null rows and status "missing"; present ones have
    status "ok". One count job per dataset, unioned."""
    present = [(n, df) for n, df in named if df is not None]
    missing = [n for n, df in named if df is None]
    if not present:
        raise ValueError("no dataset to count")
    spark = present[0][1].sparkSession
    parts = [df.agg(F.count(F.lit(1)).alias("rows")).select(
        F.lit(n).alias("dataset"), "rows", F.lit("ok").alias("status")) for n, df in present]
    if missing:
        parts.append(spark.createDataFrame([(n, None, "missing") for n in missing],
                                           "dataset string, rows long, status string"))
    counts = reduce(lambda a, b: a.unionByName(b), parts)
    # the total is summed from the counted rows: each also adds to TOTAL
    both = F.array(F.col("dataset"), F.when(~F.col("dataset").isin(list(exclude_from_total)), "TOTAL"))
    return (counts.withColumn("dataset", F.explode(both)).where(F.col("dataset").isNotNull())
            .groupBy("dataset").agg(F.sum("rows").alias("rows"),
                                    F.when(F.col("dataset") == "TOTAL", "ok").otherwise(F.min("status")).alias("status")))


def read_if_present(spark: SparkSession, path: str, schema: StructType) -> Optional[DataFrame]:
    """S1 reader that returns None for a missing path (for S7's flags)."""
    try:
        header_columns(spark, path)
    except AnalysisException:
        return None
    return read_jobs_csv(spark, path, schema)


# --- fixed values: signs taken as delimiters in this order, where nothing is quoted ------
PREFERRED_DELIMITERS = [",", "\t", ";", " ", ":"]
# --- fixed values: a quoted field between, before and behind a delimiter -----------------
_QUOTED = [
    r"""(?s)([^\w\n"'])( ?)(["']).*?\3\1""",
    r"""(?s)^(["']).*?\1([^\w\n"'])( ?)""",
    r"""(?s)([^\w\n"'])( ?)(["']).*?\3$""",
]
_QUOTED_GROUP = [1, 2, 1]


def detect_delimiter(header) -> F.Column:
    """The delimiter of a header line, found as the counting script's sniffer finds it:
    the sign that most often stands beside quoted fields; where none is quoted, every
    sign of a single line is as consistent as any other, and the first of the preferred
    ones that occurs is taken. Where none of these occurs the most frequent other sign
    is (the sniffer would take the most frequent character, letters too); a line
    without signs has the first candidate."""
    h = F.col(header) if isinstance(header, str) else header

    def most_frequent(found: F.Column) -> F.Column:
        ranked = F.transform(F.array_distinct(found), lambda x: F.struct(
            F.size(F.filter(found, lambda y: y == x)).alias("n"), (-F.array_position(found, x)).alias("first"), x.alias("sign")))
        return F.array_max(ranked)["sign"]

    quoted = [most_frequent(F.regexp_extract_all(h, F.lit(rx), g)) for rx, g in zip(_QUOTED, _QUOTED_GROUP)]
    preferred = [F.when(h.contains(d), d) for d in PREFERRED_DELIMITERS]
    other = most_frequent(F.regexp_extract_all(h, F.lit(r"([^\w\s\"'])"), 1))
    return F.coalesce(*quoted, *preferred, other, F.lit(CANDIDATE_DELIMITERS[0]))


def count_records_detect_delim(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """Per dataset (a file or a folder of part files, named by its last path
    element), the delimiter sniffed from its header line and the number of CSV
    records (quoted newlines respected, headers excluded).

    Only each given dataset's first line is read ahead, to choose the reader."""
    counts = []
    for path in paths:
        first = spark.read.text(path).limit(1)
        delimiter = first.select(detect_delimiter("value").alias("d")).first()
        delimiter = delimiter["d"] if delimiter else CANDIDATE_DELIMITERS[0]
        rows = csv_records(spark, path, delimiter).where("NOT first")
        counts.append(rows.agg(F.count(F.lit(1)).alias("records")).select(
            F.lit(path.rstrip("/").rsplit("/", 1)[-1]).alias("dataset"), F.lit(delimiter).alias("delimiter"), "records"))
    return reduce(lambda a, b: a.unionByName(b), counts)
