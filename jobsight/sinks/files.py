"""File sinks K1-K3, K7. Writes are distributed (one file per task), never
collected to the driver; a "file" of the reference is a folder of part files."""

from __future__ import annotations

from typing import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CSV_WRITE = {"sep": ";", "header": "true", "escape": '"', "quoteAll": "false"}


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """K1: ``;`` CSV with header (quotes doubled, pandas-compatible)."""
    df.write.mode(mode).options(**CSV_WRITE).csv(path)


def write_outputs(outputs: Mapping[str, DataFrame], out_dir: str, clear: bool = True) -> None:
    """K2: the output folder is cleared (tables of earlier runs vanish), then
    each named result is written to ``out_dir/<name>``."""
    if outputs and clear:
        first = next(iter(outputs.values()))
        # an overwrite of the folder with an empty table removes what was there
        first.sparkSession.createDataFrame([], "cleared int").coalesce(1).write.mode("overwrite").csv(out_dir)
    for name, df in outputs.items():
        write_csv(df, f"{out_dir.rstrip('/')}/{name}")


def write_documents(docs: DataFrame, path: str) -> None:
    """K3: replace the document collection: parquet partitioned by platform,
    rows sorted by (country, keyword) within each file, so filters on
    platform prune folders and filters on country / keyword skip row groups
    (the role the store's indexes played).

    Rows are rebalanced by platform (the REBALANCE hint): adaptive execution
    groups each platform's rows into few tasks, so each folder gets few
    large files instead of one small file per input task, and it splits a
    platform that holds a third of the rows over several tasks (skew-aware),
    so no single task writes it all."""
    (docs.hint("rebalance", "platform")
     .sortWithinPartitions("platform", "country", "keyword")
     .write.mode("overwrite").partitionBy("platform").parquet(path))


def replace_documents(docs: DataFrame, path: str) -> int:
    """K3 for readers at work: the collection's next version, put in place whole."""
    from jobsight.sinks.snapshots import replace_table

    return replace_table(docs, path, write_documents)


def append_records(df: DataFrame, path: str) -> None:
    """K7: add a page's records to the raw file (append mode)."""
    write_csv(df, path, mode="append")
