"""Atomic replacement of tables (K3, K5, K6) and the window log.

A table is a folder with ``data/<version>-<id>`` folders and small manifests
``_manifest/<version>``; the manifest of the highest number names the folders that
make up the table. A writer fills a new data folder first and puts its manifest
in place last, by renaming a finished file, so a reader sees one whole version
at any time, and a writer that dies leaves the version before. The folders of
the last ``KEEP`` versions stay, for readers that have begun; older ones and what
dead writers left behind go with the next write. One writer a table.
"""

from __future__ import annotations

import json
import uuid
from typing import Callable, Optional

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Versions whose folders stay.
KEEP = 3
#: Runs of one level of a window log that are merged into one of the next.
FAN = 8


def _fs(spark: SparkSession, path: str):
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _at(spark: SparkSession, path: str):
    return spark._jvm.org.apache.hadoop.fs.Path(path)


def _names(spark: SparkSession, path: str) -> list[str]:
    fs = _fs(spark, path)
    if not fs.exists(_at(spark, path)):
        return []
    return [s.getPath().getName() for s in fs.listStatus(_at(spark, path))]


def versions(spark: SparkSession, path: str) -> list[int]:
    return sorted(int(n) for n in _names(spark, f"{path}/_manifest") if n.isdigit())


def manifest(spark: SparkSession, path: str, version: Optional[int] = None) -> Optional[dict]:
    """The content of a version (the last one), with its number; None where there is none."""
    if version is None:
        known = versions(spark, path)
        if not known:
            return None
        version = known[-1]
    place = f"{path}/_manifest/{version:012d}"
    stream = _fs(spark, path).open(_at(spark, place))
    try:
        text = spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()
    return {**json.loads(text), "version": version}


def commit(spark: SparkSession, path: str, content: dict) -> int:
    """Puts a manifest in place and clears what no kept version names."""
    fs, known = _fs(spark, path), versions(spark, path)
    version = known[-1] + 1 if known else 1
    content = {k: v for k, v in content.items() if k != "version"}
    hidden = _at(spark, f"{path}/_manifest/.{version:012d}-{uuid.uuid4().hex}")
    out = fs.create(hidden, True)
    try:
        out.write(bytearray(json.dumps(content).encode()))
    finally:
        out.close()
    place = _at(spark, f"{path}/_manifest/{version:012d}")
    if fs.exists(place) or not fs.rename(hidden, place):
        raise RuntimeError(f"another writer has put version {version} of {path} in place")
    kept = (known + [version])[-KEEP:]
    used = {f for v in kept for f in manifest(spark, path, v)["folders"]}
    for old in known:
        if old not in kept:
            fs.delete(_at(spark, f"{path}/_manifest/{old:012d}"), False)
    for name in _names(spark, f"{path}/data"):
        if name not in used:
            fs.delete(_at(spark, f"{path}/data/{name}"), True)
    return version


def new_folder(spark: SparkSession, path: str) -> str:
    return f"{(versions(spark, path) or [0])[-1] + 1:012d}-{uuid.uuid4().hex[:12]}"


def write_parquet(df: DataFrame, folder: str) -> None:
    df.write.parquet(folder)


def replace_table(df: DataFrame, path: str, write: Callable[[DataFrame, str], None] = write_parquet) -> int:
    """A new version of the whole table; returns its number. ``df`` may read the table itself."""
    spark = df.sparkSession
    name = new_folder(spark, path)
    write(df, f"{path}/data/{name}")
    return commit(spark, path, {"folders": [name]})


def current_folder(spark: SparkSession, path: str) -> Optional[str]:
    """The data folder of the last version of a replaced table; None where there is none."""
    found = manifest(spark, path)
    return f"{path}/data/{found['folders'][0]}" if found else None


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """The last version; a table that was never written is an AnalysisException, as any missing path."""
    return spark.read.parquet(current_folder(spark, path) or f"{path}/data")


class WindowLog:
    """Counts of windows, kept as runs of updates. A batch adds one run of its own updated
    windows; ``FAN`` runs of a level are merged into one of the next, so a window is
    rewritten once a level, and bytes written follow the updates, not the history.
    The count of the latest batch stands for a window. A batch that was taken
    before (a replay) changes nothing."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _read(self, runs: list[dict]) -> DataFrame:
        return self.spark.read.parquet(*[f"{self.path}/data/{r['folder']}" for r in runs])

    @staticmethod
    def _latest(rows: DataFrame) -> DataFrame:
        return rows.groupBy("window_start", "window_end", "platform").agg(
            F.max_by("jobs_per_minute", "batch_id").alias("jobs_per_minute"), F.max("batch_id").alias("batch_id"))

    def append(self, batch: DataFrame, batch_id: int) -> None:
        found = manifest(self.spark, self.path) or {"runs": [], "last": -1}
        if batch_id <= found["last"]:
            return
        name = new_folder(self.spark, self.path)
        batch.withColumn("batch_id", F.lit(int(batch_id)).cast("long")).write.parquet(f"{self.path}/data/{name}")
        runs, level = [*found["runs"], {"folder": name, "level": 0}], 0
        while len(full := [r for r in runs if r["level"] == level]) >= FAN:
            merged = f"{name}-{level + 1}"
            self._latest(self._read(full)).write.parquet(f"{self.path}/data/{merged}")
            runs = [r for r in runs if r["level"] != level] + [{"folder": merged, "level": level + 1}]
            level += 1
        commit(self.spark, self.path, {"folders": [r["folder"] for r in runs], "runs": runs, "last": int(batch_id)})

    def read(self) -> DataFrame:
        """The latest count of every window."""
        found = manifest(self.spark, self.path)
        if found is None:
            return self.spark.read.parquet(f"{self.path}/data")
        return self._latest(self._read(found["runs"])).drop("batch_id")
