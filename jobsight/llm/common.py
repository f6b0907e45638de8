"""Helpers shared by the operators: Arrow batch plumbing, scratch tables, word hashes."""

from __future__ import annotations

from typing import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from jobsight.session import scratch_path

#: Rows handled at once inside a task; bounds memory with very long texts.
SLICE_ROWS = 256


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` under the shared checkpoint folder and read it back: cuts the
    lineage, and a lost executor never recomputes what lies before."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch = path
    return out


def discard(*tables: DataFrame | None) -> None:
    """Deletes materialised tables that nothing will read again. Only what
    ``materialise`` returned itself has a folder; other frames are left alone.

    Spark deletes the shuffle files of ended jobs when the driver's JVM collects their
    plans, which a driver with memory to spare puts off: it is asked to do so here, as what
    the tables were made by is no longer needed either."""
    gone = None
    for table in tables:
        path = getattr(table, "scratch", None)
        if path:
            gone = table.sparkSession
            folder = gone._jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(gone.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)
            table.scratch = None
    if gone is not None:
        gone._jvm.System.gc()


#: Bits of the filter of ``near_keys``: 2^18 words of 64 bits, whatever the number of keys.
FILTER_BITS = 24


def near_keys(rows: DataFrame, keys: DataFrame, column: str) -> DataFrame:
    """``rows`` and ``__near``: true for every row whose ``column`` is among ``keys``, and for
    few others. A bitmap over key hashes meets the rows as a broadcast table of at most
    2^18 words (4 MB); as the keys grow it fills, and more others are near."""
    def slot(c: Column) -> Column:
        return F.shiftrightunsigned(F.xxhash64(c), 64 - FILTER_BITS)

    words = materialise(
        keys.where(F.col(column).isNotNull()).select(slot(F.col(column)).alias("__slot"))
        .groupBy(F.shiftright("__slot", 6).alias("__at"))
        .agg(F.bit_or(F.expr("shiftleft(1L, cast(__slot & 63 AS INT))")).alias("__word")), "key-filter")
    own = slot(F.col(column))
    met = rows.withColumn("__at", F.shiftright(own, 6)).join(F.broadcast(words), "__at", "left")
    near = F.col("__word").isNotNull() & F.col(column).isNotNull() & (
        F.call_function("getbit", F.coalesce("__word", F.lit(0)).cast("long"), own.bitwiseAND(63).cast("int")) == 1)
    return met.select(*rows.columns, near.alias("__near"))


def without(rows: DataFrame, keys: DataFrame, column: str) -> DataFrame:
    """``rows`` whose ``column`` is not among ``keys`` (null stays). Rows that are not near
    stay where they are; only the others meet the keys in a join. That is an outer join, as
    Spark moves an anti join below the filter, where it would deal out all rows."""
    met = near_keys(rows, keys, column)
    named = keys.select(column, F.lit(True).alias("__among"))
    return met.where("NOT __near").drop("__near").unionByName(
        met.where("__near").drop("__near").join(named, column, "left").where("__among IS NULL").select(rows.columns))


def slices(batches: Iterator[pa.RecordBatch], rows: int = SLICE_ROWS) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def byte_slices(batches: Iterator[pa.RecordBatch], column: int, limit: int) -> Iterator[pa.RecordBatch]:
    """Slices with at most ``limit`` bytes of text in ``column``, or one row; a
    task's memory follows the limit or its longest text."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        total, start, sent = np.cumsum(sizes, dtype=np.int64), 0, 0
        while start < batch.num_rows:
            stop = max(start + 1, int(np.searchsorted(total, sent + limit, side="right")))
            yield batch.slice(start, stop - start)
            start, sent = stop, int(total[stop - 1])


def words(text: str | None) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of the text with A-Z lower-cased, as UTF-8.
    ``bytes.lower``/``bytes.split`` touch exactly these ASCII characters."""
    return text.encode().lower().split() if text else []


class WordHashes(dict):
    """64-bit hashes of words, remembered for the frequent ones. Emptied when
    full, so a task's memory stays bounded whatever the vocabulary."""

    LIMIT = 300_000

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.LIMIT:
            self.clear()
        value = xxhash.xxh3_64_intdigest(word)
        if len(word) <= 64:
            self[word] = value
        return value

    def of(self, ws: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, ws), dtype=np.uint64, count=len(ws))


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser (wrapping arithmetic)."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(32))


def gram_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of every run of ``k`` consecutive word hashes (order matters)."""
    n = len(h) - k + 1
    if n <= 0:
        return np.empty(0, dtype=np.uint64)
    out = h[:n].copy()
    for i in range(1, k):
        out = mix(out) + h[i:i + n]
    return mix(out)
