"""An inverted index behind the text search.

A posting is one row (bucket, term, key) for each stem that a row of the table
holds in its searched fields. The index is written
partitioned by ``bucket``, a hash of the term, and sorted by term inside its
files, so a query opens the folders of its own terms (PartitionFilters) and in
them the row groups of these terms. A frequent term is many rows of many files,
never one list in one task.

``append`` writes the postings of new rows only, beside the written ones. A row
whose key is written twice is found once. ``search`` gives the rows that the
scanning search (``filters.text_search``) gives, for every query: terms and
exclusions are settled by the index, phrases by a look at the candidates. A
query of phrases alone takes as candidates the rows that hold all inner words
of its phrases (outer words may be parts of longer words); phrases of one or two
words have none, and are looked for in the table.

Null fields hold no words; rows with a null key are not indexed and so must not
occur (``build`` says so). An empty table gives an empty index.
"""

from __future__ import annotations

from typing import Optional, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from jobsight.operators.filters import TEXT_FIELDS, has_phrases, parse_text_query, query_stems, with_search_tokens

BUCKETS = 64


def _bucket(term: Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(BUCKETS)).cast("int")


def postings(df: DataFrame, key: str, fields: Sequence[str] = TEXT_FIELDS) -> DataFrame:
    """bucket, term, key: each stem of each row once."""
    checked = F.coalesce(F.col(key), F.raise_error(F.lit(f"a row without {key} cannot be indexed")).cast(df.schema[key].dataType))
    out = with_search_tokens(df.select(checked.alias("key"), *fields), fields, "terms").select("key", F.explode("terms").alias("term"))
    return out.select(_bucket(F.col("term")).alias("bucket"), "term", "key")


class SearchIndex:
    """The index of one table under ``path``; ``key`` names its rows."""

    def __init__(self, spark: SparkSession, path: str, key: str, fields: Sequence[str] = TEXT_FIELDS):
        self.spark, self.path, self.key, self.fields = spark, path, key, list(fields)

    def _write(self, df: DataFrame, mode: str) -> None:
        rows = postings(df, self.key, self.fields)
        # a bucket's rows meet in few files; a large bucket is split over several tasks
        (rows.hint("rebalance", "bucket").sortWithinPartitions("bucket", "term")
         .write.mode(mode).partitionBy("bucket").parquet(self.path))

    def build(self, df: DataFrame) -> "SearchIndex":
        self._write(df, "overwrite")
        return self

    def append(self, new_rows: DataFrame) -> "SearchIndex":
        self._write(new_rows, "append")
        return self

    def read(self) -> DataFrame:
        return self.spark.read.parquet(self.path).select("bucket", "term", "key")

    def keys_of(self, stems: Sequence[str]) -> DataFrame:
        """Keys of the rows that hold any of the stems. Buckets are computed here, so the
        plan's partition filter is a plain list."""
        stems = sorted(set(stems))
        buckets = sorted({r[0] for r in self.spark.createDataFrame([(s,) for s in stems], "term string").select(_bucket(F.col("term"))).collect()})
        return self.read().where(F.col("bucket").isin(buckets) & F.col("term").isin(stems))

    def search(self, df: DataFrame, query: Optional[str]) -> DataFrame:
        """The rows of ``df`` (the indexed table, possibly filtered) that the query finds."""
        if not query:
            return df
        terms, phrases, negated = parse_text_query(query)
        if not terms and not phrases:                      # only exclusions select nothing
            return df.where(F.lit(False))
        wanted, unwanted = query_stems(self.spark, terms), query_stems(self.spark, negated)
        hit = None
        if wanted:
            hit = self.keys_of(wanted).select("key").distinct()
        else:
            inner = query_stems(self.spark, [w for p in phrases for w in parse_text_query(" ".join(p.split()[1:-1]))[0]])
            if inner:
                hit = (self.keys_of(inner).select("key", "term").distinct().groupBy("key").count()
                       .where(F.col("count") == len(set(inner))).select("key"))
        out = df
        if hit is not None:
            out = out.join(hit.withColumnRenamed("key", self.key), self.key, "left_semi")
        if unwanted:
            out = out.join(self.keys_of(unwanted).select(F.col("key").alias(self.key)), self.key, "left_anti")
        return out.where(has_phrases(phrases, self.fields)).select(*df.columns)
