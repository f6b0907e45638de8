"""U2, N3, J1 without moving the old rows: a bucketed master in generations.

Every update writes one generation: the batch's last row of each key, bucketed by a
hash of the key. Generations are bucketed alike, so the rows of a key lie in the
same bucket of each, and a newer generation beats an older one in a join that
shuffles neither. Only an update's own rows are exchanged, once, for their
deduplication. ``FAN`` generations are merged into one, bucket by bucket, again
without an exchange. A filter of fixed size over its key hashes lies beside each
generation; filters merge by OR, and tell which new rows have surely not been
ingested before anything is looked up.

The result equals ``merge_master`` over all batches in order: null keys form a key,
new beats old, the largest ``seq`` wins within a batch. Versions are put in place whole
(``sinks.snapshots``); one writer. The hash only places rows: keys are compared
themselves.
"""

from __future__ import annotations

import uuid
from functools import reduce
from typing import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from jobsight.operators.dedup import dedup_keep_last
from jobsight.sinks import snapshots as S

#: Generations that are merged into one.
FAN = 8
#: Bits of a generation's key filter: at most 2^18 words of 64 bits.
FILTER_BITS = 24


class Master:
    def __init__(self, spark: SparkSession, path: str, keys: Sequence[str], buckets: int = 64):
        self.spark, self.path, self.keys, self.buckets = spark, path, list(keys), buckets

    # ------------------------------------------------------------- generations

    def _key(self) -> Column:
        return F.xxhash64(*[F.col(f"`{k}`") for k in self.keys])

    def _write(self, rows: DataFrame, name: str) -> None:
        """``rows`` (with ``__key``) as a bucketed folder, and its key filter."""
        table = f"jobsight_master_{uuid.uuid4().hex}"
        (rows.write.format("parquet").bucketBy(self.buckets, "__key").sortBy("__key")
         .option("path", f"{self.path}/data/{name}/rows").saveAsTable(table))
        slot = F.shiftrightunsigned("__key", 64 - FILTER_BITS)
        (self.spark.table(table).select(slot.alias("slot")).groupBy(F.shiftright("slot", 6).alias("at"))
         .agg(F.bit_or(F.expr("shiftleft(1L, cast(slot & 63 AS INT))")).alias("word"))
         .coalesce(1).write.parquet(f"{self.path}/data/{name}/filter"))          # 2^18 rows at most
        self.spark.sql(f"DROP TABLE {table}")              # the files stay: the table is external

    def _generation(self, name: str, schema: StructType) -> DataFrame:
        """The folder as a table that knows its buckets."""
        table = f"jobsight_master_{uuid.uuid4().hex}"
        columns = ", ".join("`{}` {}".format(f.name.replace("`", "``"), f.dataType.simpleString()) for f in schema.fields)
        self.spark.sql(f"CREATE TABLE {table} ({columns}) USING parquet CLUSTERED BY (__key) SORTED BY (__key) "
                       f"INTO {self.buckets} BUCKETS LOCATION '{self.path}/data/{name}/rows'")
        try:
            return self.spark.table(table).select("*")
        finally:
            self.spark.sql(f"DROP TABLE {table}")

    def _generations(self, found: dict) -> list[DataFrame]:
        schema = StructType.fromJson(found["schema"])
        return [self._generation(n, schema) for n in found["folders"]]

    def _absent(self, rows: DataFrame, newer: DataFrame) -> DataFrame:
        """``rows`` whose key ``newer`` does not hold. The join is on the hash alone, so both
        sides keep their buckets; the keys are compared beside it."""
        n = newer.select(F.col("__key").alias("__n"), *[F.col(f"`{k}`").alias(f"__n{i}") for i, k in enumerate(self.keys)])
        same = reduce(lambda a, b: a & b, [
            F.coalesce(F.col(f"`{k}`") == F.col(f"__n{i}"), F.col(f"`{k}`").isNull() & F.col(f"__n{i}").isNull()) for i, k in enumerate(self.keys)])
        return rows.join(n, (F.col("__key") == F.col("__n")) & same, "left_anti")

    def _merged(self, generations: list[DataFrame]) -> DataFrame:
        kept = []
        for i, g in enumerate(generations):
            for newer in generations[i + 1:]:
                g = self._absent(g, newer)
            kept.append(g)
        return reduce(lambda a, b: a.unionByName(b), kept)

    # ------------------------------------------------------------- operators

    def update(self, batch: DataFrame, seq: str) -> None:
        """Merges a batch: its rows are the only ones that move."""
        found = S.manifest(self.spark, self.path)
        last = dedup_keep_last(batch, self.keys, [seq]).withColumn("__key", self._key())
        if found:
            schema = StructType.fromJson(found["schema"])
            if [f.name for f in schema.fields] != last.columns:
                raise ValueError(f"the master has the columns {[f.name for f in schema.fields][:-1]}")
            last = last.select(*[F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in schema.fields])
        else:
            schema = last.schema
        # the batch's rows meet by bucket, so each task writes its own buckets
        name = S.new_folder(self.spark, self.path)
        self._write(last.repartition(self.buckets, "__key"), name)
        folders = [*(found["folders"] if found else []), name]
        if len(folders) >= FAN:
            merged = f"{name}-merged"
            self._write(self._merged([self._generation(n, schema) for n in folders]), merged)
            folders = [merged]
        S.commit(self.spark, self.path, {"folders": folders, "schema": schema.jsonValue()})

    def read(self) -> DataFrame:
        """The master: the last row of every key."""
        found = S.manifest(self.spark, self.path)
        if found is None:
            return self.spark.read.parquet(f"{self.path}/data")
        return self._merged(self._generations(found)).drop("__key")

    def not_yet_ingested(self, new: DataFrame) -> DataFrame:
        """The rows of ``new`` whose key the master does not hold (a null key is a key).
        Rows that fail the merged filter are new at once; the others are looked up."""
        found = S.manifest(self.spark, self.path)
        if found is None:
            return new
        words = reduce(lambda a, b: a.unionByName(b), [self.spark.read.parquet(f"{self.path}/data/{n}/filter") for n in found["folders"]])
        words = words.groupBy(F.col("at").alias("__at")).agg(F.bit_or("word").alias("__word"))
        place = F.shiftrightunsigned("__key", 64 - FILTER_BITS)
        # a table of fixed size: at most 2^18 words
        met = (new.withColumn("__key", self._key()).withColumn("__at", F.shiftright(place, 6))
               .join(F.broadcast(words), "__at", "left")
               .withColumn("__near", F.col("__word").isNotNull() & (F.call_function(
                   "getbit", F.coalesce("__word", F.lit(0)).cast("long"), place.bitwiseAND(63).cast("int")) == 1)))
        near = met.where("__near").select(*new.columns, "__key")
        for g in self._generations(found):
            near = self._absent(near, g)
        return met.where("NOT __near").select(*new.columns).unionByName(near.select(*new.columns))
