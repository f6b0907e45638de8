"""Extendible hashing: shards of bounded size from a directory over hash-prefix bits.

All rows start in one bucket. A bucket whose bytes exceed the limit splits on
the next bit of the key's hash, only that bucket, until every shard fits. The
directory is built from byte sums per hash prefix, ``PAGE_BITS`` bits at a
time: one aggregation of the rows (map-side partial) gives a page of at most
2^PAGE_BITS sums, from which all splits of those bits follow; only prefixes
still too large after a page are summed again on their next bits. Rows look
their shard up by joins with the pages, so the directory is never held whole
by the driver or a task. DataFrame functions only.

Edge cases: a null key hashes as a value of its own; a null text has 0 bytes;
rows of one key cannot be told apart by its hash bits, so a bucket that is too
large at the last bit is a directory of its own, whose pages go over the bits of
a hash of the whole row and its number, so that identical rows part too. Its
shards have ``part`` = 1 followed by the bits used; which of its rows meet
depends on the numbers, so on how the input was read. A shard above the limit
holds a single row. An empty table has no shards.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobsight.llm.common import materialise

PAGE_BITS = 12
#: Bits of md5 used; five pages.
MAX_BITS = 60


def hash_bits(key) -> "F.Column":
    """The first 60 bits of the key's md5, as a non-negative long."""
    text = F.coalesce(key.cast("string"), F.lit("\u0000null"))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("long")


def _page(rows: DataFrame, low: int, limit: int) -> DataFrame:
    """Leaves of one page of each directory: rows (root, bits, n_bytes), all of which sit
    in prefixes of ``low`` bits that are too large (or low = 0)."""
    high = min(low + PAGE_BITS, MAX_BITS)
    sums = (rows.groupBy("root", F.shiftright("bits", MAX_BITS - high).alias("prefix"))
            .agg(F.sum("n_bytes").alias("n_bytes"), F.count("*").alias("n_rows")))
    # every entry of the page counts towards its ancestors: depth low .. high
    tried = sums.select("*", F.explode(F.sequence(F.lit(low), F.lit(high))).alias("depth")).withColumn(
        "bucket", F.expr(f"shiftright(prefix, {high} - depth)"))
    up = (tried.groupBy("root", "depth", "bucket")
          .agg(F.sum("n_bytes").alias("shard_bytes"), F.sum("n_rows").alias("shard_rows")))
    fits = up.where((F.col("shard_bytes") <= limit) | (F.col("shard_rows") == 1) | (F.col("depth") == MAX_BITS))
    # the pointer of an entry goes to its shallowest bucket that fits
    return (tried.select("root", "prefix", "depth", "bucket").join(fits, ["root", "depth", "bucket"])
            .groupBy("root", "prefix").agg(F.min(F.struct("depth", "bucket", "shard_bytes", "shard_rows")).alias("leaf"))
            .select("root", "prefix", "leaf.*"))


def _leaves(rows: DataFrame, limit: int) -> tuple[DataFrame, bool]:
    """(rows with depth, bucket, shard_bytes, shard_rows of their leaf in the directory
    ``root``, whether any was followed to its last bit)."""
    left, found, low = rows, None, 0
    while True:
        page = materialise(_page(left.select("root", "bits", "n_bytes"), low, limit), "shard-page")
        high = min(low + PAGE_BITS, MAX_BITS)
        hit = left.withColumn("prefix", F.shiftright("bits", MAX_BITS - high)).join(
            page, ["root", "prefix"], "left").drop("prefix")
        done = hit.where("depth IS NOT NULL")
        found = done if found is None else found.unionByName(done)
        if high == MAX_BITS:
            return found, True
        rest = hit.where("depth IS NULL").select(left.columns)
        if rest.isEmpty():
            return found, False
        left, low = materialise(rest, "shard-rest"), high


def _hashable(kind: str) -> bool:
    return "map<" not in kind and "variant" not in kind


def _placed(docs: DataFrame, row: "F.Column", limit_bytes: int, key_col: str, text_col: str) -> DataFrame:
    whole = [F.col(f"`{c}`") for c, kind in docs.dtypes if _hashable(kind)]
    rows = materialise(docs.select(
        row.alias("row"), F.lit(0).cast("long").alias("root"), hash_bits(F.col(key_col)).alias("bits"),
        F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("n_bytes"),
        F.xxhash64(*whole).alias("row_hash"), F.monotonically_increasing_id().alias("row_no")), "shard-rows")
    found, last = _leaves(rows, limit_bytes)
    out = found.withColumn("part", F.lit(0).cast("long"))
    if last:
        over = (F.col("depth") == MAX_BITS) & (F.col("shard_bytes") > limit_bytes) & (F.col("shard_rows") > 1)
        cut = materialise(found.where(over).select(
            "row", F.col("bits").alias("root"), hash_bits(F.concat_ws(":", "row_hash", "row_no")).alias("bits"), "n_bytes"),
            "shard-cut")
        if not cut.isEmpty():
            parts = _leaves(cut, limit_bytes)[0].select(
                "row", "n_bytes", F.lit(MAX_BITS).alias("depth"), F.col("root").alias("bucket"), "shard_bytes",
                F.expr("shiftleft(1L, depth) | bucket").alias("part"))
            out = out.where(~over).select(parts.columns).unionByName(parts)
    return out.withColumn("shard_id", F.concat_ws("-", "depth", "bucket", "part"))


def shard(docs: DataFrame, limit_bytes: int, key_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: key_col, n_bytes, depth, bucket (hash prefix of ``depth`` bits), part,
    shard_id ("depth-bucket-part"), shard_bytes."""
    placed = _placed(docs, F.col(key_col), limit_bytes, key_col, text_col)
    return placed.select(F.col("row").alias(key_col), "n_bytes", F.col("depth").cast("int").alias("depth"),
                         "bucket", "part", "shard_id", "shard_bytes")


def write_shards(docs: DataFrame, path: str, limit_bytes: int, key_col: str = "doc_id", text_col: str = "text") -> None:
    """Write every shard as a folder ``shard_id=...`` of Parquet. The rows travel as
    one struct, so their column names cannot clash with the directory's; a column
    ``shard_id`` of the input is replaced."""
    placed = _placed(docs, F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "shard_id"]), limit_bytes, key_col, text_col)
    placed.repartition("shard_id").select("row.*", "shard_id").write.partitionBy("shard_id").parquet(path)
