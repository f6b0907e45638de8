"""Joins J1-J2.

Both joins are equi-joins planned by Catalyst; with AQE on, a side whose
*measured* shuffle size is under ``spark.sql.adaptive.autoBroadcastJoinThreshold``
is switched to a broadcast at run time, otherwise the sort-merge join stays
(and skewed partitions are split by AQE's skew-join handling).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def not_yet_ingested(new: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Rows of ``new`` whose key is absent from ``done`` (incremental load).

    ``done`` is reduced to its distinct non-null keys first (partial aggregation
    before the shuffle); null keys in ``new`` never match, so they are kept.
    """
    keys = done.where(F.col(key).isNotNull()).select(key).distinct()
    return new.join(keys, on=key, how="left_anti")


def enrich_with_detail(listing: DataFrame, detail: DataFrame, on: str = "id") -> DataFrame:
    """Each listing row with its detail row; a listing without a detail is
    dropped (inner join). Detail columns that clash with listing columns get a
    ``detail_`` prefix."""
    clash = (set(listing.columns) & set(detail.columns)) - {on}
    d = detail.select(*[F.col(c).alias(f"detail_{c}") if c in clash else F.col(c)
                        for c in detail.columns])
    return listing.join(d, on=on, how="inner")
