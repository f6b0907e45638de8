"""Sort / limit / paging: T1-T4, N5, U3.

Every limit gets a total order (metric desc, then key asc with nulls first), so
results do not depend on partitioning. ``orderBy(...).limit(k)`` plans as
TakeOrderedAndProject: each task keeps its own top k, only k rows per task
reach the final merge.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _key(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def order_desc(metric: str, *keys) -> list:
    return [F.col(metric).desc()] + [_key(k).asc_nulls_first() for k in keys]


def top_k(df: DataFrame, n: int, metric: str, *keys) -> DataFrame:
    """Metric desc, tie-broken by keys asc (nulls first), first n."""
    return df.orderBy(*order_desc(metric, *keys)).limit(n)


def recent_k(df: DataFrame, n: int = 50, time_col: str = "event_time", *tie) -> DataFrame:
    """Newest n by ``time_col`` (compared as given, e.g. ISO text)."""
    order = [F.col(time_col).desc_nulls_last()] + [_key(t).asc() for t in tie]
    return df.orderBy(*order).limit(n)


def head(df: DataFrame, n: int) -> DataFrame:
    """T4: first n rows of an ordered frame."""
    return df.limit(n)


def page_info(df: DataFrame, page: int, page_size: int = 500) -> DataFrame:
    """One row (total, pages, page, start, end) for 1-based ``page``.

    ``pages = max(1, ceil(total / size))``; the page is clamped to that range,
    ``end = min(start + size, total)``. Only a global count is computed.
    """
    total = df.agg(F.count(F.lit(1)).alias("total_rows"))
    pages = F.greatest(F.lit(1), F.ceil(F.col("total_rows") / F.lit(page_size))).cast("bigint")
    cur = F.least(F.greatest(F.lit(page), F.lit(1)), pages)
    start = (cur - 1) * page_size
    return total.select(
        "total_rows", pages.alias("total_pages"), cur.alias("page"),
        start.alias("start_idx"), F.least(start + page_size, F.col("total_rows")).alias("end_idx"))


def _total_order(df: DataFrame, order_key: str) -> list:
    """The key (nulls first), then every other sortable column: repeated keys
    have one order, whatever the partitioning."""
    rest = [f.name for f in df.schema.fields
            if f.name != order_key and f.dataType.typeName() not in ("map", "variant")]
    return [F.col(f"`{c}`").asc_nulls_first() for c in [order_key] + rest]


def paginate(df: DataFrame, order_key: str, page: int, page_size: int = 500) -> DataFrame:
    """Rows [start, end) of ``df`` in ascending ``order_key``, nulls first.

    One ORDER BY + OFFSET/LIMIT for every depth; Catalyst plans it as a top-k
    (each task keeps ``end`` rows at most) or, beyond its own threshold, as a
    range-partitioned sort. Walking through many pages is ``next_page``'s work."""
    start = (max(page, 1) - 1) * page_size
    return df.orderBy(*_total_order(df, order_key)).offset(start).limit(page_size)


def next_page(df: DataFrame, order_key: str, after=None, page_size: int = 500) -> DataFrame:
    """T3 by position instead of number: the ``page_size`` rows that follow the
    row ``after`` (a Row of ``df``; None for the first page). Each task keeps
    one page of rows, however deep the page lies; no row is skipped or shown
    twice as long as rows differ."""
    order = _total_order(df, order_key)
    if after is None:
        return df.orderBy(*order).limit(page_size)
    kinds = {f.name: f.dataType for f in df.schema.fields}
    names = [order_key] + [c for c in kinds if c != order_key and kinds[c].typeName() not in ("map", "variant")]
    beyond, same = F.lit(False), F.lit(True)
    for c in names:
        col, last = F.col(f"`{c}`"), F.lit(after[c]).cast(kinds[c])
        beyond = beyond | (same & (col.isNotNull() if after[c] is None else F.coalesce(col > last, F.lit(False))))
        same = same & col.eqNullSafe(last)
    return df.where(beyond).orderBy(*order).limit(page_size)


def facet_values(df: DataFrame, column: str) -> DataFrame:
    """Sorted distinct non-null values of one column (filter options)."""
    return df.where(F.col(column).isNotNull()).select(column).distinct().orderBy(column)
