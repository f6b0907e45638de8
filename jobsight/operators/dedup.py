"""Deduplication N2-N4 as aggregations, not windows.

``row_number() over (partition by key order by seq)`` sends every row of a key
to one task; a hot key (a third of the data) would then sort in one task. A
``min``/``max`` over ``struct(seq, ...)`` is partially aggregated map-side, so
each map task ships at most one row per key. Null keys form one group, like
pandas' ``drop_duplicates``. Ties in ``seq`` fall back to the other columns,
so the result never depends on partitioning.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _as_list(x):
    return [x] if isinstance(x, (str, Column)) else list(x)


def _dedup(df: DataFrame, keys: Sequence, seq: Sequence[str], pick) -> DataFrame:
    keys, seq = _as_list(keys), _as_list(seq)
    key_cols, key_names = [], []
    for i, k in enumerate(keys):
        if isinstance(k, str):
            key_cols.append(F.col(f"`{k}`").alias(f"_k{i}"))
            key_names.append(k)
        else:
            key_cols.append(k.alias(f"_k{i}"))
    rest = list(seq) + [c for c in df.columns if c not in seq]
    packed = F.struct(*[F.col(f"`{c}`").alias(f"_c{j}") for j, c in enumerate(rest)])
    grouped = df.select(*key_cols, packed.alias("_row")).groupBy(
        *[f"_k{i}" for i in range(len(keys))]).agg(pick("_row").alias("_row"))
    return grouped.select(*[F.col(f"_row._c{j}").alias(c) for j, c in enumerate(rest)]).select(*df.columns)


def dedup_keep_first(df: DataFrame, keys, seq) -> DataFrame:
    """The first row (smallest ``seq``) per key."""
    return _dedup(df, keys, seq, F.min)


def dedup_keep_last(df: DataFrame, keys, seq) -> DataFrame:
    """The last row (largest ``seq``) per key."""
    return _dedup(df, keys, seq, F.max)


def dedup_normalized(df: DataFrame, cols, seq) -> DataFrame:
    """First row per case-insensitive composite key; the parts are grouped
    side by side, so a null part never runs into its neighbour."""
    return dedup_keep_first(df, [F.lower(F.col(c) if isinstance(c, str) else c) for c in cols], seq)
