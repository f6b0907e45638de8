"""JSON payload rules (F13-F15) on VARIANT values.

VARIANT keeps the difference between a missing key and an explicit JSON null,
which ``from_json`` with a fixed schema cannot: ``variant_get(v, p, 'variant')``
is SQL NULL only when the path is missing, and ``is_variant_null`` is true only
for a JSON null.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from jobsight.functions.text import col_


def _node(v: Column, path: str) -> Column:
    return F.variant_get(v, path, "variant")


def get_or_default(v, path: str, default: str) -> Column:
    """``obj.get(key, default)``: default only when the key is missing."""
    v = col_(v)
    node = _node(v, path)
    return F.when(node.isNull(), F.lit(default)).otherwise(
        F.try_variant_get(v, path, "string"))


def is_object(node: Column) -> Column:
    return F.coalesce(F.schema_of_variant(node).startswith("OBJECT"), F.lit(False))


def dict_or_string(v, path: str, key: str, default: str) -> Column:
    """an object gives its ``key`` (default if absent); anything else itself."""
    v = col_(v)
    node = _node(v, path)
    return F.when(is_object(node), get_or_default(v, f"{path}.{key}", default)).otherwise(
        get_or_default(v, path, default))


def _truthy_array(v: Column, path: str) -> Column:
    arr = F.try_variant_get(v, path, "array<variant>")
    return F.when(F.size(arr) > 0, arr)


def join_names(v, paths, default: str, sep: str = ", ") -> Column:
    """the first non-empty array among ``paths``; names of its object items
    joined by ``sep`` (an object without a name counts as ""); none -> default."""
    v = col_(v)
    return names_of(F.coalesce(*[_truthy_array(v, p) for p in paths]), default, sep)


def names_of(arr: Column, default: str, sep: str = ", ") -> Column:
    """F15 on the chosen array of variants (null -> default)."""
    names = F.transform(F.filter(arr, is_object),
                        lambda x: F.coalesce(F.try_variant_get(x, "$.name", "string"), F.lit("")))
    return F.when(arr.isNull(), F.lit(default)).otherwise(F.array_join(names, sep))
