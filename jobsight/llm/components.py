"""Connected components of an edge table by alternating large-star and small-star
steps; every step is a partial aggregation and a join, cut by a written table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobsight.llm.common import discard, materialise


def connected_components(edges: DataFrame) -> DataFrame:
    """Rows (node, comp) of all nodes of ``edges`` (a, b: long, a <> b) that are not the
    smallest of their component; ``comp`` is the smallest node of the component."""
    e = materialise(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    while True:
        # done when all nodes hang on a root by one edge
        twice = e.groupBy("u").count().where("count > 1")
        inner = e.select(F.col("v").alias("u")).distinct().join(e.select("u").distinct(), "u", "left_semi")
        if twice.select("u").unionByName(inner).isEmpty():
            out = e.select(F.col("u").alias("node"), F.col("v").alias("comp"))
            out.scratch = e.scratch
            return out
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = materialise(large, "large-star")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (large.join(low, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .unionByName(low.select("u", F.col("m").alias("v"))).distinct())
        before, e = e, materialise(small, "small-star")
        discard(before, large)
