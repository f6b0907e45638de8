"""The import's counts, taken while its table is written.

The rows pass an Observation on their way into the files: counts by platform and
by country (both closed vocabularies of the cleaning rules), salaries and all rows.
It stands in the writing stage itself, behind the rebalance, where every row passes
once for the task that is kept. The report then costs no scan. Values outside the
vocabularies are counted as such; only if there are any is the written table
asked again, so the report equals ``aggregates.integration_report`` for every input.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from jobsight.functions.text import COUNTRY_KEYS
from jobsight.operators.aggregates import integration_report
from jobsight.schemas import DEFAULT_COUNTRY, PLATFORMS

COUNTRIES = list(dict.fromkeys([DEFAULT_COUNTRY, *[name for _, name in COUNTRY_KEYS]]))


@dataclass
class WriteCounts:
    """What one write has seen."""

    path: str
    total: int
    with_salary: int
    platforms: dict
    countries: dict
    elsewhere: int

    def report(self, spark, n_countries: int = 5) -> DataFrame:
        """Section, item, count, pct."""
        if self.elsewhere:
            return integration_report(spark.read.parquet(self.path), n_countries)
        rows = [("platform", p, n, None) for p, n in self.platforms.items() if n]
        rows += [("country", c, n, None) for c, n in self.top_countries(n_countries)]
        rows.append(("salary", "with_salary", self.with_salary, 100.0 * self.with_salary / self.total if self.total else None))
        return spark.createDataFrame(rows, "section string, item string, count long, pct double")

    def top_countries(self, n: int = 5) -> list:
        """A14 of the written rows."""
        return sorted(((c, k) for c, k in self.countries.items() if k), key=lambda x: (-x[1], x[0]))[:n]


def write_documents_observed(docs: DataFrame, path: str) -> WriteCounts:
    """K3 as ``files.write_documents`` writes it, and its counts."""
    seen = Observation("written")
    known = F.coalesce(F.col("platform").isin(PLATFORMS) & F.col("country").isin(COUNTRIES), F.lit(False))
    metrics = [F.count(F.lit(1)).alias("total"), F.count("salary_min").alias("with_salary"), F.count_if(~known).alias("elsewhere")]
    metrics += [F.count_if(F.col("platform") == p).alias(f"p{i}") for i, p in enumerate(PLATFORMS)]
    metrics += [F.count_if(F.col("country") == c).alias(f"c{i}") for i, c in enumerate(COUNTRIES)]
    (docs.hint("rebalance", "platform").sortWithinPartitions("platform", "country", "keyword").observe(seen, *metrics)
     .write.mode("overwrite").partitionBy("platform").parquet(path))
    got = seen.get                                        # empty where the plan was folded to no rows
    return WriteCounts(path, got.get("total", 0), got.get("with_salary", 0), {p: got.get(f"p{i}", 0) for i, p in enumerate(PLATFORMS)},
                       {c: got.get(f"c{i}", 0) for i, c in enumerate(COUNTRIES)}, got.get("elsewhere", 0))
