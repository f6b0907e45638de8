"""Aggregations A1-A21 and the per-group argmax N1.

All grouped aggregates are plain ``groupBy().agg()``: a partial (map-side)
HashAggregate before the shuffle, so a hot key costs one row per map task in
the exchange, never its raw rows. Money averages are rounded to 2 decimals
half-up through ``decimal(38,6)`` (absorbs the last-bit noise of a double sum
whose order depends on partitioning).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobsight.functions import midpoint
from jobsight.operators.ordering import order_desc, top_k


def money(c: Column) -> Column:
    """Round a money amount to 2 decimals, half-up."""
    return F.round(c.cast("decimal(38,6)"), 2).cast("double")


def count_by(df: DataFrame, key: str, name: str = "total_jobs") -> DataFrame:
    """Rows per key value (null is a group)."""
    return df.groupBy(key).agg(F.count(F.lit(1)).alias(name))


def _counted(df: DataFrame, key: str, n=None, name: str = "total_jobs") -> DataFrame:
    out = count_by(df, key, name)
    return top_k(out, n, name, key) if n else out.orderBy(*order_desc(name, key))


def job_demand(df: DataFrame, n=None) -> DataFrame:
    """A1: postings per keyword, most first (all rows in batch; 15 on the dashboard)."""
    return _counted(df, "keyword", n)


def salary_by_role(df: DataFrame, n=None) -> DataFrame:
    """A2: rows with both salary ends; per keyword the count and the rounded
    averages of min, max and midpoint; highest midpoint first."""
    w = df.where(F.col("salary_min").isNotNull() & F.col("salary_max").isNotNull())
    out = w.groupBy("keyword").agg(
        F.count(F.lit(1)).alias("total_jobs_with_salary"),
        money(F.avg("salary_min")).alias("avg_salary_min"),
        money(F.avg("salary_max")).alias("avg_salary_max"),
        money(F.avg(midpoint("salary_min", "salary_max"))).alias("avg_salary_overall"),
    )
    return top_k(out, n, "avg_salary_overall", "keyword") if n else out.orderBy(
        *order_desc("avg_salary_overall", "keyword"))


def jobs_by_platform(df: DataFrame) -> DataFrame:
    """A3."""
    return _counted(df, "platform")


def jobs_by_country(df: DataFrame, n=None) -> DataFrame:
    """A4 (10 on the dashboard)."""
    return _counted(df, "country", n)


def jobs_by_type(df: DataFrame) -> DataFrame:
    """A5."""
    return _counted(df, "job_type")


def top_companies(df: DataFrame, n: int = 10) -> DataFrame:
    """Known companies, most postings first."""
    return _counted(df.where(F.col("company_name").isNotNull()), "company_name", n)


def platform_country_heatmap(df: DataFrame, pairs: int = 50, rows: int = 10) -> DataFrame:
    """Count per (platform, country), keep the top ``pairs`` pairs, pivot
    countries x platforms (missing pairs 0), keep the ``rows`` countries with
    the largest total over the kept pairs. Pairs with a null side use up a
    slot and then vanish, as in a pivot table. The columns are the platforms
    of the kept pairs, so these (``pairs`` rows at most) are read first."""
    counts = df.groupBy("platform", "country").agg(F.count(F.lit(1)).alias("n"))
    found = top_k(counts, pairs, "n", "platform", "country").where(
        F.col("platform").isNotNull() & F.col("country").isNotNull()).collect()
    kept = df.sparkSession.createDataFrame(found, counts.schema)
    cols = sorted({r["platform"] for r in found})
    grid = kept.groupBy("country").agg(*[
        F.coalesce(F.max(F.when(F.col("platform") == c, F.col("n"))), F.lit(0)).alias(c) for c in cols])
    total = sum((F.col(f"`{c}`") for c in cols), F.lit(0))
    return (grid.withColumn("_total", total)
            .orderBy(F.col("_total").desc(), F.col("country").asc())
            .limit(rows).drop("_total"))


def salary_by_platform(df: DataFrame) -> DataFrame:
    """Rows with a salary average; per platform avg min, avg max, count;
    highest avg max first."""
    w = _with_avg(df)
    out = w.groupBy("platform").agg(
        money(F.avg("salary_min")).alias("avg_min"),
        money(F.avg("salary_max")).alias("avg_max"),
        F.count(F.lit(1)).alias("count"),
    )
    return out.orderBy(*order_desc("avg_max", "platform"))


def _with_avg(df: DataFrame) -> DataFrame:
    if "salary_avg" in df.columns:
        return df.where(F.col("salary_avg").isNotNull())
    return df.where(F.col("salary_min").isNotNull() & F.col("salary_max").isNotNull())


def top_keywords(df: DataFrame, n: int = 20) -> DataFrame:
    """A9 (20 as a preset, 5 in the import summary)."""
    return _counted(df, "keyword", n, "count")


def top_paying_locations(df: DataFrame, min_jobs: int = 2, n: int = 15) -> DataFrame:
    """A10: per location the average midpoint and the count, locations with
    at least ``min_jobs`` rows, highest average first."""
    from jobsight.operators.filters import having_count

    w = _with_avg(df)
    mid = F.col("salary_avg") if "salary_avg" in w.columns else midpoint("salary_min", "salary_max")
    out = w.groupBy("location").agg(
        money(F.avg(mid)).alias("avg_salary"),
        F.count(F.lit(1)).alias("job_count"),
    )
    return top_k(having_count(out, min_jobs, "job_count"), n, "avg_salary", "location")


def first_per_group(df: DataFrame, group: str, metric: str, tie: str,
                    out_metric: str, out_value: str) -> DataFrame:
    """Per ``group`` the row with the largest ``metric`` (ties: smallest
    ``tie``), as a partial-aggregatable min over struct(-metric, tie); no window,
    so one hot group never lands in one task with all its rows."""
    best = F.min(F.struct((-F.col(metric)).alias("m"), F.col(tie).alias("t")))
    return df.groupBy(group).agg(best.alias("_b")).select(
        group, F.col("_b.t").alias(out_value), (-F.col("_b.m")).alias(out_metric))


def top_company_per_country(df: DataFrame, n: int = 10) -> DataFrame:
    """Count per (country, company); each country's top company;
    countries with the largest such count first."""
    pairs = df.groupBy("country", "company_name").agg(F.count(F.lit(1)).alias("n"))
    best = first_per_group(pairs, "country", "n", "company_name", "job_count", "top_company")
    return top_k(best, n, "job_count", "country")


def experience_distribution(df: DataFrame, n: int = 15) -> DataFrame:
    """A12."""
    return _counted(df, "experience", n, "count")


def platform_share(df: DataFrame) -> DataFrame:
    """Rows per platform and their percent of all rows. The window runs
    over the per-platform rows only (one row per platform)."""
    from pyspark.sql import Window

    counts = count_by(df, "platform", "count")
    share = F.col("count").cast("double") * 100.0 / F.sum("count").over(Window.partitionBy())
    return counts.select("platform", "count", share.alias("pct")).orderBy(
        *order_desc("count", "platform"))


def top_countries(df: DataFrame, n: int = 5) -> DataFrame:
    """A14."""
    return _counted(df, "country", n, "count")


def salary_stats(df: DataFrame) -> DataFrame:
    """Over rows with a salary average: avg midpoint, min of min, max of max."""
    w = _with_avg(df)
    mid = F.col("salary_avg") if "salary_avg" in w.columns else midpoint("salary_min", "salary_max")
    return w.agg(
        money(F.avg(mid)).alias("avg_salary"),
        F.min("salary_min").alias("min_salary"),
        F.max("salary_max").alias("max_salary"),
    )


def salary_coverage(df: DataFrame) -> DataFrame:
    """Rows with salary_min and their percent of all rows (null when empty)."""
    return df.agg(
        F.count("salary_min").alias("with_salary"),
        F.count(F.lit(1)).alias("total"),
    ).select("with_salary", "total",
             F.try_divide(F.col("with_salary").cast("double") * 100.0, F.col("total")).alias("pct"))


def dashboard_kpis(df: DataFrame) -> DataFrame:
    """One row: total, with salary, percent, average pay ((avg min +
    avg max)/2 over rows with both ends), top platform with its count and share.

    Two-level aggregation, no join: partial sums per platform (few rows),
    then one global aggregate over them that also picks the top platform."""
    both = F.col("salary_min").isNotNull() & F.col("salary_max").isNotNull()
    per = df.groupBy("platform").agg(
        F.count(F.lit(1)).alias("n"),
        F.count("salary_min").alias("ws"),
        F.sum(F.when(both, F.col("salary_min"))).alias("smin"),
        F.sum(F.when(both, F.col("salary_max"))).alias("smax"),
        F.count(F.when(both, F.lit(1))).alias("nb"),
    )
    g = per.agg(
        F.sum("n").alias("total_jobs"),
        F.sum("ws").alias("jobs_with_salary"),
        F.try_divide(F.sum("smin"), F.sum("nb")).alias("_amin"),
        F.try_divide(F.sum("smax"), F.sum("nb")).alias("_amax"),
        F.min(F.struct((-F.col("n")).alias("m"), F.col("platform").alias("p"))).alias("_t"),
    )
    return g.select(
        "total_jobs", "jobs_with_salary",
        F.try_divide(F.col("jobs_with_salary").cast("double") * 100.0, F.col("total_jobs")).alias("salary_pct"),
        money((F.col("_amin") + F.col("_amax")) / 2.0).alias("avg_salary"),
        F.col("_t.p").alias("top_platform"),
        (-F.col("_t.m")).alias("top_platform_count"),
        F.try_divide((-F.col("_t.m")).cast("double") * 100.0, F.col("total_jobs")).alias("top_platform_pct"),
    )


def integration_report(df: DataFrame, n_countries: int = 5) -> DataFrame:
    """Rows per platform, top countries, salary coverage - one long table
    (section, item, count, pct). One pass over the input: a grouping-sets
    aggregate by platform, by country and over all; what follows works on one
    row per group."""
    from pyspark.sql import Window

    sums = df.groupingSets([[F.col("platform")], [F.col("country")], []], F.col("platform"), F.col("country")).agg(
        F.grouping_id().alias("g"), F.count(F.lit(1)).alias("n"), F.count("salary_min").alias("paid"))
    # g: 1 by platform, 2 by country, 3 all rows
    rank = F.row_number().over(Window.partitionBy("g").orderBy(F.col("n").desc(), F.col("country").asc_nulls_first()))
    rows = sums.withColumn("rank", F.when(F.col("g") == 2, rank).otherwise(F.lit(0)))
    return rows.where(F.col("rank") <= n_countries).select(
        F.when(F.col("g") == 1, "platform").when(F.col("g") == 2, "country").otherwise("salary").alias("section"),
        F.when(F.col("g") == 1, F.col("platform")).when(F.col("g") == 2, F.col("country")).otherwise(F.lit("with_salary")).alias("item"),
        F.when(F.col("g") == 3, F.col("paid")).otherwise(F.col("n")).alias("count"),
        F.when(F.col("g") == 3, F.try_divide(F.col("paid").cast("double") * 100.0, F.col("n"))).alias("pct"))


def stream_total(counts: DataFrame, col: str = "stream_count") -> DataFrame:
    """Sum of the live per-platform counts."""
    return counts.agg(F.coalesce(F.sum(col), F.lit(0)).alias("stream_total"))


def keyword_yield(df: DataFrame) -> DataFrame:
    """Records found per keyword (the caller picks raw or deduplicated input)."""
    return _counted(df, "keyword", None, "records")
