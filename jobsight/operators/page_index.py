"""Pages by number without sorting what lies before them.

``build`` writes a table once in the total order of its pages (range-partitioned
sort, files of at most ``file_rows`` rows whose names follow the order) and beside
it the rows of every file with their prefix sums, two levels of them, so that no task
sums all files. A page then is an interval of row numbers: the sums name the one or
two files that hold it, and only these are opened; ``_metadata.row_index`` gives the
rows' places in them. Totals and page numbers come from the sums alone.

The rows of a page equal ``ordering.paginate`` (key ascending, nulls first, then all
other columns). An empty table has one empty page. A page beyond the last one has
no rows, as with OFFSET; ``info`` clamps the number, as the dashboard does.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from jobsight.operators.ordering import _total_order, page_info

#: Files whose sums one task adds up.
GROUP = 10_000


class PageIndex:
    def __init__(self, spark: SparkSession, path: str, order_key: str):
        self.spark, self.path, self.order_key = spark, path.rstrip("/"), order_key

    @property
    def rows_path(self) -> str:
        return f"{self.path}/rows"

    @property
    def files_path(self) -> str:
        return f"{self.path}/files"

    def build(self, df: DataFrame, file_rows: int = 1_000_000) -> "PageIndex":
        """A snapshot of ``df``: the table in order, and its files' sums."""
        (df.orderBy(*_total_order(df, self.order_key)).write.mode("overwrite")
         .option("maxRecordsPerFile", file_rows).parquet(self.rows_path))
        written = self.spark.read.schema(df.schema).parquet(self.rows_path)
        files = written.groupBy(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_name").alias("name")).agg(F.count(F.lit(1)).alias("rows"))
        # part-<task>-<id>-c<file>: the order of the rows
        task, number = (F.regexp_extract("name", rx, 1).cast("long") for rx in (r"^part-(\d+)", r"-c(\d+)\."))
        files = files.withColumn("task", task).withColumn("number", number).withColumn("group", F.expr(f"task DIV {GROUP}"))
        far = files.groupBy("group").agg(F.sum("rows").alias("n"))
        far = far.select("group", (F.sum("n").over(Window.orderBy("group")) - F.col("n")).alias("before"))
        own = F.sum("rows").over(Window.partitionBy("group").orderBy("task", "number")) - F.col("rows")
        (files.join(far, "group").select("path", "rows", (F.col("before") + own).alias("first"))
         .sort("first").write.mode("overwrite").parquet(self.files_path))
        return self

    def files(self) -> DataFrame:
        """path, rows, first (rows of the files before)."""
        return self.spark.read.schema("path string, rows long, first long").parquet(self.files_path)

    def info(self, page: int, page_size: int = 500) -> DataFrame:
        """N5 from the sums."""
        total = self.files().agg(F.coalesce(F.sum("rows"), F.lit(0)).alias("n")).first()["n"]
        return page_info(self.spark.range(total), page, page_size)

    def page(self, number: int, page_size: int = 500) -> DataFrame:
        """The page's rows in order; opens the files that hold them."""
        lo = (max(number, 1) - 1) * page_size
        held = self.files().where((F.col("first") < lo + page_size) & (F.col("first") + F.col("rows") > lo)).collect()
        table = self.spark.read.parquet(self.rows_path)
        if not held:
            return table.where(F.lit(False))
        # one or two files; more only where a page is larger than a file
        rows = self.spark.read.schema(table.schema).parquet(*[r["path"] for r in held])
        first = F.element_at(F.create_map(*[x for r in held for x in (F.lit(r["path"]), F.lit(r["first"]))]), F.col("_metadata.file_path"))
        place = first + F.col("_metadata.row_index")
        return (rows.withColumn("__place", place).where((F.col("__place") >= lo) & (F.col("__place") < lo + page_size))
                .orderBy("__place").drop("__place"))
