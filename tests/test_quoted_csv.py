"""Splittable CSV records: many tasks a file, rows equal to Spark's one-task reader."""

import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from jobsight.sources import files as SRC
from jobsight.sources.quoted_csv import _lines, csv_records, seam_states

SCHEMA = StructType([StructField(c, StringType()) for c in ("a", "b b", "c")])


def messy_csv(seed, rows, newline="\n", sep=";"):
    r = random.Random(seed)

    def field():
        kind = r.random()
        if kind < .35:
            return r.choice(["", "x", "plain text", 'bare "quote" inside', "ünï", "NA", " lead"])
        parts = [r.choice(["word", " ", sep, '""', newline, newline + newline, "é", "'", "tail "]) for _ in range(r.randrange(9))]
        return '"' + "".join(parts) + '"'
    out = [sep.join(["a", "b b", "c"])]
    out += [sep.join(field() for _ in range(3)) if r.random() > .05 else "" for _ in range(rows)]
    return newline.join(out) + (newline if seed % 2 else "")


def in_one_task(spark, path, sep=";"):
    return spark.read.options(**{**SRC.CSV_OPTIONS, "sep": sep}).schema(SCHEMA).csv(path)


def split_small(spark, size):
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
    spark.conf.set("spark.sql.files.openCostInBytes", "1")


@pytest.fixture
def small_splits(spark):
    kept = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    yield lambda size: split_small(spark, size)
    for k, v in kept.items():
        spark.conf.set(k, v)


@pytest.mark.parametrize("seed,newline,size", [(1, "\n", 50), (2, "\n", 333), (3, "\r\n", 97), (4, "\n", 20), (5, "\r\n", 4000)])
def test_rows_equal_the_one_task_reader(spark, tmp_path, small_splits, seed, newline, size):
    for part in range(2):
        (tmp_path / f"p{part}.csv").write_bytes((b"\xef\xbb\xbf" if part else b"") + messy_csv(seed + 10 * part, 150, newline).encode())
    path = str(tmp_path)
    want = sorted(map(tuple, in_one_task(spark, path).collect()), key=repr)
    small_splits(size)
    got = SRC.read_jobs_csv(spark, path, SCHEMA, na_tokens=False)
    assert sorted(map(tuple, got.collect()), key=repr) == want
    assert any("\n" in (x or "") for row in want for x in row)
    assert got.count() == len(want)


def test_one_file_is_read_by_many_tasks(spark, tmp_path, small_splits):
    long = "".join(f"line {i};\n" for i in range(300))
    (tmp_path / "x.csv").write_text('a;b b;c\n1;2;3\n4;"' + long + '";6\n' + "7;8;9\n" * 200 + '"' + long + '";"x\ny";\n')
    small_splits(1000)
    records = csv_records(spark, str(tmp_path))
    used = records.select(F.spark_partition_id().alias("p")).distinct().count()
    assert used > 3                                                   # whole splits lie inside the long fields
    assert _lines(spark, str(tmp_path), ";").rdd.getNumPartitions() > 5
    changes = seam_states(_lines(spark, str(tmp_path), ";")).orderBy("block").collect()
    assert [r["state"] for r in changes] == [1, 0, 1, 0]              # two records cross seams
    rows = SRC.read_jobs_csv(spark, str(tmp_path), SCHEMA).collect()
    assert len(rows) == 203 and sum((r["a"] or "").startswith("line 0") for r in rows) == 1
    assert [r["b b"] for r in rows if r["a"] == "4"] == [long]


def test_header_of_several_lines_and_unclosed_field(spark, tmp_path, small_splits):
    (tmp_path / "x.csv").write_text('\n"a";"b\n\n\nb";c\n1;2;3\n1;2;"never closed\n4;5;6')
    small_splits(5)
    got = sorted((r["first"], r["value"]) for r in csv_records(spark, str(tmp_path)).collect())
    assert got == [(False, '1;2;"never closed\n4;5;6'), (False, "1;2;3"), (True, '"a";"b\n\n\nb";c')]


def test_another_header_stops_the_reading(spark, tmp_path):
    (tmp_path / "1.csv").write_text("a;b b;c\n1;2;3\n")
    (tmp_path / "2.csv").write_text("a;c;b b\n1;2;3\n")
    with pytest.raises(Exception, match="does not conform"):
        SRC.read_jobs_csv(spark, str(tmp_path), SCHEMA).collect()


def test_broken_rows_and_counts(spark, tmp_path, small_splits):
    (tmp_path / "good.csv").write_text('a;b b;c\n1;"2;\n2";3\n4;;\n')
    (tmp_path / "bad.csv").write_text('a;b b;c\n1;"2;\n2";3\n4;;;5\n')
    small_splits(7)
    assert not SRC.has_broken_rows(spark, str(tmp_path / "good.csv"), SCHEMA)
    assert SRC.has_broken_rows(spark, str(tmp_path / "bad.csv"), SCHEMA)
    counts = SRC.count_records_detect_delim(spark, [str(tmp_path / "good.csv"), str(tmp_path / "bad.csv")]).collect()
    assert [r["records"] for r in counts] == [2, 2]


def test_long_quoted_line(spark, tmp_path):
    """Patterns stay linear and do not recurse on long lines."""
    text = ('say ""hi"" ' * 40_000) + ";"
    (tmp_path / "x.csv").write_text(f'a;b b;c\n"{text}";' + "y" * 200_000 + ';"z\n"\n')
    rows = SRC.read_jobs_csv(spark, str(tmp_path), SCHEMA).collect()
    assert len(rows) == 1 and rows[0]["a"] == text.replace('""', '"') and rows[0]["c"] == "z\n"
