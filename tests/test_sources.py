"""Sources and sinks: CSV dialect, optional sources, fallbacks, sniffing."""

import os

from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from testkit import rows
from jobsight import schemas as S
from jobsight.operators.normalize import normalize_glints
from jobsight.sinks.files import append_records, write_csv, write_documents, write_outputs
from jobsight.sources import files as SRC


def _write(path, text, bom=True):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w", encoding="utf-8-sig" if bom else "utf-8") as f:
        f.write(text)


GLINTS_CSV = (
    "Judul Posisi;Nama Perusahaan;Lokasi;Tipe Pekerjaan;Pengalaman;Pendidikan;Gaji;Tanggal Posting;Keyword\n"
    '"Data ""Lead""";PT A;Jakarta;Kontrak;Apa Saja;S1;Rp 3.000.000 - Rp 4.000.000;1 hari lalu;data\n'
    '"Multi\nline";NA;TOKYO;;;;;;web\n'
)


def test_read_jobs_csv_dialect(spark, tmp_path):
    p = str(tmp_path / "glints" / "g.csv")
    _write(p, GLINTS_CSV)
    df = SRC.read_jobs_csv(spark, p, S.GLINTS_RAW)
    got = rows(df, "Judul Posisi", "Nama Perusahaan", "Tipe Pekerjaan", "Keyword")
    assert got == [('Data "Lead"', "PT A", "Kontrak", "data"), ("Multi\nline", None, None, "web")]
    jobs = normalize_glints(df)
    r = jobs.orderBy("keyword").collect()
    assert (r[0]["salary_min"], r[0]["salary_max"], r[0]["experience"]) == (3e6, 4e6, "Tidak dicantumkan")
    assert (r[1]["country"], r[1]["job_type"], r[1]["post_date"]) == ("Japan", "Full-time", "Tidak dicantumkan")
    inferred = SRC.read_jobs_csv_inferred(spark, p)
    assert inferred.columns[0] == "Judul Posisi"        # BOM removed


def test_read_sources_skips_missing_and_bad(spark, tmp_path):
    good = str(tmp_path / "glints")
    _write(f"{good}/g.csv", GLINTS_CSV)
    bad = str(tmp_path / "bad")
    _write(f"{bad}/b.csv", "a;b\n1;2\n")
    specs = [("Glints", good, S.GLINTS_RAW, normalize_glints),
             ("missing", str(tmp_path / "nope"), S.GLINTS_RAW, normalize_glints),
             ("bad header", bad, S.GLINTS_RAW, normalize_glints)]
    out = SRC.read_sources(spark, specs)
    assert out.count() == 2 and out.columns == S.JOB_COLUMNS
    assert SRC.read_sources(spark, specs[1:]) is None


def test_load_first_available(spark, tmp_path):
    empty = str(tmp_path / "empty")
    write_csv(spark.createDataFrame([], S.JOBS), empty)
    full = str(tmp_path / "full")
    write_csv(spark.createDataFrame([("Dev",) + (None,) * 13], S.JOBS), full)
    loaders = [lambda: SRC.read_documents(spark, str(tmp_path / "no-docs")),
               lambda: SRC.read_jobs_csv(spark, empty, S.JOBS),
               lambda: SRC.read_jobs_csv(spark, full, S.JOBS)]
    assert SRC.load_first_available(spark, loaders, S.JOBS).count() == 1
    none = SRC.load_first_available(spark, loaders[:2], S.JOBS)
    assert none.count() == 0 and none.schema == S.JOBS


def test_record_counts(spark):
    a, b, m = spark.range(3), spark.range(4), spark.range(7)
    out = {r[0]: (r[1], r[2]) for r in rows(SRC.record_counts(
        [("a", a), ("b", b), ("gone", None), ("merged", m)], ["merged"]))}
    assert out == {"a": (3, "ok"), "b": (4, "ok"), "gone": (None, "missing"), "merged": (7, "ok"),
                   "TOTAL": (7, "ok")}


def test_count_records_detect_delim(spark, tmp_path):
    _write(str(tmp_path / "semi" / "x.csv"), 'a;b;c\n1;"x\ny";3\n4;5;6\n', bom=False)
    _write(str(tmp_path / "comma" / "x.csv"), 'a,b\n"1;2",3\n', bom=False)
    _write(str(tmp_path / "tab" / "x.csv"), "a\tb\tc\n1\t2\t3\n", bom=False)
    _write(str(tmp_path / "pipe" / "x.csv"), "a|b\n1|2\n3|4\n5|6\n", bom=False)
    out = sorted(rows(SRC.count_records_detect_delim(
        spark, [str(tmp_path / d) for d in ("semi", "comma", "tab", "pipe")])))
    assert out == [("comma", ",", 1), ("pipe", "|", 3), ("semi", ";", 2), ("tab", "\t", 1)]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("k1", 2), ("k2", 1)], "keyword string, total_jobs long")
    write_outputs({"stale": df}, str(tmp_path / "out"))
    write_outputs({"job_demand": df, "other": df}, str(tmp_path / "out"))
    assert not (tmp_path / "out" / "stale").exists()
    back = SRC.read_jobs_csv(spark, str(tmp_path / "out" / "job_demand"),
                             StructType([StructField("keyword", StringType()), StructField("total_jobs", StringType())]))
    assert sorted(rows(back)) == [("k1", "2"), ("k2", "1")]
    target = str(tmp_path / "raw")
    append_records(df, target)
    append_records(df, target)
    assert spark.read.options(**SRC.CSV_OPTIONS).csv(target).count() == 4
    docs = spark.createDataFrame([("Dev", "Glints", "ID", "k"), ("QA", "Indeed", "SG", "k")],
                                 "job_title string, platform string, country string, keyword string")
    write_documents(docs, str(tmp_path / "docs"))
    folders = sorted(d for d in os.listdir(tmp_path / "docs") if d.startswith("platform="))
    assert folders == ["platform=Glints", "platform=Indeed"]
    assert SRC.read_documents(spark, str(tmp_path / "docs")).where(F.col("platform") == "Indeed").count() == 1


HEADERS = ["a;b;c", "a,b", "a\tb\tc", "Judul Posisi;Nama Perusahaan;Lokasi", "x;y, z;w", "one two,three four five six",
           "'a b';'c, d';'e'", '"a,b";"c,d";"e,f"', '"a b"|"c d"|"e"', 'name|"a, b"|"c, d"|x', "a:b:c", "k;v;'it''s';z",
           "first name last name\tage", '"only one"', "date:time;zone", "a;b;c;d,e", '"q;r",s', "x=1;y=2,z=3"]


def test_delimiters_equal_the_standard_sniffer(spark):
    """On every header for which the sniffer finds a sign (it may also settle for a letter)."""
    import csv

    got = spark.createDataFrame([(i, h) for i, h in enumerate(HEADERS)], "i int, h string").select("i", SRC.detect_delimiter("h").alias("d")).collect()
    got = {HEADERS[r["i"]]: r["d"] for r in got}
    want = {h: csv.Sniffer().sniff(h).delimiter for h in HEADERS}
    assert {h: d for h, d in got.items() if not want[h].isalnum()} == {h: d for h, d in want.items() if not d.isalnum()}
    assert sum(not d.isalnum() for d in want.values()) >= len(HEADERS) - 1
    # headers in which the most frequent candidate is not the delimiter
    assert want["x;y, z;w"] == "," and want["first name last name\tage"] == "\t" and got["name|\"a, b\"|\"c, d\"|x"] == "|"
