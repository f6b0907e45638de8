"""Golden rows for the scalar rules (FIXTURES.md sections 2 and 3)."""

import math

import pytest
from pyspark.sql import functions as F

from jobsight import functions as R
from jobsight.operators.normalize import tag_positions

SALARY_GOLDEN = [
    (None, None, None),
    ("", None, None),
    ("Gaji Tidak Ditampilkan", None, None),
    ("gaji tidak ditampilkan per bulan", None, None),
    ("Rp 3.000.000 - Rp 12.500.000", 3000000.0, 12500000.0),
    ("6,5 jt - 7,5 jt", None, None),
    ("5 jt", 5.0, None),
    ("5 million", 5000000.0, None),
    ("$1,000 - $2,000", 12000.0, 24000.0),
    ("Rp 3,000,000", 3.0, 3.0),
    ("500 rb - 700", 500000.0, 700000.0),
    ("5 - 10 rb", 5000.0, 10000.0),
    ("10 - 10 rb", 10.0, 10000.0),
    ("Rp 50.000 per jam", 50000000000.0, 50000000000.0),
    ("10.000.000 ₫", 6500000.0, 6500000.0),
    ("SGD 5k – 7k", 60000000.0, 84000000.0),
    ("- 5", None, 5.0),
    ("1 - 2 - 3", None, None),
    ("   Rp 4.500.000　 ", 4500000.0, 4500000.0),
]


def _close(a, b):
    if a is None or b is None:
        return a is None and b is None
    return math.isclose(a, b, rel_tol=1e-12)


def test_parse_salary_golden(spark):
    df = spark.createDataFrame([(i, s) for i, (s, _, _) in enumerate(SALARY_GOLDEN)], "i int, s string")
    out = R.with_parsed_salary(df, "s", "sal").select("i", "sal.min", "sal.max").orderBy("i").collect()
    for (s, lo, hi), r in zip(SALARY_GOLDEN, out):
        assert _close(r["min"], lo) and _close(r["max"], hi), (s, r["min"], r["max"], lo, hi)


def _one(spark, col_fn, values, typ="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {typ}")
    return [r[0] for r in df.orderBy("i").select(col_fn(F.col("v"))).collect()]


def test_detect_country(spark):
    vals = [None, "Nusa Dua, Bali", "London, Singapore", "Indianapolis", "Paris", "TOKYO", "Jakarta",
            "Perumahan Indah", "France"]
    assert _one(spark, R.detect_country, vals) == [
        "Indonesia", "United States", "Singapore", "India", "Indonesia", "Japan", "Indonesia",
        "Peru", "Indonesia"]


def test_normalize_job_type(spark):
    vals = [None, "Penuh Waktu", "Full-time contract", "Kontrak", "International", "Paruh waktu",
            "Remote", "Shift", "Freelance project", "MAGANG"]
    assert _one(spark, R.normalize_job_type, vals) == [
        "Full-time", "Full-time", "Full-time", "Contract", "Internship", "Part-time", "Remote",
        "Full-time", "Freelance", "Internship"]


def test_clean_experience_and_education(spark):
    vals = [None, " Apa Saja ", " 2 tahun ", "TIDAK DIKETAHUI", "Tidak Disebutkan", "S1"]
    exp = ["Tidak dicantumkan", "Tidak dicantumkan", "2 tahun", "Tidak dicantumkan", "Tidak dicantumkan", "S1"]
    assert _one(spark, R.clean_experience, vals) == exp
    assert _one(spark, R.clean_education, vals) == exp


def test_map_years(spark):
    vals = [None, "0", "3.0", "abc", "3", "7.9"]
    assert _one(spark, R.map_years, vals) == [
        "Tidak dicantumkan", "Fresh Graduate / Tanpa Pengalaman", "3 tahun", "abc", "3 tahun", "7 tahun"]


def test_indeed_job_type(spark):
    df = spark.createDataFrame([(0, None, "Remote"), (1, "Temporary", "x"), (2, "Contract Internship", "x"),
                                (3, "$5", "Kontrak"), (4, "nan", "Magang"), (5, "  ", None),
                                (6, "Paruh Waktu", "x")], "i int, raw string, jt string")
    out = [r[0] for r in df.orderBy("i").select(R.indeed_job_type("raw", "jt")).collect()]
    assert out == ["Remote", "Contract", "Contract", "Contract", "Internship", "Full-time", "Part-time"]


def test_strip_html(spark):
    vals = [None, "", "<p></p>", "<b>a</b>&amp;b", "<p>x&nbsp;&nbsp;y</p>", "&quot;q&quot;   z"]
    assert _one(spark, R.strip_html, vals) == [
        "Tidak dicantumkan", "Tidak dicantumkan", "Tidak dicantumkan", "a &b", "x y", '"q" z']


def test_format_salary_range(spark):
    df = spark.createDataFrame([(0, 3000000, 4500000), (1, 0, 5), (2, None, 5), (3, 1234567, 7654321)],
                               "i int, lo long, hi long")
    out = [r[0] for r in df.orderBy("i").select(R.format_salary_range("lo", "hi")).collect()]
    assert out == ["Rp 3.000.000 - Rp 4.500.000", "Tidak dicantumkan", "Tidak dicantumkan",
                   "Rp 1.234.567 - Rp 7.654.321"]


def test_format_millions(spark):
    assert _one(spark, R.format_millions, [None, 1500000.0, 6500000.0], "double") == ["-", "Rp 1.5 Jt", "Rp 6.5 Jt"]
    assert _one(spark, lambda c: R.format_millions(c, 2), [12345678.0], "double") == ["Rp 12.35 Jt"]


def test_remote_flag(spark):
    df = spark.createDataFrame([(0, "Jakarta", "WFH ok"), (1, None, None), (2, "Remote - ID", None),
                                (3, "Bandung", "Kerja dari rumah")], "i int, loc string, snip string")
    out = [r[0] for r in df.orderBy("i").select(R.remote_flag("loc", "snip")).collect()]
    assert out == ["Remote", "", "Remote", "Remote"]


def test_absolute_url(spark):
    assert _one(spark, lambda c: R.absolute_url(c, "https://id.example.com"), ["/a", "http://x", "a", None]) == [
        "https://id.example.com/a", "http://x", None, None]


def test_first_truthy_default_text_date_part(spark):
    df = spark.createDataFrame([(0, "", "b"), (1, None, ""), (2, "a", "b")], "i int, a string, b string")
    out = [r[0] for r in df.orderBy("i").select(R.first_truthy("a", "b", default="d")).collect()]
    assert out == ["b", "d", "a"]
    assert _one(spark, lambda c: R.default_text(c, "Dirahasiakan"), ["  ", None, " PT X "]) == [
        "", "Dirahasiakan", "PT X"]
    ties = [6_250_000.0, 2_250_000.0, 12_350_000.0, 12_250_000.0, 50_000.0, 150_000.0, 999_950_000.0, 0.0, -6_250_000.0, None]
    assert _one(spark, R.format_millions, ties, "double") == ["-" if t is None else f"Rp {t / 1e6:.1f} Jt" for t in ties]
    assert _one(spark, R.date_part, ["2024-01-02T03:04:05Z", "2024-01-02", None]) == ["2024-01-02", "2024-01-02", None]


def test_years_label_and_degrees(spark):
    df = spark.createDataFrame([(0, 3, ["S1", "S2"]), (1, None, None), (2, 0, [])],
                               "i int, y long, d array<string>")
    out = [tuple(r) for r in df.orderBy("i").select(R.years_label("y"), R.join_degrees("d")).collect()]
    assert out == [("3 Tahun", "S1, S2"), ("0 Tahun", ""), ("0 Tahun", "")]


def test_tag_positions(spark):
    df = spark.createDataFrame([(0, ["Kontrak", "+2", "1-3 tahun"]), (1, ["", " A ", "B", "C", "D"]), (2, [])],
                               "i int, tags array<string>")
    jt, ex, ed = tag_positions("tags")
    out = [tuple(r) for r in df.orderBy("i").select(jt, ex, ed).collect()]
    assert out == [("Kontrak", "1-3 tahun", "Tidak diketahui"), ("A", "B", "C"),
                   ("Tidak diketahui", "Tidak diketahui", "Tidak diketahui")]


def test_midpoint_and_clean_number(spark):
    df = spark.createDataFrame([(0, 1.0, 3.0), (1, float("nan"), 2.0), (2, float("inf"), None)],
                               "i int, a double, b double")
    out = [tuple(r) for r in df.orderBy("i").select(R.midpoint("a", "b"), R.clean_number(F.col("a"))).collect()]
    assert out[0] == (2.0, 1.0)
    assert out[1][1] is None and out[2][1] is None


@pytest.mark.parametrize("hit, expected", [
    ('{"title":null,"name":"B","company":{"name":null},"job_type":{"name":"FT"},'
     '"job_skills":[{"name":"SQL"},"x",{"id":1}],"experience_min":2}',
     ("B", None, "FT", "SQL, ", "2")),
    ('{"company":{},"job_type":"PT","job_skills":[],"skills":[{"name":"Go"}]}',
     ("Tidak dicantumkan", "Tidak dicantumkan", "PT", "Go", "0")),
    ('{"title":"A","company":null,"job_type":null}',
     ("A", "Tidak dicantumkan", None, "Tidak dicantumkan", "0")),
])
def test_payload_rules(spark, hit, expected):
    df = spark.createDataFrame([(hit,)], "h string").select(F.parse_json("h").alias("v"))
    s = lambda p: F.try_variant_get(F.col("v"), p, "string")
    out = df.select(
        R.first_truthy(s("$.title"), s("$.name"), default="Tidak dicantumkan"),
        R.get_or_default("v", "$.company.name", "Tidak dicantumkan"),
        R.dict_or_string("v", "$.job_type", "name", "Tidak dicantumkan"),
        R.join_names("v", ["$.job_skills", "$.skills"], "Tidak dicantumkan"),
        R.get_or_default("v", "$.experience_min", "0"),
    ).collect()[0]
    assert tuple(out) == expected
