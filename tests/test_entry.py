"""Driver contract: entry(), queries(), oracle_sql(); oracle spot checks."""

import duckdb
import pytest

import __spark_entry__ as E
from testkit import SF_SMALL
from oracle_check import digest
from jobsight.session import TABLES, table_path


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.columns == ["keyword", "total_jobs_with_salary", "avg_salary_min",
                          "avg_salary_max", "avg_salary_overall"]
    assert df.count() > 0


def test_registry_shape():
    qs, sql = E.queries(), E.oracle_sql()
    assert len(qs) >= 90
    assert set(sql) <= set(qs)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{table_path(SF_SMALL, t)}')")
    return con


SPOT = ["a02_salary_by_role", "a07_platform_country_heatmap", "a11_top_company_per_country",
        "w07_text_search", "n04_dedup_normalized", "t03_paginate", "f01_parse_salary",
        "p12_flatten_search_hits", "p14_extract_cards", "j02_enrich_with_detail", "x04_stream_windowed_counts"]


@pytest.mark.parametrize("name", SPOT)
def test_oracle_spot(spark, duck, name):
    df = E.queries()[name](spark, SF_SMALL)
    got = [tuple(r) for r in df.collect()]
    res = duck.execute(E.oracle_sql()[name])
    ocols = [d[0] for d in res.description]
    want = res.fetchall()
    assert sorted(df.columns) == sorted(ocols)
    assert len(got) == len(want)
    assert digest(df.columns, got) == digest(ocols, want)


def test_every_test_file_collects():
    """No test module may hide behind another one of the same name."""
    import pathlib
    import subprocess
    import sys

    top = pathlib.Path(__file__).resolve().parent.parent
    out = subprocess.run([sys.executable, "-m", "pytest", "--collect-only", "-q", "-p", "no:cacheprovider", "tests"],
                         cwd=top, capture_output=True, text=True, timeout=300).stdout
    assert "error" not in out.lower(), out[-2000:]
    for file in (top / "tests").rglob("test_*.py"):
        assert file.name in out, file
