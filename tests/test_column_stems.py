"""Stems of whole columns, each distinct word of a batch stemmed once."""

import random

from pyspark.sql import functions as F

from jobsight.functions.stemming import STEP_2, STEP_3, STEP_4, Stems, stems, stems_sql


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_column_stems_equal_the_expression(spark):
    r = random.Random(5)
    ends = [e for e, _ in STEP_2 + STEP_3] + STEP_4 + "s es ies ied ed ing ingly edly eed eedly y ll e us ss sses".split()
    words = sorted({"".join(r.choice("aeiouybcdlnrstxwé9ß") for _ in range(r.randrange(1, 6))) + "".join(r.choices(ends, k=r.randrange(4)))
                    for _ in range(3000)} | {"skies", "dying", "news", "inning", "exceeds", "generously", "communism"})
    rows = [(words[i:i + 40],) for i in range(0, len(words), 40)] + [(None,), ([],), ([None, "dogs", "dogs"],)]
    df = spark.createDataFrame(rows, "w array<string>").repartition(3)
    assert all(a == b for a, b in df.select(F.expr(stems_sql("w")), stems(F.col("w"))).collect())


def test_remembered_stems_are_bounded(monkeypatch):
    monkeypatch.setattr(Stems, "LIMIT", 10)
    memo = Stems()
    assert [memo[f"{x}dogs"] for x in "abcdefghijklmnop"] == [f"{x}dog" for x in "abcdefghijklmnop"] and len(memo) <= 10
    assert memo["x" * 100 + "s"] and "x" * 100 + "s" not in memo


def test_search_stems_no_word_in_the_expression(spark):
    from jobsight.operators.filters import text_search

    docs = spark.createDataFrame([(1, "Engineers met"), (2, "an analyst")], "id long, text string")
    found = text_search(docs, "engineer -analysts", fields=["text"])
    assert [r[0] for r in found.collect()] == [1] and "ArrowEvalPython" in _plan(found)
