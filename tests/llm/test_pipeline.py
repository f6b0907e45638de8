"""The pipeline against a plain run of its decisions."""

import os

import corpus_pipeline
import pytest
from helpers import awkward_docs
from test_joins import brute_components, brute_contamination
from test_text_ops import check_pieces

from jobsight.llm import toxicity_rnn as X
from jobsight.llm.common import discard, materialise, near_keys, read, without

SF = "/root/testdata/sf0.001"


def test_stage_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["detoxify", "deduplicate", "decontaminate", "pack"]


def test_run_equals_plain_decisions(spark):
    docs, labels = read(spark, SF, "documents"), read(spark, SF, "labels")
    rows = {r["doc_id"]: r for r in docs.collect()}
    toxic = {r["doc_id"] for r in X.score(docs, X.fit(docs, labels)).where("predicted = 1").collect()}
    rows = [r for k, r in rows.items() if k not in toxic]
    keep = {k for k, _, c in brute_components(rows, 90) if k == c}
    rows = [r for r in rows if r["doc_id"] in keep]
    leaked = {x[0] for x in brute_contamination(rows, read(spark, SF, "benchmark").collect()) if x[-1]}
    rows = [r for r in rows if r["doc_id"] not in leaked]
    check_pieces(rows, corpus_pipeline.run(spark, SF).collect())


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES[:-1])
def test_stages_keep_columns(spark, tmp_path, name, stage):
    path = str(tmp_path)
    os.symlink(f"{SF}/labels.parquet", f"{path}/labels.parquet")
    os.symlink(f"{SF}/benchmark.parquet", f"{path}/benchmark.parquet")
    docs = awkward_docs(spark)
    out = stage(spark, docs, path)
    assert out.columns == docs.columns and out.count() > 0
    assert stage(spark, docs.limit(0), path).count() == 0


def test_run_on_empty_tables(spark, tmp_path):
    for name in ("documents", "labels", "benchmark"):
        read(spark, SF, name).limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_keys_are_filtered_exactly(spark):
    rows = spark.range(5000).selectExpr("id AS doc_id", "concat('t', id) AS text").unionByName(
        spark.createDataFrame([(None, "none"), (7, "again")], "doc_id long, text string"))
    keys = spark.range(0, 5000, 7).withColumnRenamed("id", "doc_id").unionByName(spark.createDataFrame([(None,)], "doc_id long"))
    got = [r["doc_id"] for r in without(rows, keys, "doc_id").collect()]
    assert sorted(x for x in got if x is not None) == [i for i in range(5000) if i % 7] and got.count(None) == 1
    assert near_keys(rows, keys, "doc_id").where("__near").count() < 800            # few others are near
    assert without(rows, keys.limit(0), "doc_id").count() == 5002


def test_superseded_tables_are_deleted(spark):
    table = materialise(spark.range(3), "x")
    path = table.scratch
    assert os.path.isdir(path.removeprefix("file:"))
    discard(table, None, spark.range(1))
    assert not os.path.exists(path.removeprefix("file:"))
