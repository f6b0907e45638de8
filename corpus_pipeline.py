"""Corpus pipeline: toxicity, near duplicates, benchmark decontamination, packing.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame, which is
written as Parquet and reread as the next stage's ``docs``. All but the last
return the columns of ``documents``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from jobsight.llm.common import discard, materialise, read, without


def detoxify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored as toxic go; the network learns from labelled rows of ``docs``."""
    from jobsight.llm.toxicity_rnn import THRESHOLD, fit, score_rows

    net = fit(docs, read(spark, sf_dir, "labels"))
    return score_rows(docs, net).where(f"score < {THRESHOLD}").select("row.*")


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near copies stays."""
    from jobsight.llm.ngram_join import jaccard_components, keep_one

    return keep_one(docs, materialise(jaccard_components(docs), "classes"))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go, by id: all rows of such an id
    go, and rows without an id stay."""
    from jobsight.llm.winnowing import contamination

    found = contamination(docs, read(spark, sf_dir, "benchmark")).where("contaminated").select("doc_id").distinct()
    return without(docs, materialise(found, "found"), "doc_id")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All remaining documents as pieces of sequences."""
    from jobsight.llm.packing import pack_documents
    from jobsight.llm.queries import vocabulary

    return pack_documents(docs, vocabulary("byte_bpe_50k.json"), vocabulary("byte_bpe_50k.tiktoken"))


STAGES = [
    ("detoxify", detoxify),
    ("deduplicate", deduplicate),
    ("decontaminate", decontaminate),
    ("pack", pack),
]

#: A trained network decides in the first stage, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        before, docs = docs, materialise(stage(spark, docs, sf_dir), name)
        discard(before)
    return docs
