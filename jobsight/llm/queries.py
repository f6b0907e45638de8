"""Registered queries of the operators: each applies one operator, with production
parameters, to its whole table; DuckDB SQL where SQL can express it."""

from __future__ import annotations

import zlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import LongType

from jobsight.llm.common import read
from jobsight.llm import queries_sql as sql
from jobsight.session import scratch_path

#: Limit of a shard in ``op9``.
SHARD_BYTES = 1 << 20


def vocabulary(name: str) -> str:
    """Place of a public vocabulary file (the same on every executor)."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_html_mincut(spark: SparkSession, sf_dir: str) -> DataFrame:
    from jobsight.llm.html_mincut import extract

    return extract(read(spark, sf_dir, "pages"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from jobsight.llm.token_counts import token_counts

    return token_counts(read(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from jobsight.llm.packing import pack_documents

    return pack_documents(read(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"),
                          vocabulary("byte_bpe_50k.tiktoken"))


def op4_arc_to_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from jobsight.llm.arc_warc import pages_through_warc

    return pages_through_warc(read(spark, sf_dir, "pages"))


def op5_brown_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    from jobsight.llm.brown_lm import learn, score

    docs = read(spark, sf_dir, "documents")
    return score(docs, *learn(docs))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from jobsight.llm.toxicity_rnn import fit, score

    docs = read(spark, sf_dir, "documents")
    return score(docs, fit(docs, read(spark, sf_dir, "labels")))


def op7_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from jobsight.llm.ngram_join import jaccard_components

    return jaccard_components(read(spark, sf_dir, "documents"))


def op8_posting_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    from jobsight.llm.posting_ann import search

    return search(read(spark, sf_dir, "embeddings"))


def op9_extendible_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from jobsight.llm.extendible_sharding import shard

    return shard(read(spark, sf_dir, "documents"), SHARD_BYTES)


def op10_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from jobsight.llm.winnowing import contamination

    return contamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op11_wavelet_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    from jobsight.llm.wavelet import read_documents, write_shards

    docs = read(spark, sf_dir, "documents")
    manifest = write_shards(docs, scratch_path(spark, "wavelet"), vocabulary("byte_bpe_50k.json"),
                            vocabulary("byte_bpe_50k.tiktoken"))
    return read_documents(manifest, docs.schema["doc_id"], ("ids_crc32", LongType(), zlib.crc32))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    from jobsight.llm.collocations import collocations

    return collocations(read(spark, sf_dir, "documents"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from jobsight.llm.periodic_runs import periodic_runs, periodic_tail, run_digests

    return run_digests(periodic_runs(read(spark, sf_dir, "documents"), rearrange=periodic_tail))


QUERIES = {f.__name__: f for f in (
    op1_html_mincut, op2_token_counts, op3_packing, op4_arc_to_warc, op5_brown_lm, op6_toxicity,
    op7_ngram_jaccard_join, op8_posting_lists, op9_extendible_sharding, op10_winnowing, op11_wavelet_matrix,
    op12_collocations, op13_periodic_runs)}

ORACLE = {
    "op4_arc_to_warc": sql.OP4,
    "op7_ngram_jaccard_join": sql.OP7,
    "op9_extendible_sharding": sql.op9(SHARD_BYTES),
    "op10_winnowing": sql.OP10,
    "op12_collocations": sql.OP12,
}
