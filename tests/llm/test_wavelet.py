import io
import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from helpers import awkward_docs, empty_docs
from pyspark.sql import types as T
from tokenizers import Tokenizer

from jobsight.llm import wavelet as W
from jobsight.session import scratch_path

JSON, RANKS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")


def file_of(ids, width):
    docs = pa.RecordBatch.from_arrays([pa.array([7]), pa.array([len(ids)])], ["id", "n_tokens"])
    return W.WaveletFile(io.BytesIO(W.encode_shard(np.array(ids, dtype=np.uint32), docs, width)))


@pytest.mark.parametrize("n,width,top", [(1, 1, 2), (9, 3, 8), (5000, 16, 50257), (3 * W.BLOCK + 17, 5, 3), (W.BLOCK, 17, 100_000)])
def test_file_answers_equal_plain_ones(n, width, top):
    r = np.random.default_rng(n)
    ids = r.integers(0, top, n).astype(np.uint32)
    ids[r.integers(0, n, n // 3)] = ids[0]
    f = file_of(ids, width)
    assert (f.decode() == ids).all()
    at = np.unique(np.r_[0, n - 1, r.integers(0, n, 50)])
    assert (f.access(at) == ids[at]).all()
    for token in {int(ids[0]), int(ids[-1]), 0, top - 1}:
        lo, hi = sorted(r.integers(0, n + 1, 2).tolist())
        assert f.count(token) == (ids == token).sum() and f.count(token, lo, hi) == (ids[lo:hi] == token).sum()
        assert (f.occurrences(token) == np.flatnonzero(ids == token)).all()
        assert (f.occurrences(token, lo, hi) == lo + np.flatnonzero(ids[lo:hi] == token)).all()
    assert f.count(1 << width) == 0
    with pytest.raises(IndexError):
        f.access([n])


def test_a_lookup_reads_few_blocks():
    class Counted(io.BytesIO):
        got = 0

        def read(self, size=-1):
            Counted.got += size
            return super().read(size)

    ids = np.random.default_rng(1).integers(0, 50257, 20 * W.BLOCK).astype(np.uint32)
    docs = pa.RecordBatch.from_arrays([pa.array([7]), pa.array([len(ids)])], ["id", "n_tokens"])
    data = W.encode_shard(ids, docs, 16)
    f = W.WaveletFile(Counted(data))
    Counted.got = 0
    assert f.access([123_456])[0] == ids[123_456]
    assert Counted.got < len(data) / 8
    with pytest.raises(ValueError):
        W.WaveletFile(io.BytesIO(b"x" * 64))


def test_documents_come_back_from_the_files(spark):
    library = Tokenizer.from_file(JSON)
    rows = [tuple(r) for r in awkward_docs(spark).select("doc_id", "text").collect()]
    rows += [(i, " ".join(random.Random(i).choices(["the", "Über", "a\nb", "x", "don't", "12"], k=i % 70))) for i in range(100, 400)]
    rows += [(150, "again "), (100, " head"), (None, "second without id")]
    docs = spark.createDataFrame([(t, k, "clash") for k, t in rows], "text string, doc_id long, start string").repartition(5)
    manifest = W.write_shards(docs, scratch_path(spark, "wm"), JSON, RANKS, shard_tokens=1000)
    assert manifest.count() > 5
    got = W.read_documents(manifest, docs.schema["doc_id"]).orderBy("start").collect()
    plain = sorted((k is not None, k or 0, library.encode(t or "", add_special_tokens=False).ids + [0]) for k, t in rows)
    at, all_ids, texts = 0, [], []
    for row in got:
        assert row["start"] == at
        at += row["n_tokens"]
        ids = np.frombuffer(row["ids"], "<u4").tolist()
        texts.append((row["doc_id"] is not None, row["doc_id"] or 0, ids))
        all_ids += ids
        assert len(ids) == row["n_tokens"]
    assert [t[:2] for t in texts] == [t[:2] for t in plain]     # ascending ids, nulls first
    assert sorted(texts) == plain
    # the files answer by themselves
    tokens = [0, all_ids[3], 50256, 49999]
    counts = {r["token"]: r["n"] for r in W.count_tokens(manifest, tokens).collect()}
    assert counts == {t: all_ids.count(t) for t in tokens}
    found = W.find_tokens(manifest, [all_ids[3]], docs.schema["doc_id"]).collect()
    assert sorted(r["position"] for r in found) == [i for i, t in enumerate(all_ids) if t == all_ids[3]]
    starts = {r["start"]: r["doc_id"] for r in got}
    assert all(starts[r["position"] - r["offset"]] == r["doc_id"] for r in found)
    spots = [0, 5, len(all_ids) - 1, len(all_ids) + 5]
    assert sorted(map(tuple, W.tokens_at(manifest, spots).collect())) == [(i, all_ids[i]) for i in spots[:3]]
    crc = W.read_documents(manifest, docs.schema["doc_id"], ("c", T.LongType(), zlib.crc32)).orderBy("start").collect()
    assert [r["c"] for r in crc] == [zlib.crc32(np.array(t[2], "<u4").tobytes()) for t in texts]


def test_empty_table_and_long_document(spark):
    empty = W.write_shards(empty_docs(spark), scratch_path(spark, "wm"), JSON, RANKS)
    assert empty.count() == 0 and W.read_documents(empty, empty_docs(spark).schema["doc_id"]).count() == 0
    docs = spark.createDataFrame([(2, "b " * 3000), (1, "a"), (3, None)], "doc_id int, text string").coalesce(1)
    manifest = W.write_shards(docs, scratch_path(spark, "wm"), JSON, RANKS, shard_tokens=100)
    got = W.read_documents(manifest, docs.schema["doc_id"]).orderBy("start").select("doc_id", "start", "n_tokens").collect()
    n = len(Tokenizer.from_file(JSON).encode("b " * 3000, add_special_tokens=False).ids) + 1
    assert [tuple(r) for r in got] == [(1, 0, 2), (2, 2, n), (3, n + 2, 1)]


def test_start_sums_over_many_writing_tasks(spark):
    rows = [((part << 24) + s, "p", 1, part % 7 + s) for part in (0, 1, 1023, 1024, 5000) for s in range(3)]
    m = spark.createDataFrame(rows, W.MANIFEST).repartition(4)
    got = {r["shard"]: r["start"] for r in W.with_starts(m).collect()}
    at = 0
    for shard, _, _, n in sorted(rows):
        assert got[shard] == at
        at += n
