"""Benchmark decontamination by winnowing.

Texts are cut into words; of every run of ``W`` consecutive k-gram hashes the
smallest is kept as a fingerprint. A span of ``K + W - 1`` words shared by a
document and a test item therefore shares at least one fingerprint, at the same
place in both. Fingerprints are joined (hash and words), and each hit is
extended word by word over the neighbours that travel with it; a run of
``WINDOW`` equal words or more marks its document words as hit. With
``K + W - 1 = WINDOW`` no shared window is missed. Items shorter than a window
are matched whole: their n-gram is looked up among all n-grams of that length.

A bitmap of fixed size over the items' fingerprints drops most document
fingerprints before the join; it never drops a true one.

Edge cases: null or empty texts have no words, are never contaminated and as
items occur nowhere; repeated rows are reported row by row; with an empty
benchmark nothing is contaminated.
"""

from __future__ import annotations

from typing import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobsight.llm.common import WordHashes, gram_hashes, materialise, mix, slices

#: Words of a window, of a k-gram, and k-grams of a winnowing window.
WINDOW, K = 10, 5
W = WINDOW - K + 1
#: Bits of the prefilter: 512 KB, whatever the benchmark's size.
FILTER_BITS = 22
# word characters: digits, letters a-z after lower-casing, everything beyond ASCII
_NOT_WORD = bytes(32 if c < 0x30 or 0x3A <= c <= 0x60 or 0x7B <= c <= 0x7F else c for c in range(256))

_HIT = pa.struct([("kind", pa.int32()), ("fp", pa.int64()), ("pos", pa.int64()), ("gram", pa.string()),
                  ("before", pa.list_(pa.string())), ("after", pa.list_(pa.string()))])
_HIT_SQL = "struct<kind:int,fp:bigint,pos:bigint,gram:string,before:array<string>,after:array<string>>"


def item_words(text: str | None) -> list[bytes]:
    return text.encode().lower().translate(_NOT_WORD).split() if text else []


def winnow(grams: np.ndarray) -> np.ndarray:
    """Places of the fingerprints: every k-gram that is the smallest of some run of W
    (all of equal ones, so both texts of a shared span keep the same)."""
    n = len(grams)
    if n < W:
        return np.empty(0, dtype=np.int64)
    low = np.lib.stride_tricks.sliding_window_view(grams, W).min(axis=1)
    best = np.full(n + W - 1, 0, dtype=np.uint64)         # largest minimum of the runs that cover a place
    padded = np.concatenate([np.zeros(W - 1, np.uint64), low, np.zeros(W - 1, np.uint64)])
    best = np.lib.stride_tricks.sliding_window_view(padded, W).max(axis=1)
    return np.flatnonzero(grams <= best)


def _slot(kind, fp: np.ndarray) -> np.ndarray:
    return mix(fp + np.uint64(kind)) >> np.uint64(64 - FILTER_BITS)


def _hits(ws: list[bytes], h: np.ndarray, places: np.ndarray, fps: np.ndarray, kind: int) -> list[dict]:
    n = kind or K
    out = []
    for p, fp in zip(places.tolist(), fps.view(np.int64).tolist()):
        around = WINDOW - K if not kind else 0
        out.append({
            "kind": kind, "fp": fp, "pos": p, "gram": b" ".join(ws[p:p + n]).decode(),
            "before": [w.decode() for w in reversed(ws[max(0, p - around):p])],
            "after": [w.decode() for w in ws[p + n:p + n + around]]})
    return out


def _fingerprints(ws: list[bytes], hashes: WordHashes, kinds: list[int], bitmap: np.ndarray | None) -> list[dict]:
    """Fingerprints of one text: kind 0 are winnowed k-grams, kind n whole n-grams."""
    out = []
    h = hashes.of(ws)
    for kind in kinds:
        grams = gram_hashes(h, kind or K)
        places = winnow(grams) if not kind else np.arange(len(grams))
        fps = grams[places]
        if bitmap is not None and len(fps):
            slot = _slot(kind, fps)
            ok = bitmap[slot >> np.uint64(6)] >> (slot & np.uint64(63)) & np.uint64(1) > 0
            places, fps = places[ok], fps[ok]
        out += _hits(ws, h, places, fps, kind)
    return out


def item_fingerprints(items: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """Rows item_id, need (words a match must have), slot, and the fields of a hit."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, id_type = WordHashes(), None
        for batch in slices(batches):
            ids, need, slots, hits = [], [], [], []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ws = item_words(text)
                if not ws:
                    continue
                kind = 0 if len(ws) >= WINDOW else len(ws)
                for hit in _fingerprints(ws, hashes, [kind], None):
                    ids.append(None if key is None else str(key))
                    need.append(kind or WINDOW)
                    slots.append(int(_slot(kind, np.array([hit["fp"]], np.int64).view(np.uint64))[0]))
                    hits.append(hit)
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.string()), pa.array(need, pa.int32()), pa.array(slots, pa.int64()), pa.array(hits, _HIT)],
                ["item", "need", "slot", "hit"])

    return (items.select(id_col, text_col).mapInArrow(run, f"item string, need int, slot bigint, hit {_HIT_SQL}")
            .select("item", "need", "slot", "hit.*").drop("pos").distinct()   # a repeated passage once
            .withColumnsRenamed({"before": "item_before", "after": "item_after"}))


def _bitmap(fps: DataFrame) -> np.ndarray:
    """At most 2^FILTER_BITS / 64 longs come to the driver."""
    bits = np.zeros(1 << (FILTER_BITS - 6), dtype=np.uint64)
    for at, word in (fps.groupBy(F.expr("shiftright(slot, 6)").alias("at"))
                     .agg(F.bit_or(F.expr("shiftleft(1L, cast(slot & 63 AS INT))")).alias("word")).collect()):
        bits[at] = np.uint64(word & 0xFFFFFFFFFFFFFFFF)
    return bits


def _document_hits(docs: DataFrame, kinds: list[int], bitmap: np.ndarray, id_col: str, text_col: str) -> DataFrame:
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, base, done = WordHashes(), TaskContext.get().partitionId() << 33, 0
        for batch in slices(batches):
            words = [item_words(t) for t in batch.column(1).to_pylist()]
            hits = [_fingerprints(ws, hashes, kinds, bitmap) for ws in words]
            yield pa.RecordBatch.from_arrays(
                [pa.array(range(base + done, base + done + len(words)), pa.int64()), batch.column(0),
                 pa.array([len(ws) for ws in words], pa.int64()), pa.array(hits, pa.list_(_HIT))],
                ["row", id_col, "n_words", "hits"])
            done += len(words)

    return docs.select(id_col, text_col).mapInArrow(
        run, f"row bigint, `{id_col}` {id_type}, n_words bigint, hits array<{_HIT_SQL}>")


def _same(a: str, b: str) -> str:
    """Length of the common prefix of two arrays, as SQL."""
    eq = f"zip_with({a}, {b}, (x, y) -> coalesce(x = y, false))"
    return f"if(array_position({eq}, false) = 0, cast(size({eq}) AS BIGINT), array_position({eq}, false) - 1)"


def shared_spans(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 item_col: str = "item_id") -> tuple[DataFrame, DataFrame]:
    """(all document rows: row, id, n_words; spans: row, start, stop, item)."""
    fps = materialise(item_fingerprints(items, item_col, text_col), "item-fingerprints")
    kinds = sorted(r[0] for r in fps.select("kind").distinct().collect())      # 0 .. WINDOW - 1
    found = materialise(_document_hits(docs, kinds, _bitmap(fps), id_col, text_col), "document-hits")
    spans = (found.select("row", F.explode("hits").alias("h")).select("row", "h.*")
             .join(fps, ["kind", "fp", "gram"])
             .withColumn("back", F.expr(_same("before", "item_before")))
             .withColumn("on", F.expr(_same("after", "item_after")))
             .select("row", "item", "need", (F.col("pos") - F.col("back")).alias("start"),
                     F.expr(f"pos + if(kind = 0, {K}, kind) + on").alias("stop"))
             .where("stop - start >= need").drop("need"))
    return found.drop("hits"), spans


def contamination(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  item_col: str = "item_id") -> DataFrame:
    """Per row of docs: id_col, n_words, n_hit, n_items, items_sha256, contaminated."""
    rows, spans = shared_spans(docs, items, id_col, text_col, item_col)
    # spans of a row: repeats go before the shuffle, then one small array a row
    covered = (spans.select("row", "start", "stop").distinct()
               .groupBy("row").agg(F.sort_array(F.collect_list(F.struct("start", "stop"))).alias("s"))
               .select("row", F.expr(
                   "aggregate(s, named_struct('n', 0L, 'upto', 0L), (a, x) -> named_struct("
                   "'n', a.n + greatest(0L, x.stop - greatest(x.start, a.upto)), 'upto', greatest(a.upto, x.stop)),"
                   " a -> a.n)").alias("n_hit")))
    matched = (spans.select("row", "item").distinct().groupBy("row")
               .agg(F.count("*").alias("n_items"), F.concat_ws(",", F.sort_array(F.collect_list("item"))).alias("items")))
    out = rows.join(covered, "row", "left").join(matched, "row", "left")
    return out.select(
        id_col, "n_words", F.coalesce("n_hit", F.lit(0)).alias("n_hit"), F.coalesce("n_items", F.lit(0)).alias("n_items"),
        F.sha2(F.coalesce("items", F.lit("")).cast("binary"), 256).alias("items_sha256"),
        F.coalesce(F.col("n_hit") > 0, F.lit(False)).alias("contaminated"))
