"""Phrase collocation mining by sorted count streams.

Every word of a piece starts one window of three words, padded at the piece's
end. The windows, sorted, are the prefix-order stream: the counts of all words,
pairs and triples are sums over its runs of equal first one, two or three words.

1. A task sorts the windows of a block of texts by (first, second, third word),
   adds up equal ones and cuts the sorted stream at splitters into ranges. Each
   range travels as one compressed row: its words, sorted, and numbers into them.
2. The streams of a range are merged: word lists united in byte order, numbers
   mapped, windows sorted and added. Runs give the counts. A phrase that may go on
   in a neighbouring range (a range's first or last word or pair) is passed on
   whatever its count; these few partial counts are added afterwards.
3. What is met ``least`` times or more is kept in two orders and lockstep-joined
   (sort-merge joins, no hash tables): in prefix order a phrase meets its left
   parts and a pair its right extensions, in suffix order (last word first) its
   right parts and its left extensions. The parts of a phrase are met at least as
   often as the phrase, so nothing below ``least`` is needed.

The splitters are quantiles of a sample of windows, one for ``RANGE_WINDOWS`` windows
and ``MAX_RANGES`` at most (beyond, ranges grow); they decide how evenly ranges are
dealt, never a result. A range may begin inside a word or a pair, so one with a third
of all windows is split like any other. Exact arithmetic: counts are longs, products
decimals of 38 digits.

Edge cases: null or blank texts give nothing; a null language is ``und``; repeated
rows count each time; ties are broken by count, then phrase bytes. An empty
table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import io
from bisect import bisect_left
from typing import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from jobsight.llm.common import byte_slices, materialise

#: Bytes of text that a task sorts at once.
BLOCK_BYTES = 8 << 20
#: Windows (before adding up equal ones) that a range holds, about; how many ranges at most.
RANGE_WINDOWS, MAX_RANGES = 2_000_000, 65_536
#: Rows of the sample (at least; one in 5,000), every how many words a window is taken, and a row's most.
SAMPLE_ROWS, SAMPLE_STEP, SAMPLE_MOST = 512, 32, 1024
BREAKS = b".,;:!?\n\x0b\x0c\r"
_TABLE = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ\t" + BREAKS, b"abcdefghijklmnopqrstuvwxyz " + b"\n" * len(BREAKS))
Key = tuple[bytes, bytes, bytes, bytes]                   # language and window


def windows_of(texts: list[bytes]) -> tuple[pa.Array, list[np.ndarray]]:
    """The distinct words in byte order, and the numbers (from 1; 0 pads) of every window."""
    joined = b"\n".join(texts).translate(_TABLE).replace(b"\n", b" \n ")
    coded = pc.split_pattern(pa.array([joined], pa.large_binary()), " ").flatten().dictionary_encode()
    found, index = coded.dictionary, coded.indices.to_numpy()
    order = pc.sort_indices(found).to_numpy()
    is_word = np.ones(len(found), dtype=bool)
    blank, mark = pc.index(found, pa.scalar(b"", pa.large_binary())).as_py(), pc.index(found, pa.scalar(b"\n", pa.large_binary())).as_py()
    is_word[[i for i in (blank, mark) if i >= 0]] = False
    order = order[is_word[order]]
    number = np.zeros(len(found), dtype=np.int64)         # a break is 0
    number[order] = np.arange(1, len(order) + 1)
    w = number[index[index != blank]]
    second = np.append(w[1:], 0)
    third = np.where(second > 0, np.append(second[1:], 0), 0)
    at = w > 0
    return found.take(pa.array(order)), [w[at], second[at], third[at]]


def add_up(columns: list[np.ndarray], counts: np.ndarray | None, top: int,
           at_hand: int = 63) -> tuple[list[np.ndarray], np.ndarray]:
    """Windows in ascending order, equal ones added up. ``top``: the largest number;
    three numbers share one 64-bit key where they fit."""
    bits, n = max(1, int(top).bit_length()), len(columns[0])
    if 3 * bits <= at_hand:
        key = (columns[0] << (2 * bits)) | (columns[1] << bits) | columns[2]
        if counts is None:
            key.sort()
        else:
            order = np.argsort(key, kind="stable")
            key, counts = key[order], counts[order]
        first = np.flatnonzero(np.r_[n > 0, key[1:] != key[:-1]][:n])
        key, mask = key[first], (1 << bits) - 1
        columns = [key >> (2 * bits), (key >> bits) & mask, key & mask]
    else:
        order = np.lexsort(columns[::-1])
        columns = [c[order] for c in columns]
        counts = None if counts is None else counts[order]
        changes = np.zeros(n, dtype=bool)
        changes[:1] = True
        for c in columns:
            changes[1:] |= c[1:] != c[:-1]
        first = np.flatnonzero(changes)
        columns = [c[first] for c in columns]
    if counts is None:
        return columns, np.diff(np.append(first, n))
    return columns, np.add.reduceat(counts, first, dtype=np.int64) if n else counts


def cuts(splitters: list[Key], lang: bytes, words: pa.Array, columns: list[np.ndarray]) -> tuple[int, list[int]]:
    """The range of the stream's first window, and where each further range begins. A
    window's range is the number of splitters not above it."""
    begin = bisect_left(splitters, (lang,))
    end = bisect_left(splitters, (lang + b"\0",))
    places = []
    for key in splitters[begin:end]:
        lo, hi = 0, len(columns[0])
        for column, word in zip(columns, key[1:]):
            at = bisect_left(words, word, key=lambda x: x.as_py()) if word else -1
            known = not word or at < len(words) and words[at].as_py() == word
            lo, hi = (lo + int(np.searchsorted(column[lo:hi], at + 1, side)) for side in ("left", "right"))
            if not known:
                break
        places.append(lo)
    return begin, places


def _listed(values: pa.Array) -> pa.Array:
    return pa.LargeListArray.from_arrays([0, len(values)], values)


def pack(words: pa.Array, columns: list[np.ndarray], counts: np.ndarray) -> bytes:
    """One range of a stream: its words, the windows as numbers into them, the counts."""
    used = np.unique(np.concatenate(columns))
    used = used[used > 0]
    kind = np.uint16 if len(used) < 1 << 16 else np.uint32
    small = [np.searchsorted(used, c).astype(kind) + (c > 0).astype(kind) for c in columns]
    small[0] = np.diff(small[0], prepend=kind(0))
    arrays = [words.take(pa.array(used - 1)), *map(pa.array, small), pa.array(counts.astype(np.uint32 if counts.max() >> 16 else np.uint16))]
    batch = pa.RecordBatch.from_arrays([_listed(a) for a in arrays], ["words", "first", "second", "third", "counts"])
    sink = io.BytesIO()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_batch(batch)
    return sink.getvalue()


def unpack(blob: bytes) -> tuple[pa.Array, list[np.ndarray], np.ndarray]:
    batch = pa.ipc.open_stream(blob).read_next_batch()
    words, *numbers = (c.flatten() for c in batch.columns)
    first, second, third, counts = (x.to_numpy().astype(np.int64) for x in numbers)
    return words, [np.cumsum(first), second, third], counts


def _texts_by_language(batch: pa.RecordBatch) -> dict[bytes, list[bytes]]:
    found: dict[bytes, list[bytes]] = {}
    for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
        if text:
            found.setdefault(b"und" if lang is None else str(lang).encode(), []).append(text.encode())
    return found


def _blocks(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[dict[bytes, list[bytes]]]:
    held: dict[bytes, list[bytes]] = {}
    size = 0
    for batch in byte_slices(batches, 1, limit):
        for lang, texts in _texts_by_language(batch).items():
            held.setdefault(lang, []).extend(texts)
            size += sum(map(len, texts))
        if size >= limit:
            yield held
            held, size = {}, 0
    if held:
        yield held


def sort_blocks(splitters: list[Key], block_bytes: int):
    """Step 1: (range, lang, blob) rows of one task's blocks."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _blocks(batches, block_bytes):
            for lang, texts in block.items():
                words, columns = windows_of(texts)
                if not len(words):
                    continue
                columns, counts = add_up(columns, None, len(words))
                at, places = cuts(splitters, lang, words, columns)
                edges = [0, *places, len(counts)]
                found = [(at + j, pack(words, [c[a:b] for c in columns], counts[a:b]))
                         for j, (a, b) in enumerate(zip(edges, edges[1:])) if b > a]
                yield pa.RecordBatch.from_arrays([
                    pa.array([j for j, _ in found], pa.int64()), pa.array([lang.decode()] * len(found)),
                    pa.array([b for _, b in found], pa.binary())], ["range", "lang", "blob"])
    return run


COUNTS = "lang string, n int, w1 string, w2 string, w3 string, f long"


def merge_range(least: int):
    """Step 2: the counts of one range, by language; partial ones of what may go on beyond it."""
    def run(table: pa.Table) -> pa.Table:
        langs, out = table["lang"].to_pylist(), []
        blobs = table["blob"]
        for lang in sorted(set(langs)):
            parts = [unpack(blobs[i].as_py()) for i, x in enumerate(langs) if x == lang]
            coded = pa.concat_arrays([p[0] for p in parts]).dictionary_encode()
            order = pc.sort_indices(coded.dictionary).to_numpy()
            number = np.empty(len(order), dtype=np.int64)
            number[order] = np.arange(1, len(order) + 1)
            number, words = number[coded.indices.to_numpy()], coded.dictionary.take(pa.array(order)).cast(pa.large_string())
            at, mapped = 0, []
            for own, columns, _ in parts:
                way = np.r_[0, number[at:at + len(own)]]
                mapped.append([way[c] for c in columns])
                at += len(own)
            counts = np.concatenate([p[2] for p in parts])
            columns = [np.concatenate(c) for c in zip(*mapped)]
            del parts, mapped
            columns, counts = add_up(columns, counts, len(order))
            out.append(([lang], [0], [""], [""], [""], [int(counts.sum())]))
            new = np.zeros(len(counts), dtype=bool)
            new[0] = True
            for n, column in enumerate(columns, 1):
                new[1:] |= column[1:] != column[:-1]
                first = np.flatnonzero(new)
                f = np.add.reduceat(counts, first)
                keep = f >= least
                keep[[0, -1]] |= n < 3                    # may go on in a neighbouring range
                keep &= column[first] > 0
                first, f = first[keep], f[keep]
                shown = [words.take(pa.array(c[first] - 1)) if k <= n else [""] * len(first) for k, c in enumerate(columns, 1)]
                out.append(([lang] * len(f), [n] * len(f), *shown, f))
        cols = [pa.chunked_array([pa.array(x, t) if not isinstance(x, pa.Array) else x.cast(t) for x in c], t) for c, t in zip(
            zip(*out), [pa.string(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.int64()])]
        return pa.table(cols, ["lang", "n", "w1", "w2", "w3", "f"])
    return run


def choose_splitters(texts: DataFrame, range_windows: int) -> list[Key]:
    """Quantiles of the distinct windows of a sample of rows."""
    rows = texts.count()
    size = max(SAMPLE_ROWS, rows // 5000)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in byte_slices(batches, 1, BLOCK_BYTES):
            for lang, own in _texts_by_language(batch).items():
                for text in own:
                    words, columns = windows_of([text])
                    n = len(columns[0])
                    at = np.arange(0, n, max(SAMPLE_STEP, -(-n // SAMPLE_MOST)))
                    shown = [["" if i == 0 else words[i - 1].as_py().decode() for i in c[at].tolist()] for c in columns]
                    yield pa.RecordBatch.from_arrays([pa.array([lang.decode()] * len(at), pa.string()), *(pa.array(c, pa.string()) for c in shown),
                                                      pa.array(np.full(len(at), n / max(1, len(at))))], ["lang", "w1", "w2", "w3", "stands"])

    sample = texts.orderBy(F.rand(7)).limit(size).mapInArrow(run, "lang string, w1 string, w2 string, w3 string, stands double")
    found = sample.toArrow()
    stood = pc.sum(found["stands"]).as_py() or 0
    ranges = min(MAX_RANGES, int(stood * rows / min(size, max(rows, 1)) / range_windows) + 1)
    keys = sorted({tuple(x.encode() for x in row) for row in zip(*(found[c].to_pylist() for c in ("lang", "w1", "w2", "w3")))})
    return sorted({keys[len(keys) * j // ranges] for j in range(1, ranges)}) if keys else []


def phrase_counts(docs: DataFrame, least: int = 10, lang_col: str = "lang", text_col: str = "text",
                  range_windows: int = RANGE_WINDOWS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """lang, n, w1, w2, w3, f: every phrase of 1 to 3 words met ``least`` times or more
    in a language; n = 0: all its word occurrences."""
    texts = docs.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"))
    splitters = choose_splitters(texts, range_windows)
    streams = texts.mapInArrow(sort_blocks(splitters, block_bytes), "range long, lang string, blob binary")
    merged = streams.groupBy("range").applyInArrow(merge_range(least), COUNTS)
    added = merged.groupBy("lang", "n", "w1", "w2", "w3").agg(F.sum("f").alias("f"))
    return materialise(added.where((F.col("n") == 0) | (F.col("f") >= least)), "phrase-counts")


def _lockstep(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    return left.join(right.hint("merge"), on, how)


def collocations(docs: DataFrame, least: int = 10, share: int = 50, top: int = 2000,
                 lang_col: str = "lang", text_col: str = "text", **ways) -> DataFrame:
    """Each language's first ``top`` phrases of 2 or 3 words: lang, rank, phrase, a (its
    count), l, r (its parts' at the lowest-scoring cut), n, score = floor(10^6 a a / (l r)).
    A pair that stands ``share`` % of the time inside one triple is dropped."""
    counts = phrase_counts(docs, least, lang_col, text_col, **ways)
    ones = counts.where("n = 1").select("lang", F.col("w1").alias("x"), F.col("f").alias("fx"))
    twos = counts.where("n = 2").select("lang", F.col("w1").alias("x"), F.col("w2").alias("y"), F.col("f").alias("fxy"))
    triples = counts.where("n = 3").select("lang", "w1", "w2", "w3", F.col("f").alias("a"))
    pairs = counts.where("n = 2").select("lang", "w1", "w2", F.col("f").alias("a"))

    def word(c: str, name: str) -> DataFrame:
        return ones.select("lang", F.col("x").alias(c), F.col("fx").alias(name))

    def pair(c: str, d: str, name: str) -> DataFrame:
        return twos.select("lang", F.col("x").alias(c), F.col("y").alias(d), F.col("fxy").alias(name))

    def extended(c: str, d: str, name: str) -> DataFrame:
        return triples.groupBy("lang", F.col(c).alias("w1"), F.col(d).alias("w2")).agg(F.max("a").alias(name))

    def score(l: str, r: str) -> str:
        return f"(CAST(1000000 AS DECIMAL(38, 0)) * a * a) DIV (CAST({l} AS DECIMAL(38, 0)) * {r})"

    # prefix order: left parts, extensions to the right
    triples_l = _lockstep(_lockstep(triples, pair("w1", "w2", "l2"), ["lang", "w1", "w2"]), word("w1", "l1"), ["lang", "w1"])
    pairs_l = _lockstep(_lockstep(pairs, extended("w1", "w2", "right"), ["lang", "w1", "w2"], "left"), word("w1", "l"), ["lang", "w1"])
    # suffix order: right parts, extensions to the left
    triples_lr = _lockstep(_lockstep(triples_l, pair("w2", "w3", "r1"), ["lang", "w2", "w3"]), word("w3", "r2"), ["lang", "w3"])
    pairs_lr = _lockstep(_lockstep(pairs_l, extended("w2", "w3", "left"), ["lang", "w1", "w2"], "left"), word("w2", "r"), ["lang", "w2"])

    third = (triples_lr.withColumn("s1", F.expr(score("l1", "r1"))).withColumn("s2", F.expr(score("l2", "r2")))
             .withColumn("later", F.expr("s2 < s1"))
             .select("lang", F.concat_ws(" ", "w1", "w2", "w3").alias("phrase"), "a", F.expr("if(later, l2, l1)").alias("l"),
                     F.expr("if(later, r2, r1)").alias("r"), F.expr("if(later, s2, s1)").alias("score")))
    second = (pairs_lr.where(f"NOT coalesce(100 * greatest(right, left) >= {share} * a, false)")
              .select("lang", F.concat_ws(" ", "w1", "w2").alias("phrase"), "a", "l", "r", F.expr(score("l", "r")).alias("score")))
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    found = second.unionByName(third).withColumn("__deal", F.expr("pmod(xxhash64(phrase), 64)"))
    # the first of every language: those of 64 shares first, so that no task sorts a whole language
    near = found.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "__deal").orderBy(*order))).where(f"rank <= {top}")
    ranked = near.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(f"rank <= {top}")
    totals = counts.where("n = 0").select("lang", F.col("f").alias("n"))
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
