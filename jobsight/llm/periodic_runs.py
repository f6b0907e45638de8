"""Periodic runs of words by the dictionary of basic factors.

A run is a stretch of words with smallest period q, at least ``max(6, 4 * q)``
words long, that no neighbouring word extends. For every power of two L the
factors of L words are named (equal factors of one document, equal names; the
name of 2L words is the pair of two names of L). Successive occurrences of a
name at equal distances d, two steps within 2L, form an arithmetic progression
that proposes the period d. Distances of at most L/2 were proposed a level
below, so a level keeps L/2 < d <= L. Neighbouring proposals of one distance
are one progression; it is extended word by word and doubles are dropped.

A run of four periods holds each factor at its start three times, so names met
less than three times in their document leave the dictionary: after a few levels
only repeated passages are left. All documents of a slice are named together in
numpy arrays; a task holds one slice (``SLICE_BYTES`` of text, or one longer
document). Time is in proportion to n log n.

Why a progression is exact: inside a run of period q <= L, two occurrences of a
factor of L words are a multiple of q apart, so the successor lies at q itself,
and no smaller distance can be a period of the run.

Edge cases: null, empty and blank texts have no words, no runs and an empty
collapsed text. Repeated rows are handled row by row, null ids as any other. An
empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

from typing import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from jobsight.llm.common import byte_slices

SLICE_BYTES = 4 << 20
RUN = T.StructType([T.StructField(c, T.LongType(), False) for c in ("start", "length", "period")])


def progressions(codes: np.ndarray, doc: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(start, end, distance) arrays of the progressions of every level. ``codes``: a
    number a word; ``doc``: the number of its document, ascending."""
    n = len(codes)
    pos = np.arange(n)
    key = doc.astype(np.int64) * (int(codes.max(initial=0)) + 1) + codes
    name_at = np.empty(n, dtype=np.int64)
    size = 1
    while len(pos):
        order = np.argsort(key, kind="stable")            # equal names together, ascending positions
        p, k = pos[order], key[order]
        group = np.cumsum(np.r_[False, k[1:] != k[:-1]])
        often = np.bincount(group)[group] >= 3
        p, group = p[often], group[often]
        if not len(p):
            return
        step = np.diff(p)
        same = group[1:] == group[:-1]
        t = np.flatnonzero(same[:-1] & same[1:] & (step[:-1] == step[1:])
                           & (step[:-1] > size // 2) & (step[:-1] <= size))
        if len(t):
            at, d = p[t], step[t]
            order = np.lexsort((at, d))
            at, d = at[order], d[order]
            first = np.r_[True, (at[1:] != at[:-1] + 1) | (d[1:] != d[:-1])]
            last = np.r_[first[1:], True]
            yield at[first], at[last] + 2 * d[last] + size, d[first]
        name_at.fill(-1)
        name_at[p] = group
        pos = np.sort(p)
        pos = pos[pos + size < n]
        pos = pos[name_at[pos + size] >= 0]
        key = name_at[pos] * (int(group[-1]) + 1) + name_at[pos + size]
        size *= 2


def find_runs(codes: np.ndarray, lengths: np.ndarray, least: int = 6,
              exponent: int = 4) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(document, start within it, length, period) of all runs, in that order."""
    doc = np.repeat(np.arange(len(lengths)), lengths)
    ends = np.cumsum(lengths)
    begins = ends - lengths
    found = list(progressions(codes, doc))
    if not found:
        return (np.empty(0, dtype=np.int64),) * 4
    lo, hi, d = (np.concatenate(x) for x in zip(*found))
    of = doc[lo]
    while len(more := np.flatnonzero(lo > begins[of])):   # extend to the left, then to the right
        more = more[codes[lo[more] - 1] == codes[lo[more] - 1 + d[more]]]
        if not len(more):
            break
        lo[more] -= 1
    while len(more := np.flatnonzero(hi < ends[of])):
        more = more[codes[hi[more]] == codes[hi[more] - d[more]]]
        if not len(more):
            break
        hi[more] += 1
    rows = np.stack([of, lo - begins[of], hi - lo, d], axis=1)
    rows = np.unique(rows[(hi - lo) >= np.maximum(least, exponent * d)], axis=0)
    rows = rows[np.lexsort((rows[:, 3], rows[:, 1], rows[:, 0]))]
    return rows[:, 0], rows[:, 1], rows[:, 2], rows[:, 3]


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 6, exponent: int = 4,
                  rearrange: Callable[[object, int], "np.ndarray | None"] | None = None) -> DataFrame:
    """``id_col``, ``runs`` (start, length, period in words, by start and period) and
    ``collapsed``: the words outside all runs and each run's first period, joined by
    one space. ``exponent`` is 4 or more. ``rearrange(id, n)`` may give the word
    numbers that a document of n words is read by (None: as it is)."""
    if exponent < 4:
        raise ValueError("progressions of three terms prove runs of four periods and more")
    schema = T.StructType([docs.schema[id_col], T.StructField("runs", T.ArrayType(RUN, False)),
                           T.StructField("collapsed", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in byte_slices(batches, 1, SLICE_BYTES):
            words: list[bytes] = []
            lengths = []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                own = text.encode().split() if text else []
                way = rearrange(key, len(own)) if rearrange and own else None
                if way is not None:
                    own = [own[i] for i in way.tolist()]
                words += own
                lengths.append(len(own))
            lengths = np.array(lengths, dtype=np.int64)
            codes = pa.array(words, pa.binary()).dictionary_encode().indices.to_numpy().astype(np.int64)
            of, start, length, period = find_runs(codes, lengths, least, exponent)
            begins = np.cumsum(lengths) - lengths
            edge = np.zeros(len(words) + 1, dtype=np.int64)   # how many runs drop a word, as differences
            np.add.at(edge, begins[of] + start + period, 1)
            np.add.at(edge, begins[of] + start + length, -1)
            dropped = np.cumsum(edge) > 0
            per_doc = np.bincount(of, minlength=len(lengths))
            collapsed = []
            for begin, n, runs in zip(begins.tolist(), lengths.tolist(), per_doc.tolist()):
                if runs:
                    places = (begin + np.flatnonzero(~dropped[begin:begin + n])).tolist()
                    collapsed.append(b" ".join([words[i] for i in places]).decode())
                else:
                    collapsed.append(b" ".join(words[begin:begin + n]).decode())
            offsets = pa.array(np.r_[0, np.cumsum(per_doc)].astype(np.int32))
            fields = [pa.field(c, pa.int64(), False) for c in RUN.names]
            triples = pa.StructArray.from_arrays([pa.array(x, pa.int64()) for x in (start, length, period)], fields=fields)
            listed = pa.ListArray.from_arrays(offsets, triples, type=pa.list_(pa.field("element", triples.type, False)))
            yield pa.RecordBatch.from_arrays([batch.column(0), listed, pa.array(collapsed, pa.string())], schema.names)

    return docs.select(id_col, text_col).mapInArrow(run, schema)


def run_digests(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Per row of ``periodic_runs``: how many runs, the longest one (ties: smallest
    start, then period), and SHA-256 digests of all runs and of the collapsed text."""
    best = F.expr("array_max(transform(runs, r -> struct(r.length AS length, -r.start AS start, -r.period AS period)))")
    lines = F.expr("array_join(transform(runs, r -> concat(r.start, ',', r.length, ',', r.period, '\\n')), '')")
    return found.withColumn("best", best).select(
        id_col, F.size("runs").cast("long").alias("n_runs"), (-F.col("best.start")).alias("start"),
        F.col("best.length").alias("length"), (-F.col("best.period")).alias("period"),
        F.expr("(1000 * best.length) DIV (-best.period)").alias("exponent_milli"),
        F.sha2(F.encode(lines, "UTF-8"), 256).alias("runs_sha256"),
        F.sha2(F.encode("collapsed", "UTF-8"), 256).alias("collapsed_sha256"))


def periodic_tail(key: object, n: int) -> np.ndarray | None:
    """The rearrangement that the registered query states: one document in ten repeats
    a stretch of its words to its end. A null id leaves the text as it is."""
    import zlib

    if key is None:
        return None
    h = zlib.crc32(str(key).encode())
    if h % 10:
        return None
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    way = np.arange(n)
    way[a:] = a + (way[a:] - a) % p
    return way
