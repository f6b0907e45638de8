"""Brown class-based bigram model, learnt from the corpus and scoring every text.

Word counts and bigram counts come from all training documents, in Spark. The
``CORE`` most frequent words are clustered by the exchange algorithm: each word
in turn moves to the class that raises the mutual information of adjacent
classes most, until nothing moves (or ``SWEEPS``). That is the seed. All other
training words start in one of ``SHAPES`` classes by their form and then move,
``WORD_SWEEPS`` times and all at once, to the class of the most gain (to first
order) against the matrix of class bigrams; a sweep that lowers the information
is not taken. Only words never seen in training keep the class of their form; the
end of a text is a class of its own.

    P(text) = product over tokens of P(class | class before) * P(word | class)
    P(class | before) = (n(before, class) + 1) / (n(before) + classes)
    P(word | class)   = (c(word) + 1) / (N(class) + V(class) + 1)

a text being entered from the end token. Counts of the ``HELD`` most frequent
words travel to the tasks; a document's rarer words meet their counts in a
join, pre-aggregated per document, so no vocabulary is ever held whole. Texts are
kept as chunks of token numbers; the classes of a chunk's rarer words come from
buckets of the vocabulary by 64-bit word hash (words of equal hash share a class).

Edge cases: null and empty texts are one end token; with no training rows
every count is 0; rows without id are learnt from and not held out; repeated
rows are learnt from and scored row by row.
"""

from __future__ import annotations

from typing import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobsight.llm.common import byte_slices, discard, materialise

#: Words clustered, their classes, and sweeps of the exchange algorithm.
CORE, CLASSES, SWEEPS = 1024, 48, 10
#: Classes by form, where all other words start; the last class is the end of a text.
SHAPES = 32
END_CLASS = CLASSES + SHAPES
#: Sweeps over all other words.
WORD_SWEEPS = 2
#: Contexts of a word: the class before it, the class after it.
SLOTS = 2 * (END_CLASS + 1)
#: Tokens of a chunk; tokens for each further bucket of the vocabulary; held words a block.
CHUNK, BUCKET_TOKENS, BLOCK = 250_000, 8_000_000, 1024
#: Class of a word never seen in training, in replies.
UNSEEN = 255
#: Words whose counts travel to the tasks.
HELD = 65_536
#: Bytes of texts split at once; of words counted or chunked at once.
SLICE_BYTES, COUNT_BYTES = 1 << 20, 1 << 23


_CLOSING = np.isin(np.arange(256), list(b".,;:!?\"')"))


def shapes(ws: pa.Array) -> np.ndarray:
    """Class by form of each word, where words outside the core start: length, digits, closing
    punctuation, script. Words are not empty and not null."""
    if not len(ws):
        return np.zeros(0, dtype=np.uint8)
    edge = np.frombuffer(ws.buffers()[1], dtype=np.int32)[ws.offset:ws.offset + len(ws) + 1]
    data, starts = np.frombuffer(ws.buffers()[2], dtype=np.uint8)[edge[0]:edge[-1]], edge[:-1] - edge[0]
    length = np.searchsorted(np.array([3, 6, 10]), np.diff(edge))
    digit = np.logical_or.reduceat((data >= 48) & (data <= 57), starts)
    other = np.maximum.reduceat(data, starts) > 127
    return (CLASSES + length * 8 + digit * 4 + _CLOSING[data[edge[1:] - edge[0] - 1]] * 2 + other).astype(np.uint8)


def shape(word: bytes) -> int:
    return int(shapes(pa.array([word], pa.binary()))[0])


def training_rows(docs: DataFrame, id_col: str) -> "F.Column":
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 7 != 2, F.lit(True))


def split_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """(words of all texts, words of each text): as ``common.words``, null texts having none."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts.cast(pa.string()), "")))
    flat, edge = lists.flatten(), lists.offsets.to_numpy()
    full = pc.greater(pc.binary_length(flat), 0)           # white space at an end leaves an empty word
    kept = np.append(0, np.cumsum(full.to_numpy(zero_copy_only=False)))
    return flat.filter(full), np.diff(kept[edge - edge[0]])


def word_counts(texts: DataFrame) -> DataFrame:
    """(word, c) of all texts; counted per task first, in bounded tables."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out() -> pa.RecordBatch:
            found = pc.value_counts(pa.concat_arrays(held))
            return pa.RecordBatch.from_arrays([found.field("values"), found.field("counts")], ["word", "c"])

        held, size = [], 0
        for batch in byte_slices(batches, 0, SLICE_BYTES):
            held.append(split_words(batch.column(0))[0])
            size += held[-1].nbytes
            if size > COUNT_BYTES:
                yield out()
                held, size = [], 0
        if held:
            yield out()

    return texts.mapInArrow(run, "word string, c bigint").groupBy("word").agg(F.sum("c").alias("c"))


CHUNKS = "chunk bigint, line binary, hashes binary, shapes binary"


def chunked(texts: Iterator[pa.Array], top: pa.Array) -> Iterator[tuple[int, np.ndarray, pa.Array]]:
    """(texts, line, rare words) of chunks. A line has the rank of held words, len(top) + k
    for the k-th rare word of the chunk, and -1 for the end of a text (and the start of the chunk)."""
    def out() -> tuple[int, np.ndarray, pa.Array]:
        lens = np.concatenate(lengths)
        found = pa.concat_arrays(held).dictionary_encode()
        rank = pc.index_in(found.dictionary, value_set=top)
        rare = found.dictionary.filter(rank.is_null())
        number = pc.fill_null(rank, -1).to_numpy().copy()
        number[number < 0] = len(top) + np.arange(len(rare))
        line = np.full(lens.sum() + len(lens) + 1, -1, dtype=np.int32)
        line[np.arange(lens.sum()) + np.repeat(np.arange(len(lens)), lens) + 1] = number[found.indices.to_numpy()]
        return len(lens), line, rare

    held, lengths, size = [], [], 1
    for array in texts:
        ws, lens = split_words(array)
        while len(lens):
            ends = size + np.cumsum(lens + 1)
            stop = int(np.searchsorted(ends, CHUNK, side="right")) + 1      # the text that fills the chunk is its last
            taken = int(lens[:stop].sum())
            held.append(ws[:taken])
            lengths.append(lens[:stop])
            if stop > len(lens):
                size = int(ends[-1])
            else:
                yield out()
                held, lengths, size = [], [], 1
            ws, lens = ws[taken:], lens[stop:]
    if lengths:
        yield out()


def _packed(line: np.ndarray) -> bytes:
    """Integers by byte planes, compressed; their number first."""
    planes = np.ascontiguousarray(line.view(np.uint8).reshape(-1, 4).T)
    return len(line).to_bytes(8, "little") + pa.compress(planes.tobytes(), codec="zstd", asbytes=True)


def _line(packed: bytes) -> np.ndarray:
    n = int.from_bytes(packed[:8], "little")
    planes = np.frombuffer(pa.decompress(packed[8:], decompressed_size=4 * n, codec="zstd"), dtype=np.uint8)
    return np.ascontiguousarray(planes.reshape(4, n).T).view(np.int32).ravel()


def _columns(chunk: int, line: np.ndarray, rare: pa.Array) -> list[pa.Array]:
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, rare.to_pylist()), dtype=np.uint64, count=len(rare))
    return [pa.array([chunk], pa.int64()), *(pa.array([x], pa.binary()) for x in (_packed(line), hashes.tobytes(), shapes(rare).tobytes()))]


def training_chunks(texts: DataFrame, top: pa.Array) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk = TaskContext.get().partitionId() << 33
        for _, line, rare in chunked((b.column(0) for b in byte_slices(batches, 0, SLICE_BYTES)), top):
            yield pa.RecordBatch.from_arrays(_columns(chunk, line, rare), ["chunk", "line", "hashes", "shapes"])
            chunk += 1

    return materialise(texts.mapInArrow(run, CHUNKS), "word-lines")


def _records(batches: Iterator[pa.RecordBatch]) -> Iterator[list]:
    """The records of batches, one at a time."""
    for batch in batches:
        for i in range(batch.num_rows):
            yield [column[i].as_py() for column in batch.columns]


def _by_bucket(hashes: np.ndarray, buckets: int) -> Iterator[tuple[int, np.ndarray]]:
    """(bucket, places of its hashes)."""
    bucket = (hashes % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    ends = np.cumsum(np.bincount(bucket, minlength=buckets))
    for b, at in enumerate(np.split(order, ends[:-1])):
        if len(at):
            yield b, at


def with_classes(chunks: DataFrame, vocabulary: DataFrame | None, buckets: int) -> DataFrame:
    """Chunks with ``got``, the classes of their rare words a bucket (all by form without a vocabulary)."""
    got = "array<struct<bucket:int,classes:binary>>"
    if vocabulary is None:
        return chunks.withColumn("got", F.lit(None).cast(got))

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk, hashes in _records(batches):
            h = np.frombuffer(hashes, dtype=np.uint64)
            parts = [(b, h[at].tobytes()) for b, at in _by_bucket(h, buckets)]
            yield pa.RecordBatch.from_arrays([pa.array([b for b, _ in parts], pa.int32()), pa.array([chunk] * len(parts), pa.int64()),
                                              pa.array([x for _, x in parts], pa.binary())], ["bucket", "chunk", "hashes"])

    def answer(asked: pa.Table, known: pa.Table) -> pa.Table:
        h = np.frombuffer(b"".join(known["hashes"].to_pylist()), dtype=np.uint64)
        c = np.frombuffer(b"".join(known["classes"].to_pylist()), dtype=np.uint8)
        out = []
        for x in asked["hashes"].to_pylist():
            x = np.frombuffer(x, dtype=np.uint64)
            if len(h):
                at = np.minimum(np.searchsorted(h, x), len(h) - 1)
                out.append(np.where(h[at] == x, c[at], UNSEEN).astype(np.uint8).tobytes())
            else:
                out.append(np.full(len(x), UNSEEN, dtype=np.uint8).tobytes())
        return pa.table([asked["chunk"], asked["bucket"], pa.array(out, pa.binary())], ["chunk", "bucket", "classes"])

    sent = chunks.select("chunk", "hashes").mapInArrow(send, "bucket int, chunk bigint, hashes binary")
    replies = (sent.groupBy("bucket").cogroup(vocabulary.groupBy("bucket"))
               .applyInArrow(answer, "chunk bigint, bucket int, classes binary")
               .groupBy("chunk").agg(F.collect_list(F.struct("bucket", "classes")).alias("got")))
    return chunks.join(replies, "chunk", "left")


def _rare_classes(hashes: np.ndarray, shapes: np.ndarray, got: list | None, buckets: int) -> np.ndarray:
    out = shapes.copy()
    answers = {x["bucket"]: np.frombuffer(x["classes"], dtype=np.uint8) for x in got or []}
    for b, at in _by_bucket(hashes, buckets) if answers else ():
        out[at] = np.where(answers[b] == UNSEEN, out[at], answers[b])
    return out


def _arrays(line: bytes, hashes: bytes, shapes: bytes, got: list | None, buckets: int) -> tuple:
    h = np.frombuffer(hashes, dtype=np.uint64)
    return _line(line), h, _rare_classes(h, np.frombuffer(shapes, dtype=np.uint8), got, buckets)


def bigrams(chunks: DataFrame, held: np.ndarray, size: int, buckets: int, shift: int = 0) -> np.ndarray:
    """Counts of adjacent classes, ``size`` of them, the last being the end of a text.
    ``held``: class of each held word; rare words have theirs plus ``shift``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size * size, dtype=np.int64)
        for record in _records(batches):
            line, _, rare = _arrays(*record, buckets)
            x = np.concatenate([held, rare.astype(np.int64) + shift, [size - 1]])[line]
            codes, n = np.unique(x[:-1] * size + x[1:], return_counts=True)
            total[codes] += n
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], ["pair", "n"])

    sums = (chunks.select("line", "hashes", "shapes", "got").mapInArrow(run, "pair bigint, n bigint")
            .groupBy("pair").agg(F.sum("n").alias("n")))
    got = sums.toArrow()                                  # at most size^2 rows
    out = np.zeros(size * size)
    out[got["pair"].to_numpy()] = got["n"].to_numpy()
    return out.reshape(size, size)


def contexts(chunks: DataFrame, held: np.ndarray, core: int, buckets: int) -> DataFrame:
    """(bucket, hashes, now, slots): the contexts of words outside the core. Rare words: bucket >= 0,
    their hashes and classes, and word * SLOTS + slot of each token. Held words: bucket = -1 - block,
    (rank in the block) * SLOTS + slot and its count (in ``now``), summed over the task."""
    end = END_CLASS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(rows: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), *(pa.array([r[i].tobytes() for r in rows], pa.binary()) for i in (1, 2)),
                pa.array([_packed(np.diff(r[3], prepend=np.int32(0))) for r in rows], pa.binary())], ["bucket", "hashes", "now", "slots"])

        sums = np.zeros(len(held) * SLOTS, dtype=np.int32)
        for record in _records(batches):
            line, h, rare = _arrays(*record, buckets)
            x = np.concatenate([held, rare.astype(np.int64), [end]])[line]
            at = np.flatnonzero(line >= core)
            word, before, after = line[at].astype(np.int64), x[at - 1], x[at + 1] + end + 1
            own = word < len(held)
            for slot in (before, after):
                codes, n = np.unique(word[own] * SLOTS + slot[own], return_counts=True)
                sums[codes] += n.astype(np.int32)
            word, before, after = word[~own] - len(held), before[~own], after[~own]
            order = np.argsort(word, kind="stable")
            word, before, after = word[order], before[order], after[order]
            rows = []
            for b, places in _by_bucket(h, buckets):
                number = np.full(len(h), -1, dtype=np.int64)
                number[places] = np.arange(len(places))
                k = number[word]
                k, x1, x2 = k[k >= 0], before[k >= 0], after[k >= 0]
                rows.append((b, h[places], rare[places], np.concatenate([k * SLOTS + x1, k * SLOTS + x2]).astype(np.int32)))
            if rows:
                yield out(rows)
        rows, none = [], np.zeros(0, dtype=np.uint8)
        for block in range(-(-len(held) // BLOCK)):
            part = sums[block * BLOCK * SLOTS:(block + 1) * BLOCK * SLOTS]
            at = np.flatnonzero(part)
            if len(at):
                rows.append((-1 - block, none, np.frombuffer(_packed(part[at]), dtype=np.uint8), at.astype(np.int32)))
        if rows:
            yield out(rows)

    return chunks.select("line", "hashes", "shapes", "got").mapInArrow(
        run, "bucket int, hashes binary, now binary, slots binary")


def best_classes(codes: np.ndarray, v: np.ndarray, now: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Class of each word that raises the mutual information of ``n`` most; ``now``: their classes.
    ``codes``: word * SLOTS + slot, ascending, of ``v`` tokens each; each word has some. The gain is
    that of the exchange to first order (add-one counts), as all words move at once: the full gain
    would send them all to the same empty class."""
    out = now.astype(np.int64)
    near = np.concatenate([n[:, :END_CLASS], n[:END_CLASS].T])  # slot x class: the cell that a token falls into
    sums = np.repeat(np.stack([n.sum(axis=0), n.sum(axis=1)])[:, :END_CLASS], END_CLASS + 1, axis=0)
    token = np.log(near + 1) - np.log(sums + END_CLASS + 1)
    word, slot = codes // SLOTS, codes % SLOTS
    starts = np.append(np.searchsorted(word, np.arange(0, len(now), 2048)), len(codes))
    for first, i, j in zip(range(0, len(now), 2048), starts[:-1], starts[1:]):
        a = out[first:first + 2048]
        gain = np.add.reduceat(token[slot[i:j]] * v[i:j, None], np.searchsorted(word[i:j] - first, np.arange(len(a))), axis=0)
        b, k = gain.argmax(axis=1), np.arange(len(a))
        out[first:first + 2048] = np.where(gain[k, b] > gain[k, a] + 1e-9, b, a)
    return out


def assigned(seen: DataFrame, held: np.ndarray, core: int, n: np.ndarray) -> tuple[np.ndarray, DataFrame]:
    """(classes of held words, vocabulary of rare words (bucket, hashes ascending, classes))."""
    def ranks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for bucket, counts, slots in _records(batches):
            block = -1 - bucket
            total = sums.setdefault(block, np.zeros(BLOCK * SLOTS, dtype=np.int64))
            total[np.cumsum(_line(slots))] += _line(counts)
        for block, total in sums.items():
            codes = np.flatnonzero(total)
            some = np.unique(codes // SLOTS)              # core words have no contexts here
            dense = np.searchsorted(some, codes // SLOTS) * SLOTS + codes % SLOTS
            got = best_classes(dense, total[codes], held[block * BLOCK + some], n)
            yield pa.RecordBatch.from_arrays([pa.array(block * BLOCK + some, pa.int32()), pa.array(got, pa.int32())], ["rank", "class"])

    def bucket(key: tuple, table: pa.Table) -> pa.Table:
        parts = [np.frombuffer(x, dtype=np.uint64) for x in table["hashes"].to_pylist()]
        hashes, first, number = np.unique(np.concatenate(parts), return_index=True, return_inverse=True)
        now = np.frombuffer(b"".join(table["now"].to_pylist()), dtype=np.uint8)[first]
        codes, start = [], 0
        for x, slots in zip(parts, table["slots"].to_pylist()):
            k = np.cumsum(_line(slots), dtype=np.int64)
            codes.append(number[start + k // SLOTS] * SLOTS + k % SLOTS)
            start += len(x)
        codes, v = np.unique(np.concatenate(codes), return_counts=True)
        got = best_classes(codes, v, now, n).astype(np.uint8)
        return pa.table([pa.array([key[0].as_py()], pa.int32()), pa.array([hashes.tobytes()], pa.binary()),
                         pa.array([got.tobytes()], pa.binary())], ["bucket", "hashes", "classes"])

    out = held.copy()
    moved = (seen.where("bucket < 0").select("bucket", "now", "slots").repartition("bucket")
             .mapInArrow(ranks, "rank int, class int").toArrow())   # one row a held word
    out[moved["rank"].to_numpy()] = moved["class"].to_numpy()
    rare = (seen.where("bucket >= 0").groupBy("bucket")
            .applyInArrow(bucket, "bucket int, hashes binary, classes binary"))
    return out, materialise(rare, "vocabulary")


def information(n: np.ndarray) -> float:
    """Mutual information of adjacent classes, up to constants."""
    return float(_xlogx(n).sum() - _xlogx(n.sum(axis=0)).sum() - _xlogx(n.sum(axis=1)).sum())


def _xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1e-300))


def exchange(pairs: np.ndarray, core: int, classes: int = CLASSES, sweeps: int = SWEEPS) -> np.ndarray:
    """Class of each core word. ``pairs``: bigram counts, core words (most frequent first)
    in the first ``core`` rows; the others are classes of their own that never move."""
    rest = len(pairs) - core
    k = classes + rest
    own = np.concatenate([np.arange(core) % classes, classes + np.arange(rest)])
    member = np.zeros((len(pairs), k))
    member[np.arange(len(pairs)), own] = 1
    n = member.T @ pairs @ member                         # class bigrams
    # mutual information up to constants: sum xlogx(n_ij) - sum xlogx(row) - sum xlogx(column)
    for _ in range(sweeps):
        moved = 0
        for w in range(core):
            a = own[w]
            right, left, self_pair = pairs[w] @ member, pairs[:, w] @ member, pairs[w, w]
            right[a] -= self_pair
            left[a] -= self_pair
            n[a] -= right                                 # take the word out of its class
            n[:, a] -= left
            n[a, a] -= self_pair
            rows, cols = n.sum(axis=1), n.sum(axis=0)
            r, c = right.sum() + self_pair, left.sum() + self_pair
            base = n[:classes]
            gain = (_xlogx(base + right) - _xlogx(base)).sum(axis=1)
            base = n[:, :classes]
            gain += (_xlogx(base + left[:, None]) - _xlogx(base)).sum(axis=0)
            i = np.arange(classes)                        # the diagonal cell takes both and the self pair
            d = n[i, i]
            gain += _xlogx(d + right[:classes] + left[:classes] + self_pair) - _xlogx(d)
            gain -= _xlogx(d + right[:classes]) - _xlogx(d) + _xlogx(d + left[:classes]) - _xlogx(d)
            gain -= _xlogx(rows[:classes] + r) - _xlogx(rows[:classes]) + _xlogx(cols[:classes] + c) - _xlogx(cols[:classes])
            b = int(gain.argmax())
            if gain[b] <= gain[a] + 1e-9:
                b = a
            moved += b != a
            member[w, a], member[w, b] = 0, 1
            own[w] = b
            n[b] += right
            n[:, b] += left
            n[b, b] += self_pair
        if not moved:
            break
    return own[:core]


class Model:
    """What a task needs to score texts, bounded tables only, and the classes of rare words."""

    def __init__(self, top: pa.Array, classes: np.ndarray, logs: np.ndarray, step: np.ndarray, end: float,
                 v_total: int, n_total: int, vocabulary: DataFrame | None, buckets: int):
        self.top, self.classes, self.logs, self.step, self.end = top, classes, logs, step, end
        self.v_total, self.n_total, self.vocabulary, self.buckets = v_total, n_total, vocabulary, buckets


def learn(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[Model, DataFrame]:
    """(model, counts of all training words)."""
    train = docs.where(training_rows(docs, id_col)).select(F.col(text_col).alias("text"))
    counts = materialise(word_counts(train), "word-counts")
    ends = train.count()
    total = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    n_total, v_total = total[0] + ends, total[1] + (ends > 0)
    top = counts.orderBy(F.desc("c"), "word").limit(HELD).toArrow()
    top, top_c = pa.concat_arrays([pa.array([], pa.string()), *top["word"].cast(pa.string()).chunks]), top["c"].to_numpy()
    core = min(CORE, len(top))
    forms = shapes(top).astype(np.int64)
    buckets = 8 + n_total // BUCKET_TOKENS
    chunks = training_chunks(train, top)
    seeds = np.concatenate([np.arange(core), core + forms[core:] - CLASSES])
    own = exchange(bigrams(with_classes(chunks, None, buckets), seeds, core + SHAPES + 1, buckets, core - CLASSES), core)
    held, vocabulary = np.concatenate([own, forms[core:]]), None
    lines = with_classes(chunks, None, buckets)
    n = bigrams(lines, held, END_CLASS + 1, buckets)
    for left in reversed(range(WORD_SWEEPS if n_total else 0)):
        seen = materialise(contexts(lines, held, core, buckets), "word-contexts")
        moved, words_moved = assigned(seen, held, core, n)
        discard(seen, lines)
        lines = with_classes(chunks, words_moved, buckets)
        lines = materialise(lines, "word-lines") if left else lines
        after = bigrams(lines, moved, END_CLASS + 1, buckets)
        if information(after) <= information(n):
            discard(words_moved)
            break
        discard(vocabulary)
        held, vocabulary, n = moved, words_moved, after
    discard(lines, chunks)
    class_tokens = n.sum(axis=0)                          # each token is once the second of a pair
    kinds = np.bincount(held, minlength=END_CLASS + 1).astype(float)
    kinds[END_CLASS] = ends > 0
    kinds += rare_kinds(counts, vocabulary, top)
    # log10 P(class | before) less the emission's denominator
    step = np.log10((n + 1) / (n.sum(axis=1, keepdims=True) + END_CLASS + 1)) - np.log10(class_tokens + kinds + 1)[None]
    logs = np.log10(np.array(top_c, dtype=np.float64) + 1)
    return Model(top, held, logs, step, float(np.log10(ends + 1)), v_total, n_total, vocabulary, buckets), counts


def rare_kinds(counts: DataFrame, vocabulary: DataFrame | None, top: pa.Array) -> np.ndarray:
    """Number of rare training words of each class."""
    def by_form(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield tally(shapes(w.filter(pc.invert(pc.is_in(w, value_set=top)))) for w in (b.column(0).cast(pa.string()) for b in batches))

    def learnt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield tally(np.frombuffer(classes, dtype=np.uint8) for (classes,) in _records(batches))

    def tally(classes: Iterator[np.ndarray]) -> pa.RecordBatch:
        total = np.zeros(END_CLASS + 1, dtype=np.int64)
        for c in classes:
            total += np.bincount(c, minlength=END_CLASS + 1)
        at = np.flatnonzero(total)
        return pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at], pa.int64())], ["class", "v"])

    found = (counts.select("word").mapInArrow(by_form, "class int, v bigint") if vocabulary is None
             else vocabulary.select("classes").mapInArrow(learnt, "class int, v bigint"))
    out = np.zeros(END_CLASS + 1)
    for row in found.groupBy("class").agg(F.sum("v").alias("v")).collect():
        out[row["class"]] = row["v"]
    return out


def score(docs: DataFrame, model: Model, counts: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id_col, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    kind = docs.schema[id_col].dataType.simpleString()
    top, classes, logs, step, end, buckets = model.top, model.classes, model.logs, model.step, model.end, model.buckets
    names = ["n_tokens", "held_known", "held_logs"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, ids = TaskContext.get().partitionId() << 33, []

        def texts() -> Iterator[pa.Array]:
            for b in byte_slices(batches, 1, SLICE_BYTES):
                ids.append(b.column(0))
                yield b.column(1)

        for n, line, rare in chunked(texts(), top):
            own = (line >= 0) & (line < len(top))
            row = np.cumsum(line < 0)[:-1] - 1            # of the token behind
            second, own = line[1:], own[1:]
            tokens = np.bincount(row, minlength=n)
            known = np.bincount(row[own], minlength=n) + (end > 0)
            sums = np.bincount(row[own], weights=logs[second[own]], minlength=n) + end
            other = second >= len(top)
            code, times = np.unique(row[other] * (len(rare) + 1) + second[other] - len(top), return_counts=True)
            at, k = code // (len(rare) + 1), code % (len(rare) + 1)
            rares = pa.StructArray.from_arrays([pa.array(at, pa.int32()), rare.take(pa.array(k)),
                                                pa.array(times, pa.int64())], ["at", "word", "n"])
            waiting = pa.concat_arrays(ids)
            taken, ids[:] = waiting[:n], [waiting[n:]]
            base = [pa.array(tokens, pa.int64()), pa.array(known, pa.int64()), pa.array(sums, pa.float64())]
            lists = [pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x) for x in (taken, *base, rares)]
            yield pa.RecordBatch.from_arrays(_columns(chunk, line, rare) + lists,
                                             ["chunk", "line", "hashes", "shapes", "ids", *names, "rare"])
            chunk += 1

    schema = (f"{CHUNKS}, ids array<{kind}>, n_tokens array<bigint>, held_known array<bigint>, held_logs array<double>,"
              " rare array<struct<at:int,word:string,n:bigint>>")
    chunks = materialise(docs.select(id_col, text_col).mapInArrow(run, schema), "scored")

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk, *record in _records(batches):
            line, _, rare = _arrays(*record, buckets)
            x = np.concatenate([classes, rare.astype(np.int64), [END_CLASS]])[line]
            steps = np.bincount(np.cumsum(line < 0)[:-1] - 1, weights=step[x[:-1], x[1:]])
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(steps), chunk), pa.int64()), pa.array(np.arange(len(steps)), pa.int32()),
                                              pa.array(steps, pa.float64())], ["chunk", "at", "steps"])

    steps = (with_classes(chunks.select("chunk", "line", "hashes", "shapes"), model.vocabulary, buckets)
             .mapInArrow(walk, "chunk bigint, at int, steps double"))
    rows = chunks.select("chunk", F.posexplode(F.arrays_zip("ids", *names)).alias("at", "r")).select("chunk", "at", "r.*")
    met = (chunks.select("chunk", F.explode("rare").alias("r")).select("chunk", "r.*").join(counts, "word")
           .groupBy("chunk", "at").agg(F.sum("n").alias("rare_known"), F.sum(F.col("n") * F.log10(F.col("c") + 1)).alias("rare_logs")))
    logs_of = F.col("held_logs") + F.coalesce("rare_logs", F.lit(0.0))
    floor = float(np.log10(model.n_total + model.v_total + 1)) if model.n_total else 0.0
    return rows.withColumnRenamed("ids", id_col).join(steps, ["chunk", "at"]).join(met, ["chunk", "at"], "left").select(
        id_col, F.coalesce(F.crc32(F.col(id_col).cast("string")) % 7 == 2, F.lit(False)).alias("held_out"), "n_tokens",
        (F.col("held_known") + F.coalesce("rare_known", F.lit(0))).alias("n_known"),
        F.lit(model.n_total).cast("long").alias("train_tokens"),
        (logs_of - F.col("n_tokens") * F.lit(floor)).alias("base_score"), (logs_of + F.col("steps")).alias("score"))
