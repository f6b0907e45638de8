"""Token ids as one compressed wavelet matrix file a shard.

Documents are sorted by id over all tasks (equal ids in the order of the input),
encoded, ended by ``end_id`` and written as shards of whole documents. A shard
is one file: the bit-planes of a wavelet matrix over its ids, highest bit first,
each cut into blocks of 2^16 bits that are compressed on their own, and a
directory of the blocks (place in the file, ones before them) with the
documents' ids and token counts. Rank looks up a block's ones before it and
counts inside one block; select searches the directory and looks inside one
block. So a reader gets the token at a position, the number of a token's
occurrences and their places from a few blocks, without decoding the file.

Layout: magic, blocks by plane, directory (compressed JSON, arrays, documents as
an Arrow stream), its length (8 bytes), magic. Files are written through
``pyarrow.fs`` under the name of the attempt that writes them; the manifest table
names the files of finished tasks only, so a lost or repeated task leaves no
trace in the results.

Edge cases: a null or empty text is the end id alone; repeated rows and ids are
documents of their own; null ids come first. An empty table gives an empty
manifest and no file. Other columns are ignored.
"""

from __future__ import annotations

import io
import json
import re
import uuid
from collections import OrderedDict
from typing import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from jobsight.llm.common import byte_slices, materialise

MAGIC = b"WMATRIX1"
BLOCK = 1 << 16
SHARD_TOKENS = 1 << 21
SLICE_BYTES = 4 << 20
_WS_AFTER_SPACE = re.compile(r" \s")
MANIFEST = "shard long, path string, n_docs long, n_tokens long"


def _store(path: str) -> tuple[fs.FileSystem, str]:
    if path.startswith("file:/") and not path.startswith("file://"):
        path = "file://" + path[len("file:"):]
    return fs.FileSystem.from_uri(path)


def special_strings(json_path: str) -> tuple[list[str], int]:
    """The strings that the library turns into ids of their own, and the vocabulary's size."""
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(json_path)
    return [t.content for t in whole.get_added_tokens_decoder().values()], whole.get_vocab_size()


def _flat(found: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    counts = np.fromiter(map(len, found), dtype=np.int64, count=len(found))
    return np.fromiter((i for ids in found for i in ids), dtype=np.uint32, count=int(counts.sum())), counts


class TextIds:
    """Ids of whole texts, slice by slice. A text is cut before single spaces, where no
    pre-token can span; the distinct chunks of a slice are encoded in one call, whose
    ids part where a token begins with a space, and all ids of the slice are gathered. Texts holding special strings or white space
    beside a space go to ``tokenizers`` whole, loaded when the first one comes."""

    def __init__(self, json_path: str, rank_path: str | None, end_id: int, special: list[str]):
        self.json_path, self.end_id, self.special, self.library = json_path, end_id, special, None
        self.spaced = None
        if rank_path:
            import base64

            import tiktoken
            from public_tokenizers import PATTERN

            with open(rank_path, "rb") as f:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            self.encode = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
            self.spaced = np.zeros(max(ranks.values()) + 1, dtype=bool)
            self.spaced[[i for t, i in ranks.items() if t.startswith(b" ")]] = True
        else:
            self.encode = self.whole

    def whole(self, text: str) -> list[int]:
        if self.library is None:
            from tokenizers import Tokenizer

            self.library = Tokenizer.from_file(self.json_path)
        return self.library.encode(text, add_special_tokens=False).ids

    def _chunks(self, chunks: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all (non-empty) chunks, each behind a space, and how many each has."""
        if self.spaced is not None and len(chunks):
            ids = np.array(self.encode(" " + " ".join(chunks.to_numpy(zero_copy_only=False))), dtype=np.uint32)
            begins = np.flatnonzero(self.spaced[ids])
            if len(begins) == len(chunks):
                return ids, np.diff(np.append(begins, len(ids)))
        return _flat([self.encode(" " + c) for c in chunks.to_pylist()])

    def _plain(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        parts = pc.split_pattern(pa.array(texts, pa.large_string()), " ")
        offsets = parts.offsets.to_numpy()
        coded = parts.flatten().dictionary_encode()
        chunks, index = coded.dictionary, coded.indices.to_numpy()
        full = pc.not_equal(chunks, "").to_numpy(zero_copy_only=False)
        ids, counts = self._chunks(chunks.filter(pa.array(full)))
        # the pool: chunks, a single space, the texts' first chunks (no space before them), the end id
        heads, head_counts = _flat([self.encode(t.partition(" ")[0]) for t in texts])
        space = np.array(self.encode(" "), dtype=np.uint32)
        pool = np.concatenate([ids, space, heads, np.array([self.end_id], dtype=np.uint32)])
        sizes = np.concatenate([counts, [len(space)], head_counts, [1]])
        starts = np.cumsum(sizes) - sizes
        slot = np.where(full, np.cumsum(full) - 1, len(counts))
        place = slot[index]
        place[offsets[:-1]] = len(counts) + 1 + np.arange(len(texts))
        place = np.insert(place, offsets[1:], len(sizes) - 1)
        lengths = sizes[place]
        before = np.cumsum(lengths)
        ends = before[offsets[1:] + np.arange(len(texts))]
        shift = np.repeat((starts[place] - (before - lengths)).astype(np.int32), lengths)
        return pool[np.arange(before[-1], dtype=np.int32) + shift], np.diff(ends, prepend=0)

    def __call__(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and the number of each document's (its end id included)."""
        texts = [t or "" for t in texts]
        odd = [any(s in t for s in self.special) or _WS_AFTER_SPACE.search(t) is not None for t in texts]
        ids, counts = self._plain([t for t, o in zip(texts, odd) if not o]) if not all(odd) else (None, [])
        if not any(odd):
            return ids, counts
        own, at, out, n = iter(counts), 0, [], []
        for text, whole in zip(texts, odd):
            if whole:
                out.append(np.array(self.whole(text) + [self.end_id], dtype=np.uint32))
            else:
                size = int(next(own))
                out.append(ids[at:at + size])
                at += size
            n.append(len(out[-1]))
        return np.concatenate(out), np.array(n, dtype=np.int64)


def planes_of(ids: np.ndarray, width: int) -> Iterator[tuple[int, np.ndarray]]:
    """(zeros, bits) of every plane: each sorts the ids stably by one bit, zeros first."""
    a = ids.astype(np.uint16 if width <= 16 else np.uint32)
    for bit in range(width - 1, -1, -1):
        b = (a & a.dtype.type(1 << bit)) != 0
        low = a[~b]
        yield len(low), b
        a = np.concatenate([low, a[b]])


def encode_shard(ids: np.ndarray, docs: pa.RecordBatch, width: int) -> bytes:
    """The file of one shard. ``docs``: id and n_tokens of its documents, in order."""
    out = io.BytesIO()
    out.write(MAGIC)
    zeros, places, ones = [], [out.tell()], []
    for low, b in planes_of(ids, width):
        zeros.append(low)
        packed = np.packbits(b, bitorder="little")
        per_block = np.add.reduceat(np.bitwise_count(packed), np.arange(0, len(packed), BLOCK // 8), dtype=np.int64)
        ones.append(np.cumsum(np.r_[0, per_block]))
        for at in range(0, len(packed), BLOCK // 8):
            out.write(pa.compress(packed[at:at + BLOCK // 8].tobytes(), codec="zstd", asbytes=True))
            places.append(out.tell())
    sink = io.BytesIO()
    with pa.ipc.new_stream(sink, docs.schema) as writer:
        writer.write_batch(docs)
    arrays = [np.array(places, dtype="<i8").tobytes(), np.concatenate(ones).astype("<i8").tobytes(), sink.getvalue()]
    head = json.dumps({"n": len(ids), "width": width, "zeros": zeros, "sizes": [len(x) for x in arrays]}).encode()
    plain = len(head).to_bytes(8, "little") + head + b"".join(arrays)
    tail = len(plain).to_bytes(8, "little") + pa.compress(plain, codec="zstd", asbytes=True)
    out.write(tail + len(tail).to_bytes(8, "little") + MAGIC)
    return out.getvalue()


class WaveletFile:
    """Access, rank, count, select and occurrences over one shard file (any seekable file object)."""

    KEEP = 256                                            # decompressed blocks (8 KiB each)

    def __init__(self, source):
        self.source, self.cache = source, OrderedDict()
        source.seek(0, 2)
        end = source.tell()
        foot = self._read(end - 16, 16)
        if foot[8:] != MAGIC:
            raise ValueError("not a wavelet matrix file")
        size = int.from_bytes(foot[:8], "little")
        tail = self._read(end - 16 - size, size)
        plain = pa.decompress(tail[8:], int.from_bytes(tail[:8], "little"), codec="zstd", asbytes=True)
        at = 8 + int.from_bytes(plain[:8], "little")
        head = json.loads(plain[8:at])
        self.n, self.width, self.zeros = head["n"], head["width"], head["zeros"]
        self.blocks = -(-self.n // BLOCK)
        places, ones, docs = head["sizes"]
        self.places = np.frombuffer(plain, "<i8", places // 8, at)
        self.ones = np.frombuffer(plain, "<i8", ones // 8, at + places).reshape(self.width, self.blocks + 1)
        self.docs = pa.ipc.open_stream(plain[at + places + ones:]).read_all().combine_chunks()

    def _read(self, at: int, size: int) -> bytes:
        self.source.seek(at)
        return bytes(self.source.read(size))

    def _bits(self, level: int, block: int) -> np.ndarray:
        key = level * self.blocks + block
        if key not in self.cache:
            n = min(BLOCK, self.n - block * BLOCK)
            raw = self._read(self.places[key], int(self.places[key + 1] - self.places[key]))
            packed = np.frombuffer(pa.decompress(raw, -(-n // 8), codec="zstd", asbytes=True), dtype=np.uint8)
            self.cache[key] = np.unpackbits(packed, count=n, bitorder="little")
            if len(self.cache) > self.KEEP:
                self.cache.popitem(last=False)
        return self.cache[key]

    def rank1(self, level: int, places: np.ndarray) -> np.ndarray:
        """Ones before each place (0..n) of a plane."""
        places = np.asarray(places, dtype=np.int64)
        block = np.minimum(places // BLOCK, max(self.blocks - 1, 0))
        out = np.zeros(len(places), dtype=np.int64)
        for b in np.unique(block).tolist() if self.n else []:
            of = block == b
            before = np.r_[0, np.cumsum(self._bits(level, b), dtype=np.int64)]
            out[of] = self.ones[level, b] + before[places[of] - b * BLOCK]
        return out

    def select(self, level: int, bit: int, order: np.ndarray) -> np.ndarray:
        """Places of the ones (or zeros) with these numbers (from 0) in a plane."""
        order = np.asarray(order, dtype=np.int64)
        upto = self.ones[level] if bit else np.minimum(np.arange(self.blocks + 1) * BLOCK, self.n) - self.ones[level]
        block = np.searchsorted(upto, order, side="right") - 1
        out = np.empty(len(order), dtype=np.int64)
        for b in np.unique(block).tolist():
            of = block == b
            out[of] = b * BLOCK + np.flatnonzero(self._bits(level, b) == bit)[order[of] - upto[b]]
        return out

    def access(self, places: np.ndarray) -> np.ndarray:
        """Ids at these places."""
        places = np.array(places, dtype=np.int64)
        if len(places) and not (0 <= places.min() and places.max() < self.n):
            raise IndexError("place outside the shard")
        value = np.zeros(len(places), dtype=np.int64)
        for level, zeros in enumerate(self.zeros):
            before = self.rank1(level, places)
            bit = self.rank1(level, places + 1) - before
            places = np.where(bit == 1, zeros + before, places - before)
            value = value << 1 | bit
        return value

    def _span(self, token: int, start: int, stop: int) -> tuple[int, int]:
        """Where the occurrences of ``token`` in [start, stop) stand below the last plane."""
        lo, hi = start, stop
        if not 0 <= token < 1 << self.width:
            return 0, 0
        for level, zeros in enumerate(self.zeros):
            if lo >= hi:
                return 0, 0
            a, b = self.rank1(level, np.array([lo, hi])).tolist()
            lo, hi = (zeros + a, zeros + b) if token >> (self.width - 1 - level) & 1 else (lo - a, hi - b)
        return lo, hi

    def count(self, token: int, start: int = 0, stop: int | None = None) -> int:
        lo, hi = self._span(token, start, self.n if stop is None else stop)
        return hi - lo

    def occurrences(self, token: int, start: int = 0, stop: int | None = None) -> np.ndarray:
        """Places of ``token``, ascending: its span, carried up through all planes by select."""
        lo, hi = self._span(token, start, self.n if stop is None else stop)
        at = np.arange(lo, hi, dtype=np.int64)
        for level in range(self.width - 1, -1, -1):
            if token >> (self.width - 1 - level) & 1:
                at = self.select(level, 1, at - self.zeros[level])
            else:
                at = self.select(level, 0, at)
        return at

    def decode(self) -> np.ndarray:
        """All ids, plane by plane from the lowest bit."""
        kind = np.uint16 if self.width <= 16 else np.uint32
        a = np.zeros(self.n, dtype=kind)
        for level in range(self.width - 1, -1, -1):
            first, last = level * self.blocks, (level + 1) * self.blocks
            raw = self._read(self.places[first], int(self.places[last] - self.places[first]))
            edges = (self.places[first:last + 1] - self.places[first]).tolist()
            packed = b"".join(
                pa.decompress(raw[x:y], -(-min(BLOCK, self.n - k * BLOCK) // 8), codec="zstd", asbytes=True)
                for k, (x, y) in enumerate(zip(edges, edges[1:])))
            b = np.unpackbits(np.frombuffer(packed, dtype=np.uint8), count=self.n, bitorder="little").view(bool)
            above = np.empty_like(a)
            above[~b] = a[:self.zeros[level]]
            above[b] = a[self.zeros[level]:] | kind(1 << (self.width - 1 - level))
            a = above
        return a.astype(np.uint32)


def write_shards(docs: DataFrame, folder: str, json_path: str, rank_path: str | None = None, end_id: int = 0,
                 shard_tokens: int = SHARD_TOKENS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Writes the shard files under ``folder`` (a place all executors share); the manifest:
    shard (ascending in document order), path, n_docs, n_tokens."""
    _store(folder)[0].create_dir(_store(folder)[1], recursive=True)
    special, size = special_strings(json_path)
    width = max(1, (max(size, end_id + 1) - 1).bit_length())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        encode = TextIds(json_path, rank_path, end_id, special)
        held, keys, counts, size, sent = [], [], [], 0, 0

        def flush() -> pa.RecordBatch:
            nonlocal size, sent
            key = pa.chunked_array(keys).combine_chunks()
            entry = pa.RecordBatch.from_arrays([key, pa.array(np.concatenate(counts), pa.int64())], ["id", "n_tokens"])
            path = f"{folder}/{part:06d}-{sent:06d}-{uuid.uuid4().hex}.wm"
            store, place = _store(path)
            with store.open_output_stream(place) as out:
                out.write(encode_shard(np.concatenate(held), entry, width))
            row = pa.RecordBatch.from_arrays([pa.array([(part << 24) + sent]), pa.array([path]),
                                              pa.array([entry.num_rows]), pa.array([size])],
                                             ["shard", "path", "n_docs", "n_tokens"])
            sent, size = sent + 1, 0
            for x in (held, keys, counts):
                x.clear()
            return row

        for batch in byte_slices(batches, 1, SLICE_BYTES):
            ids, n = encode(batch.column(1).to_pylist())
            ends, at, first = np.cumsum(n), 0, 0
            while first < len(n):                         # whole documents until the shard is full
                last = max(int(np.searchsorted(ends, at + shard_tokens - size, side="right")), first + (not size))
                if last > first:
                    held.append(ids[at:ends[last - 1]])
                    keys.append(batch.column(0).slice(first, last - first))
                    counts.append(n[first:last])
                    size, at, first = size + int(ends[last - 1]) - at, int(ends[last - 1]), last
                if first < len(n):
                    yield flush()
        if size:
            yield flush()

    rows = docs.select(id_col, text_col).withColumn("__row", F.monotonically_increasing_id())
    ordered = rows.orderBy(F.col(id_col).asc_nulls_first(), "__row").select(id_col, text_col)
    return materialise(ordered.mapInArrow(run, MANIFEST), "manifest")


def with_starts(manifest: DataFrame) -> DataFrame:
    """The manifest with ``start``: ids of all shards before. Sums in two levels, so
    that no task sorts more than the shards of 1,024 writing tasks."""
    m = manifest.withColumn("__far", F.expr("shard DIV (1 << 34)"))
    far = m.groupBy("__far").agg(F.sum("n_tokens").alias("__n"))
    far = far.select("__far", (F.sum("__n").over(Window.orderBy("__far")) - F.col("__n")).alias("__before"))
    near = F.sum("n_tokens").over(Window.partitionBy("__far").orderBy("shard")) - F.col("n_tokens")
    return m.join(far, "__far").withColumn("start", F.col("__before") + near).drop("__far", "__before")


def _over_files(manifest: DataFrame, schema: T.StructType | str, of) -> DataFrame:
    """``of(file, row)``'s record batches for every shard; the shards are dealt evenly over tasks."""
    shards = manifest.count()
    tasks = max(1, min(shards, 8 * max(25, manifest.sparkSession.sparkContext.defaultParallelism)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                store, place = _store(row["path"])
                with store.open_input_file(place) as source:
                    yield from of(WaveletFile(source), row)

    return manifest.repartitionByRange(tasks, "shard").mapInArrow(run, schema)


def read_documents(manifest: DataFrame, id_field: T.StructField, derive: tuple | None = None) -> DataFrame:
    """From the files: id, start (ids of all documents before), n_tokens, and ``ids``
    (binary, little-endian uint32) or ``derive`` = (name, Spark type, function of these
    bytes), worked out where the file is read."""
    name, kind, of_ids = derive or ("ids", T.BinaryType(), bytes)
    schema = T.StructType([id_field, T.StructField("start", T.LongType()), T.StructField("n_tokens", T.LongType()),
                           T.StructField(name, kind)])

    def of(file: WaveletFile, row: dict) -> Iterator[pa.RecordBatch]:
        raw = memoryview(file.decode().astype("<u4").tobytes())
        keys, n = file.docs.column("id").combine_chunks(), file.docs.column("n_tokens").to_numpy()
        ends = np.cumsum(n)
        first = 0
        while first < len(n):                             # batches of about 1 MB of ids
            stop = max(first + 1, int(np.searchsorted(ends, ends[first] + (1 << 18))))
            got = [of_ids(raw[4 * (e - m):4 * e]) for e, m in zip(ends[first:stop].tolist(), n[first:stop].tolist())]
            yield pa.RecordBatch.from_arrays([
                keys.slice(first, stop - first), pa.array(row["start"] + ends[first:stop] - n[first:stop]),
                pa.array(n[first:stop]), pa.array(got, to_arrow_type(kind))], schema.names)
            first = stop

    return _over_files(with_starts(manifest), schema, of)


def count_tokens(manifest: DataFrame, tokens: list[int]) -> DataFrame:
    """token, n: occurrences in all shards, by rank alone."""
    def of(file: WaveletFile, row: dict) -> Iterator[pa.RecordBatch]:
        yield pa.RecordBatch.from_arrays([pa.array(tokens, pa.int64()),
                                          pa.array([file.count(t) for t in tokens], pa.int64())], ["token", "n"])

    found = _over_files(manifest, "token long, n long", of)
    return found.groupBy("token").agg(F.sum("n").alias("n"))


def find_tokens(manifest: DataFrame, tokens: list[int], id_field: T.StructField) -> DataFrame:
    """token, position (among all ids), id, offset (within its document) of every occurrence."""
    schema = T.StructType([T.StructField("token", T.LongType()), T.StructField("position", T.LongType()), id_field,
                           T.StructField("offset", T.LongType())])

    def of(file: WaveletFile, row: dict) -> Iterator[pa.RecordBatch]:
        n = file.docs.column("n_tokens").to_numpy()
        ends = np.cumsum(n)
        for token in tokens:
            at = file.occurrences(token)
            doc = np.searchsorted(ends, at, side="right")
            yield pa.RecordBatch.from_arrays([
                pa.array(np.full(len(at), token)), pa.array(row["start"] + at),
                file.docs.column("id").combine_chunks().take(pa.array(doc)), pa.array(at - (ends - n)[doc])], schema.names)

    return _over_files(with_starts(manifest), schema, of)


def tokens_at(manifest: DataFrame, positions: list[int]) -> DataFrame:
    """position, token for the given positions among all ids; positions beyond the end give no row."""
    wanted = np.unique(np.array(positions, dtype=np.int64))

    def of(file: WaveletFile, row: dict) -> Iterator[pa.RecordBatch]:
        own = wanted[(wanted >= row["start"]) & (wanted < row["start"] + file.n)]
        yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(file.access(own - row["start"]))], ["position", "token"])

    return _over_files(with_starts(manifest), "position long, token long", of)
