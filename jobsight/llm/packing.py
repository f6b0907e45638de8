"""Bounded-space online packing of token sequences.

Every partition keeps a fixed number of open windows. A document's full
windows leave at once; its remainder goes into the open window it fits best.
When none fits and no further window may be opened, the fullest one leaves:
if its gap is more than ``slack`` tokens it is topped up with the head of the
piece at hand, as documents may be cut anywhere. At the end of a partition the
open windows are merged into full ones and at most one partly filled window;
these last windows meet in groups of ``FAN_IN`` partitions and are packed
again, so padding does not grow with the number of partitions.

Edge cases: a null or empty text is one token (the terminating id 0); repeated
rows are packed row by row; an empty table gives no pieces.
"""

from __future__ import annotations

import base64
import re
import zlib
from bisect import bisect_left, insort
from typing import Iterator

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from jobsight.llm.common import materialise, slices

#: Partitions whose last windows are packed together.
FAN_IN = 64
_MEMO_LIMIT = 300_000
_WS_AFTER_SPACE = re.compile(r" \s")


class ChunkIds(dict):
    """Little-endian uint32 ids of `` chunk`` strings, remembered while recurring."""

    def __init__(self, encode):
        self.encode = encode

    def __missing__(self, chunk: str) -> bytes:
        import numpy as np

        ids = np.array(self.encode(" " + chunk), dtype="<u4").tobytes()
        if len(chunk) <= 64:
            if len(self) >= _MEMO_LIMIT:
                self.clear()
            self[chunk] = ids
        return ids


class ByteBpe:
    """Ids as ``tokenizers`` gives them for ``json_path`` (no special tokens added).

    ``rank_path`` holds the same vocabulary as ranks for ``tiktoken``, which
    encodes single words several times faster; the two agree id for id. A text
    is cut before single spaces, where no pre-token can span. Texts holding
    special strings or white space beside a space go to ``tokenizers`` whole."""

    def __init__(self, json_path: str, rank_path: str | None):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(json_path)
        self.special = [t.content for t in self.whole.get_added_tokens_decoder().values()]
        if rank_path:
            import tiktoken
            from public_tokenizers import PATTERN

            with open(rank_path, "rb") as f:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            encode = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        else:
            def encode(s):
                return self.whole.encode(s, add_special_tokens=False).ids
        self.encode, self.memo = encode, ChunkIds(encode)

    def __call__(self, text: str | None) -> bytes:
        import numpy as np

        if not text:
            return b""
        if any(s in text for s in self.special) or _WS_AFTER_SPACE.search(text):
            return np.array(self.whole.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()
        head, *rest = text.split(" ")
        first = np.array(self.encode(head), dtype="<u4").tobytes() if head else b""
        return first + b"".join(map(self.memo.__getitem__, rest))


class Packer:
    """Open windows of one partition. A piece is (key, start, ids bytes, doc tokens)."""

    def __init__(self, window: int, max_open: int, slack: int):
        self.window, self.max_open, self.slack = window, max_open, slack
        self.free: list[tuple[int, int]] = []             # (gap, window number), ascending
        self.open: dict[int, list] = {}
        self.opened = 0

    def _new(self) -> int:
        self.opened += 1
        self.open[self.opened] = []
        return self.opened

    def _leave(self, number: int) -> list:
        return self.open.pop(number)

    def add(self, piece) -> Iterator[list]:
        """Windows that leave when this piece comes in."""
        key, start, ids, total = piece
        size = self.window * 4
        while len(ids) >= size:
            yield [(key, start, ids[:size], total)]
            start, ids = start + self.window, ids[size:]
        while ids:
            n = len(ids) // 4
            at = bisect_left(self.free, (n, 0))
            if at < len(self.free):                       # best fit
                gap, number = self.free.pop(at)
                self.open[number].append((key, start, ids, total))
                if gap == n:
                    yield self._leave(number)
                else:
                    insort(self.free, (gap - n, number))
                return
            if len(self.free) < self.max_open:
                number = self._new()
                self.open[number].append((key, start, ids, total))
                insort(self.free, (self.window - n, number))
                return
            gap, number = self.free.pop(0)                # the fullest leaves
            if gap > self.slack:
                self.open[number].append((key, start, ids[:gap * 4], total))
                start, ids = start + gap, ids[gap * 4:]
            yield self._leave(number)

    def close(self) -> Iterator[tuple[list, bool]]:
        """Leftover windows merged; True marks the one that is not full."""
        rest = [p for _, number in self.free for p in self.open[number]]
        self.free, self.open = [], {}
        current, used = [], 0
        for key, start, ids, total in rest:
            while ids:
                n = min(len(ids) // 4, self.window - used)
                current.append((key, start, ids[:n * 4], total))
                start, ids, used = start + n, ids[n * 4:], used + n
                if used == self.window:
                    yield current, False
                    current, used = [], 0
        if current:
            yield current, True


def _piece_schema(id_col: str, id_type: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(id_col, id_type)] + [T.StructField(c, T.LongType()) for c in (
        "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")])


def _best_fit_decreasing(window: int, schema: T.StructType):
    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        free, out = [], []
        rows = rows.sort_values(["length", "sequence_id", "offset"], ascending=[False, True, True], kind="stable")
        opened = 0
        base = (1 << 62) + (int(key[0]) << 32)            # never an id given within a partition
        ids, offsets = [], []
        for n in rows["length"]:
            at = bisect_left(free, (n, 0))
            if at < len(free):
                gap, number = free.pop(at)
            else:
                gap, number, opened = window, opened, opened + 1
            ids.append(base + number)
            offsets.append(window - gap)
            insort(free, (gap - n, number))
        return rows.assign(sequence_id=ids, offset=offsets)[schema.names]
    return run


def pack_documents(docs: DataFrame, json_path: str, rank_path: str | None = None, window: int = 1024,
                   max_open: int = 64, slack: int = 4, end_id: int = 0,
                   id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces: id_col, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    schema = _piece_schema(id_col, docs.schema[id_col].dataType)
    first = T.StructType(schema.fields + [T.StructField("last_of", T.LongType())])
    end = end_id.to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        encode, packer, sent = ByteBpe(json_path, rank_path), Packer(window, max_open, slack), 0

        def rows(pieces: list, partial: bool = False) -> list[tuple]:
            nonlocal sent
            offset, out = 0, []
            for key, start, ids, total in pieces:
                n = len(ids) // 4
                out.append((key, start, n, zlib.crc32(ids), total, (part << 32) + sent, offset, part if partial else None))
                offset += n
            sent += 1
            return out

        def batch_of(found: list[tuple]) -> pa.RecordBatch:
            cols = list(zip(*found)) if found else [[]] * len(first.names)
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], first.names)

        types = None
        for batch in slices(batches):
            types = types or [batch.schema.field(0).type] + [pa.int64()] * 7
            found = []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids = encode(text) + end
                for left in packer.add((key, 0, ids, len(ids) // 4)):
                    found += rows(left)
            yield batch_of(found)
        if types:
            yield batch_of([r for pieces, partial in packer.close() for r in rows(pieces, partial)])

    pieces = materialise(docs.select(id_col, text_col).mapInArrow(run, first), "packed")
    whole = pieces.where("last_of IS NULL").drop("last_of")
    merged = (pieces.where("last_of IS NOT NULL")
              .withColumn("meet", F.expr(f"last_of DIV {FAN_IN}")).drop("last_of")
              .groupBy("meet").applyInPandas(_best_fit_decreasing(window, schema), schema))
    return whole.unionByName(merged)
