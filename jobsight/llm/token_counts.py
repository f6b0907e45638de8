"""Token counts by rank-synchronous array merging.

Pre-tokens of a batch are held as one ragged numpy array of symbols. In every
round each pre-token applies its own lowest-rank pair, all pre-tokens at once;
what survives when no pair is left is counted. The vocabulary file (byte-level
BPE with an end-of-word suffix) is a parameter; its normaliser is NFC, white
space runs to one space, lower case.

Edge cases: a null or empty text has 0 bytes and 0 tokens. Special strings of
the file (``<|endoftext|>``) inside a text count as one token each, as the
library does by default. Repeated rows are counted row by row.
"""

from __future__ import annotations

import json
import unicodedata
from typing import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from jobsight.llm.common import slices

_NONE = np.int32(2**31 - 1)
#: Chunks remembered per task with their counts.
MEMO_LIMIT = 300_000


def byte_alphabet() -> dict[int, str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    shown = {b: chr(b) for b in plain}
    for i, b in enumerate(x for x in range(256) if x not in shown):
        shown[b] = chr(256 + i)
    return shown


class RankMerges:
    """Merge table of one vocabulary file, as arrays."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab, suffix = model["vocab"], model.get("end_of_word_suffix") or ""
        size = max(vocab.values()) + 1
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        left = np.array([vocab[a] for a, _ in pairs], dtype=np.int64)
        right = np.array([vocab[b] for _, b in pairs], dtype=np.int64)
        product = np.array([vocab[a + b] for a, b in pairs], dtype=np.int64)
        keys = left * size + right
        order = np.argsort(keys, kind="stable")
        self.size, self.product = size, product
        self.keys, self.rank_of = keys[order], order.astype(np.int32)
        # a merge whose product takes part in an earlier-ranked merge must not be
        # applied to several places of a pre-token in one round
        first_use = np.full(size, _NONE, dtype=np.int64)
        np.minimum.at(first_use, left, np.arange(len(pairs)))
        np.minimum.at(first_use, right, np.arange(len(pairs)))
        self.one_at_a_time = first_use[product] < np.arange(len(pairs))
        shown = byte_alphabet()
        self.inner = np.array([vocab[shown[b]] for b in range(256)], dtype=np.int64)
        self.last = np.array([vocab[shown[b] + suffix] for b in range(256)], dtype=np.int64)
        self.special = regex.compile("|".join(regex.escape(t["content"]) for t in spec["added_tokens"]) or r"(?!)")
        self.split = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])

    def ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a * self.size + b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.rank_of[at], _NONE)

    def count(self, pieces: list[bytes]) -> np.ndarray:
        """Symbols left of each (non-empty) pre-token after all merges."""
        lengths = np.array([len(p) for p in pieces], dtype=np.int64)
        out = lengths.copy()
        raw = np.frombuffer(b"".join(pieces), dtype=np.uint8)
        ends = np.cumsum(lengths)
        sym = self.inner[raw]
        sym[ends - 1] = self.last[raw[ends - 1]]
        ids = np.arange(len(pieces))                      # the pre-tokens still merging
        rank = np.full(len(sym), _NONE, dtype=np.int32)
        rank[:-1] = self.ranks(sym[:-1], sym[1:])
        rank[ends - 1] = _NONE                            # no pair across pre-tokens
        while len(ids):
            starts = ends - lengths
            best = np.minimum.reduceat(rank, starts)
            live = best < _NONE
            if not live.all():                            # finished ones leave the arrays
                out[ids[~live]] = lengths[~live]
                keep = np.repeat(live, lengths)
                sym, rank = sym[keep], rank[keep]
                ids, lengths, best = ids[live], lengths[live], best[live]
                if not len(ids):
                    break
                ends = np.cumsum(lengths)
                starts = ends - lengths
            hit = np.flatnonzero(rank == np.repeat(best, lengths))
            owner = np.searchsorted(ends, hit, side="right")
            # within a run of overlapping hits, every second one applies
            run = np.r_[True, np.diff(hit) != 1] | np.r_[True, np.diff(owner) != 0]
            first = np.flatnonzero(run)
            place = np.arange(len(hit)) - np.repeat(first, np.diff(np.r_[first, len(hit)]))
            take = place % 2 == 0
            slow = self.one_at_a_time[best[owner]]
            take &= ~slow | np.r_[True, np.diff(owner) != 0]
            hit, owner = hit[take], owner[take]
            sym[hit] = self.product[rank[hit]]
            dead = np.zeros(len(sym), dtype=bool)
            dead[hit + 1] = True
            hit = hit - (np.cumsum(dead)[hit])
            sym, rank = sym[~dead], rank[~dead]
            lengths = lengths - np.bincount(owner, minlength=len(lengths))
            ends = np.cumsum(lengths)
            # only pairs beside a merged symbol changed
            rank[ends - 1] = _NONE
            at_end = np.zeros(len(sym), dtype=bool)
            at_end[ends - 1] = True
            near = np.unique(np.r_[hit, hit[hit > 0] - 1])
            near = near[~at_end[near]]
            rank[near] = self.ranks(sym[near], sym[near + 1])
        return out

    def pre_tokens(self, chunk: str) -> list[bytes]:
        text = unicodedata.normalize("NFC", chunk).replace("Σ", "σ").lower()
        return [m.encode() for m in self.split.findall(text)]


class TextCounter:
    """Counts of whole texts. A text is cut at single spaces, where no
    pre-token can span, and counts of recurring chunks are remembered."""

    def __init__(self, path: str):
        self.merges, self.memo = RankMerges(path), {}

    def __call__(self, texts: list[str | None]) -> list[int]:
        docs, extra = [], []
        for text in texts:
            parts = self.merges.special.split(text) if text and "<|" in text else [text or ""]
            docs.append([c for p in parts for c in p.split(" ")])
            extra.append(len(parts) - 1)
        if len(self.memo) > MEMO_LIMIT:
            self.memo.clear()
        fresh = self._count(list(set().union(*docs).difference(self.memo)))
        self.memo.update(fresh)
        out = [n + sum(map(self.memo.__getitem__, chunks)) for n, chunks in zip(extra, docs)]
        for chunk in fresh:
            if len(chunk) > 64:                           # long chunks hardly recur
                del self.memo[chunk]
        return out

    def _count(self, chunks: list[str]) -> dict[str, int]:
        if not chunks:
            return {}
        found = [self.merges.pre_tokens(c) for c in chunks]
        pieces = list({p for ps in found for p in ps})
        size = dict(zip(pieces, self.merges.count(pieces).tolist())) if pieces else {}
        return {c: sum(map(size.__getitem__, ps)) for c, ps in zip(chunks, found)}


def token_counts(docs: DataFrame, vocab_path: str, limit: int = 2048,
                 id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, n_bytes, n_tokens, over_limit per row of ``docs``."""
    id_type = docs.schema[id_col].dataType
    schema = T.StructType([T.StructField(id_col, id_type), T.StructField("n_bytes", T.LongType()),
                           T.StructField("n_tokens", T.LongType()), T.StructField("over_limit", T.BooleanType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = TextCounter(vocab_path)
        for batch in slices(batches):
            texts = batch.column(1).to_pylist()
            n = count(texts)
            yield pa.RecordBatch.from_arrays([
                batch.column(0),
                pa.array([len(t.encode()) if t else 0 for t in texts], pa.int64()),
                pa.array(n, pa.int64()),
                pa.array([x > limit for x in n], pa.bool_())], schema.names)

    return docs.select(id_col, text_col).mapInArrow(run, schema)
