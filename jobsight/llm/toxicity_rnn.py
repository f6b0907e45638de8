"""Toxicity by a bidirectional gated recurrent network with attention pooling.

A word's input is the sum of a word embedding (words of the training sample)
and the mean embedding of its character n-grams (hashed, so inflected and
unseen forms still have one). Windows of ``SPAN`` words, every one overlapping
the next by half, run through a gated recurrent unit in both directions;
attention weighs the words of a window, and a text's score is that of its most
toxic window. The network is trained in numpy on a sample of labelled rows of
at most ``PER_CLASS`` rows a label, chosen by a hash of the id, with texts of at
most ``TRAIN_CHARS`` characters; a toxic text teaches through the window that
looks most toxic so far, a clean one through its most suspicious window and two
others. All windows of all texts are scored.

Edge cases: null and empty texts (and texts without words) score 0; without
labels of both classes every text scores 0; repeated rows are scored row by
row; rows without id can be scored but not learnt from.
"""

from __future__ import annotations

from typing import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobsight.llm.common import mix, slices

SPAN, STRIDE = 32, 16
EMBED, HIDDEN = 12, 8
NGRAM_BITS = 15
GRAMS = (3, 4, 5)
PER_CLASS, TRAIN_CHARS = 3000, 20_000
#: Windows a step, and least number of steps (small samples are gone through more often).
BATCH, STEPS = 128, 400
THRESHOLD = 0.3
#: Bytes of words whose n-grams are embedded at once.
CHUNK_BYTES = 1 << 16
#: Words whose inputs a task remembers.
MEMO_LIMIT = 150_000
_NOT_WORD = bytes(32 if c < 0x30 or 0x3A <= c <= 0x60 or 0x7B <= c <= 0x7F else c for c in range(256))


def text_words(text: str | None) -> list[bytes]:
    return text.lower().encode().translate(_NOT_WORD).split() if text else []


def char_ngrams(ws: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed n-gram slots of all words, concatenated, and how many each word has
    (words are framed by a space, so every word has some)."""
    framed = np.frombuffer(b"".join(b" %b " % w for w in ws), dtype=np.uint8).astype(np.uint64)
    length = np.array([len(w) + 2 for w in ws])
    owner = np.repeat(np.arange(len(ws)), length)
    left = np.repeat(np.cumsum(length), length) - np.arange(len(framed))       # bytes up to the word's end
    slot, who = [], []
    code = framed.copy()
    for n in range(2, max(GRAMS) + 1):
        code = (code[:-1] << np.uint64(8)) | framed[n - 1:]
        if n in GRAMS:
            ok = left[:len(code)] >= n
            slot.append((mix(code[ok] + np.uint64(n)) >> np.uint64(64 - NGRAM_BITS)).astype(np.int32))
            who.append(owner[:len(code)][ok].astype(np.int32))
    slot, who = np.concatenate(slot), np.concatenate(who)
    order = np.argsort(who, kind="stable")
    return slot[order], np.bincount(who, minlength=len(ws))


def in_chunks(ws: list[bytes]) -> Iterator[list[bytes]]:
    """Words in runs whose n-grams fit small arrays (very long words alone)."""
    start = size = 0
    for i, w in enumerate(ws):
        if i > start and size + len(w) > CHUNK_BYTES:
            yield ws[start:i]
            start, size = i, 0
        size += len(w) + 2
    if start < len(ws):
        yield ws[start:]


def window_starts(n: int) -> np.ndarray:
    """Starts of the windows over ``n`` words; the last one ends with the text."""
    if n <= SPAN:
        return np.zeros(min(n, 1), dtype=np.int64)
    return np.append(np.arange(0, n - SPAN, STRIDE), n - SPAN)


def window_matrix(rows: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Word rows of each window; 0 pads texts shorter than one window."""
    if len(rows) < SPAN:
        rows = np.concatenate([rows, np.zeros(SPAN - len(rows), dtype=rows.dtype)])
    return rows[starts[:, None] + np.arange(SPAN)]


def scatter(at: np.ndarray, values: np.ndarray, rows: int) -> np.ndarray:
    """Sums of ``values`` rows by their place."""
    return np.stack([np.bincount(at, weights=values[:, d], minlength=rows) for d in range(values.shape[1])], axis=1).astype(values.dtype)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


class Network:
    """Parameters, forward pass and gradients. ``p`` maps names to arrays."""

    def __init__(self, vocab: dict[bytes, int], known: np.ndarray, seed: int = 7):
        r = np.random.default_rng(seed)
        def init(*shape, scale=None):
            return r.normal(0, scale or shape[0] ** -0.5, shape).astype(np.float32)
        self.vocab, self.known = vocab, known
        self.p = {"word": init(len(vocab) + 1, EMBED, scale=0.05), "gram": init(1 << NGRAM_BITS, EMBED, scale=0.3),
                  "out": init(2 * HIDDEN), "att": init(2 * HIDDEN), "bias": np.array([-2.0], np.float32)}
        for d in "fb":
            self.p |= {f"x{d}": init(EMBED, 3 * HIDDEN), f"u{d}": init(HIDDEN, 3 * HIDDEN), f"c{d}": np.zeros(3 * HIDDEN, np.float32)}
        self.p["word"][0] = 0

    def features(self, ws: list[bytes]) -> tuple:
        """(vocabulary rows, n-gram slots, slots a word, weight of a slot)."""
        slot, count = char_ngrams(ws)
        seen = self.known[slot]
        ends = np.cumsum(count)
        n = np.add.reduceat(seen, ends - count)
        return np.array([self.vocab.get(w, 0) for w in ws]), slot, count, seen / np.repeat(np.maximum(n, 1), count).astype(seen.dtype)

    def embed(self, f: tuple) -> np.ndarray:
        row, slot, count, weight = f
        ends = np.cumsum(count)
        return self.p["word"][row] + np.add.reduceat(self.p["gram"][slot] * weight[:, None], ends - count)

    def inputs(self, e: np.ndarray) -> list[np.ndarray]:
        return [e @ self.p[f"x{d}"] + self.p[f"c{d}"] for d in "fb"]

    def word_inputs(self, ws: list[bytes]) -> list[np.ndarray]:
        """Inputs of both directions for any number of words, in bounded memory; row 0 is padding."""
        out = [np.empty((len(ws) + 1, 3 * HIDDEN), np.float32) for _ in "fb"]
        for x, pad in zip(out, self.inputs(np.zeros((1, EMBED), np.float32))):
            x[:1] = pad
        end = 1
        for c in in_chunks(ws):
            for x, part in zip(out, self.inputs(self.embed(self.features(c)))):
                x[end:end + len(c)] = part
            end += len(c)
        return out

    def steps(self, d: str, x: np.ndarray, at: np.ndarray, keep: list | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Attention logits and output terms [windows, SPAN] of one direction; ``x`` are
        the inputs of the words, ``at`` the windows' word rows."""
        u, half = self.p["u" + d], slice(0, HIDDEN) if d == "f" else slice(HIDDEN, None)
        read = np.stack([self.p["att"][half], self.p["out"][half]], axis=1)
        h = np.zeros((len(at), HIDDEN), np.float32)
        seen = np.empty((len(at), SPAN, 2), np.float32)
        for t in range(SPAN) if d == "f" else range(SPAN - 1, -1, -1):
            g, hu = x[at[:, t]], h @ u
            zr = _sigmoid(g[:, :2 * HIDDEN] + hu[:, :2 * HIDDEN])
            z, r = zr[:, :HIDDEN], zr[:, HIDDEN:]
            n = np.tanh(g[:, 2 * HIDDEN:] + r * hu[:, 2 * HIDDEN:])
            if keep is not None:
                keep.append((t, h, z, r, n, hu[:, 2 * HIDDEN:]))
            h = n + z * (h - n)
            seen[:, t] = h @ read
        return seen[..., 0], seen[..., 1]

    def pool(self, att: np.ndarray, out: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(window logits, attention weights); padding gets no attention."""
        att = np.where(at > 0, att, -1e9)
        a = np.exp(att - att.max(axis=1, keepdims=True))
        a /= a.sum(axis=1, keepdims=True)
        return (a * out).sum(axis=1) + self.p["bias"][0], a

    def logits(self, x: list[np.ndarray], at: np.ndarray, batch: int = 2048) -> np.ndarray:
        done = []
        for i in range(0, len(at), batch):
            part = at[i:i + batch]
            (ef, of), (eb, ob) = (self.steps(d, x[k], part) for k, d in enumerate("fb"))
            done.append(self.pool(ef + eb, of + ob, part)[0])
        return np.concatenate(done) if done else np.empty(0, np.float32)

    def gradients(self, f: tuple, at: np.ndarray, y: np.ndarray, weight: np.ndarray) -> dict:
        """Gradients of the weighted logistic loss; row 0 of the words is padding."""
        e = np.concatenate([np.zeros((1, EMBED), np.float32), self.embed(f)])
        x, kept = self.inputs(e), {"f": [], "b": []}
        (ef, of), (eb, ob) = (self.steps(d, x[k], at, kept[d]) for k, d in enumerate("fb"))
        logit, a = self.pool(ef + eb, of + ob, at)
        out = of + ob
        dl = (_sigmoid(logit) - y) * weight
        g = {"bias": np.array([dl.sum()], np.float32)}
        d_out = a * dl[:, None]                                               # [windows, SPAN]
        d_att = a * (out - (a * out).sum(axis=1, keepdims=True)) * dl[:, None]
        g["att"], g["out"] = np.zeros_like(self.p["att"]), np.zeros_like(self.p["out"])
        de = np.zeros_like(e)
        for k, d in enumerate("fb"):
            half = slice(0, HIDDEN) if d == "f" else slice(HIDDEN, None)
            u, flows = self.p["u" + d], []
            g["u" + d] = np.zeros_like(u)
            dh = np.zeros((len(at), HIDDEN), np.float32)
            for t, h, z, r, n, hn in reversed(kept[d]):
                after = n + z * (h - n)
                dh = dh + d_att[:, t:t + 1] * self.p["att"][half] + d_out[:, t:t + 1] * self.p["out"][half]
                g["att"][half] += after.T @ d_att[:, t]
                g["out"][half] += after.T @ d_out[:, t]
                dn = (1 - z) * dh * (1 - n * n)
                dz = (h - n) * dh * z * (1 - z)
                dr = dn * hn * r * (1 - r)
                flow = np.concatenate([dz, dr, dn * r], axis=1)
                g["u" + d] += h.T @ flow
                flows.append((at[:, t], np.concatenate([dz, dr, dn], axis=1)))
                dh = z * dh + flow @ u.T
            dx = scatter(*map(np.concatenate, zip(*flows)), len(e))
            g["x" + d], g["c" + d] = e.T @ dx, dx.sum(axis=0)
            de += dx @ self.p["x" + d].T
        row, slot, count, share = f
        de = de[1:]
        g["word"] = scatter(row, de, len(self.p["word"]))
        g["word"][0] = 0
        g["gram"] = scatter(slot, np.repeat(de, count, axis=0) * share[:, None], 1 << NGRAM_BITS)
        return g


def train(texts: list[str], toxic: list[int], steps: int = STEPS, seed: int = 7) -> Network | None:
    """A network fitted to labelled texts; None without both labels."""
    # each distinct word is kept once; a text is the numbers of its words
    number: dict[bytes, int] = {}
    rows, y = [], []
    for text, label in zip(texts, toxic):
        ws = text_words(text)
        if ws:
            rows.append(np.array([number.setdefault(w, len(number)) for w in ws], dtype=np.int32))
            y.append(label)
    y = np.array(y, np.float32)
    if not len(y) or y.min() == y.max():
        return None
    words = sorted(number)
    place = np.empty(len(words), dtype=np.int32)
    place[[number[w] for w in words]] = np.arange(len(words))
    rows = [place[r] for r in rows]
    del number, place
    # words and n-grams of at least three texts have a parameter of their own
    seen = np.zeros((2, len(words)))
    slot, count = (np.concatenate(x) for x in zip(*map(char_ngrams, in_chunks(words))))
    ends = np.cumsum(count)
    grams_seen = np.zeros((2, 1 << NGRAM_BITS))
    for r, label in zip(rows, y.astype(int)):
        own = np.unique(r)
        seen[label, own] += 1
        at = np.concatenate([slot[ends[i] - count[i]:ends[i]] for i in own])
        grams_seen[label, np.unique(at)] += 1
    vocab = {w: i + 1 for i, w in enumerate(w for k, w in enumerate(words) if seen[:, k].sum() >= 3)}
    net = Network(vocab, (grams_seen.sum(axis=0) >= 3).astype(np.float32), seed)
    rate = np.array([(y == 0).sum(), (y == 1).sum()])[:, None]
    odds = (lambda s: (np.log((s[1] + .2) / (rate[1] + .4)) - np.log((s[0] + .2) / (rate[0] + .4))).astype(np.float32))
    suspect = np.maximum(odds(seen), np.maximum.reduceat(odds(grams_seen)[slot], ends - count)) * (seen.sum(axis=0) >= 2)
    del slot, count, ends, grams_seen
    wins = [window_matrix(r + 1, window_starts(len(r))) for r in rows]
    best = [int(np.argmax(np.append(0, suspect)[w].max(axis=1))) for w in wins]
    rng = np.random.default_rng(seed)
    m = {k: np.zeros_like(v) for k, v in net.p.items()}
    v = {k: np.zeros_like(x) for k, x in net.p.items()}
    step = epoch = 0
    while step < steps:
        epoch += 1
        if epoch > 2:                                     # windows as the network sees them now
            x = net.word_inputs(words)
            best = []
            for i in range(0, len(wins), 64):
                part = wins[i:i + 64]
                flat = net.logits(x, np.concatenate(part))
                best += [int(f.argmax()) for f in np.split(flat, np.cumsum([len(w) for w in part])[:-1])]
            del x
        at, target = [], []
        for w, b, label in zip(wins, best, y):
            take = [b] if label else {b, *rng.integers(0, len(w), 2).tolist()}
            for i in take:
                at.append(w[i])
                target.append(label)
        at, target = np.array(at), np.array(target, np.float32)
        order = rng.permutation(len(at))
        for i in range(0, len(order), BATCH):
            part, want = at[order[i:i + BATCH]], target[order[i:i + BATCH]]
            used, inverse = np.unique(np.append(0, part.ravel()), return_inverse=True)
            f = net.features([words[k - 1] for k in used[1:]])
            g = net.gradients(f, inverse[1:].reshape(part.shape), want, np.full(len(want), 1 / len(want), np.float32))
            step += 1
            for k in net.p:
                d = g[k] + (1e-4 * net.p[k] if k in ("word", "gram") else 0)
                m[k] = .9 * m[k] + .1 * d
                v[k] = .999 * v[k] + .001 * d * d
                net.p[k] -= (.02 * (m[k] / (1 - .9 ** step)) / (np.sqrt(v[k] / (1 - .999 ** step)) + 1e-6)).astype(np.float32)
    return net


class Scorer:
    """Scores of texts; a word's inputs are computed once and remembered."""

    def __init__(self, net: Network):
        self.net = net
        self._clear()

    def _clear(self) -> None:
        self.rows: dict[bytes, int] = {}
        self.x = [np.repeat(x, 1024, axis=0) for x in self.net.inputs(np.zeros((1, EMBED), np.float32))]

    def __call__(self, texts: list[str | None]) -> list[float]:
        docs = [text_words(t) for t in texts]
        if len(self.rows) > MEMO_LIMIT:
            self._clear()
        new = list(set().union(*docs).difference(self.rows))
        if new:
            base = len(self.rows) + 1
            self.rows.update(zip(new, range(base, base + len(new))))
            for k, x in enumerate(x[1:] for x in self.net.word_inputs(new)):
                if base + len(new) > len(self.x[k]):
                    self.x[k] = np.concatenate([self.x[k], np.empty((base + len(new), x.shape[1]), np.float32)])
                self.x[k][base:base + len(new)] = x
        at, edge = [], [0]
        for ws in docs:
            starts = window_starts(len(ws))
            if len(starts):
                r = np.fromiter(map(self.rows.__getitem__, ws), dtype=np.int32, count=len(ws))
                at.append(window_matrix(r, starts))
            edge.append(edge[-1] + len(starts))
        if not at:
            return [0.0] * len(docs)
        p = _sigmoid(self.net.logits(self.x, np.concatenate(at)).astype(np.float64))
        return [float(p[a:b].max()) if b > a else 0.0 for a, b in zip(edge, edge[1:])]


def training_sample(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> DataFrame:
    """text, toxic of at most ``per_class`` labelled documents a label, never of held-out rows."""
    known = (labels.where("doc_id IS NOT NULL AND toxic IN (0, 1) AND crc32(cast(doc_id AS STRING)) % 4 <> 2")
             .groupBy("doc_id").agg(F.max("toxic").alias("toxic")))
    picked = [known.where(F.col("toxic") == t).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class) for t in (0, 1)]
    ids = picked[0].unionByName(picked[1]).withColumnRenamed("doc_id", "labelled")
    # at most 2 * per_class ids
    return (docs.join(F.broadcast(ids), F.col("doc_id") == F.col("labelled"))
            .where(F.length("text") <= TRAIN_CHARS).select("doc_id", "text", ids["toxic"]))


def fit(docs: DataFrame, labels: DataFrame) -> Network | None:
    """A network trained by one task on the bounded sample; only its parameters reach the driver."""
    docs, labels = docs.select("doc_id", "text"), labels.select("doc_id", "toxic")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sample = list(batches)
        net = train((t.as_py() for b in sample for t in b.column(0)), [y for b in sample for y in b.column(1).to_pylist()])
        if net is not None:
            arrays = {"known": net.known} | net.p
            yield pa.RecordBatch.from_arrays([pa.array([list(net.vocab)], pa.list_(pa.binary())), pa.array([list(arrays)]),
                                              pa.array([[x.tobytes() for x in arrays.values()]], pa.list_(pa.binary()))], ["words", "names", "arrays"])

    rows = training_sample(docs, labels).select("text", F.col("toxic").cast("int").alias("toxic")).distinct()     # a copy teaches nothing new
    got = (rows.repartition(1).sortWithinPartitions("text", "toxic")
           .mapInArrow(run, "words array<binary>, names array<string>, arrays array<binary>").first())
    if got is None:
        return None
    arrays = {k: np.frombuffer(x, np.float32).copy() for k, x in zip(got["names"], got["arrays"])}
    net = Network({bytes(w): i + 1 for i, w in enumerate(got["words"])}, arrays.pop("known"))
    net.p = {k: x.reshape(net.p[k].shape) for k, x in arrays.items()}
    return net


def _scored(rows: DataFrame, net: Network | None, field: int | None = None) -> DataFrame:
    """(row, score) of rows (row, text), or of rows (row) whose text is that field of the row."""
    kind = rows.schema["row"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(net) if net is not None else None
        for batch in slices(batches, 128):
            texts = (batch.column(1) if field is None else batch.column(0).field(field)).to_pylist()
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(scorer(texts) if scorer else [0.0] * len(texts), pa.float64())], ["row", "score"])

    return rows.mapInArrow(run, f"row {kind}, score double")


def score_rows(docs: DataFrame, net: Network | None, text_col: str = "text") -> DataFrame:
    """(row, score): whole rows of ``docs`` as one struct, so no column name can clash. The
    text goes to the task's Python once, inside its row."""
    return _scored(docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")), net, docs.columns.index(text_col))


def score(docs: DataFrame, net: Network | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, held_out, score, predicted per row of docs."""
    return _scored(docs.select(F.col(id_col).alias("row"), F.col(text_col).alias("text")), net).select(
        F.col("row").alias(id_col), F.coalesce(F.crc32(F.col("row").cast("string")) % 4 == 2, F.lit(False)).alias("held_out"),
        "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
