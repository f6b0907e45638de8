"""Language model and toxicity: against plain code and on held-out rows."""

import math
import zlib
from collections import Counter

import numpy as np
from helpers import awkward_docs, empty_docs, words_of

from jobsight.llm import brown_lm as B
from jobsight.llm import toxicity_rnn as X

SF = "/root/testdata/sf0.01"


def held(key, n):
    return key is not None and zlib.crc32(str(key).encode()) % n == 2


def plain_base(rows):
    c = Counter()
    for r in rows:
        if not held(r["doc_id"], 7):
            c.update(words_of(r["text"]))
            c[None] += 1
    c = +c
    n, v = sum(c.values()), len(c)
    out = []
    for r in rows:
        t = words_of(r["text"]) + [None]
        base = sum(math.log10((c[w] + 1) / (n + v + 1)) for w in t)
        out.append((-1 if r["doc_id"] is None else r["doc_id"], held(r["doc_id"], 7), len(t), sum(c[w] > 0 for w in t), n, round(base, 6)))
    return sorted(out)


def got_base(df):
    return sorted((-1 if r["doc_id"] is None else r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"],
                   round(r["base_score"], 6)) for r in df.collect())


def test_lm_on_given_documents(spark, monkeypatch):
    monkeypatch.setattr(B, "HELD", 500)                    # most words go through the join
    monkeypatch.setattr(B, "CORE", 200)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    scored = B.score(docs, *B.learn(docs)).persist()
    assert got_base(scored) == plain_base(docs.collect())
    rows = [r for r in scored.collect() if r["held_out"]]
    assert sum(r["score"] for r in rows) > sum(r["base_score"] for r in rows)


def test_lm_of_awkward_rows(spark):
    docs = awkward_docs(spark)
    model, counts = B.learn(docs)
    assert got_base(B.score(docs, model, counts)) == plain_base(docs.collect())
    assert np.isfinite(model.step).all()
    empty = empty_docs(spark)
    assert B.score(empty, *B.learn(empty)).count() == 0


def test_lm_learns_classes_of_all_training_words(spark, monkeypatch):
    monkeypatch.setattr(B, "CORE", 8)
    monkeypatch.setattr(B, "HELD", 60)                     # most words are neither clustered first nor held
    r = np.random.default_rng(2)
    a, b = ([f"{p}{chr(97 + i // 26)}{chr(97 + i % 26)}{q}" for i in range(150)] for p, q in (("qu", "r"), ("st", "v")))
    rows = [(i, " ".join(w for _ in range(30) for w in (a[int(150 * r.random() ** 2)], b[int(150 * r.random() ** 2)]))) for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert len({B.shape(w.encode()) for w in a + b}) == 1   # their forms tell nothing
    got = [x for x in B.score(docs, *B.learn(docs)).collect() if x["held_out"]]
    tokens = sum(x["n_tokens"] for x in got)
    assert tokens > 1000 and sum(x["score"] - x["base_score"] for x in got) > 0.25 * tokens  # of log10(2) at best


def test_exchange_raises_mutual_information():
    r = np.random.default_rng(4)
    group = np.arange(60) % 3                              # words of group g are followed by group g + 1
    n = np.zeros((61, 61))
    for _ in range(20000):
        a = r.integers(60)
        b = r.choice(np.flatnonzero(group == (group[a] + 1) % 3))
        n[a, b] += 1
    n[60, 0] = n[59, 60] = 1

    def information(own):
        m = np.zeros((61, 8))
        m[np.arange(60), own] = 1
        m[60, 7] = 1
        t = m.T @ n @ m
        return B._xlogx(t).sum() - B._xlogx(t.sum(0)).sum() - B._xlogx(t.sum(1)).sum()

    own = B.exchange(n, 60, classes=3)
    start = np.random.default_rng(0).integers(0, 3, 60)
    assert information(own) > information(start)
    assert len({(g, c) for g, c in zip(group.tolist(), own.tolist())}) == 3  # the groups are found


def test_gradients_match_differences():
    r = np.random.default_rng(0)
    words = [b"ab", b"cde", b"fgh", b"ijkl"]
    net = X.Network({w: i + 1 for i, w in enumerate(words)}, np.ones(1 << X.NGRAM_BITS, np.float32))
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    f = net.features(words)
    at = np.array([[1 + int(r.integers(4)) for _ in range(X.SPAN)], [1, 2] + [0] * (X.SPAN - 2)])
    y, w = np.array([1.0, 0.0]), np.array([0.5, 0.5])

    def loss():
        e = np.concatenate([np.zeros((1, X.EMBED)), net.embed(f)])
        logit = net.logits(net.inputs(e), at).astype(float)
        p = 1 / (1 + np.exp(-logit))
        return -(w * (y * np.log(p) + (1 - y) * np.log(1 - p))).sum()

    g = net.gradients(f, at, y, w)
    for k in net.p:
        big = np.argsort(-np.abs(g[k]).ravel())[:3]
        for i in big:
            flat = net.p[k].reshape(-1)
            old, h = flat[i], 1e-3
            flat[i] = old + h
            up = loss()
            flat[i] = old - h
            down = loss()
            flat[i] = old
            assert abs((up - down) / (2 * h) - g[k].ravel()[i]) < 2e-3 + 0.02 * abs(g[k].ravel()[i]), k


def test_all_windows_overlap():
    for n in (0, 1, 31, 32, 33, 48, 49, 200):
        starts = X.window_starts(n)
        assert len(starts) == 0 if n == 0 else starts[0] == 0
        covered = {i for s in starts for i in range(s, min(n, s + X.SPAN))}
        assert covered == set(range(n))
        assert all(b - a <= X.STRIDE for a, b in zip(starts, starts[1:]))


def test_toxicity_held_out(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    docs = docs.join(labels, "doc_id", "left_semi")
    seen = X.training_sample(docs, labels, 400)
    assert not any(held(r["doc_id"], 4) for r in seen.select("doc_id").collect())
    net = X.train(*zip(*[(r["text"], r["toxic"]) for r in seen.orderBy("doc_id").collect()]))
    rows = X.score(docs, net).join(labels, "doc_id").where("held_out").collect()
    s, y = np.array([r["score"] for r in rows]), np.array([r["toxic"] for r in rows])
    auc = (s[y == 1][:, None] > s[y == 0][None]).mean()
    assert auc > 0.9 and all(r["predicted"] == (r["score"] >= 0.3) for r in rows)


def test_toxicity_of_awkward_rows(spark):
    docs = awkward_docs(spark)
    labels = spark.createDataFrame([(1, 0), (5, 1), (8, 0), (None, 1), (7, 1), (9, None)], "doc_id bigint, toxic int")
    rows = X.score(docs, X.fit(docs, labels)).collect()
    assert len(rows) == 12 and all(0 <= r["score"] <= 1 for r in rows)
    assert all(r["score"] == 0 for r in rows if r["doc_id"] in (2, 3, 4))
    assert X.fit(docs, labels.where("toxic = 0")) is None
    assert {r["score"] for r in X.score(docs, None).collect()} == {0.0}
    assert X.score(empty_docs(spark), None).count() == 0
    whole = X.score_rows(docs, None).select("row.*")
    assert whole.columns == docs.columns and whole.count() == 12
