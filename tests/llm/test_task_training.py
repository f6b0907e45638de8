"""The toxicity network is trained in a task, on words kept once."""

import os
import tracemalloc

import numpy as np

from jobsight.llm import toxicity_rnn as T

TEXTS = ["bad words %d" % i for i in range(8)] + ["fine day %d é\U0001f600" % i for i in range(8)]


def tables(spark):
    rows = [(4 * i + k, t) for i, t in enumerate(TEXTS) for k in range(4)] + [(None, "no id"), (900, None)]
    labels = [(4 * i + k, int(i < 8)) for i in range(16) for k in range(4)] + [(900, 1), (None, 1)]
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")


def test_network_of_a_task_is_the_plain_one(spark, monkeypatch):
    monkeypatch.setattr(T.train, "__defaults__", (20, 7))  # few steps
    docs, labels = tables(spark)
    rows = sorted(set(map(tuple, T.training_sample(docs, labels).select("text", "toxic").collect())))
    want, got = T.train(*zip(*rows)), T.fit(docs, labels)
    assert got.vocab == want.vocab and (got.known == want.known).all() and got.p.keys() == want.p.keys()
    assert all((got.p[k] == want.p[k]).all() and got.p[k].dtype == want.p[k].dtype for k in want.p)


def test_training_does_not_run_on_the_driver(spark, monkeypatch):
    network, slots = T.Network, 1 << T.NGRAM_BITS

    def train(texts, toxic):
        net = network({}, np.ones(slots, np.float32))
        net.p["bias"][0] = os.getpid()
        return net

    monkeypatch.setattr(T, "train", train)
    assert int(T.fit(*tables(spark)).p["bias"][0]) != os.getpid()


def test_training_keeps_each_word_once():
    texts = [" ".join(f"word{(i * j) % 997}" for j in range(6000)) for i in range(1, 121)]
    tracemalloc.start()
    T.train(texts, [i % 2 for i in range(120)], steps=0)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 25e6, peak                               # 16 MB; with every word of every text 38 MB
