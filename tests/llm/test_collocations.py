import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from helpers import ascii_lower, awkward_docs, empty_docs
from hypothesis import given, settings
from hypothesis import strategies as st

from jobsight.llm import collocations as C


def plain(rows, least=10, share=50, top=2000):
    f = defaultdict(Counter)
    for lang, text in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", ascii_lower(text)):
            w = re.findall(r"[^\x20\x09]+", piece)
            for k in (1, 2, 3):
                f["und" if lang is None else lang].update(tuple(w[i:i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, c in f.items():
        n = sum(v for p, v in c.items() if len(p) == 1)
        if not n:
            continue
        cand = {p: a for p, a in c.items() if len(p) > 1 and a >= least}
        found = []
        for p, a in cand.items():
            if len(p) == 2 and any(100 * b >= share * a for q, b in cand.items() if len(q) == 3 and p in (q[:2], q[1:])):
                continue
            score, k = min((1000000 * a * a // (c[p[:k]] * c[p[k:]]), k) for k in range(1, len(p)))
            found.append((-score, -a, " ".join(p).encode(), c[p[:k]], c[p[k:]]))
        for rank, (score, a, p, l, r) in enumerate(sorted(found)[:top], 1):
            out.append((lang, rank, p.decode(), -a, l, r, n, -score))
    return sorted(out)


def many_rows(seed, n=400):
    r = random.Random(seed)
    words = ["the", "The", "of", "a", "ß", "zeta", "über", "x y", "q", "r2", "new", "york", "city"] + ["w%d" % i for i in range(30)]
    weights = [30, 5, 20, 20, 3, 3, 3, 3, 8, 8, 1, 1, 1] + [1] * 30
    rows = []
    for _ in range(n):
        t = []
        for _ in range(r.randrange(60)):
            t.append("new york city" if r.random() < .03 else r.choices(words, weights)[0])
            t.append(r.choice([" "] * 12 + ["  ", "\t", ". ", ",", "\n", " ;", "\x0b"]))
        rows.append((r.choice(["en", "en", "en", "de", None, "und", ""]), "".join(t)))
    return rows


@pytest.mark.parametrize("ways", [{}, {"range_windows": 200, "block_bytes": 3000}, {"range_windows": 40, "block_bytes": 1 << 20, "top": 7}])
def test_equal_to_plain_counting(spark, ways):
    rows = many_rows(3) + [tuple(r) for r in awkward_docs(spark).select("lang", "text").collect()]
    rows += [("hot", "one two three " * 2000), ("hot", "one two. " * 50), ("en", "of the " * 900)]
    docs = spark.createDataFrame([(t, l, 1, "z") for l, t in rows], "text string, lang string, n int, w1 string").repartition(5)
    got = sorted(tuple(r) for r in C.collocations(docs, **ways).collect())
    assert got == plain(rows, top=ways.get("top", 2000)) and got
    assert any(len(r[2].split(" ")) == 3 for r in got)


def test_counts_split_a_hot_word(spark):
    rows = [("en", f"hot w{i % 37} v{i % 53}. hot hot") for i in range(3000)]
    docs = spark.createDataFrame(rows, "lang string, text string").repartition(4)
    assert len(C.choose_splitters(docs, 300)) > 5
    got = {tuple(x for x in (r["w1"], r["w2"], r["w3"]) if x): r["f"] for r in C.phrase_counts(docs, range_windows=300).collect() if r["n"]}
    c = Counter()
    for _, t in rows:
        for piece in t.split("."):
            w = piece.split()
            c.update(tuple(w[i:i + k]) for k in (1, 2, 3) for i in range(len(w) - k + 1))
    assert got == {p: n for p, n in c.items() if n >= 10}


def test_empty(spark):
    assert C.collocations(empty_docs(spark)).count() == 0
    assert C.collocations(spark.createDataFrame([("en", None), ("en", " .,\n")], "lang string, text string")).count() == 0


def test_scores_beyond_64_bits(spark):
    a = 3_000_000_000_000
    c = spark.createDataFrame([("en", a, 4 * a, 5 * a)], "lang string, a long, l long, r long")
    from pyspark.sql import functions as F

    got = c.select(F.expr("(CAST(1000000 AS DECIMAL(38, 0)) * a * a) DIV (CAST(l AS DECIMAL(38, 0)) * r)")).first()[0]
    assert got == 1000000 * a * a // (20 * a * a)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(*[st.integers(0, 5)] * 3, st.integers(1, 9)), max_size=40))
def test_add_up_packed_and_unpacked(rows):
    cols = [np.array([r[i] for r in rows], dtype=np.int64) for i in range(3)]
    counts = np.array([r[3] for r in rows], dtype=np.int64)
    plain_sum = Counter()
    for r in rows:
        plain_sum[r[:3]] += r[3]
    for at_hand in (63, 0):
        c, n = C.add_up([x.copy() for x in cols], counts, 5, at_hand)
        assert list(zip(*(x.tolist() for x in c), n.tolist())) == [(*k, v) for k, v in sorted(plain_sum.items())]
        c, n = C.add_up([x.copy() for x in cols], None, 5, at_hand)
        assert list(zip(*(x.tolist() for x in c), n.tolist())) == [(*k, v) for k, v in sorted(Counter(r[:3] for r in rows).items())]


def test_streams_travel_whole():
    words, columns = C.windows_of([b"b a c. a b c d", "é a".encode()])
    columns, counts = C.add_up(columns, None, len(words))
    own, back, n = C.unpack(C.pack(words, columns, counts))
    assert own.equals(words) and all((a == b).all() for a, b in zip(columns, back)) and (n == counts).all()
    show = lambda i: b"" if i == 0 else words[i - 1].as_py()
    rows = [tuple(map(show, r)) for r in zip(*(c.tolist() for c in columns))]
    assert rows == sorted(rows)
    keys = sorted([(b"en", *rows[3]), (b"en", b"aa", b"", b""), (b"en", b"zz", b"q", b""), (b"de", b"x", b"", b""), (b"fr", b"a", b"", b"")])
    at, places = C.cuts(keys, b"en", words, columns)
    assert at == 1 and [sum((b"en", *r) < k for r in rows) for k in keys[1:4]] == places
    assert isinstance(own, pa.Array)
