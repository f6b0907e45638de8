import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from helpers import awkward_docs, empty_docs
from hypothesis import given, settings
from hypothesis import strategies as st

from jobsight.llm.periodic_runs import find_runs, periodic_runs, periodic_tail, run_digests


def plain_runs(w):
    """Every stretch, by trying all periods and walking all positions."""
    n, out = len(w), []
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            start, length = i, j + q - i
            if j > i and length >= max(6, 4 * q):
                s = w[start:start + length]
                if not any(s[d:] == s[:-d] for d in range(1, q)):
                    out.append((start, length, q))
            i = max(j, i) + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def plain_row(key, text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n, h = len(w), zlib.crc32(str(key).encode())
    g = h // 10
    if key is not None and h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = plain_runs(w)
    gone = {i for s, m, q in runs for i in range(s + q, s + m)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else None
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return (key, len(runs), *(best or (None,) * 3), best and 1000 * best[1] // best[2],
            sha("".join("%d,%d,%d\n" % r for r in runs)), sha(" ".join(x for i, x in enumerate(w) if i not in gone)))


def found_of(texts):
    codes = np.array([c for t in texts for c in t], dtype=np.int64)
    of, start, length, period = find_runs(codes, np.array([len(t) for t in texts], dtype=np.int64))
    out = [[] for _ in texts]
    for d, *r in zip(of.tolist(), start.tolist(), length.tolist(), period.tolist()):
        out[d].append(tuple(r))
    return out


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2), max_size=60), max_size=6))
def test_runs_of_small_alphabets(texts):
    assert found_of(texts) == [plain_runs(t) for t in texts]


def test_runs_with_long_periods():
    r = random.Random(5)
    texts = []
    for _ in range(60):
        t = []
        while len(t) < 150:
            block = [r.randrange(4) for _ in range(r.choice([1, 2, 3, 5, 8, 9, 16, 17, 31]))]
            t += block * r.choice([1, 2, 4, 5]) + block[:r.randrange(len(block) + 1)]
        texts.append(t)
    assert any(q > 8 for t in texts for *_, q in plain_runs(t))
    assert found_of(texts) == [plain_runs(t) for t in texts]


def test_query_rows_equal_plain_rows(spark):
    rows = [tuple(r) for r in awkward_docs(spark).select("doc_id", "text").collect()]
    rows += [(i, " ".join(random.Random(i).choice("ab cd Ab é".split()) for _ in range(i % 90))) for i in range(20, 200)]
    rows += [(None, "x " * 9), (900, "y\t\n" * 5000), (901, "y z " * 7 + "y"), (20, "a")]
    docs = spark.createDataFrame([(a, b, 1, "n") for a, b in rows], "doc_id long, text string, start int, runs string").repartition(3)
    got = sorted(map(tuple, run_digests(periodic_runs(docs, rearrange=periodic_tail)).collect()), key=repr)
    assert got == sorted((plain_row(*r) for r in rows), key=repr)
    assert any(r[1] for r in got)


def test_operator_texts_and_bounds(spark):
    docs = spark.createDataFrame([("k", "one  two two two two two two three\nfour")], "name string, body string")
    row = periodic_runs(docs, "name", "body").first()
    assert [tuple(r) for r in row["runs"]] == [(1, 6, 1)] and row["collapsed"] == "one two three four"
    assert periodic_runs(empty_docs(spark)).count() == 0
    with pytest.raises(ValueError):
        periodic_runs(docs, "name", "body", exponent=3)
