"""Archives, n-gram join, decontamination, sharding, neighbours: against plain code."""

import base64
import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from helpers import awkward_docs, empty_docs, item_words_of, words_of

from jobsight.llm import arc_warc as A
from jobsight.llm import extendible_sharding as E
from jobsight.llm import ngram_join as N
from jobsight.llm import posting_ann as P
from jobsight.llm.components import connected_components
from jobsight.llm.winnowing import contamination, item_fingerprints


# ------------------------------------------------------------------- archives

def test_arc_versions_and_lengths():
    v1 = (b"filedesc://a.arc 0.0.0.0 19970101 text/plain 76\n1 0 Reserved\nURL IP-address Archive-date Content-type Archive-length\n\n\n\n"
          b"http://x/ 1.2.3.4 19970203040506 text/html 38\nHTTP/1.0 200 OK\r\nA: b\r\n\r\nURL 1 2 3 4\r\n\n\n"
          b"dns:x 1.2.3.4 19970203040506 text/dns 4\nA 1\n")
    rows = [A.to_record(r) for r in A.parse_arc(v1)]
    assert [r[3] for r in rows] == ["warcinfo", "response", "resource"]
    assert rows[1][2] == "1997-02-03T04:05:06Z" and rows[1][7] == b"URL 1 2 3 4\r\n" and rows[1][5] == A.digest(b"URL 1 2 3 4\r\n")
    assert rows[0][2] == "1997-01-01T00:00:00Z"
    with pytest.raises(ValueError):
        list(A.parse_arc(v1[:-3]))
    for key in (0, 1, 2**62 + 5, 2**63 - 1, -7):
        assert A.key_of(A.record_id(key)) == key


def test_pages_through_warc(spark):
    rows = [(3, "http://a/ b", "x", 1), (1, "http://a", "x", 1), (1, "http://a", "x", 1), (5, None, None, 1), (4, "u", "", 2),
            (7, "u", "WARC/1.1\r\n\r\nURL é\r\n\r\n" * 50, 1), (None, "u", "x", 1), (9, "u", "y" * 3_000_000, 1)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string, record_type int")
    got = sorted(tuple(r) for r in A.pages_through_warc(pages).collect() if r["page_id"] is not None)

    def digest(t):
        return base64.b32encode(hashlib.sha1((t or "").encode()).digest()).decode()

    first = {}
    for k, _, t, _ in rows:
        if k is not None:
            first[t or ""] = min(k, first.get(t or "", k))
    want = sorted((k, len((t or "").encode()), digest(t), "revisit" if k > first[t or ""] else "response",
                   first[t or ""] if k > first[t or ""] else None) for k, _, t, _ in rows if k is not None)
    assert got == want
    assert A.pages_through_warc(pages.limit(0)).count() == 0


# ---------------------------------------------------------------- n-gram join

def brute_components(rows, percent):
    sets = []
    for r in rows:
        w = words_of(r["text"])
        sets.append({tuple(w[i:i + 3]) for i in range(max(1, len(w) - 2))} if w else set())
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and 100 * both >= percent * len(sets[i] | sets[j]) and both:
                root[find(i)] = find(j)
    label = {}
    for i, r in enumerate(rows):
        if r["doc_id"] is not None:
            label[find(i)] = min(r["doc_id"], label.get(find(i), r["doc_id"]))
    return sorted((r["doc_id"] if r["doc_id"] is not None else -1, len(sets[i]),
                   label.get(find(i)) if sets[i] else r["doc_id"]) for i, r in enumerate(rows))


def near_copies(seed, n=160):
    """Groups of near copies at all distances around the threshold, and chains."""
    r = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)]
    rows = []
    while len(rows) < n:
        base = [r.choice(vocab) for _ in range(r.choice([3, 8, 40, 120]))]
        for _ in range(r.randint(1, 12)):
            for _ in range(r.choice([0, 0, 1, 1, 2])):
                base = list(base)
                base[r.randrange(len(base))] = r.choice(vocab)
            rows.append((len(rows), " ".join(base)))
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize("percent,block", [(90, 2000), (70, 3)])
def test_components_equal_brute_force(spark, percent, block, monkeypatch):
    monkeypatch.setattr(N, "BLOCK", block)
    docs = spark.createDataFrame(near_copies(percent), "doc_id bigint, text string")
    got = sorted(tuple(r) for r in N.jaccard_components(docs, percent).collect())
    want = brute_components(docs.collect(), percent)
    assert got == want
    assert len({c for _, _, c in want}) < len(want)


def test_components_of_awkward_rows(spark):
    docs = awkward_docs(spark)
    classes = N.jaccard_components(docs)
    got = sorted((-1 if r["doc_id"] is None else r["doc_id"], r["n_shingles"], r["component_id"]) for r in classes.collect())
    assert got == brute_components(docs.collect(), 90)
    kept = sorted(r["doc_id"] or -1 for r in N.keep_one(docs, classes).collect())
    assert kept == [-1, 1, 2, 3, 4, 5, 7, 8, 10]           # 9 is a near copy of 1, 6 a copy of 5
    assert N.jaccard_components(empty_docs(spark)).count() == 0


def test_bitmaps_never_lose_a_link():
    r = np.random.default_rng(1)
    for n in (3, 31, 33, 200, 1000):
        a = np.unique(r.integers(0, 2**63, n, dtype=np.uint64))
        b = np.unique(np.concatenate([a[n // 12:], r.integers(0, 2**63, n // 20, dtype=np.uint64)]))
        x, y = N.bitmap(a), N.bitmap(b)
        apart = len(np.setxor1d(a, b))
        assert not N.far_apart(int.from_bytes(x, "little"), int.from_bytes(y, "little"), len(x) * 8, len(y) * 8, apart)


def test_connected_components_of_a_path(spark):
    order = random.Random(3).sample(range(60), 60)
    edges = spark.createDataFrame(list(zip(order, order[1:])) + [(100, 101)], "a bigint, b bigint")
    got = {r["node"]: r["comp"] for r in connected_components(edges).collect()}
    assert got == {**{i: 0 for i in range(1, 60)}, 101: 100}


def test_one_id_with_several_payloads(spark):
    rows = [(1, "B"), (2, "A"), (5, "A"), (5, "B"), (5, "C"), (5, "C"), (7, "C")]
    pages = spark.createDataFrame([(k, "u", t) for k, t in rows], "page_id bigint, url string, html string")
    got = sorted((r["page_id"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in A.pages_through_warc(pages).collect())
    first = {t: min(k for k, x in rows if x == t) for _, t in rows}
    assert got == sorted((k, A.digest(t.encode()), "revisit" if k > first[t] else "response", first[t] if k > first[t] else None) for k, t in rows)


# ------------------------------------------------------------- decontamination

def brute_contamination(docs, items):
    out = []
    wins = {}
    for it in items:
        w = item_words_of(it["text"])
        n = min(10, len(w))
        for i in range(len(w) - n + 1 if w else 0):
            wins.setdefault((n, tuple(w[i:i + n])), set()).add(it["item_id"])
    for r in docs:
        w, hit, own = item_words_of(r["text"]), set(), set()
        for n in {n for n, _ in wins}:
            for i in range(len(w) - n + 1):
                if found := wins.get((n, tuple(w[i:i + n]))):
                    hit.update(range(i, i + n))
                    own |= found
        ids = ",".join(sorted(str(x) for x in own if x is not None))     # an item without id hits, and has no name
        out.append((-1 if r["doc_id"] is None else r["doc_id"], len(w), len(hit), len(own), hashlib.sha256(ids.encode()).hexdigest(), bool(hit)))
    return sorted(out)


def test_contamination_equals_brute_force(spark):
    r = random.Random(9)
    vocab = ["a", "b", "the", "x1", "é", "word"]
    text = lambda n: r.choice([" ", ", "]).join(r.choice(vocab) for _ in range(n))
    items = [(i, text(r.choice([1, 2, 4, 5, 6, 9, 10, 11, 14, 25, 40]))) for i in range(30)] + [(30, None), (31, ""), (2, text(12))]
    docs = []
    for i in range(80):
        parts = [text(r.randint(0, 30))]
        if r.random() < 0.7:
            w = (items[r.randrange(30)][1] or "").split()
            a = r.randint(0, len(w))
            parts += [" ".join(w[a:a + r.randint(1, 25)]).upper(), text(r.randint(0, 9))]
        docs.append((i, " ".join(parts)))
    docs = spark.createDataFrame(docs, "doc_id bigint, text string")
    items = spark.createDataFrame(items, "item_id bigint, text string")
    for some in (items, items.where("size(split(text, ' ')) >= 10")):
        got = sorted(tuple(x) for x in contamination(docs, some).collect())
        assert got == brute_contamination(docs.collect(), some.collect())


def test_repeated_words_on_both_sides(spark):
    docs = spark.createDataFrame([(i, "word " * 2000 + "end") for i in range(2)] + [(2, "word " * 9)], "doc_id bigint, text string")
    items = spark.createDataFrame([(1, "word " * 1000), (2, "word " * 999 + "other")], "item_id bigint, text string")
    assert item_fingerprints(items).count() < 60
    got = {r["doc_id"]: (r["n_hit"], r["n_items"]) for r in contamination(docs, items).collect()}
    assert got == {0: (2000, 2), 1: (2000, 2), 2: (0, 0)}


def test_contamination_of_awkward_rows(spark):
    docs = awkward_docs(spark)
    items = spark.createDataFrame([(1, "ALPHA beta, gamma delta epsilon zeta eta theta iota kappa lambda"), (None, "one"), (2, "one")],
                                  "item_id bigint, text string")
    got = sorted((-1 if x["doc_id"] is None else x["doc_id"], *x[1:]) for x in contamination(docs, items).collect())
    assert got == brute_contamination(docs.collect(), items.collect())
    nameless = items.where("item_id IS NULL")
    got = sorted((-1 if x["doc_id"] is None else x["doc_id"], *x[1:]) for x in contamination(docs, nameless).collect())
    assert got == brute_contamination(docs.collect(), nameless.collect()) and any(x[-1] for x in got)
    assert contamination(docs, items.limit(0)).where("contaminated").count() == 0
    assert contamination(empty_docs(spark), items).count() == 0


# ------------------------------------------------------------------- sharding

def test_shards_fit_and_split_only_where_needed(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = E.shard(docs, 60_000).collect()
    size, bits = {}, {}
    for r in rows:
        size[r["shard_id"]] = size.get(r["shard_id"], 0) + r["n_bytes"]
        bits[r["doc_id"]] = int(hashlib.md5(str(r["doc_id"]).encode()).hexdigest()[:15], 16)
    assert len(size) > 30 and max(size.values()) <= 60_000
    for r in rows:
        assert size[r["shard_id"]] == r["shard_bytes"] and bits[r["doc_id"]] >> 60 - r["depth"] == r["bucket"]
    for r in rows:                                         # the parent bucket was too large
        if r["depth"]:
            parent = sum(x["n_bytes"] for x in rows if bits[x["doc_id"]] >> 61 - r["depth"] == r["bucket"] >> 1)
            assert parent > 60_000


def test_shards_of_one_hot_key_and_awkward_rows(spark, tmp_path):
    hot = spark.createDataFrame([(7, f"text {i} " * 20) for i in range(300)] + [(i, "x") for i in range(20)], "doc_id bigint, text string")
    rows = E.shard(hot, 8000).collect()
    size = {}
    for r in rows:
        size[r["shard_id"]] = size.get(r["shard_id"], 0) + r["n_bytes"]
    assert len(rows) == 320 and max(size.values()) <= 8000 and all(size[r["shard_id"]] == r["shard_bytes"] for r in rows)
    docs = awkward_docs(spark).withColumn("depth", E.F.lit(1)).withColumn("bits", E.F.lit(2))
    assert E.shard(docs, 1000).count() == 12 and E.shard(empty_docs(spark), 1000).count() == 0
    E.write_shards(docs, str(tmp_path / "out"), 1000)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == 12 and set(back.columns) == set(docs.columns) | {"shard_id"}


def test_shards_of_one_key_with_skewed_and_identical_rows(spark, tmp_path):
    sizes = [6000] * 30 + [40] * 900 + [20_000]            # one row alone is above the limit
    rows = [(7, f"{i:06d}" + "x" * (n - 6)) for i, n in enumerate(sizes)]
    rows += [(8, "same " * 20)] * 4000 + [(None, "no id, same text")] * 2000
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = E.shard(docs, 8000).collect()
    assert Counter((r["doc_id"], r["n_bytes"]) for r in got) == Counter((k, len(t)) for k, t in rows)
    held = {}
    for r in got:
        held.setdefault(r["shard_id"], []).append(r)
    for rs in held.values():
        assert {r["shard_bytes"] for r in rs} == {sum(r["n_bytes"] for r in rs)}
        assert rs[0]["shard_bytes"] <= 8000 or len(rs) == 1
    assert len({r["shard_id"] for r in got if r["doc_id"] == 8}) >= 50
    E.write_shards(docs, str(tmp_path / "out"), 8000)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert Counter((r["doc_id"], r["text"]) for r in back.collect()) == Counter(rows)
    worst = back.groupBy("shard_id").agg(E.F.sum(E.F.octet_length("text")).alias("b"), E.F.count("*").alias("n"))
    assert worst.where("b > 8000 AND n > 1").isEmpty()


# ----------------------------------------------------------------- neighbours

def brute_neighbours(rows, k=10):
    good = [(i, np.array(v, float)) for i, v in rows if i is not None and v and None not in v and np.isfinite(v).all() and any(v) and len(v) == 8]
    out = {}
    for q, x in good:
        if q % 100 == 0:
            best = {}
            for i, y in good:
                if i != q:
                    d = float(np.sqrt(((x - y) ** 2).sum()))
                    best[i] = min(d, best.get(i, d))
            out[q] = sorted((d, i) for i, d in best.items())[:k]
    return out


def test_neighbours_recall_and_order(spark):
    r = np.random.default_rng(2)
    centre = r.normal(size=(12, 8))
    rows = [(i, (centre[i % 12] + 0.2 * r.normal(size=8)).tolist()) for i in range(3000)]
    rows += [(3000 + i, [1.0] * 8) for i in range(1500)]                      # a third are copies
    rows += [(9000, None), (9100, [0.0] * 8), (9200, [float("nan")] + [1.0] * 7), (9300, [None] + [1.0] * 7), (9400, [1.0] * 3), (None, [1.0] * 8)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").withColumn("score", P.F.lit("x"))
    got = {}
    for x in P.search(df).collect():
        got.setdefault(x["query_id"], []).append((x["rank"], x["vec_id"], x["score"]))
    want = brute_neighbours([(a, b) for a, b, _ in df.collect()])
    assert set(got) == set(want)
    hits = total = 0
    for q, best in want.items():
        own = sorted(got[q])
        assert [x[0] for x in own] == list(range(1, 11))
        assert [(x[2], x[1]) for x in own] == sorted((x[2], x[1]) for x in own)
        if q >= 3000:                                                         # copies: distance 0, smallest ids
            assert [x[1] for x in own] == [i for i in range(3000, 3012) if i != q][:10]
        hits += len({i for _, i in best} & {x[1] for x in own})
        total += 10
    assert hits / total >= 0.9


def test_ties_go_to_smaller_ids(spark):
    rows = [(i, [float(b) for b in f"{i:06b}"] + [2.0]) for i in range(1, 64)]            # corners of a cube
    rows += [(100, [0.5] * 6 + [2.0]), (200, [0.5] * 6 + [1e8]), (201, [0.5] * 6 + [1e8 + 1]), (300, [9.0] * 7), (300, [0.5] * 6 + [2.5])]
    got = P.search(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")).collect()
    assert [r["vec_id"] for r in sorted(got, key=lambda r: (r["query_id"], r["rank"])) if r["query_id"] == 100] == [300, *range(1, 10)]
    assert [r["vec_id"] for r in got if r["query_id"] == 200 and r["rank"] == 1] == [201]
    assert {r["query_id"] for r in got} == {100, 200, 300}


def test_neighbours_of_few_vectors(spark):
    df = spark.createDataFrame([(100, [1.0, 0.0]), (100, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 1.0])], "vec_id bigint, embedding array<double>")
    got = sorted((x["query_id"], x["rank"], x["vec_id"], x["score"]) for x in P.search(df).collect())
    assert got == [(100, 1, 2, 1.0), (100, 2, 1, 2 ** 0.5)]
    assert P.search(df.limit(0)).count() == 0
