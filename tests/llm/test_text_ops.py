"""Token counts, packing, main text: against the libraries and plain code."""

import itertools
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from helpers import awkward_docs, empty_docs
from tokenizers import Tokenizer

from jobsight.llm import html_mincut as H
from jobsight.llm.packing import ByteBpe, Packer, pack_documents
from jobsight.llm.token_counts import RankMerges, TextCounter, token_counts

WORD, BYTE, RANKS = (public_tokenizers.path(n) for n in ("word_bpe_49k.json", "byte_bpe_50k.json", "byte_bpe_50k.tiktoken"))
ODD = ["", "  ", " a  b   c\t\n x\x1c y\x85z\xa0q r", "don't we'll THEY'VE I'm ΣΑΣ İstanbul naïve 12345 ½ x²",
       "<|endoftext|> hi<|startoftext|>there <|ENDOFTEXT|>", "!" * 900, "ha" * 700, "日本語 한국어 🙂🙂👩‍👩‍👧 z\r\n\r\n x \n y",
       "\n\n\n a\n \n b ", "ﬁ ǆ ẞ é"]


def fuzz(n=400):
    r = random.Random(5)
    return ODD + ["".join(r.choice("ab' \n\t<|endoftext|>éΣ1́ ") for _ in range(r.randint(0, 60))) for _ in range(n)]


def test_token_counts_equal_the_library():
    texts = fuzz()
    want = [len(e.ids) for e in Tokenizer.from_file(WORD).encode_batch(texts, add_special_tokens=False)]
    assert TextCounter(WORD)(texts) == want


def test_merge_order_guard_is_exact():
    # a product that takes part in an earlier merge must be applied one place at a time
    m = RankMerges(WORD)
    words = [bytes(random.Random(i).choices(b"abcdehinorst", k=12)) for i in range(200)]
    fast = m.count(words).tolist()
    m.one_at_a_time[:] = True
    assert m.count(words).tolist() == fast


def test_token_counts_rows(spark):
    docs = awkward_docs(spark)
    got = sorted((r["doc_id"] or -1, r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in token_counts(docs, WORD).collect())
    t = Tokenizer.from_file(WORD)
    want = sorted((r["doc_id"] or -1, len((r["text"] or "").encode()), n := len(t.encode(r["text"] or "", add_special_tokens=False).ids), n > 2048)
                  for r in docs.collect())
    assert got == want
    assert token_counts(empty_docs(spark), WORD).count() == 0


def test_byte_ids_equal_the_library():
    encode, t = ByteBpe(BYTE, RANKS), Tokenizer.from_file(BYTE)
    for text in fuzz():
        assert np.frombuffer(encode(text), "<u4").tolist() == t.encode(text, add_special_tokens=False).ids, repr(text)


def check_pieces(docs, pieces, window=1024):
    t = Tokenizer.from_file(BYTE)
    ids = {}
    for r in docs:
        ids.setdefault(r["doc_id"], []).append(t.encode(r["text"] or "", add_special_tokens=False).ids + [0])
    by_doc, by_seq = {}, {}
    for p in pieces:
        by_doc.setdefault(p["doc_id"], []).append(p)
        by_seq.setdefault(p["sequence_id"], []).append(p)
    assert set(by_doc) == set(ids)
    for key, own in by_doc.items():
        copies = len(ids[key])
        assert sum(p["length"] for p in own) == sum(map(len, ids[key]))
        if copies > 1:
            continue
        at = 0
        for p in sorted(own, key=lambda p: p["start"]):
            assert p["start"] == at and p["doc_tokens"] == len(ids[key][0])
            part = ids[key][0][at:at + p["length"]]
            assert p["ids_crc32"] == zlib.crc32(np.array(part, "<u4").tobytes())
            at += p["length"]
    for own in by_seq.values():
        at = 0
        for p in sorted(own, key=lambda p: p["offset"]):
            assert p["offset"] == at
            at += p["length"]
        assert at <= window
    return 1 - sum(p["length"] for p in pieces) / (window * len(by_seq))


def test_pack_awkward_rows(spark):
    docs = awkward_docs(spark)
    check_pieces(docs.collect(), pack_documents(docs, BYTE, RANKS).collect())
    assert pack_documents(empty_docs(spark), BYTE, RANKS).count() == 0


def test_pack_documents_has_little_padding(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").repartition(5)
    docs.persist()
    padding = check_pieces(docs.collect(), pack_documents(docs, BYTE, RANKS).collect())
    assert padding < 0.01


def test_packer_keeps_few_windows_open():
    p, r, left = Packer(100, 4, 2), random.Random(1), []
    for i in range(500):
        left += list(p.add((i, 0, bytes(4 * r.randint(1, 140)), 0)))
        assert len(p.open) <= 4 and len(p.free) == len(p.open)
    gaps = [100 - sum(len(x[2]) // 4 for x in w) for w in left]
    assert max(gaps) <= 2 and min(gaps) >= 0
    last = list(p.close())
    assert sum(partial for _, partial in last) <= 1


def test_min_cut_equals_brute_force():
    r = random.Random(0)
    for _ in range(150):
        n = r.randint(1, 8)
        score = [r.uniform(-2, 2) for _ in range(n)]
        edges = [(r.randrange(n), r.randrange(n), r.uniform(0, 2)) for _ in range(r.randint(0, 12))]

        def cost(label):
            return (sum(abs(s) for s, k in zip(score, label) if (s > 0) != k)
                    + sum(w for a, b, w in edges if label[a] != label[b]))

        best = min(map(cost, itertools.product([False, True], repeat=n)))
        assert cost(H.min_cut(score, edges)) == pytest.approx(best)


PAGE = """<html><head><title>T</title><style>p{}</style></head><body class="nav-open"><header class="site-header"><a href=/>Home</a> My Site</header>
<div id="cookie-notice">We use cookies on this site. <button>OK</button></div><div class="wrap"><div class="content"><h1>Big story &amp; more</h1>
<p>First paragraph of the story is here, with <a href=x>a link</a> in side.</p><div class="ad-box">Buy now, it is cheap today!</div><p>Short.</p>
<p>Second paragraph continues the tale until the end of time.</p></div><div class="sidebar"><h3>Popular</h3><ul><li><a href=1>One</a></li></ul></div></div>
<section id="comments"><p>Great article, I loved reading every single word of it. Thanks.</p></section><form><label>Name</label></form>
<footer>&copy; 2020</footer></body></html>"""


def test_main_text_of_pages():
    assert H.main_text(PAGE) == ("Big story & more First paragraph of the story is here, with a link in side. Short. "
                                 "Second paragraph continues the tale until the end of time.")
    assert H.main_text("<article><h1>A</h1><p>x<footer>f</footer><aside>q</aside><p>y <b>z</b>w<br>v") == "A x y zw v"
    assert H.main_text('<article><script>var t="</p>";</script><p>x &am &amp y</p><!-- open') == "x &am & y"
    assert H.main_text("just plain text with no markup") == "just plain text with no markup"
    assert H.main_text("<p>unclosed 'quote <a href='x>y") != ""
    assert H.main_text(None) == H.main_text("") == H.main_text("<div></div>") == ""
    assert H.main_text("<p>" + "word " * 200_000 + "</p>").count("word") == 200_000


def test_extract_rows(spark):
    pages = spark.createDataFrame([(1, None, PAGE, 3, "a"), (1, None, PAGE, 3, "a"), (2, "u", None, None, None), (None, "v", "", 1, "")],
                                  "page_id bigint, url string, html string, n_chars int, text string")
    rows = H.extract(pages).collect()
    assert [len(r["text"]) == r["n_chars"] for r in rows] == [True] * 4
    assert sorted((r["page_id"] or 0, r["url"], r["text"] != "") for r in rows if r["page_id"] != 1) == [(0, "v", False), (2, "u", False)]
    assert H.extract(pages.limit(0)).count() == 0


def test_main_text_of_given_pages(spark):
    import html
    import re

    for r in spark.read.parquet("/root/testdata/sf0.001/pages.parquet").collect():
        article = re.search(r"<article>(.*?)</article>", r["html"], re.S)[1]
        want = html.unescape(re.sub(r"</?b>", "", re.sub(r"</?(?:p|h1|br)>", "\n", article)))
        assert H.main_text(r["html"]) == " ".join(want.split())
