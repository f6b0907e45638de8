"""Words, chunks and forms of the language model by Arrow, against plain code."""

import time

import pyarrow as pa
from helpers import words_of

from jobsight.llm import brown_lm as B

TEXTS = [None, "", " ", "\t\n x\x0b\x0cY\r ", "É İ a b c d\x1ce\x85f", "\x00 \x00a", "one Two, one 3rd x9.", "a  B", None]


def plain_shape(word):
    length = 0 if len(word) <= 3 else 1 if len(word) <= 6 else 2 if len(word) <= 10 else 3
    digit = any(48 <= b <= 57 for b in word)
    return B.CLASSES + length * 8 + digit * 4 + (word[-1:] in b".,;:!?\"')") * 2 + (not word.isascii())


def test_words_and_forms_equal_plain_ones():
    ws, lens = B.split_words(pa.array(["gone", *TEXTS])[1:])
    want = [words_of(t) for t in TEXTS]
    assert ws.to_pylist() == sum(want, []) and lens.tolist() == list(map(len, want))
    some = ["a", "abc", "abcd", "sixsix", "seven77", "tencharss!", "elevenchars", "é", "naïve.", "(x)", "end\"", "'", "9", "ab;c", "éééé7?"]
    assert B.shapes(pa.array(["x", *some])[1:]).tolist() == [plain_shape(w.encode()) for w in some]
    assert len(B.shapes(pa.array([], pa.string()))) == 0 and B.shape(b"seven77") == plain_shape(b"seven77")


def test_chunks_hold_every_text(monkeypatch):
    monkeypatch.setattr(B, "CHUNK", 9)
    texts, top = TEXTS * 7, ["one", "a", "x"]
    got = list(B.chunked((pa.array(texts[i:i + 4], pa.string()) for i in range(0, len(texts), 4)), pa.array(top)))
    assert sum(n for n, _, _ in got) == len(texts) and len(got) > 5
    back = []
    for n, line, rare in got:
        names = top + rare.to_pylist()
        assert line[0] == -1 and line[-1] == -1 and not set(top) & set(rare.to_pylist())
        assert len(line) > 9 or n == got[-1][0]
        doc = []
        for k in line[1:]:
            if k < 0:
                back.append(doc)
                doc = []
            else:
                doc.append(names[k])
    assert back == [words_of(t) for t in texts]


def test_forms_of_many_words_are_quick():
    ws = pa.array([f"word{i}é" for i in range(400_000)])
    start = time.process_time()
    B.shapes(ws)
    assert time.process_time() - start < 0.6               # word by word: about 2 s
