"""Fixtures that several operator tests share: awkward rows and plain reference code."""

import re

DOCS = "doc_id bigint, text string, lang string, n_chars bigint, n_words bigint, row string"


def awkward_docs(spark):
    """Nulls, empty and long texts, repeated rows, extra columns with clashing names."""
    base = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon"
    rows = [(1, base, "en", None, 5, "x"), (1, base, "en", None, 5, "x"), (2, None, None, 1, None, None),
            (3, "", "en", 0, 0, ""), (4, "   \n\t ", None, 0, 0, ""), (None, "no id here at all", "en", 1, 1, "y"),
            (5, "one", "en", 3, 1, "z"), (6, "One", "en", 3, 1, "z"), (7, "two words", "en", 9, 2, ""),
            (8, ("word%d " * 6000) % tuple(range(6000)), "en", 1, 6000, ""), (9, base + " phi", "en", 1, 21, ""),
            (10, "<|endoftext|> don't  stop\n \nnow é 12", "en", 1, 1, "")]
    return spark.createDataFrame(rows, DOCS)


def empty_docs(spark):
    return spark.createDataFrame([], DOCS)


def ascii_lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", ascii_lower(text))


def item_words_of(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", ascii_lower(text))
