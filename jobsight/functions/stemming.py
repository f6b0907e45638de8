"""English word stems by the Snowball rules, as a native expression and as a column function.

The rules work on regions: R1 begins behind the first non-vowel that follows a
vowel, R2 likewise inside R1; both are found once and kept while endings are
replaced. Each step looks for the longest ending it knows and changes it only
where the ending lies in the step's region. Every step is bound to a name by a
one-element ``transform``, so the expression stays linear in the number of rules
although each rule names its word many times.

``stems`` gives the same stems for a whole column: a batch's distinct words are
stemmed once and remembered by the task, where the expression would go through
all rules for every word of every row.
"""

from __future__ import annotations

import re
import sys

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values: words with stems of their own, and words that stay -------------------
IRREGULAR = {"skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl",
             "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl"}
INVARIANT = ["sky", "news", "howe", "atlas", "cosmos", "bias", "andes"]
INVARIANT_AFTER_PLURAL = ["inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed"]
# --- fixed values: word beginnings whose R1 follows them ----------------------------------
R1_BEGINNINGS = ["gener", "commun", "arsen"]
# --- fixed values: endings and what replaces them, by step ---------------------------------
STEP_2 = [("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("abli", "able"), ("entli", "ent"),
          ("izer", "ize"), ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"), ("aliti", "al"), ("alli", "al"),
          ("fulness", "ful"), ("ousli", "ous"), ("ousness", "ous"), ("iveness", "ive"), ("iviti", "ive"), ("biliti", "ble"),
          ("bli", "ble"), ("ogi", "og"), ("fulli", "ful"), ("lessli", "less"), ("li", "")]
STEP_3 = [("ational", "ate"), ("tional", "tion"), ("alize", "al"), ("icate", "ic"), ("iciti", "ic"), ("ical", "ic"),
          ("ful", ""), ("ness", ""), ("ative", "")]
STEP_4 = ["al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "ion"]
# --- fixed values: what must stand before some endings -------------------------------------
BEFORE = {"ogi": "l", "li": "cdeghkmnrt", "ion": "st"}

_V = "[aeiouy]"
_N = "[^aeiouy]"


def _bind(value: str, name: str, body: str) -> str:
    return f"transform(array({value}), {name} -> {body})[0]"


def _words(words) -> str:
    return ", ".join(f"'{w}'" for w in words)


def _without(w: str, n: int) -> str:
    return f"left({w}, length({w}) - {n})"


def _short(w: str) -> str:
    return f"({w} RLIKE '{_N}{_V}[^aeiouywxY]$' OR {w} RLIKE '^{_V}{_N}$')"


def _endings(w: str, rules, region: dict | None = None, default: str = "p.r1") -> str:
    """The longest known ending decides; it changes only inside its region."""
    cases = []
    for ending, put in sorted(rules, key=lambda r: -len(r[0])):
        tests = [f"length({w}) - {len(ending)} >= {(region or {}).get(ending, default)}"]
        if ending in BEFORE:
            tests.append(f"{w} RLIKE '[{BEFORE[ending]}]{ending}$'")
        cases.append(f"WHEN endswith({w}, '{ending}') THEN if({' AND '.join(tests)}, concat({_without(w, len(ending))}, '{put}'), {w})")
    return f"CASE {' '.join(cases)} ELSE {w} END"


def _region(w: str) -> str:
    return f"length(regexp_extract({w}, '^{_N}*{_V}+{_N}', 0))"


def _plural(w: str) -> str:
    return (f"CASE WHEN endswith({w}, 'sses') THEN {_without(w, 2)} "
            f"WHEN {w} RLIKE 'ie[ds]$' THEN {_without(w, '(CASE WHEN length(' + w + ') > 4 THEN 2 ELSE 1 END)')} "
            f"WHEN {w} RLIKE '[us]s$' THEN {w} WHEN {w} RLIKE '{_V}.+s$' THEN {_without(w, 1)} ELSE {w} END")


def _participle(w: str) -> str:
    base = f"regexp_replace({w}, '(?:ed|edly|ing|ingly)$', '')"
    mended = (f"CASE WHEN b RLIKE '(?:at|bl|iz)$' THEN concat(b, 'e') WHEN b RLIKE '(?:bb|dd|ff|gg|mm|nn|pp|rr|tt)$' THEN {_without('b', 1)} "
              f"WHEN length(b) <= p.r1 AND {_short('b')} THEN concat(b, 'e') ELSE b END")
    eed = f"regexp_replace({w}, 'eed(?:ly)?$', '')"
    return (f"CASE WHEN {w} RLIKE 'eed(?:ly)?$' THEN if(length({eed}) >= p.r1, concat({eed}, 'ee'), {w}) "
            f"WHEN {w} RLIKE '{_V}.*(?:ed|edly|ing|ingly)$' THEN {_bind(base, 'b', mended)} ELSE {w} END")


def _last_letter(w: str) -> str:
    rest = _without(w, 1)
    return (f"CASE WHEN endswith({w}, 'e') THEN if(length({w}) > p.r2 OR (length({w}) > p.r1 AND NOT {_short(rest)}), {rest}, {w}) "
            f"WHEN endswith({w}, 'll') AND length({w}) > p.r2 THEN {rest} ELSE {w} END")


def stem_sql(word: str) -> str:
    """SQL text of the stem of ``word`` (the name of a lower-case word)."""
    marked = f"regexp_replace(regexp_replace({word}, '^y', 'Y'), '({_V})y', '$1Y')"      # y as a consonant
    begins = f"length(regexp_extract(m, '^(?:{'|'.join(R1_BEGINNINGS)})', 0))"
    r1 = f"coalesce(nullif({begins}, 0), nullif({_region('m')}, 0), length(m))"
    r2 = f"coalesce(a + nullif({_region('substring(m, a + 1)')}, 0), length(m))"
    regions = _bind(r1, "a", f"named_struct('r1', a, 'r2', {r2})")
    steps = [
        ("w2", _participle("w1")),
        ("w3", "regexp_replace(w2, '(?<=.[^aeiouy])[yY]$', 'i')"),
        ("w4", _endings("w3", STEP_2)),
        ("w5", _endings("w4", STEP_3, {"ative": "greatest(p.r1, p.r2)"})),
        ("w6", _endings("w5", [(e, "") for e in STEP_4], default="p.r2")),
        ("w7", _last_letter("w6")),
    ]
    body = "w7"
    for name, step in reversed(steps):
        body = _bind(step, name, body)
    body = _bind(_plural("m"), "w1", f"if(w1 IN ({_words(INVARIANT_AFTER_PLURAL)}), w1, {body})")
    body = f"replace({_bind(marked, 'm', _bind(regions, 'p', body))}, 'Y', 'y')"
    irregular = " ".join(f"WHEN {word} = '{w}' THEN '{s}'" for w, s in IRREGULAR.items())
    return f"CASE WHEN length({word}) <= 2 OR {word} IN ({_words(INVARIANT)}) THEN {word} {irregular} ELSE {body} END"


def stems_sql(words: str) -> str:
    """SQL text of the stems of an array (given by name) of lower-case words."""
    return f"transform({words}, w0 -> {stem_sql('w0')})"


# executors need no copy of this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])

_ANY_VOWEL_S = re.compile(f"{_V}.+s$")
_EED = re.compile("eed(?:ly)?$")
_ING = re.compile("(?:ed|edly|ing|ingly)$")
_VOWEL_ING = re.compile(f"{_V}.*(?:ed|edly|ing|ingly)$")
_SHORT = re.compile(f"{_N}{_V}[^aeiouywxY]$|^{_V}{_N}$")
_REGION = re.compile(f"{_N}*{_V}+{_N}")
_BEGINNINGS = re.compile("|".join(R1_BEGINNINGS))


def _by_length(rules) -> list:
    return sorted(rules, key=lambda r: -len(r[0]))


_RULES_2, _RULES_3, _RULES_4 = _by_length(STEP_2), _by_length(STEP_3), _by_length([(e, "") for e in STEP_4])


def _changed(w: str, rules: list, region: int, regions: dict) -> str:
    """``_endings`` of one word."""
    for ending, put in rules:
        if w.endswith(ending):
            n = len(w) - len(ending)
            before = BEFORE.get(ending)
            inside = n >= regions.get(ending, region) and (before is None or (n > 0 and w[n - 1] in before))
            return w[:n] + put if inside else w
    return w


def stem(word: str) -> str:
    """The stem of a lower-case word: ``stem_sql`` rule by rule."""
    if len(word) <= 2 or word in INVARIANT:
        return word
    if word in IRREGULAR:
        return IRREGULAR[word]
    m = re.sub(f"({_V})y", r"\1Y", re.sub("^y", "Y", word))
    found = _BEGINNINGS.match(m) or _REGION.match(m)
    r1 = found.end() if found else len(m)
    found = _REGION.match(m[r1:])
    r2 = r1 + found.end() if found else len(m)
    if m.endswith("sses"):
        w = m[:-2]
    elif m.endswith(("ied", "ies")):
        w = m[:-2] if len(m) > 4 else m[:-1]
    elif m.endswith(("us", "ss")) or not _ANY_VOWEL_S.search(m):
        w = m
    else:
        w = m[:-1]
    if w not in INVARIANT_AFTER_PLURAL:
        if _EED.search(w):
            base = _EED.sub("", w)
            w = base + "ee" if len(base) >= r1 else w
        elif _VOWEL_ING.search(w):
            w = _ING.sub("", w)
            if w.endswith(("at", "bl", "iz")):
                w += "e"
            elif w.endswith(("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt")):
                w = w[:-1]
            elif len(w) <= r1 and _SHORT.search(w):
                w += "e"
        w = re.sub("(?<=.[^aeiouy])[yY]$", "i", w)
        w = _changed(w, _RULES_2, r1, {})
        w = _changed(w, _RULES_3, r1, {"ative": max(r1, r2)})
        w = _changed(w, _RULES_4, r2, {})
        if w.endswith("e"):
            if len(w) > r2 or (len(w) > r1 and not _SHORT.search(w[:-1])):
                w = w[:-1]
        elif w.endswith("ll") and len(w) > r2:
            w = w[:-1]
    return w.replace("Y", "y")


class Stems(dict):
    """Stems of words, remembered. Emptied when full, so a task's memory stays bounded
    whatever the vocabulary."""

    LIMIT = 200_000

    def __missing__(self, word: str) -> str:
        if len(self) >= self.LIMIT:
            self.clear()
        value = stem(word)
        if len(word) <= 64:
            self[word] = value
        return value


def stems(words: Column) -> Column:
    """The stems of a column of arrays of lower-case words, in their order."""
    memo = Stems()

    def of_batch(lists: pa.Array) -> pa.Array:
        flat = lists.flatten().dictionary_encode()
        known = pa.array([None if w is None else memo[w] for w in flat.dictionary.to_pylist()], pa.string())
        sizes = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
        offsets = pa.array([0, *sizes.cumsum().tolist()], pa.int32())
        return pa.ListArray.from_arrays(offsets, known.take(flat.indices), mask=lists.is_null())
    return F.arrow_udf(of_batch, "array<string>")(words)
