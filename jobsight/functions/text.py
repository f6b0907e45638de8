"""Text rules (F2-F12, F16-F20) as native Column expressions.

Every function maps Column(s) to a Column, so they stay inside whole-stage
codegen and compose into a single projection; no Python runs per row.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from jobsight.schemas import (
    DEFAULT_COUNTRY,
    DEFAULT_JOB_TYPE,
    FRESH_GRADUATE,
    NOT_STATED,
    UNSTATED_TEXTS,
)

# Python's str.strip() removes every character for which str.isspace() is true;
# Java's \s covers only the ASCII ones, so the rest are listed explicitly.
PY_SPACE = (
    r"[\s\x{0B}\x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}"
    r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
)

# --- fixed values: location substring -> country, first entry in list order wins ---
COUNTRY_KEYS = [
    ("singapore", "Singapore"),
    ("malaysia", "Malaysia"),
    ("vietnam", "Vietnam"),
    ("india", "India"),
    ("united kingdom", "United Kingdom"),
    ("london", "United Kingdom"),
    ("united states", "United States"),
    ("usa", "United States"),
    ("philippines", "Philippines"),
    ("manila", "Philippines"),
    ("japan", "Japan"),
    ("tokyo", "Japan"),
    ("thailand", "Thailand"),
    ("bangkok", "Thailand"),
    ("kenya", "Kenya"),
    ("nigeria", "Nigeria"),
    ("peru", "Peru"),
    ("germany", "Germany"),
    ("australia", "Australia"),
    ("canada", "Canada"),
]

# --- fixed values: job-type markers, highest precedence first ---------------------
JOB_TYPE_MARKERS = [
    ("Full-time", ["penuh waktu", "full-time", "fulltime"]),
    ("Contract", ["kontrak", "contract"]),
    ("Internship", ["magang", "intern"]),
    ("Freelance", ["freelance"]),
    ("Part-time", ["paruh waktu", "part-time"]),
    ("Remote", ["remote"]),
]

# --- fixed values: contract hints in an Indeed salary snippet, first match wins ----
SNIPPET_JOB_TYPE_MARKERS = [
    ("Contract", ["contract"]),
    ("Internship", ["internship"]),
    ("Part-time", ["part-time", "paruh waktu"]),
    ("Contract", ["temporary"]),
    ("Freelance", ["freelance"]),
]

# --- fixed values: remote-work markers on a card --------------------------------
REMOTE_MARKERS = ["remote", "wfh", "work from home", "kerja dari rumah"]

# --- fixed values: HTML entities decoded by the text cleaner, in this order -------
HTML_ENTITIES = [("&nbsp;", " "), ("&amp;", "&"), ("&quot;", '"')]


class shared_rules:
    """Scope in which a rule applied to the *same* Column object returns the
    same Column (built once). Used when the five source rule sets are fused:
    e.g. the country rule on ``location`` is then built once, not five times
    (each Column node is a Python->JVM call). Inputs are kept referenced for
    the scope's lifetime, so object identities cannot be reused inside it."""

    active = None

    def __enter__(self):
        self._prev, shared_rules.active = shared_rules.active, {}
        return self

    def __exit__(self, *exc):
        shared_rules.active = self._prev


def _shared(fn):
    def wrapper(*args):
        memo = shared_rules.active
        if memo is None:
            return fn(*args)
        key = (fn.__name__,) + tuple(id(a) if isinstance(a, Column) else a for a in args)
        if key not in memo:
            memo[key] = (fn(*args), args)
        return memo[key][0]
    wrapper.__name__, wrapper.__doc__ = fn.__name__, fn.__doc__
    return wrapper


def col_(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def any_contains(c: Column, needles) -> Column:
    """True when ``c`` contains any needle (null when ``c`` is null)."""
    return reduce(lambda a, b: a | b, [c.contains(n) for n in needles])


# The same set as characters, derived from Python's own definition of space.
PY_SPACE_CHARS = "".join(chr(i) for i in range(0x3001) if chr(i).isspace())


@_shared
def py_strip(c) -> Column:
    """Python ``str.strip()``: trim all Unicode whitespace at both ends
    (``trim`` with a character set: no regex per row)."""
    return F.trim(col_(c), F.lit(PY_SPACE_CHARS))


def blank_to_null(c) -> Column:
    c = col_(c)
    return F.when(py_strip(c) != "", c)


def first_truthy(*cols, default=None) -> Column:
    """Python ``a or b or default``: null and "" both fall through."""
    parts = [F.nullif(col_(c), F.lit("")) for c in cols]
    if default is not None:
        parts.append(F.lit(default))
    return F.coalesce(*parts)


def default_text(c, default: str) -> Column:
    """stripped text, or ``default`` when missing (a blank one stays blank)."""
    return F.coalesce(py_strip(c), F.lit(default))


@_shared
def detect_country(c) -> Column:
    """first country key (in list order) found in the lower-cased location."""
    low = F.lower(col_(c))
    expr = None
    for key, name in COUNTRY_KEYS:
        expr = (F.when(low.contains(key), name) if expr is None
                else expr.when(low.contains(key), name))
    return F.when(low.isNull(), DEFAULT_COUNTRY).otherwise(expr.otherwise(DEFAULT_COUNTRY))


@_shared
def clean_unstated(c) -> Column:
    """stripped text; null or an "unknown" phrase becomes the sentinel."""
    s = py_strip(c)
    return F.when(s.isNull() | F.lower(s).isin(UNSTATED_TEXTS), NOT_STATED).otherwise(s)


clean_experience = clean_unstated
clean_education = clean_unstated


def _first_marker(low: Column, markers, fallback: Column) -> Column:
    expr = None
    for label, needles in markers:
        cond = any_contains(low, needles)
        expr = F.when(cond, label) if expr is None else expr.when(cond, label)
    return expr.otherwise(fallback)


@_shared
def normalize_job_type(c) -> Column:
    """contract type by marker precedence; null and unknown are Full-time."""
    low = F.lower(col_(c))
    return F.when(low.isNull(), DEFAULT_JOB_TYPE).otherwise(
        _first_marker(low, JOB_TYPE_MARKERS, F.lit(DEFAULT_JOB_TYPE)))


@_shared
def indeed_job_type(salary_raw, job_type) -> Column:
    """contract hints in the salary snippet win over the card's job type."""
    low = F.lower(col_(salary_raw))
    fallback = normalize_job_type(job_type)
    blank = low.isNull() | (py_strip(low) == "") | (low == "nan")
    return F.when(blank, fallback).otherwise(
        _first_marker(low, SNIPPET_JOB_TYPE_MARKERS, fallback))


@_shared
def map_years(c) -> Column:
    """minimum years -> label; numbers are truncated, other text kept as is."""
    text = col_(c).cast("string")
    num = text.try_cast("double")
    finite = num.isNotNull() & ~F.isnan(num) & (F.abs(num) != float("inf"))
    years = F.when(finite, F.when(num < 0, F.ceil(num)).otherwise(F.floor(num)))
    return (F.when(text.isNull(), NOT_STATED)
            .when(years == 0, FRESH_GRADUATE)
            .when(years.isNotNull(), F.concat(years.cast("string"), F.lit(" tahun")))
            .otherwise(text))


def strip_html(c) -> Column:
    """F8: tags -> space, three entities decoded, space runs collapsed, trimmed."""
    # "." of Python is all but \n; texts without markup skip the pattern
    s = F.when(col_(c).contains("<"), F.regexp_replace(col_(c), r"<[^\n]*?>", " ")).otherwise(col_(c))
    for entity, repl in HTML_ENTITIES:
        s = F.replace(s, F.lit(entity), F.lit(repl))
    s = py_strip(F.regexp_replace(s, r" {2,}", " "))
    return F.coalesce(F.nullif(s, F.lit("")), F.lit(NOT_STATED))


def _rupiah(x: Column) -> Column:
    return F.replace(F.format_number(x.cast("bigint"), 0), F.lit(","), F.lit("."))


def format_salary_range(lower, upper) -> Column:
    """"Rp 3.000.000 - Rp 4.500.000"; a null or zero end gives the sentinel."""
    lo, hi = col_(lower), col_(upper)
    ok = lo.isNotNull() & hi.isNotNull() & (lo != 0) & (hi != 0)
    return F.when(ok, F.concat(F.lit("Rp "), _rupiah(lo), F.lit(" - Rp "), _rupiah(hi))).otherwise(NOT_STATED)


def format_millions(c, decimals: int = 1) -> Column:
    """amount in millions of rupiah, e.g. "Rp 1.5 Jt"; null -> "-".

    The quotient's exact binary value is rounded, ties to even, as Python's
    ``.1f`` does (Java formats its shortest decimal text, ties up): the scaled
    value is rounded by ``rint``, and where it looks like a tie the exact
    rounding error of the multiplication (split into two 26-bit halves) decides."""
    x = col_(c)
    y = F.abs(x.cast("double") / F.lit(1_000_000.0))
    scale = F.lit(float(10 ** decimals))
    t = y * scale
    high = y * F.lit(134217729.0) - (y * F.lit(134217729.0) - y)
    error = (high * scale - t) + (y - high) * scale
    tie = t - F.floor(t) == F.lit(0.5)
    n = (F.when(tie & (error > 0), F.floor(t) + 1).when(tie & (error < 0), F.floor(t))
         .otherwise(F.rint(t))).cast("bigint")
    unit = F.lit(10 ** decimals).cast("bigint")
    text = F.floor(n / unit).cast("bigint").cast("string")
    if decimals:
        text = F.concat(text, F.lit("."), F.lpad((n % unit).cast("string"), decimals, "0"))
    sign = F.when(x < 0, "-").otherwise("")
    return (F.when(x.isNull(), "-").when(F.isnan(x.cast("double")), "Rp nan Jt")
            .otherwise(F.concat(F.lit("Rp "), sign, text, F.lit(" Jt"))))


def date_part(c) -> Column:
    """text before the first "T" of an ISO timestamp."""
    return F.substring_index(col_(c), "T", 1)


def years_label(c) -> Column:
    """F16: "{n} Tahun", missing years counted as 0."""
    return F.concat(F.coalesce(col_(c).cast("string"), F.lit("0")), F.lit(" Tahun"))


def join_degrees(c) -> Column:
    """F16: degree names joined by ", " (no degrees -> "")."""
    return F.coalesce(F.array_join(col_(c), ", "), F.lit(""))


def remote_flag(location, snippet) -> Column:
    """"Remote" when location or snippet mentions remote work, else ""."""
    text = F.lower(F.concat(F.coalesce(col_(location), F.lit("")), F.lit(" "),
                            F.coalesce(col_(snippet), F.lit(""))))
    return F.when(any_contains(text, REMOTE_MARKERS), "Remote").otherwise("")


def absolute_url(href, origin) -> Column:
    """root-relative links get the origin (text or a Column, e.g. each
    page's own origin), http(s) links stay, others null."""
    h = col_(href)
    o = origin if isinstance(origin, Column) else F.lit(origin)
    return (F.when(h.startswith("/"), F.concat(o, h))
            .when(h.startswith("http"), h))


def midpoint(lo, hi) -> Column:
    """(min + max) / 2."""
    return (col_(lo) + col_(hi)) / F.lit(2.0)


def clean_number(c) -> Column:
    """NaN and +-infinity become null (document and event cleaners)."""
    x = col_(c)
    return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)
