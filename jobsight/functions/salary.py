"""free-text salary -> struct<min double, max double>, with native expressions.

Rule (compat mode, the behaviour the cleaned table was produced with):

1. null -> nulls; the text is lower-cased and stripped.
2. Any "missing" marker as a substring, or empty text -> nulls.
3. A currency factor for the whole text (dollar-ish -> 12000, dong -> 0.65).
4. The text is split on the character class ``[-–—to]``: every letter "t" and
   "o" separates too, so "5 jt" is two parts and "6,5 jt - 7,5 jt" four.
5. Each part: a unit factor (a million marker, else a thousand marker); with a
   comma, dots are dropped and commas become the decimal point; otherwise digit
   runs whose tail groups all have 3 digits are joined; then the first
   ``\\d+(\\.\\d+)?`` times both factors.
6. One part -> (v, v); two parts -> (lo, hi) with a unit repair when only one
   side carries the unit; any other count -> nulls.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from jobsight.functions.text import PY_SPACE_CHARS

# --- fixed values: salary parsing vocabulary ------------------------------------
SALARY_MISSING_MARKERS = [
    "gaji tidak ditampilkan", "tidak dicantumkan", "tidak disebutkan",
    "confidential", "dirahasiakan", "unknown", "tidak ada",
]
CURRENCY_FACTORS = [                      # first group found in the text wins
    (["$", "sgd", "usd"], 12000.0),
    (["₫", "vnd"], 0.65),
]
RANGE_SEPARATORS = "[-–—to]"              # a character class, not words
MILLION_MARKERS = ["jt", "juta", "million", "m"]
THOUSAND_MARKERS = ["rb", "ribu", "thousand", "k"]
UNIT_REPAIR = [("jt", 1_000_000.0), ("rb", 1_000.0)]   # first applicable wins
REPAIR_SPREAD = 1000.0                    # hi > lo * spread triggers the min repair


def _lit(v: str) -> str:
    """Spark SQL string literal (backslashes and quotes escaped)."""
    return "'" + v.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _any(col: str, needles) -> str:
    return "(" + " OR ".join(f"contains({col}, {_lit(n)})" for n in needles) + ")"


def _strip(expr: str) -> str:
    return f"trim(BOTH {_lit(PY_SPACE_CHARS)} FROM {expr})"


def _dbl(x: float) -> str:
    return f"{float(x)!r}D"


def _first_factor(col: str, groups, default: float = 1.0) -> str:
    whens = " ".join(f"WHEN {_any(col, needles)} THEN {_dbl(f)}" for needles, f in groups)
    return f"CASE {whens} ELSE {_dbl(default)} END"


def _repair(cond_side: str, other_side: str) -> str:
    """Factor for the first unit present in ``cond_side`` but not in ``other_side``."""
    whens = " ".join(f"WHEN contains({cond_side}, {_lit(u)}) AND NOT contains({other_side}, {_lit(u)}) "
                     f"THEN {_dbl(f)}" for u, f in UNIT_REPAIR)
    return f"CASE {whens} ELSE 1.0D END"


def with_parsed_salary(df: DataFrame, source: str, out: str = "salary") -> DataFrame:
    """adds ``out`` = struct<min: double, max: double> parsed from the text
    column ``source``.

    Written as a few narrow projections whose intermediate columns are
    referenced by name: one large nested expression would repeat its shared
    parts at every use (Catalyst expressions are trees), which makes planning
    and code generation explode; separate projections keep it linear and all
    of it stays in one whole-stage-codegen stage. Each stage is one SQL
    projection (built in one call).
    """
    keep = [f"`{c}`" for c in df.columns]
    stages = [
        [f"{_strip(f'lower(`{source}`)')} AS _s_txt"],
        [f"({' OR '.join(f'contains(_s_txt, {_lit(m)})' for m in SALARY_MISSING_MARKERS)} OR _s_txt = '') AS _s_missing",
         f"{_first_factor('_s_txt', CURRENCY_FACTORS)} AS _s_cur",
         f"split(_s_txt, {_lit(RANGE_SEPARATORS)}, -1) AS _s_parts"],
    ]
    stages.append([e for i in (0, 1) for e in (f"{_strip(f'get(_s_parts, {i})')} AS _s_p{i}",
                                               f"get(_s_parts, {i}) AS _s_r{i}")])
    units = [([*MILLION_MARKERS], 1_000_000.0), ([*THOUSAND_MARKERS], 1_000.0)]
    part = []
    for i in (0, 1):
        p = f"_s_p{i}"
        runs = f"regexp_extract_all({p}, '(\\\\d+)', 1)"
        # digit runs after the first that are not exactly 3 long
        joinable = f"(size({runs}) > 1 AND size(filter({runs}, (x, j) -> j > 0 AND length(x) != 3)) = 0)"
        normalized = (f"CASE WHEN contains({p}, ',') THEN replace(replace({p}, '.', ''), ',', '.') "
                      f"WHEN {joinable} THEN array_join({runs}, '') ELSE {p} END")
        part += [f"{_first_factor(p, units)} AS _s_u{i}",
                 f"regexp_extract({normalized}, '\\\\d+(\\\\.\\\\d+)?', 0) AS _s_n{i}"]
    stages.append(part)
    stages.append([f"CASE WHEN _s_p{i} != '' AND _s_n{i} != '' THEN CAST(_s_n{i} AS DOUBLE) * _s_u{i} * _s_cur END AS _s_v{i}"
                   for i in (0, 1)])
    s = df
    for stage in stages:
        s = s.selectExpr("*", *stage)
    both = "_s_v0 IS NOT NULL AND _s_v1 IS NOT NULL"
    lo = (f"CASE WHEN {both} AND NOT (_s_v0 > _s_v1) AND _s_v1 > _s_v0 * {_dbl(REPAIR_SPREAD)} "
          f"THEN _s_v0 * ({_repair('_s_r1', '_s_r0')}) ELSE _s_v0 END")
    hi = f"CASE WHEN {both} AND _s_v0 > _s_v1 THEN _s_v1 * ({_repair('_s_r0', '_s_r1')}) ELSE _s_v1 END"
    pick = lambda e: (f"CASE WHEN _s_txt IS NULL OR _s_missing THEN CAST(NULL AS DOUBLE) "
                      f"WHEN size(_s_parts) = 1 THEN _s_v0 WHEN size(_s_parts) = 2 THEN {e} "
                      f"ELSE CAST(NULL AS DOUBLE) END")
    # Fence: the parsed struct goes through a non-deterministic identity.
    # Catalyst does not push a predicate through a projection with a
    # non-deterministic field, so a filter on the salary never gets the whole
    # parser substituted into it (which re-inflates the expression tree); yet
    # the field is still pruned, parser and all, when nothing reads it.
    parsed = f"named_struct('min', {pick(lo)}, 'max', {pick(hi)})"
    return s.selectExpr(*keep, f"CASE WHEN spark_partition_id() >= 0 THEN {parsed} END AS `{out}`")
