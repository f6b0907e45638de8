"""Filters and predicates W1-W12. All are ``where`` clauses on native
expressions, so Catalyst pushes the simple ones into the parquet scan."""

from __future__ import annotations

import re
from functools import reduce
from typing import Optional, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from jobsight.functions import py_strip
from jobsight.functions.stemming import stems, stems_sql

# --- fixed values: markers of a blocked / challenge page --------------------------
BLOCK_MARKERS = ["cloudflare", "security check", "challenge", "captcha"]

# --- fixed values: English stop words ignored by the text search ------------------
STOP_WORDS = [
    "a", "about", "above", "after", "again", "against", "all", "am", "an", "and",
    "any", "are", "as", "at", "be", "because", "been", "before", "being", "below",
    "between", "both", "but", "by", "can", "did", "do", "does", "doing", "down",
    "during", "each", "few", "for", "from", "further", "had", "has", "have",
    "having", "he", "her", "here", "hers", "herself", "him", "himself", "his",
    "how", "i", "if", "in", "into", "is", "it", "its", "itself", "just", "me",
    "more", "most", "my", "myself", "no", "nor", "not", "now", "of", "off", "on",
    "once", "only", "or", "other", "our", "ours", "ourselves", "out", "over", "own",
    "same", "she", "should", "so", "some", "such", "than", "that", "the", "their",
    "theirs", "them", "themselves", "then", "there", "these", "they", "this",
    "those", "through", "to", "too", "under", "until", "up", "very", "was", "we",
    "were", "what", "when", "where", "which", "while", "who", "whom", "why", "will",
    "with", "you", "your", "yours", "yourself", "yourselves",
]

TEXT_FIELDS = ["job_title", "company_name", "skills"]


def with_salary(df: DataFrame) -> DataFrame:
    """Both salary ends present."""
    return df.where(F.col("salary_min").isNotNull() & F.col("salary_max").isNotNull())


def with_avg_salary(df: DataFrame) -> DataFrame:
    """Documents whose salary.avg is present."""
    return df.where(F.col("salary.avg").isNotNull())


def company_known(df: DataFrame) -> DataFrame:
    """W3."""
    return df.where(F.col("company_name").isNotNull())


def value_in(df: DataFrame, column: str, values: Optional[Sequence[str]]) -> DataFrame:
    """Membership; ``None`` means no filter. The value list is a literal
    IN-set (it is a user selection, bounded by the facet values)."""
    if values is None:
        return df
    return df.where(F.col(column).isin(list(values)))


def salary_at_least(df: DataFrame, amount: float, lo="salary_min", hi="salary_max") -> DataFrame:
    """Min >= x OR max >= x, only when x > 0; null ends fail."""
    if not amount or amount <= 0:
        return df
    cond = F.coalesce(F.col(lo) >= amount, F.lit(False)) | F.coalesce(F.col(hi) >= amount, F.lit(False))
    return df.where(cond)


def contains_ci(df: DataFrame, query: str, fields=("job_title", "company_name")) -> DataFrame:
    """Case-insensitive REGEX match in any field; null never matches."""
    cond = None
    for f in fields:
        m = F.coalesce(F.col(f).rlike(f"(?i){query}"), F.lit(False))
        cond = m if cond is None else cond | m
    return df.where(cond)


_ACCENTED = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿÀÁÂÃÄÅÇÈÉÊËÌÍÎÏÑÒÓÔÕÖÙÚÛÜÝ"
_PLAIN = "aaaaaaceeeeiiiinooooouuuuyyAAAAAACEEEEIIIINOOOOOUUUUY"


def search_words(text) -> Column:
    """Folded words of a text, each once, without stop words."""
    words = F.split(F.lower(F.translate(F.coalesce(text, F.lit("")), _ACCENTED, _PLAIN)), r"[^\p{L}\p{N}]+")
    return F.array_distinct(F.filter(words, lambda w: (w != "") & ~w.isin(STOP_WORDS)))


def with_search_tokens(df: DataFrame, fields=TEXT_FIELDS, name: str = "search_tokens") -> DataFrame:
    """The table with the stems of its fields' words: what a text index stores."""
    words = search_words(F.concat_ws(" ", *[F.col(f) for f in fields]))
    return df.withColumn(name, F.array_distinct(stems(words)))


def query_stems(spark: SparkSession, words: Sequence[str]) -> list:
    """The stems of a query's words (letters and digits), found once and not beside every row."""
    if not words:
        return []
    literals = ", ".join(f"'{w}'" for w in words)
    row = spark.sql(f"SELECT {stems_sql('words')} AS s FROM VALUES (array({literals})) AS q(words)").first()
    return list(dict.fromkeys(row["s"]))


def parse_text_query(query: str):
    """Split a search string into (terms, phrases, negated terms), folded like
    the indexed text: ``"data engineer" python -java``. A term is cut like the
    text, so ``full-stack`` is two terms."""
    fold = str.maketrans(_ACCENTED.lower(), _PLAIN.lower())
    phrases = [p.strip().lower().translate(fold) for p in re.findall(r'"([^"]+)"', query)]
    terms, negated = [], []
    for tok in re.sub(r'"[^"]+"', " ", query).split():
        out = negated if tok.startswith("-") and len(tok) > 1 else terms
        out += [w for w in re.split(r"[\W_]+", tok.lower().translate(fold)) if w and w not in STOP_WORDS]
    return terms, phrases, negated


def text_search(df: DataFrame, query: Optional[str], fields=TEXT_FIELDS, tokens: Optional[str] = None) -> DataFrame:
    """OR of terms over title, company and skills; quoted phrases must all
    appear, each within one field; ``-term`` excludes. Text and query are
    folded, stop words dropped and inflections removed alike.

    ``tokens`` names a stored column of ``search_tokens`` (see
    ``with_search_tokens``); without it the tokens are made from the fields."""
    if not query:
        return df
    terms, phrases, negated = parse_text_query(query)
    if not terms and not phrases:          # only exclusions select nothing
        return df.where(F.lit(False))
    name, columns = tokens or "__search_tokens", df.columns
    if not tokens and (terms or negated):
        df = with_search_tokens(df, fields, name)

    def any_token(words) -> Column:
        return F.arrays_overlap(F.col(name), F.array(*[F.lit(w) for w in query_stems(df.sparkSession, words)]))

    cond = any_token(terms) if terms else F.lit(True)
    cond = cond & has_phrases(phrases, fields)
    if negated:
        cond = cond & ~any_token(negated)
    return df.where(F.coalesce(cond, F.lit(False))).select(*[f"`{c}`" for c in columns])


def has_phrases(phrases: Sequence[str], fields: Sequence[str]) -> Column:
    """Every phrase stands in some field, accents and case aside."""
    cond = F.lit(True)
    for p in phrases:
        folded = [F.lower(F.translate(F.col(f), _ACCENTED, _PLAIN)).contains(p) for f in fields]
        cond = cond & reduce(lambda a, b: a | b, [F.coalesce(x, F.lit(False)) for x in folded])
    return cond


def search_jobs(df: DataFrame, query: Optional[str] = None, platforms=None, countries=None,
                min_salary: float = 0, mode: str = "documents",
                all_platforms=None, all_countries=None, index=None) -> DataFrame:
    """The job finder.

    ``mode="documents"``: an empty or complete selection means no filter (so
    null platforms/countries stay), query is a text search (W7), through the
    table's ``SearchIndex`` where one is given.
    ``mode="table"``: selections are plain IN filters (empty -> no rows, nulls
    never match), query is a case-insensitive regex on title/company (W6).
    """
    if mode == "documents":
        def sel(values, full):
            if not values:
                return None
            if full is not None and len(set(values)) >= len(set(full)):
                return None
            return values
        out = value_in(df, "platform", sel(platforms, all_platforms))
        out = value_in(out, "country", sel(countries, all_countries))
        out = salary_at_least(out, min_salary)
        return index.search(out, query) if index is not None else text_search(out, query)
    out = df.where(F.col("platform").isin(list(platforms or [])))
    out = out.where(F.col("country").isin(list(countries or [])))
    if query:
        out = contains_ci(out, query)
    return salary_at_least(out, min_salary)


def having_count(df: DataFrame, n: int, col: str = "count") -> DataFrame:
    """Groups with count >= n."""
    return df.where(F.col(col) >= n)


def title_required(df: DataFrame, title: str = "job_title", also=()) -> DataFrame:
    """Drop records without a (non-blank) title, and without the other
    required elements."""
    cond = F.coalesce(py_strip(title) != "", F.lit(False))
    for c in also:
        cond = cond & F.col(c).isNotNull()
    return df.where(cond)


def blocked_pages(pages: DataFrame, n_cards: str = "n_cards", html: str = "html",
                  page_no: str = "page_no") -> DataFrame:
    """Pages with no cards that either show a block marker or are the
    first page of their listing."""
    low = F.lower(F.col(html))
    marker = F.lit(False)
    for m in BLOCK_MARKERS:
        marker = marker | low.contains(m)
    return pages.where((F.col(n_cards) == 0) & (marker | (F.col(page_no) == 0)))


def stream_is_live(summary: DataFrame, now: Optional[Column] = None,
                   max_age_s: int = 120, col: str = "last_updated") -> DataFrame:
    """Adds ``is_live``: last update younger than ``max_age_s``;
    unparsable, missing, or without a zone offset (a naive time cannot be
    compared with the current UTC instant) -> false."""
    now = now if now is not None else F.current_timestamp()
    text = F.col(col)
    zoned = F.coalesce(text.rlike(r"(Z|[+-]\d{2}:?\d{2})$"), F.lit(False))
    ts = F.try_to_timestamp(text)
    age = F.unix_micros(now) - F.unix_micros(ts)
    return summary.withColumn("is_live", zoned & F.coalesce(age < max_age_s * 1_000_000, F.lit(False)))
