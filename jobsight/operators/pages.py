"""HTML page operators: P14 card extraction, P15 first-matching field,
A20 selector counts, W11 block detection (in ``filters``).

A page is one row (``page_id``, ``url``, ``html``); the whole HTML text is
scanned with native regex functions. Cards become rows with ``posexplode``,
so the work is spread over page partitions and no page is split or cut.
Regexes here stand in for CSS selectors; nested markup inside a matched
element is a known limit (no DOM is built).
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobsight.functions import absolute_url, py_strip, remote_flag, strip_html
from jobsight.functions.text import HTML_ENTITIES

# --- fixed values: job-card selectors of the Indeed result page, in fallback order ---
INDEED_CARD_FAMILIES = [
    ("div", "job_seen_beacon"),
    ("li", "css-5lfssm"),
    ("a", "tapItem"),
    ("div", "jobsearch-SerpJobCard"),
]
INDEED_SLIDER_ITEM = r'data-testid="slider_item"'

# --- fixed values: selectors counted by the connectivity check --------------------
CHECK_SELECTORS = [
    ("a_tapItem", ("a", "tapItem")),
    ("div_jobsearch_SerpJobCard", ("div", "jobsearch-SerpJobCard")),
    ("li_css_5lfssm", ("li", "css-5lfssm")),
    ("testid_job_title", 'data-testid="job-title"'),
]


def class_selector(tag: str, cls: str) -> str:
    """Regex for an opening ``<tag ... class="... cls ...">``: the class is a
    whole word of the list, in double or single quotes."""
    return (rf'<{tag}\s(?:[^>]*\s)?class=(?:"(?:[^"]*\s)?{cls}(?:\s[^"]*)?"'
            rf"|'(?:[^']*\s)?{cls}(?:\s[^']*)?')")


def selector_regex(sel) -> str:
    return class_selector(*sel) if isinstance(sel, tuple) else sel


# A generic card family for listing pages: navigation items (href, text).
NAV_CARD = r'<li><a href="([^"]*)">([^<]*)</a></li>'
SECTION_CARD = r"<p><b>([^<]*)"

ORIGIN = r"^(https?://[^/?#]+)"
PAGE_NO = r"[?&]page=(\d+)"


def page_origin(url) -> Column:
    u = F.col(url) if isinstance(url, str) else url
    return F.regexp_extract(u, ORIGIN, 1)


def page_number(url) -> Column:
    """Listing page index from ``?page=N`` (absent -> 0, the first page)."""
    u = F.col(url) if isinstance(url, str) else url
    n = F.nullif(F.regexp_extract(u, PAGE_NO, 1), F.lit(""))
    return F.coalesce(n.try_cast("int"), F.lit(0))


def extract_cards(pages: DataFrame, families: Sequence[tuple], html: str = "html",
                  keep: Sequence[str] = ("page_id", "url")) -> DataFrame:
    """One row per card. ``families`` is a fallback list of
    (regex, href_group or None, title_group): the first family that matches at
    least once in a page gives that page's cards. Cards without a (non-blank)
    title are dropped (W10)."""
    h = F.col(html)
    chosen = None
    for regex, href_g, title_g in reversed(families):
        titles = F.regexp_extract_all(h, F.lit(regex), title_g)
        hrefs = (F.regexp_extract_all(h, F.lit(regex), href_g) if href_g
                 else F.transform(titles, lambda _: F.lit(None).cast("string")))
        cards = F.arrays_zip(hrefs.alias("href"), titles.alias("title"))
        chosen = cards if chosen is None else F.when(F.size(titles) > 0, cards).otherwise(chosen)
    out = pages.select(*keep, F.posexplode(chosen).alias("card_no", "card"))
    out = out.select(*keep, "card_no", F.col("card.href").alias("href"),
                     py_strip(F.col("card.title")).alias("title"))
    return out.where(F.coalesce(F.col("title") != "", F.lit(False)))


def cards_with_links(cards: DataFrame, url: str = "url") -> DataFrame:
    """F18 applied to cards: root-relative links resolved against the page origin."""
    return cards.withColumn("job_url", absolute_url("href", page_origin(url)))


def card_field(html, patterns: Sequence[str], default=None) -> Column:
    """Group 1 of the first pattern that matches (non-empty), else default."""
    h = F.col(html) if isinstance(html, str) else html
    vals = [F.nullif(py_strip(F.regexp_extract(h, p, 1)), F.lit("")) for p in patterns]
    if default is not None:
        vals.append(F.lit(default))
    return F.coalesce(*vals)


def selector_counts(pages: DataFrame, selectors=CHECK_SELECTORS, html: str = "html",
                    keep=("page_id",)) -> DataFrame:
    """Number of matches of each candidate selector per page."""
    h = F.col(html)
    return pages.select(*keep, *[F.regexp_count(h, F.lit(selector_regex(s))).alias(name)
                                 for name, s in selectors])


def card_count(html, families) -> Column:
    """Cards found by the first selector family that finds any (0 when none)."""
    h = F.col(html) if isinstance(html, str) else html
    counts = [F.regexp_count(h, F.lit(selector_regex(s))) for s in families]
    expr = F.lit(0).cast("int")
    for c in reversed(counts):
        expr = F.when(c > 0, c).otherwise(expr)
    return expr


# --- fixed values: where each board's cards hold their parts, in fallback order ---------

def _inside(opening: str) -> str:
    """Text of the element that ``opening`` starts, behind further opening tags."""
    return rf"{opening}[^>]*>(?:\s*<[a-z][^>]*>)*\s*([^<]*)"


def _classed(tag: str, cls: str) -> str:
    return _inside(class_selector(tag, cls))


BOARDS = {
    "Indeed": {
        "cards": INDEED_CARD_FAMILIES,
        "job_title": [_classed("h2", "jobTitle"), _classed("a", "jcs-JobTitle"), _classed("h2", "title"), _inside(r"<a\s[^>]*data-jk=")],
        "company_name": [_inside(r'<span\s[^>]*data-testid="company-name"'), _classed("span", "companyName"), _classed("span", "company")],
        "location": [_inside(r'<div\s[^>]*data-testid="text-location"'), _classed("div", "companyLocation"), _classed("div", "location")],
        "salary_raw": [_classed("div", "salary-snippet-container"), _classed("span", "salary-snippet"), _classed("span", "salaryText")],
        "post_date": [_classed("span", "date"), _inside(r'<span\s[^>]*data-testid="myJobsStateDate"')],
        "href": [r'<a\s[^>]*\bhref="([^"]*)"'],
        "snippet": [_classed("div", "job-snippet"), _inside(r'<div\s[^>]*data-testid="job-snippet"')],
    },
    "Glints": {
        "cards": [("div", "JobCard")],
        "job_title": [_inside("<h3"), _inside("<h2")],
        "company_name": [_inside(r'<a\s[^>]*data-testid="company"')],
        "href": [r'<a\s[^>]*\bhref="([^"]*)"'],
    },
    "LinkedIn": {
        "cards": [("div", "base-card")],
        "job_title": [_classed("h3", "base-search-card__title")],
        "company_name": [_classed("h4", "base-search-card__subtitle")],
        "location": [_classed("span", "job-search-card__location")],
        "post_date": [r'<time\s[^>]*datetime="([^"]*)"'],
        "href": [r'<a\s[^>]*\bhref="([^"]*)"'],
    },
}
CARD_TAG = r'<span class="tag">([^<]*)</span>'


def card_blocks(pages: DataFrame, families: Sequence, html: str = "html", keep: Sequence[str] = ("page_id", "url")) -> DataFrame:
    """One row per card with the card's own markup (``card``): from its opening
    tag to the next card's. The first family that occurs in a page gives its cards."""
    h = F.col(html)
    chosen = F.array().cast("array<string>")
    for family in reversed(list(families)):
        rx = selector_regex(family)
        parts = F.slice(F.split(h, f"(?={rx})"), 1, 2**31 - 1)
        # every card starts at a split point, however long its opening tag
        cards = F.filter(parts, lambda x: F.rlike(x, F.lit(f"^(?:{rx})")))
        chosen = F.when(F.size(cards) > 0, cards).otherwise(chosen)
    return pages.select(*keep, F.posexplode(chosen).alias("card_no", "card"))


def card_records(pages: DataFrame, board: str, keyword=None, url: str = "url") -> DataFrame:
    """P14 + P15 + W10 + F17 + F18: the records of one board's cards, each field by
    its fallback patterns inside the card; cards without a title are dropped."""
    rules = BOARDS[board]
    cards = card_blocks(pages, rules["cards"])
    origin = page_origin(url)

    def field(name):
        text = card_field("card", rules[name]) if name in rules else F.lit(None).cast("string")
        for entity, char in HTML_ENTITIES:
            text = F.replace(text, F.lit(entity), F.lit(char))
        return text

    out = cards.select("page_id", "card_no", field("job_title").alias("job_title"), field("company_name").alias("company_name"),
                       field("location").alias("location"), field("salary_raw").alias("salary_raw"), field("post_date").alias("post_date"),
                       absolute_url(field("href"), origin).alias("job_url"), strip_html(field("snippet")).alias("snippet"),
                       F.regexp_extract_all("card", F.lit(CARD_TAG), 1).alias("tags"), F.lit(board).alias("platform"))
    out = out.where(F.coalesce(py_strip("job_title") != "", F.lit(False)))
    return out.withColumn("remote", remote_flag("location", "snippet"))
