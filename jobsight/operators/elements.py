"""Nested markup (P14, P15, P16, A20): HTML as an element interval table.

A tag scan gives the tags of a page and the texts between them as arrays. One pass
over the page's tags names them (a batch's distinct ones once) and pairs every end
tag with its start, inside the page's row: no tag is shuffled or sorted. An element
without an end tag ends with the element around it. Counting elements along the page gives each one its
pre-order numbers ``[enter, leave)``: its descendants are the elements with
numbers between, a slice of the page's list.

Selectors then are interval containment, evaluated inside the page's row: a
descendant step slices the list behind each hit, so the work follows the nesting
and not the product of cards and elements. A record never holds markup of
another card beside it, and a card inside a card is a card of its own.

Differences from a browser: no end tags are implied (``<li>`` in ``<li>`` nests), an
end tag ends the elements of its own name only, and ``>`` counts the elements that
have end tags. Comments, scripts and styles hold no elements and no text. A null
page has no elements. All but the pairing is native; memory follows an Arrow batch
or the longest page.
"""

from __future__ import annotations

import re
import sys
from functools import reduce
from typing import Callable, Optional, Sequence

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobsight.functions import absolute_url, py_strip, remote_flag

# executors need no copy of this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# --- fixed values: elements without content --------------------------------------------
VOID = ["area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"]
# --- fixed values: character references and their characters, ampersand last -----------
REFERENCES = [("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&amp;", "&")]

_RAW = "script|style"
TAG = (rf"<!--(?s:.*?)(?:-->|\z)|<(?i:{_RAW})\b[^>]*+>(?s:.*?)(?:</(?i:{_RAW})\s*+>|\z)|<![^>]*+>"
       r"""|</?[a-zA-Z][^\s/>]*+(?:[^>"']++|"[^"]*+"|'[^']*+')*+>""")


def element_table(pages: DataFrame, html: str = "html", keep: Sequence[str] = ("page_id", "url")) -> DataFrame:
    """One row per page: ``keep``, ``texts`` (the text behind each tag) and ``elements`` in
    page order: enter, leave, depth, pos (its tag's number), until (its end tag's), name, tag."""
    source = F.coalesce(F.col(html), F.lit(""))
    # an empty tag stands before the first text, another behind the last: pages without tags keep one, open elements an end
    split = pages.select(*keep, F.concat(F.split(source, TAG), F.array(F.lit(""))).alias("texts"),
                         F.concat(F.array(F.lit("")), F.regexp_extract_all(source, F.lit(TAG), 0), F.array(F.lit(""))).alias("__tags"))

    return split.select(*keep, "texts", F.arrow_udf(_elements, ELEMENTS)(F.col("__tags")).alias("elements"))


def once(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often ``body`` names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


ELEMENTS = "array<struct<enter: int, leave: int, depth: int, pos: int, until: int, name: string, tag: string>>"
_NAME = re.compile(r"</?([a-zA-Z][^\s/>]*)", re.ASCII)


def mark(tag: str) -> str:
    """name of a start tag, name/ of an element without content, /name of an end tag; names hold no /."""
    found = _NAME.match(tag)
    if not found:
        return ""
    name = found[1].lower()
    if tag[1] == "/":
        return "" if name in VOID else "/" + name
    return name + "/" if name in VOID or name in ("script", "style") or tag.endswith("/>") else name


def pair_tags(marks: Sequence[str]) -> list[list[int]]:
    """[enter, leave, depth, pos, until] of a page's elements from its ``marks``. An end tag
    ends the last open element of its name; without one it is stray. What no end tag
    ends, ends with the element around it, or with the page."""
    open_by_name: dict[str, list[int]] = {}
    ends: dict[int, int] = {}                               # end tag: its start tag
    for pos, m in enumerate(marks):
        if m and m[-1] != "/":
            if m[0] != "/":
                open_by_name.setdefault(m, []).append(pos)
            elif open_by_name.get(m[1:]):
                ends[pos] = open_by_name[m[1:]].pop()
    paired = set(ends.values())
    elements, by_pos, level = [], {}, 0
    unended: dict[int, list] = {}                           # by the level around them
    for pos, m in enumerate(marks):
        if not m:
            continue
        if m[0] != "/":
            n = len(elements)
            if pos in paired:
                e = by_pos[pos] = [n, n + 1, level, pos, pos]
                level += 1
            else:
                e = [n, n + 1, level, pos, pos]
                if m[-1] != "/":
                    unended.setdefault(level, []).append(e)
            elements.append(e)
        elif pos in ends:
            for e in [by_pos[ends[pos]], *unended.pop(level, [])]:
                e[1], e[4] = len(elements), pos
            level -= 1
    for e in (e for left in unended.values() for e in left):
        e[1], e[4] = len(elements), len(marks) - 1
    return elements


def _elements(tags: pa.Array) -> pa.Array:
    flat = tags.flatten()
    found = flat.dictionary_encode()
    marks = [mark(t) for t in found.dictionary.to_pylist()]     # of each distinct tag once
    names = pa.array([m.strip("/") for m in marks], pa.string())
    every = [marks[i] for i in found.indices.to_numpy().tolist()]
    offsets, rows, at = [0], [np.empty((0, 6), dtype=np.int32)], 0
    for n in tags.value_lengths().to_numpy(zero_copy_only=False).tolist():
        page = np.array(pair_tags(every[at:at + n]), dtype=np.int32).reshape(-1, 5)
        rows.append(np.column_stack([page, page[:, 3] + at]).astype(np.int32, copy=False))
        at += n
        offsets.append(offsets[-1] + len(page))
    rows = np.concatenate(rows)
    columns, places = [pa.array(rows[:, i]) for i in range(5)], pa.array(rows[:, 5])
    columns += [names.take(found.indices.take(places)), flat.take(places)]
    elements = pa.StructArray.from_arrays(columns, ["enter", "leave", "depth", "pos", "until", "name", "tag"])
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), elements)


class Selector:
    """A small part of CSS: steps of ``name.class[attr][attr='value']``, joined by a
    blank (descendant) or ``>`` (child)."""

    STEP = re.compile(r"([\w-]*)((?:\.[\w-]+)*)((?:\[[^\]]+\])*)$")

    def __init__(self, text: str):
        self.steps: list[tuple[bool, Callable[[Column], Column]]] = []
        child = False
        for word in text.split():
            if word == ">":
                child = True
                continue
            self.steps.append((child, self._step(word)))
            child = False

    def _step(self, word: str) -> Callable[[Column], Column]:
        found = self.STEP.match(word)
        if not found:
            raise ValueError(f"cannot read selector {word!r}")
        name, classes, attributes = found.groups()
        patterns = []
        for c in classes.split(".")[1:]:
            patterns.append(attribute_pattern("class", rf"(?:[^VALUE]*\s)?{re.escape(c)}(?:\s[^VALUE]*)?"))
        for a in re.findall(r"\[([^\]]+)\]", attributes):
            key, _, value = a.partition("=")
            patterns.append(attribute_pattern(key, re.escape(value.strip("'\""))) if value else rf"\s{re.escape(key)}(?=[\s=/>])")

        def test(e: Column) -> Column:
            tests = [e["name"] == name] if name else []
            tests += [e["tag"].rlike(p) for p in patterns]
            return reduce(lambda a, b: a & b, tests) if tests else F.lit(True)
        return test

    def within(self, elements: Column, scope: Optional[Column] = None, inside: Optional[Column] = None) -> Column:
        """The hits below ``scope`` (or in the page), in page order for one-step selectors.
        ``inside``: the elements below the scope, where they are at hand."""
        (_, first), *rest = self.steps
        if inside is None:
            inside = descendants(elements, scope) if scope is not None else elements
        found = F.filter(inside, first)
        for child, test in rest:
            found = F.flatten(F.transform(found, self._below(elements, child, test)))
        return found

    @staticmethod
    def _below(elements: Column, child: bool, test: Callable[[Column], Column]) -> Callable[[Column], Column]:
        def hits(up: Column) -> Column:
            inside = descendants(elements, up)
            return F.filter(inside, (lambda e: (e["depth"] == up["depth"] + 1) & test(e)) if child else test)
        return hits

    def first(self, elements: Column, scope: Optional[Column] = None, inside: Optional[Column] = None) -> Column:
        found = self.within(elements, scope, inside)
        return F.get(F.array_sort(found) if len(self.steps) > 1 else found, F.lit(0))


def attribute_pattern(name: str, value: str) -> str:
    """An opening tag whose attribute has this value (VALUE stands for the quote in use)."""
    return (rf"\s{re.escape(name)}\s*=\s*(?:\"{value.replace('VALUE', chr(34))}\"|'{value.replace('VALUE', chr(39))}'"
            rf"|{value.replace('VALUE', chr(34))}(?=[\s>]))")


def descendants(elements: Column, scope: Column) -> Column:
    return F.slice(elements, scope["enter"] + 2, scope["leave"] - scope["enter"] - 1)


def attribute(e: Column, name: str) -> Column:
    """The attribute's text, null where the element has none."""
    rx = rf"(?s)\s{re.escape(name)}\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))"

    def of(tag: Column) -> Column:
        return F.when(tag.rlike(rx), decoded(F.concat(*[F.regexp_extract(tag, rx, i) for i in (1, 2, 3)])))
    return once(e["tag"], of)


def decoded(text: Column) -> Column:
    return reduce(lambda t, r: F.replace(t, F.lit(r[0]), F.lit(r[1])), REFERENCES, text)


def strings(texts: Column, e: Column) -> Column:
    """The decoded texts inside an element, in order."""
    return F.transform(F.slice(texts, e["pos"] + 1, e["until"] - e["pos"]), decoded)


def text_of(texts: Column, e: Column, separator: Optional[str] = "") -> Column:
    """``separator``: texts are stripped, blank ones left out and the rest joined by it;
    None: all texts as they stand, stripped at the ends."""
    def of(found: Column) -> Column:
        if separator is None:
            return F.when(found.isNotNull(), py_strip(F.array_join(strings(texts, found), "")))
        kept = F.filter(F.transform(strings(texts, found), lambda s: py_strip(s)), lambda s: s != "")
        return F.when(found.isNotNull(), F.array_join(kept, separator))
    return once(e, of)


def first_of(elements: Column, scope: Optional[Column], selectors: Sequence[str], inside: Optional[Column] = None) -> Column:
    """The first selector that hits gives the element."""
    return F.coalesce(*[Selector(s).first(elements, scope, inside) for s in selectors])


def first_family(elements: Column, selectors: Sequence[str]) -> Column:
    """All hits of the first selector that has any."""
    own = Selector(selectors[0]).within(elements)
    if len(selectors) == 1:
        return own
    return once(own, lambda hits: F.when(F.size(hits) > 0, hits).otherwise(first_family(elements, selectors[1:])))


# --- fixed values: the boards' selectors, in fallback order ------------------------------
INDEED = {
    "cards": ["div.job_seen_beacon", "li.css-5lfssm", "a.tapItem", "div.jobsearch-SerpJobCard", "div[data-testid='slider_item']"],
    "title": ["h3.jobTitle a span[title]", "h3.jobTitle span[title]", "h3.jobTitle a span", "h2.jobTitle span"],
    "company": ["span[data-testid='company-name']"],
    "location": ["div[data-testid='text-location']"],
    "salary": ["div.salary-snippet-container", "[data-testid='attribute_snippet_testid']",
               "div.metadata.salary-snippet-container", "div[data-testid='salary-snippet']"],
    "date": ["span[data-testid='myJobsStateDate']", "span.date", "[data-testid='jobsearch-JobMetadataHeader-item']", ".css-qvloho"],
    "link": ["a.jcs-JobTitle[href]", "a[data-jk][href]", "h3.jobTitle a[href]"],
    "snippet": ["div.job-snippet", "[data-testid='job-snippet']", ".css-9446fg"],
}
INDEED_ORIGIN = "https://id.indeed.com"
LINKEDIN = {
    "cards": ["ul.jobs-search__results-list > li"], "title": ["h3.base-search-card__title"],
    "company": ["h4.base-search-card__subtitle"], "location": ["span.job-search-card__location"],
    "link": ["a.base-card__full-link"], "date": ["time"],
}


def _per_card(table: DataFrame, cards: Column, record: Callable[[Column], Column], keep: Sequence[str]) -> DataFrame:
    """Records are made inside the page's row; only they are exploded."""
    return table.select(*keep, F.posexplode(F.transform(cards, record)).alias("card_no", "r")).select(*keep, "card_no", "r.*")


def indeed_records(table: DataFrame, keep: Sequence[str] = ("page_id",)) -> DataFrame:
    """P14 + P15 + W10 + F17 + F18 over ``element_table``: one row per card with a title."""
    el, tx = F.col("elements"), F.col("texts")

    def record(card: Column) -> Column:
        return once(descendants(el, card), lambda inside: fields(card, inside))

    def fields(card: Column, inside: Column) -> Column:
        def found(name: str) -> Column:
            return first_of(el, card, INDEED[name], inside)

        def field(name: str, separator: str = "") -> Column:
            return text_of(tx, found(name), separator)

        def title(e: Column) -> Column:
            return F.coalesce(once(attribute(e, "title"), lambda t: F.when(t != "", t)), text_of(tx, e))

        return F.struct(once(found("title"), title).alias("job_title"), field("company").alias("company_name"),
                        field("location").alias("location"), field("salary").alias("salary_raw"), field("date").alias("post_date"),
                        once(attribute(found("link"), "href"), lambda h: absolute_url(h, INDEED_ORIGIN)).alias("job_url"),
                        field("snippet", " ").alias("skills"))

    out = _per_card(table, first_family(el, INDEED["cards"]), record, keep)
    return out.where("coalesce(job_title, '') <> ''").withColumn("remote_flag", remote_flag("location", "skills"))


def linkedin_records(table: DataFrame, keep: Sequence[str] = ("page_id",)) -> DataFrame:
    """Cards with a title and a company; what else lacks gets the board's sentinel."""
    el, tx = F.col("elements"), F.col("texts")
    sentinel = F.lit("Tidak dicantumkan")

    def record(card: Column) -> Column:
        def found(name: str) -> Column:
            return first_of(el, card, LINKEDIN[name])

        time = found("date")
        date = F.coalesce(F.nullif(attribute(time, "datetime"), F.lit("")), F.nullif(text_of(tx, time, None), F.lit("")), sentinel)
        return F.struct(text_of(tx, found("title"), None).alias("job_title"), text_of(tx, found("company"), None).alias("company_name"),
                        F.coalesce(text_of(tx, found("location"), None), sentinel).alias("location"),
                        F.coalesce(attribute(found("link"), "href"), sentinel).alias("job_link"), date.alias("posted_date"))

    out = _per_card(table, first_family(el, LINKEDIN["cards"]), record, keep)
    return out.where("job_title <> '' AND company_name IS NOT NULL")


def glints_records(table: DataFrame, keep: Sequence[str] = ("page_id",)) -> DataFrame:
    """A card is what stands two elements above an ``h2`` (the page counts), its date one further up."""
    el, tx = F.col("elements"), F.col("texts")
    unknown, hidden = F.lit("Tidak diketahui"), F.lit("Tidak dicantumkan")

    def up(e: Column) -> Column:
        """The element around: the last one before that ends behind it; the page around all."""
        page = F.struct(F.lit(-1).alias("enter"), F.size(el).alias("leave"), F.lit(-1).alias("depth"), F.lit(0).alias("pos"),
                        F.size(tx).alias("until"), F.lit("").alias("name"), F.lit("").alias("tag"))
        return F.coalesce(F.try_element_at(F.filter(F.slice(el, F.lit(1), e["enter"]), lambda x: x["leave"] > e["enter"]), F.lit(-1)), page)

    def having(scope: Column, word: str) -> Column:
        return F.filter(descendants(el, scope), lambda e: e["tag"].rlike(rf"\sclass\s*=\s*(?:\"[^\"]*{word}|'[^']*{word})"))

    def record(h2: Column) -> Column:
        def on(card: Column) -> Column:
            company = Selector("[data-cy='company_name_job_card']").first(el, card)
            link = Selector("a").first(el, company)
            tags = F.filter(F.transform(having(card, "TagContentWrapper"), lambda e: text_of(tx, e, None)),
                            lambda s: (s != "") & ~s.contains("+"))
            salary, place = F.get(having(card, "SalaryWrapper"), F.lit(0)), F.get(having(card, "CardJobLocation"), F.lit(0))
            dated = F.get(F.transform(F.array(up(card)), lambda o: F.get(having(o, "UpdatedAtMessage"), F.lit(0))), F.lit(0))
            return F.struct(
                text_of(tx, h2, None).alias("job_title"),
                F.coalesce(text_of(tx, F.coalesce(link, company), None), F.lit("Dirahasiakan")).alias("company_name"),
                F.coalesce(text_of(tx, place, None), unknown).alias("location"),
                *[F.coalesce(F.get(tags, F.lit(i)), unknown).alias(n) for i, n in enumerate(("job_type", "experience", "education"))],
                F.coalesce(text_of(tx, salary, None), hidden).alias("salary"),
                F.coalesce(text_of(tx, dated, None), unknown).alias("post_date"))
        return F.get(F.transform(F.array(up(up(h2))), on), F.lit(0))

    h2s = F.filter(el, lambda e: (e["name"] == "h2") & (e["depth"] >= 1))
    return _per_card(table, h2s, record, keep).where("job_title <> ''")
