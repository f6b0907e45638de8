"""Main-text extraction by minimum cut.

A page is read once into text blocks, each with the containers it lies in.
A linear classifier over block features (containers and their names, link
share, words, sentence ends) says what labelling the block content or
boilerplate would cost; these costs are the capacities of the edges from the
source and to the sink. Blocks that follow one another, and blocks of one
parent, are joined by smoothness edges. The maximum flow's cut separates
content from boilerplate at the least total cost; nodes that their own
capacities already decide leave the graph first, so the flow runs on the few
open ones.

Text: character references decoded, white space inside a block turned into one
space, blocks joined in page order by one space; nothing else is dropped.
Edge cases: null or empty html gives an empty text, as does a page without
text; broken markup (open comments, scripts, tags, quotes) is read as browsers
do; a very long page costs time in proportion to its blocks.
"""

from __future__ import annotations

import html
import re
from collections import deque
from typing import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from jobsight.llm.common import slices

_TOKEN = re.compile(
    r"<!--(?:>|->|.*?(?:-->|--!>|\Z))"
    r"|<!\[CDATA\[.*?(?:\]\]>|\Z)"
    r"|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"'<]|\"[^\"<]*\"|'[^'<]*')*+>|[^>]*(?:>|\Z))", re.S)
_ATTRIBUTE = re.compile(r"\b(class|id|role|hidden|style|aria-hidden)\b\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
_HIDDEN_STYLE = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_NAME = re.compile(r"[a-z0-9]+")

# fixed values: elements by their part in a page
RAW = {"script", "style", "noscript", "template", "iframe", "title", "textarea", "noembed", "noframes", "svg", "math", "object", "audio", "video", "canvas", "xmp"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
BLOCK = {"address", "article", "aside", "blockquote", "body", "center", "dd", "details", "dialog", "dir", "div", "dl", "dt",
         "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "head", "header", "hgroup",
         "html", "li", "main", "menu", "nav", "ol", "p", "pre", "section", "summary", "table", "tbody", "td", "tfoot", "th",
         "thead", "tr", "ul", "button", "select", "option", "optgroup", "legend", "label", "caption"}
BOILERPLATE = {"nav", "footer", "aside", "form", "menu", "dialog", "button", "select", "option", "fieldset", "legend", "label", "head"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
# fixed values: words in class, id and role that tell a container's part
BOILERPLATE_NAMES = {
    "ad", "ads", "adv", "advert", "advertisement", "advertising", "adsense", "adsbygoogle", "adbox", "adslot", "sponsor", "sponsored",
    "sponsors", "promo", "promotion", "banner", "nav", "navbar", "navigation", "menu", "breadcrumb", "breadcrumbs", "sidebar", "widget",
    "widgets", "footer", "foot", "masthead", "topbar", "toolbar", "cookie", "cookies", "consent", "gdpr", "notice", "notices", "alert",
    "warning", "popup", "modal", "overlay", "newsletter", "subscribe", "subscription", "signup", "login", "paywall", "share", "sharing",
    "social", "related", "recommended", "recommendations", "trending", "teaser", "comment", "comments", "commentlist", "disqus", "reply",
    "replies", "respond", "discussion", "copyright", "legal", "pagination", "pager", "search", "searchform", "contentinfo",
    "complementary", "skip", "skiplink"}
CONTENT_NAMES = {"article", "content", "post", "entry", "story", "main", "maincontent", "body", "text", "articlebody", "postbody"}

#: Weights of the classifier, in units of cost.
BASE, ARTICLE, OUTSIDE, NAMED, PARAGRAPH, HEADING, LONG, SENTENCE, LINKS, BARE, BAD = -1.0, 5.0, -3.0, 2.0, 1.5, 0.5, 2.0, 0.8, -5.0, 1.5, -12.0
#: Smoothness of blocks that follow one another, more if they share their parent.
ADJACENT, SIBLING = 0.4, 0.6


class Block:
    __slots__ = ("text", "words", "linked", "tag", "article", "named", "bad", "parent")

    def __init__(self, text, words, linked, tag, article, named, bad, parent):
        self.text, self.words, self.linked, self.tag = text, words, linked, tag
        self.article, self.named, self.bad, self.parent = article, named, bad, parent


def _part(tag: str, attributes: str, article: bool) -> tuple[bool, bool]:
    """(boilerplate, content) as the element and its names say."""
    bad, good = tag in BOILERPLATE or tag == "header" and not article, False
    if "=" in attributes or "hidden" in attributes:
        for name, a, b, c in _ATTRIBUTE.findall(attributes):
            name, value = name.lower(), (a or b or c)
            if name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and _HIDDEN_STYLE.search(value):
                bad = True
            elif name in ("class", "id", "role") and tag not in ("html", "body", "article", "main"):
                names = set(_NAME.findall(value.lower()))
                bad = bad or not names.isdisjoint(BOILERPLATE_NAMES) or "header" in names and not article
                good = good or not names.isdisjoint(CONTENT_NAMES)
    return bad, good


def blocks_of(page: str) -> list[Block]:
    """Text blocks in page order."""
    out: list[Block] = []
    # open containers: tag, inside article, named content, boilerplate, number
    stack = [("", False, False, False, 0)]
    number, in_link = 0, False
    held: list[str] = []
    linked = 0

    def flush():
        nonlocal linked
        if held:
            text = " ".join(html.unescape("".join(held)).split())
            if text:
                tag, article, named, bad, own = stack[-1]
                parent = stack[-2][4] if len(stack) > 1 else 0
                out.append(Block(text, text.count(" ") + 1, min(1.0, linked / len(text)), tag, article, named, bad, parent))
            held.clear()
        linked = 0

    at, size = 0, len(page)
    lower = None
    while at < size:
        m = _TOKEN.search(page, at)
        stop = m.start() if m else size
        if stop > at:
            held.append(page[at:stop])
            if in_link:
                linked += stop - at
        if not m:
            break
        at = m.end()
        tag = m[2]
        if not tag:
            continue
        tag = tag.lower()
        if m[1]:                                          # end tag
            if tag == "a":
                in_link = False
                continue
            if tag in BLOCK:
                flush()
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] == tag:
                    if tag not in BLOCK:
                        flush()
                    del stack[k:]
                    break
                if stack[k][0] in ("article", "main", "td", "body") and tag in ("p", "div", "span", "li"):
                    break                                 # a stray end tag does not close these
            continue
        if tag in RAW:
            if not m[3].endswith("/>"):
                lower = lower or page.lower()
                if len(lower) != size:                    # lower-casing changed offsets
                    end = re.compile(f"</{tag}", re.I).search(page, at)
                    at = end.start() if end else size
                else:
                    end = lower.find(f"</{tag}", at)
                    at = end if end >= 0 else size
            continue
        if tag == "a":
            in_link = True
            continue
        if tag in VOID:
            if tag in ("br", "hr"):
                held.append(" ")
                if tag == "hr":
                    flush()
            continue
        top = stack[-1]
        inside = top[1] or tag in ("article", "main")
        bad, good = _part(tag, m[3], top[1])
        if tag not in BLOCK and not bad:
            continue                                      # inline markup
        flush()
        if tag in BLOCK and tag not in ("div", "section", "span"):
            for k in range(len(stack) - 1, 0, -1):        # elements that this one ends
                open_tag = stack[k][0]
                if open_tag == "p" or open_tag == tag and tag in ("li", "td", "th", "tr", "dt", "dd", "option"):
                    del stack[k:]
                    break
                if open_tag in ("article", "main", "td", "ul", "ol", "table", "body", "section", "div", "blockquote", "nav", "aside"):
                    break
            top = stack[-1]
            inside = top[1] or tag in ("article", "main")
        number += 1
        stack.append((tag, inside, top[2] or good, top[3] or bad, number))
    flush()
    return out


def content_score(b: Block, has_article: bool) -> float:
    """Classifier: above 0 speaks for content, below for boilerplate."""
    s = BASE + LONG * min(1.0, b.words / 25) + LINKS * b.linked
    s += SENTENCE * (b.text[-1] in ".!?…:;\"”»")
    s += PARAGRAPH * (b.tag in ("p", "pre", "blockquote", "td", "li", "dd")) + HEADING * (b.tag in HEADINGS)
    if b.article:
        s += ARTICLE
    elif has_article:
        s += OUTSIDE
    s += NAMED * b.named + BARE * (b.tag in ("", "body"))
    if not b.article and "©" in b.text:
        s += OUTSIDE
    return s + BAD * b.bad


def min_cut(score: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Labels (True: source side) of least cost: a node labelled against its score costs
    the score's size, an edge whose ends differ costs its weight."""
    n = len(score)
    near: list[dict[int, float]] = [{} for _ in range(n)]
    for a, b, w in edges:
        if a != b:
            near[a][b] = near[a].get(b, 0.0) + w
            near[b][a] = near[b].get(a, 0.0) + w
    pull = list(score)
    room = [sum(x.values()) for x in near]                # weight to undecided neighbours
    label: list[bool | None] = [None] * n
    queue = deque(i for i in range(n) if abs(pull[i]) >= room[i])
    while queue:
        i = queue.popleft()
        if label[i] is not None:
            continue
        label[i] = pull[i] > 0
        for j, w in near[i].items():
            if label[j] is None:
                pull[j] += w if label[i] else -w
                room[j] -= w
                if abs(pull[j]) >= room[j] - 1e-12:
                    queue.append(j)
    rest = [i for i in range(n) if label[i] is None]
    if rest:
        for i, side in zip(rest, _flow(rest, pull, near, label)):
            label[i] = side
    return [bool(x) for x in label]


def _flow(rest: list[int], pull: list[float], near: list[dict[int, float]], label: list) -> list[bool]:
    """Source side of the maximum flow over the undecided nodes (Dinic's blocking flows)."""
    place = {i: k for k, i in enumerate(rest)}
    source, sink = len(rest), len(rest) + 1
    cap: list[dict[int, float]] = [{} for _ in range(len(rest) + 2)]
    for k, i in enumerate(rest):
        if pull[i] > 0:
            cap[source][k], cap[k][source] = pull[i], 0.0
        elif pull[i] < 0:
            cap[k][sink], cap[sink][k] = -pull[i], 0.0
        for j, w in near[i].items():
            if label[j] is None:
                cap[k][place[j]] = w
    while True:
        level = {source: 0}
        todo = deque([source])
        while todo:
            u = todo.popleft()
            for v, c in cap[u].items():
                if c > 1e-12 and v not in level:
                    level[v] = level[u] + 1
                    todo.append(v)
        if sink not in level:
            return [k in level for k in range(len(rest))]
        tries = [iter(list(c)) for c in cap]
        path = [source]
        while path:                                       # depth-first along the levels
            u = path[-1]
            if u == sink:
                amount = min(cap[a][b] for a, b in zip(path, path[1:]))
                cut = None
                for k, (a, b) in enumerate(zip(path, path[1:])):
                    cap[a][b] -= amount
                    cap[b][a] = cap[b].get(a, 0.0) + amount
                    if cut is None and cap[a][b] <= 1e-12:
                        cut = k
                del path[cut + 1:]
                tries[path[-1]] = iter([path_next for path_next in cap[path[-1]] if level.get(path_next) == level[path[-1]] + 1])
                continue
            for v in tries[u]:
                if cap[u][v] > 1e-12 and level.get(v) == level[u] + 1:
                    path.append(v)
                    break
            else:
                path.pop()


def main_text(page: str | None) -> str:
    """The page's content blocks joined by one space."""
    blocks = blocks_of(page) if page else []
    if not blocks:
        return ""
    has_article = any(b.article and not b.bad for b in blocks)
    score = [content_score(b, has_article) for b in blocks]
    edges, last = [], {}
    for i, b in enumerate(blocks):
        if i:
            edges.append((i - 1, i, ADJACENT))
        if b.parent in last:
            edges.append((last[b.parent], i, SIBLING))
        last[b.parent] = i
    return " ".join(b.text for b, keep in zip(blocks, min_cut(score, edges)) if keep)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """id_col, url_col, text, n_chars per page."""
    kinds = [pages.schema[c].dataType.simpleString() for c in (id_col, url_col)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = [main_text(x) for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                [id_col, url_col, "text", "n_chars"])

    return pages.select(id_col, url_col, html_col).mapInArrow(
        run, f"`{id_col}` {kinds[0]}, `{url_col}` {kinds[1]}, text string, n_chars bigint")
