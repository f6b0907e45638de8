"""Element intervals against a plain stack parser, and the boards' records."""

import random
from html.parser import HTMLParser

import pytest
from pyspark.sql import functions as F

from jobsight.operators import elements as E
from testkit import rows

VOID = set(E.VOID)


class Stack(HTMLParser):
    """Elements as (name, enter, leave, text) with end tags ending elements of their name."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open, self.all, self.skip = [], [], False

    def handle_starttag(self, tag, attrs):
        e = {"name": tag, "attrs": dict(attrs), "enter": len(self.all), "leave": None, "text": []}
        self.all.append(e)
        if tag in VOID:
            e["leave"] = e["enter"] + 1
        else:
            self.open.append(e)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.open.pop()["leave"] = len(self.all)

    def handle_endtag(self, tag):
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i]["name"] == tag:
                for e in self.open[i:]:
                    e["leave"] = len(self.all)
                del self.open[i:]
                return

    def handle_data(self, data):
        if self.open and self.open[-1]["name"] in ("script", "style"):
            return
        for e in self.open:
            e["text"].append(data)

    def done(self, html):
        self.feed(html)
        self.close()
        for e in self.open:
            e["leave"] = len(self.all)
        return self.all


def random_page(seed):
    """Nested markup with voids, stray end tags and unclosed elements (never crossing)."""
    r = random.Random(seed)

    def content(depth):
        out = []
        for _ in range(r.randrange(4 if depth else 7)):
            kind = r.random()
            if kind < .3:
                out.append(r.choice(["text", " a &amp; b ", "\n", "5 < 6", "é", "&lt;i&gt;"]))
            elif kind < .4:
                out.append(r.choice(["<br>", "<img src='a>b'>", "<hr/>", "<!-- <p> -->", "<script>var a='<div>';</script>", "<!DOCTYPE html>"]))
            elif kind < .45:
                out.append(r.choice(["</em>", "</u>"]))
            elif depth < 5:
                name = r.choice(["div", "p", "span", "A", "li"])
                attr = r.choice(["", ' class="x y"', " class='job x'", ' title="t > u"', " hidden", ' data-id=7'])
                close = "" if r.random() < .12 else f"</{name}>"
                out.append(f"<{name}{attr}>{content(depth + 1)}{close}")
        return "".join(out)
    return content(0)


def test_intervals_and_texts_equal_a_stack(spark):
    pages = [(i, random_page(i)) for i in range(300)] + [(1000, None), (1001, ""), (1002, "no tags"), (1003, "</p></div>"), (0, "<b>same id</b>")]
    table = E.element_table(spark.createDataFrame(pages, "page_id long, html string").repartition(3), keep=["page_id"])
    shown = table.select("page_id", F.transform("elements", lambda e: F.struct(
        e["name"], e["enter"].cast("int"), e["leave"].cast("int"), E.text_of(F.col("texts"), e, None))).alias("e"))
    got = sorted((r[0], [tuple(x) for x in r[1]]) for r in shown.collect())
    want = []
    for key, html in pages:
        found = Stack().done(html or "")
        want.append((key, [(e["name"], e["enter"], e["leave"], "".join(e["text"]).strip()) for e in found]))
    assert len(got) == len(pages)
    # a paragraph left open inside an element of its own name is the stated difference
    same = sum(a == b for a, b in zip(got, sorted(want)))
    for (key, g), (_, w) in zip(got, sorted(want)):
        assert [x[:2] for x in g] == [x[:2] for x in w], key
    assert same >= len(pages) * .9


def test_selectors(spark):
    html = ("<div class='a b'><p title=x>one <b class=\"k\">two</b></p><div class=a><p>three</p><a href='/u?a=1&amp;b=2' data-jk>l</a></div></div>"
            "<ul class=\"l\"><li>x<li-x></li-x></li><li class='ab'><ul><li>in</li></ul></li></ul>")
    t = E.element_table(spark.createDataFrame([(1, html)], "page_id long, html string"), keep=["page_id"])

    def texts(selector):
        hits = F.transform(E.Selector(selector).within(F.col("elements")), lambda e: E.text_of(F.col("texts"), e, "|"))
        return t.select(hits).first()[0]

    assert texts("div.a p") == ["one|two", "three", "three"]          # a hit for each way
    assert texts("p[title]") == ["one|two"] and texts("p[title='x'] b.k") == ["two"]
    assert texts(".b") == ["one|two|three|l"] and texts("a[data-jk][href]") == ["l"]
    assert texts("ul.l > li") == ["x", "in"] and texts("ul li") != texts("ul.l > li")
    assert texts("div.c") == [] and texts("li-x") == [""]
    href = E.attribute(E.Selector("a").first(F.col("elements")), "href")
    assert t.select(href).first()[0] == "/u?a=1&b=2"
    with pytest.raises(ValueError):
        E.Selector("a:hover")


INDEED = """<div class="job_seen_beacon"><h3 class="jobTitle"><a class="jcs-JobTitle" href="/rc/1"><span title="Data &amp; Lead">Data <b>&amp;</b> Lead</span></a></h3>
<span data-testid="company-name">PT <i>A</i></span><div data-testid="text-location">Remote, <b>Jakarta</b></div>
<div class="job-snippet"><ul><li>build things</li><li>ship <b>things</b></li></ul></div>
<div class="job_seen_beacon"><h2 class="jobTitle"><span>Inner <em>role</em></span></h2><span class="date">today</span></div></div>
<div class="job_seen_beacon"><span data-testid="company-name">no title</span></div>"""


def test_indeed_records_of_nested_cards(spark):
    page = spark.createDataFrame([(1, "u", INDEED), (2, "u", "<a class='tapItem'><h2 class=jobTitle><span title=''>T</span></h2></a>"),
                                  (3, "u", None)], "page_id long, url string, html string")
    got = rows(E.indeed_records(E.element_table(page)).orderBy("page_id", "card_no"))
    assert got == [
        (1, 0, "Data & Lead", "PTA", "Remote,Jakarta", None, "today", "https://id.indeed.com/rc/1", "build things ship things", "Remote"),
        (1, 1, "Innerrole", None, None, None, "today", None, None, ""),
        (2, 0, "T", None, None, None, None, None, None, "")]


def test_linkedin_and_glints_records(spark):
    linkedin = ("<ul class='jobs-search__results-list'><li><h3 class='base-search-card__title'> Dev <b>Ops</b> </h3><h4 class='base-search-card__subtitle'><a>PT</a></h4>"
                "<a class='base-card__full-link' href='https://l/1'></a><time datetime='2026-01-02'>now</time></li>"
                "<li><h3 class='base-search-card__title'>No company</h3></li>"
                "<li><h3 class='base-search-card__title'>QA</h3><h4 class='base-search-card__subtitle'></h4><time> 3 days </time><ul><li>x</li></ul></li></ul>")
    t = E.element_table(spark.createDataFrame([(1, linkedin)], "page_id long, html string"), keep=["page_id"])
    assert rows(E.linkedin_records(t).orderBy("card_no")) == [
        (1, 0, "Dev Ops", "PT", "Tidak dicantumkan", "https://l/1", "2026-01-02"),
        (1, 2, "QA", "", "Tidak dicantumkan", "Tidak dicantumkan", "3 days")]
    glints = ("<section><div class='card'><div><h2>Data <i>Lead</i></h2></div><p data-cy='company_name_job_card'><a>PT A</a> more</p>"
              "<span class='x CardJobLocation-1'>Jakarta</span><span class='TagContentWrapper a'>+2</span><span class='TagContentWrapper a'>Kontrak</span>"
              "<span class='TagContentWrapper a'>S1</span><b class='q SalaryWrapper'>Rp 5</b></div><em class='UpdatedAtMessage'>1 hari</em></section>"
              "<div><div><h2>  </h2></div></div><div><div><h2>Bare</h2></div></div><h2>Top</h2>")
    t = E.element_table(spark.createDataFrame([(1, glints)], "page_id long, html string"), keep=["page_id"])
    u = "Tidak diketahui"
    assert [r[2:] for r in rows(E.glints_records(t).orderBy("card_no"))] == [
        ("Data Lead", "PT A", "Jakarta", "Kontrak", "S1", u, "Rp 5", "1 hari"), ("Bare", "Dirahasiakan", u, u, u, u, "Tidak dicantumkan", "1 hari")]
