"""The table of elements against the page it comes from, element by element; selectors and labels by hand."""

import pytest
from pyspark.sql import functions as F

from veilspark.sources import html, nodes

PAGES = [
    (1, "<body><div id=main><p>One <b>two</b>\n three</p><p>Four<br>five</p></div><ul><li>a<li> b </ul> tail</body>"),
    (2, "<html><body><table><tr><td>x<td> y </table><pre> kept  as is\n</pre><script>no</script><p hidden>gone</p></body></html>"),
    (3, None), (4, ""), (5, "only text"), (6, "<p></p><p> </p><i>é日本\U0001f600</i>"),
    (7, "".join(f"<div><p>{k} words here</p>" for k in range(60))),
]


@pytest.fixture(scope="module")
def table(spark):
    df = spark.createDataFrame([(i, h, "x", 3) for i, h in PAGES], "page_id long, html string, node string, start int")
    return nodes.nodes(df).cache()


def pages():
    return {i: html.Page(h) for i, h in PAGES}


def test_ranges_and_places(table):
    got = {(r.page_id, r.node): (r.start, r.end) for r in nodes.ranges(table).collect()}
    want = {(i, k): p.range_of(e) for i, p in pages().items() for k, e in enumerate(p.elements) if p.range_of(e)}
    assert got == want
    for r in nodes.places(table).collect():
        p = pages()[r.page_id]
        e = p.elements[r.node]
        same = [x for x in p.elements if x.parent is e.parent and x.tag == e.tag]
        assert (r.nth, r.of_type) == ([id(x) for x in same].index(id(e)) + 1, len(same)) and r.tag == e.tag
    assert nodes.nodes(table.sparkSession.createDataFrame([], "page_id long, html string")).count() == 0


def test_every_offset_is_found(spark, table):
    spans = [(i, a, z, f"{a}-{z}") for i, p in pages().items() if i != 7 for a in range(len(p.text) + 2) for z in range(a, len(p.text) + 3)] + [(7, 500, 505, "500-505"), (7, 0, 10**6, "0-1000000")]
    df = spark.createDataFrame(spans, "page_id long, start int, end int, key string")
    got = {(r.page_id, r.key): (r.start_node, r.start_from, r.start_at, r.end_node, r.end_from, r.end_at) for r in nodes.located(table, df).collect()}
    want, stretches = {}, {}
    for i, p in pages().items():
        number = {id(e): k for k, e in enumerate(p.elements)}
        stretches[i] = [(s, e, number[id(x)]) for s, e, x in p.segments]
    for i, a, z, key in spans:
        own = stretches[i]
        first, last = next((x for x in own if x[1] > a), None), next((x for x in reversed(own) if x[0] <= z - 1), None)
        if z > a and first and last and first[0] <= last[0]:
            want[i, key] = (first[2], first[0], max(a, first[0]) - first[0], last[2], last[0], min(z, last[1]) - last[0])
    assert got == want


def selected(spark, page):
    table = nodes.nodes(spark.createDataFrame([(1, page)], "page_id int, html string"))
    tags = {r.node: r.tag for r in table.collect()}
    return [(tags[r.node], r.selector) for r in nodes.selectors(table).orderBy("node").collect()]


def test_selectors(spark):
    page = (
        '<html><body><div id="main"><p>a</p><p>b <i>c</i></p></div><div id="main2"><p>d</p></div><div id="item12345"><p>e</p></div>'
        '<div class="note big"><p>f</p></div><div class="note"><p>g</p></div><section data-testid="a b"><b name="x"></b><b name="x"></b></section>'
        '<div id="twice"></div><div id="twice"></div><em class="css-1ab2 wide"></em><em class="active"></em></body></html>'
    )
    assert selected(spark, page) == [
        ("html", "html"), ("body", "body"), ("div", "#main"), ("p", "#main > p:nth-of-type(1)"), ("p", "#main > p:nth-of-type(2)"), ("i", "#main > p:nth-of-type(2) > i"), ("div", "#main2"), ("p", "#main2 > p"),
        ("div", "body > div:nth-of-type(3)"), ("p", "body > div:nth-of-type(3) > p"), ("div", "div.note.big"), ("p", "div.note.big > p"), ("div", "body > div.note:nth-of-type(5)"), ("p", "body > div.note:nth-of-type(5) > p"),
        ("section", 'section[data-testid="a\\ b"]'), ("b", 'section[data-testid="a\\ b"] > b:nth-of-type(1)'), ("b", 'section[data-testid="a\\ b"] > b:nth-of-type(2)'),
        ("div", "body > div:nth-of-type(6)"), ("div", "body > div:nth-of-type(7)"), ("em", "em.wide"), ("em", "body > em:nth-of-type(2)"),
    ]
    deep = selected(spark, "<html><body>" + "<div>" * 12 + "x")
    assert deep[2][1] == "body > div" and deep[8][1] == "body > " + " > ".join(["div"] * 7) and deep[9][1] == deep[13][1] == " > ".join(["div"] * 8)


def test_ways_and_votes(spark):
    page = (
        '<p><span data-kind="email">a@b.c</span> <span data-kind="email">d@e.f</span> <i class="tag-dob x">today</i><span>Ravi <sup>Person Name</sup></span>'
        '<span>[NAME] <sup>[PERSON NAME]</sup></span><div>Ravi <sup>Person Name</sup></div><span><sup>Person Name</sup></span><b data-kind="pan">P <sub>PAN</sub></b><u class="email">x</u></p>'
    )
    df = spark.createDataFrame([(1, page), (2, "<p>nothing</p>"), (3, '<i class="a-mine">x</i>'), (4, f'<i data-x="email">{"long " * 100}</i>')], "page_id int, html string")
    texts = df.select("page_id", html.text_of(F.col("html")).alias("text"))
    table = nodes.nodes(df)
    got = sorted((r.way, r.name, r.label, tuple(r.badges)) for r in nodes.label_ways(table, texts).collect())
    assert got == [
        ("attr:data-kind", "email", "Person Email", ()), ("attr:data-kind", "email", "Person Email", ()), ("attr:data-kind", "pan", "PAN Card Number", ("sub",)),
        ("badge:span>sup", "Person Name", "Person Name", ("sup",)), ("class:tag-", "dob", "Person DOB", ()),
    ]
    assert [tuple(r) for r in nodes.patterns(nodes.label_ways(table, texts)).collect()] == [(1, "attr:data-kind", 3, ["sub", "sup"])]
    more = F.create_map(F.lit("mine"), F.lit("Voter ID"))
    assert [(r.page_id, r.way, r.label) for r in nodes.label_ways(table, texts, aliases=more).where("page_id = 3").collect()] == [(3, "class:a-", "Voter ID")]
