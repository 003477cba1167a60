"""Microdata and RDFa: nesting, values, ids, markup that is broken; judgements over nodes of all syntaxes."""

import json

import pytest
from pyspark.sql import functions as F

from pagesift.functions import markup as M
from pagesift.operators import structured_data as J

AT = "https://e.example/dir/page"


@pytest.mark.parametrize(("html", "micro", "rdfa"), [
    ("<p>nothing</p>", [], []),
    ('<div itemscope itemtype="https://schema.org/Person http://x.example/y#Z" itemid="#me"><span itemprop="name">  Kim\n K. </span></div>', [{"@type": ["Person", "Z"], "@id": AT + "#me", "name": "Kim K."}], []),
    ('<div itemscope><a itemprop="url sameAs" href="../up">x</a><img itemprop="image" src="i.png"><meta itemprop="a" content=""><data itemprop="v" value="5">five</data><time itemprop="d" datetime="2024">now</time></div>', [{"url": "https://e.example/up", "sameAs": "https://e.example/up", "image": "https://e.example/dir/i.png", "a": "", "v": "5", "d": "2024"}], []),
    ('<div itemscope><i itemprop="x">1</i><i itemprop="x">2</i><div itemscope itemprop="child"><i itemprop="x">3</i><div itemscope><i itemprop="x">4</i></div></div><i itemprop="x">5</i></div>', [{"x": ["1", "2", "5"], "child": {"x": "3"}}, {"x": "4"}], []),
    ('<i itemprop="lost">1</i><div itemscope itemprop="orphan"><i itemprop="x">2</i></div>', [], []),
    ('<div typeof="schema:Book" resource="/b" about="/no"><b property="schema:name dc:title">T</b><span property="author" typeof="Person"><b property="name">A</b></span></div>', [], [{"@type": ["Book"], "@id": "https://e.example/b", "name": "T", "title": "T", "author": {"@type": ["Person"], "name": "A"}}]),
    ('<ul itemscope typeof=""><li itemprop="e" property="p">one<li itemprop="e" property="p">two</ul>', [{"e": ["one", "two"]}], [{"p": ["one", "two"]}]),
    ('<div itemscope itemid="_:x"><b itemprop="n">a &amp; <i>b</i></div></div></b>', [{"@id": "_:x", "n": "a & b"}], []),
    ("<div itemscope>" + "<div itemscope itemprop=c>" * 2, [{"c": {"c": {}}}], []),
])
def test_items(html, micro, rdfa):
    got = M.read(html, AT)
    assert [json.loads(x) for x in got["microdata"]] == micro and [json.loads(x) for x in got["rdfa"]] == rdfa


def test_deep_nesting_and_nulls(spark):
    deep = "<div itemscope>" + "<div itemscope itemprop='c'>" * 300 + "<b itemprop='n'>" + "word " * 20_000
    df = spark.createDataFrame([(0, None, AT), (1, deep, AT), (2, deep, None), (3, "", AT)], "i int, html string, url string")
    got = {r.i: r.m for r in df.select("i", M.items(F.col("html"), F.col("url")).alias("m")).collect()}
    assert got[0] is None and got[2] is None and got[3].microdata == [] and len(got[1].microdata) == 1
    nodes = df.select("i", F.size(J.nodes(J.all_blocks(F.lit(None).cast("array<string>"), F.col("html"), F.col("url")), F.col("url"))).alias("n")).collect()
    assert {r.i: r.n for r in nodes if r.i in (1, 3)} == {1: 301, 3: 0}


def test_nesting_beyond_reading_is_told():
    assert [json.loads(x) for x in M.read("<div itemscope itemprop='c'>" + "<div itemscope>" + "<div itemscope itemprop='c'>" * 50_000, AT)["microdata"]] == [{"@error": "nested too deeply"}]


def pages(spark, *blocks):
    df = spark.createDataFrame([(f"https://e.example/{i}", [json.dumps(b)]) for i, b in enumerate(blocks)], "href string, jsonld array<string>")
    return J.page_nodes(df)


def test_judgements(spark):
    found = pages(
        spark,
        {"@type": "Event", "name": "", "startDate": "2024-02-30T10:00", "location": [], "endDate": ["2024-1-1", "2024-01-01T10:00:00.5+02:00"]},
        {"@context": "https://schema.org", "@graph": [{"@type": ["Recipe", "Thing"], "name": "x", "image": {"@id": "#i"}}, {"@type": "Course", "name": "n", "uploadDate": "soon", "hasPart": {"@type": "Course"}}]},
        [{"@type": "Product", "name": ["a"], "color": "https://schema.org/Old"}, {"@type": "Review"}],
    )
    assert {(r.href[-1], r.path, r.type, tuple(r.missing)) for r in J.missing_properties(found).collect()} == {("0", "", "Event", ("name", "location")), ("1", "@graph.1", "Course", ("description",)), ("2", "1", "Review", ("author", "itemReviewed", "reviewRating"))}
    assert {(r.href[-1], r.property, r.value) for r in J.invalid_dates(found).collect()} == {("0", "endDate", "2024-1-1"), ("1", "uploadDate", "soon")}
    terms = spark.createDataFrame([("Old", "New"), ("color", "colour"), ("Course", "Lesson")], "term string, successor string")
    assert {(r.href[-1], r.kind, r.term, r.successor) for r in J.superseded(found, terms).collect()} == {("2", "value", "Old", "New"), ("2", "property", "color", "colour"), ("1", "type", "Course", "Lesson")}


def test_claims_about_the_page_itself(spark):
    found = pages(spark, {"@type": "Article", "headline": "A  Title", "url": "/0"}, {"@type": "WebPage", "name": "Other", "url": "/elsewhere", "mainEntityOfPage": {"@id": "/1"}}, {"@type": "Product", "name": "Other", "url": "/x"}, {"@type": "WebPage", "name": "title"})
    of = spark.createDataFrame([("https://e.example/0", "/0", "a title | Site", None), ("https://e.example/1", None, "The title", "og"), ("https://e.example/2", None, "t", None), ("https://e.example/3", None, None, None)], "href string, canonical string, title string, og_title string")
    assert {(r.href[-1], r.fault) for r in J.claims_apart(found, of).collect()} == {("1", "names https://e.example/elsewhere"), ("1", "is called other")}
