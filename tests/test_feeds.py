"""Feeds of all formats, their dates, and documents that are none."""

import json
from datetime import datetime
from email.utils import parsedate_to_datetime

import pytest
from pyspark.sql import functions as F

from pagesift.functions import feeds as E
from pagesift.operators import feeds as O

AT = "https://e.example/blog/feed"
RSS = """<rss version="2.0" xmlns:atom="http://www.w3.org/2005/Atom" xmlns:content="http://purl.org/rss/1.0/modules/content/"><channel><title> T &amp; t </title><link>/home</link><description/>
<atom:link rel="self" href="feed.xml"/><atom:link rel="hub" href="https://hub.example/"/><ttl>soon</ttl><managingEditor>nobody</managingEditor><webMaster>a@b.example (Kim)</webMaster><odd>1</odd>
<item><guid>42</guid><title>One</title><pubDate>Mon, 01 Jan 2024 10:00:00 +0130</pubDate><enclosure url="a.mp3" type="audio/mpeg"/><content:encoded>&lt;p&gt;five &lt;b&gt;words&lt;/b&gt; are here now&lt;/p&gt;</content:encoded></item>
<item><guid isPermaLink="false">42</guid><author>x</author><link>https://e.example/2?utm_source=x</link><pubDate>Tue, 01 Jan 2024 10:00:00 GMT</pubDate></item></channel></rss>"""


def told(spark, *bodies):
    df = O.parsed(spark.createDataFrame([(f"{AT}/{i}", b) for i, b in enumerate(bodies)], "url string, body string"))
    return sorted((r.url[-1], r.fault, r.position or 0, r.detail) for r in O.faults(df).collect())


def test_rss_in_full(spark):
    got = E.read(RSS, AT)
    assert (got["title"], got["self"], got["hubs"], got["version"]) == ("T & t", "https://e.example/blog/feed.xml", ["https://hub.example/"], "2.0")
    assert [i["words"] for i in got["items"]] == [5, 0] and got["items"][0]["permalink"] and not got["items"][1]["permalink"]
    assert told(spark, RSS) == sorted([
        ("0", "absolute-url", 0, "/home"), ("0", "absolute-url", 1, "a.mp3"), ("0", "date", 2, "pubDate Tue, 01 Jan 2024 10:00:00 GMT"), ("0", "duplicate-id", 2, "as item 1"), ("0", "email", 0, "nobody"), ("0", "email", 2, "x"),
        ("0", "permalink", 1, "42"), ("0", "required", 0, "ttl in minutes"), ("0", "required", 1, "enclosure's length"), ("0", "required", 2, "title or description"), ("0", "unknown-element", 0, "odd"),
    ])


def test_other_formats_and_their_faults(spark):
    atom = '<feed xmlns="http://www.w3.org/2005/Atom" xml:lang="de"><title>t</title><id>i</id><updated>2024-01-01</updated><entry><id>https://e.example/?utm_source=a</id><title type="xhtml"><div xmlns="http://www.w3.org/1999/xhtml">a <b>b</b></div></title><updated>2024-01-01T00:00:00+01:00</updated><link href="../x"/></entry></feed>'
    feed = {"version": "https://jsonfeed.org/version/1.1", "title": "t", "language": "English!", "authors": [{"name": "n"}], "items": [{"id": 7, "summary": "s", "author": {"name": "x"}, "attachments": [{"url": "https://e.example/a", "mime_type": "audio/x"}]}, "odd"]}
    assert told(spark, atom, json.dumps(feed)) == sorted([
        ("0", "date", 0, "updated 2024-01-01"), ("0", "id-tracking", 1, "https://e.example/?utm_source=a"), ("0", "required", 1, "author"),
        ("1", "language", 0, "English!"), ("1", "required", 1, "content_html or content_text"), ("1", "required", 2, "content_html or content_text"), ("1", "required", 2, "id"), ("1", "version", 1, "author"),
    ])
    got = O.items(O.parsed(spark.createDataFrame([(AT, atom)], "url string, body string"))).first()
    assert (got.title, got.link, got["at"]) == ("a b", "https://e.example/x", datetime(2023, 12, 31, 23))


@pytest.mark.parametrize("body", ["", "<rss", "<html><body/></html>", '{"version": "1"}', "{", "[1]", "<rss version='2.0'/>", "<!DOCTYPE x [<!ENTITY a 'b'><!ENTITY c '&a;&a;'>]><rss>&d;</rss>", "﻿<?xml version='1.0'?>\n<feed xmlns='http://www.w3.org/2005/Atom'/>", "<a>" * 3000, "{\"version\": \"https://jsonfeed.org/version/1\", \"items\": " + "[" * 100_000])
def test_documents_that_are_no_feeds_or_empty_ones(spark, body):
    got = E.read(body, AT)
    assert got["items"] == [] and (got.get("error") or got["missing"])
    assert told(spark, body, None)


def test_dates(spark):
    mail = ["Mon, 01 Jan 2024 10:00:00 GMT", "1 Jan 2024 10:00 EST", "Thu, 29 Feb 2024 23:59:59 -0800", "Tue, 01 Jan 2024 10:00:00 GMT", "Fri, 30 Feb 2024 10:00:00 GMT", "Mon, 01 Jan 24 10:00:00 GMT", "Mon, 01 Jan 2024 24:00:00 GMT", "2024-01-01", "", "Mon, 01 Jan 2024 10:00:00 XST"]
    net = ["2024-01-01T10:00:00Z", "2024-01-01t10:00:00.25-01:30", "2024-01-01 10:00:00Z", "2024-13-01T10:00:00Z", "2024-01-01", "2024-01-01T10:00:00"]
    df = spark.createDataFrame([(t,) for t in mail + net], "t string").select("t", E.rfc822(F.col("t")).alias("m"), E.rfc3339(F.col("t")).alias("n"), E.rfc3339(F.col("t"), True).alias("d"))
    got = {r.t: r for r in df.collect()}
    for t in mail[:3]:
        assert got[t].m == parsedate_to_datetime(t).astimezone().replace(tzinfo=None) or got[t].m.timestamp() == parsedate_to_datetime(t).timestamp()
    assert all(got[t].m is None for t in mail[3:] + net)
    assert got[net[0]].n == datetime(2024, 1, 1, 10) and got[net[1]].n == datetime(2024, 1, 1, 11, 30, 0, 250000) and all(got[t].n is None for t in net[2:] + mail)
    assert got["2024-01-01"].d == datetime(2024, 1, 1)
