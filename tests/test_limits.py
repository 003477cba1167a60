"""What used to be cut silently is whole now, or told."""

import gzip
import zlib

import pytest
from pyspark.sql import functions as F

from pagesift.functions import document, headers
from pagesift.functions import strings as S
from pagesift.operators import site
from pagesift.sources import files


def sitemap(n, width=0):
    return ("<urlset>" + "".join(f"<url><loc>https://e.example/{i:07d}{'x' * width}</loc></url>" for i in range(n)) + "</urlset>").encode()


def test_packed_sitemaps_are_whole_or_refused(monkeypatch):
    told = lambda body: files.sitemap_file(body, "application/gzip", "https://e.example/s.xml.gz")
    body = sitemap(60_000, 880)
    assert len(body) > files.MOST_BYTES
    got = told(gzip.compress(body, 1))
    assert got["entries"] == [] and "more than" in got["error"]
    halves = sitemap(300)
    assert len(told(gzip.compress(halves[:1000]) + gzip.compress(halves[1000:]))["entries"]) == 300
    assert "does not unpack" in told(gzip.compress(halves)[:-30])["error"]
    assert files.unpacked(gzip.compress(b"x" * 1000), 1000) == b"x" * 1000 and files.unpacked(gzip.compress(b"x" * 1001), 1000) is None
    with pytest.raises(zlib.error):
        files.unpacked(gzip.compress(b"x" * 1000)[:-12])


def test_all_resources_of_a_page(spark):
    html = "".join(f"<img src='/{i}.png'>" for i in range(250))
    assert len(document.extract(html, "https://e.example/")["resources"]) == 250
    df = spark.createDataFrame([(html, "https://e.example/")], "h string, u string")
    got = df.select(document.page(F.col("h"), F.col("u"), most=200).alias("p")).first().p
    assert len(got.resources) == 200 and got.resources_dropped == 50


def test_walls_are_told_by_the_whole_body(spark):
    body = "x" * 30_000 + " Just a Moment"
    df = spark.createDataFrame([(403, {"server": "cloudflare"}, body)], "s int, h map<string, string>, b string")
    assert df.select(site.walled(F.col("s"), F.col("h"), F.col("b")).alias("w")).first().w == "cloudflare"


def test_keywords_that_ask_for_hashes(spark):
    df = spark.createDataFrame([("script-src 'self' 'report-sha256'",), ("script-src 'report-sha1'",), ("script-src 'nonce-ab+/_-=' 'sha256-AB==' https: *.e.example:* http://e.example/a?b 'nonce-='",)], "h string")
    assert [len(r.e) for r in df.select(headers.content_policies(F.col("h"))["errors"].alias("e")).collect()] == [0, 1, 1]


@pytest.mark.parametrize(("path", "want"), [
    ("/a/app.3f9a1c.js", True), ("/a/abcdef.js", False), ("/a/123456.js", False), ("/lib/jquery-3.6.1.min.js", True), ("/v2/x", False), ("/v2.0/x", True), ("/archive/2024/01", False), ("/index8zzzz.css", True),
    ("/A1B2C3D4.PNG", True), ("/longwordwithoutfigure.css", False), ("/a.1.b", False), ("/1.v2", False), ("/x~12.5", True), ("/x%2fabc123.css", False), ("", False),
])
def test_versions_in_paths(spark, path, want):
    assert spark.createDataFrame([(path,)], "p string").select(S.fingerprinted(F.col("p")).alias("f")).first().f is want


@pytest.mark.parametrize(("text", "want"), [("Shop | Shop", "Shop"), ("A - B - A - B", "A - B"), ("A shop: shop", "shop"), ("Shop | Other", None), ("a - a", None), ("ab · ab ", "ab"), ("", None)])
def test_titles_that_repeat_themselves(spark, text, want):
    assert spark.createDataFrame([(text,)], "t string").select(S.repeated_about(F.col("t")).alias("r")).first().r == want
