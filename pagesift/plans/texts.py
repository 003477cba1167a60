"""Queries over the text functions, URLs as browsers read them, and facts from parsed HTML."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from pagesift.functions import document as D
from pagesift.functions import strings as S
from pagesift.functions import weburl as W
from pagesift.plans.cases import Cases
from pagesift.plans.pages import read

_C = Cases()
QUERIES, SQL = _C.queries, _C.sql


def _one(name: str, kind: str, cases, make, names=("h",)) -> None:
    _C.add(name, f"x {kind}", [(a, (b,)) for a, b in cases], lambda df: df.select("id", make(df).alias("x")), names=names)


_one("header_glob", "BOOLEAN", [("Apache/2.4", True), ("apache", True), ("nginx", False), ("my apache", False), (None, None)], lambda df: S.like_header(F.col("h"), "apache*"))
_one("slug_tokens", "VARCHAR", [("F%C3%BCr-Elise_Elise", "elise fur"), ("Stra%DFe", "dfe stra"), ("Straße 7", "7 strasse"), ("ﬁne+art", "art fine"), ("---", ""), ("50%", "50")], lambda df: F.array_join(S.tokens(F.col("h")), " "))
_one("template_fill", "VARCHAR", [(("{got} in {field}", "5", "title"), "5 in title"), (("{got}{got}", "a", None), "aa"), (("{field}", "x", None), "{field}"), (("plain", "x", "y"), "plain")], lambda df: S.filled(F.col("t"), {"got": F.col("got"), "field": F.col("field")}), ("t", "got", "field"))
_one("message_elide", "VARCHAR", [("short", "5 characters: “short”"), ("a" * 100 + "b" * 100, "200 characters: “" + "a" * 100 + "b" * 100 + "”"), ("a" * 150 + "b" * 150, "300 characters: “" + "a" * 100 + "…" + "b" * 99 + "”"), (None, "none")], lambda df: S.shown(F.col("h"), "string"))
_one("title_redundant", "VARCHAR", [("Shop | Shop", "Shop"), ("Fish - Red Fish", None), ("A very long name – A very long name", "A very long name"), ("Big Shop: Shop", "Shop"), ("One | Two", None), ("a-a", None)], lambda df: S.repeated_about(F.col("h")))
_one("srcset_candidates", "VARCHAR", [("a.png 1x, b.png 2x", "a.png b.png"), (" a.png  100w ,,c.png", "a.png c.png"), ("", "")], lambda df: F.array_join(S.srcset(F.col("h")), " "))
_one("printable_text", "VARCHAR", [("a\tb\nc", "a\\u{9}b\\u{a}c"), ("\x1b[31m", "\\u{1b}[31m"), ("x‮y⁦", "x\\u{202e}y\\u{2066}"), ("für €", "für €"), ("", "")], lambda df: S.printable(F.col("h")))
_FEEDS = ["https://mp3s.nashownotes.com/pc20rss.xml", "podnews.net/rss/", "http://e.example//"]
_one("podcast_guid", "VARCHAR", [(u, str(uuid.uuid5(uuid.UUID(S.PODCASTS), u.split("://")[-1].rstrip("/")))) for u in _FEEDS] + [(None, None)], lambda df: S.podcast_guid(F.col("h")))
_one("language_tag", "BOOLEAN", [("en", True), ("de-CH-1996", True), ("zh-Hant-TW", True), ("en-US-u-islamcal", True), ("x-klingon", True), ("e", False), ("english_US", False), ("en-", False), ("de-1996-1996", False), ("en-a-bb-a-cc", False), (None, False)], lambda df: S.language_tag(F.col("h")))
_one("languages_agree", "BOOLEAN", [(("en-GB", "en"), True), (("EN", "en-gb"), True), (("en", "eng"), False), (("fr", "de"), False)], lambda df: S.languages_agree(F.col("a"), F.col("b")), ("a", "b"))
_one("path_fingerprint", "BOOLEAN", [("/app.3f9a1c.js", True), ("/jquery-3.7.1.min.js", True), ("/a/build7x9q2.css", True), ("/facade.css", False), ("/news/2024/report.pdf", False), ("/deface1/x", True), ("/style.css", False)], lambda df: S.fingerprinted(F.col("h")))
_one("unit_bytes", "VARCHAR", [("999", "999 B"), ("1500", "1.5 kB"), ("2000000", "2 MB"), ("0", "0 B"), (None, None)], lambda df: S.with_unit(F.col("h").cast("double"), "bytes"))
_one("unit_seconds", "VARCHAR", [("59", "59 s"), ("90", "1.5 min"), ("86400", "1 d"), ("7200", "2 h")], lambda df: S.with_unit(F.col("h").cast("double"), "s"))
_one("unit_grams", "VARCHAR", [("0.25", "250 mg"), ("1.26", "1.3 g"), ("2500", "2.5 kg")], lambda df: S.with_unit(F.col("h").cast("double"), "g"))

_one(
    "url_resolve_web",
    "VARCHAR",
    [
        (("http://e.example/a/b?x#y", "../für c?q=ü"), "http://e.example/f%C3%BCr%20c?q=%C3%BC"),
        (("https://e.example:443/", "//X.example:80/a/./b/../c"), "https://x.example:80/a/c"),
        (("https://e.example/a/", "https://E.example:443"), "https://e.example/"),
        (("https://e.example/a/b", "?q=1"), "https://e.example/a/b?q=1"),
        (("https://e.example/a/b?q=1", "#top"), "https://e.example/a/b?q=1#top"),
        (("https://e.example/a/b", "\\c\\d"), "https://e.example/c/d"),
        (("https://e.example/a/b", "%2e%2E/c"), "https://e.example/c"),
        (("https://e.example/a", "https://bücher.example/"), "https://xn--bcher-kva.example/"),
        (("https://e.example/", "mailto:a@b.example"), "mailto:a@b.example"),
        (("https://e.example/", "https://a b/"), None),
        (("https://e.example/", "https://e.example:99999/"), None),
        (("https://e.example/x", " /y\n "), "https://e.example/y"),
    ],
    lambda df: W.resolved(F.col("base"), F.col("ref")),
    ("base", "ref"),
)
_one(
    "registrable_domain",
    "VARCHAR",
    [("www.shop.co.uk", "shop.co.uk"), ("A.Example.com", "example.com"), ("co.uk", None), ("me.github.io", "me.github.io"), ("x.me.github.io", "me.github.io"), ("a.b.any.ck", "b.any.ck"), ("any.ck", None), ("x.www.ck", "www.ck"), ("192.0.2.1", None), ("localhost", None), (None, None)],
    lambda df: W.registrable_domain(F.col("h")),
)

#: A page with what each projection looks for, and traps beside it: markup inside a script, attributes given twice, a title in a drawing, unclosed elements.
PAGE = """<!doctype html><html lang=en-GB dir=ltr><head><title> A &amp; B </title><meta charset=utf-8><meta name=description content=one><meta name=description content=two media=print>
<meta property="og:author" content="Pat"><meta http-equiv="Refresh" content="5"><link rel=canonical href="/c"><link rel="alternate" hreflang=de href="/de"><link rel="preload stylesheet" href="s.css" as=style>
<script type="application/ld+json">{"@graph": [{"@type": "Article", "author": [{"name": "Kim"}], "datePublished": "2024-05-06"}]}</script><script type="application/ld+json">{broken</script><script src=x.js async></script></head>
<body><svg><title>drawing</title></svg><header><a href="http://o.example/z" rel="nofollow ugc">x</a></header><main><h1>Head<b>ing</h1><p>one two<p>three <a href="http://o.example/z" rel="ugc" rel="x">four</a> <a href="in#f">five</a><script>var t="</p><h1>no</h1>"</script>
<img src=i.png srcset="j.png 1x, k.png 2x" alt="" width=5></main><noscript><img src=n.png></noscript><div id=Comment-list><a href="http://q.example/">c</a></div><iframe src="//f.example/e"></iframe><input type=EMAIL autocomplete=email><area rel=help href=/h></body></html>"""

_C.add(
    "html_projections",
    "k VARCHAR, v VARCHAR",
    [
        (
            (PAGE, "http://e.example/p/"),
            [
                ("lang", "en-GB"), ("dir", "ltr"), ("charset", "utf-8"), ("offset", str(PAGE.index("utf-8>") + 6)), ("title", "A & B"), ("h1", "Heading"), ("canonical", "/c"), ("meta", "description=one"), ("metas", "one two/print"),
                ("http_equiv", "refresh=5"), ("property", "og:author=Pat"), ("head_links", "http://e.example/c http://e.example/de http://e.example/p/s.css"), ("hreflang", "de http://e.example/de"), ("jsonld", "2"), ("scripts", "http://e.example/p/x.js"),
                ("internal", "http://e.example/p/in"), ("external", "http://o.example/z http://q.example/"), ("nofollow", "http://o.example/z"), ("ugc", "http://o.example/z"), ("rel", "http://o.example/z=ugc"),
                ("regions", "comments header main"), ("images", "i.png//5/false n.png/-/-/true"), ("rels", "alternate canonical help nofollow preload stylesheet ugc"), ("inputs", "email email"), ("text", "4"),
                ("resources", "iframe:cross image:same image:same image:same image:same preload:same script:same style:same"), ("author", "Kim"), ("published", "2024-05-06"),
            ],
        ),
        (("", "http://e.example/"), [("jsonld", "0"), ("text", "0")]),
        ((None, "http://e.example/"), []),
    ],
    lambda df: _told(df),
    names=("html", "url"),
)


def _told(df):
    """id and every fact of a page as text, absent and empty ones left out."""
    df = df.select("id", D.page(F.col("html"), F.col("url")).alias("f")).where("f IS NOT NULL")
    f = lambda name: F.col(f"f.{name}")
    words = lambda c: F.array_join(c, " ")
    entries = lambda m: words(F.transform(F.map_entries(m), lambda e: F.concat(e["key"], F.lit("="), e["value"])))
    each = lambda name, *keys, mark=" ": words(F.transform(f(name), lambda x: F.concat_ws(mark, *[F.coalesce(x[k].cast("string"), F.lit("-")) for k in keys])))
    facts = {
        **{n: f(n) for n in ("lang", "dir", "title", "canonical", "author", "published")}, "charset": F.col("f.charset.declared"), "offset": F.col("f.charset.offset").cast("string"), "h1": words(f("h1")), "meta": entries(f("meta")),
        "metas": words(F.transform(f("metas"), lambda x: F.concat_ws("/", x["content"], x["media"]))), "http_equiv": words(F.transform(f("http_equiv"), lambda x: F.concat_ws("=", x["name"], x["content"]))), "property": entries(f("property")),
        "head_links": each("head_links", "href"), "hreflang": each("hreflang", "lang", "href"), "jsonld": F.size(f("jsonld")).cast("string"), "scripts": words(F.transform(F.filter(f("scripts"), lambda x: x["async"]), lambda x: x["src"])),
        **{n: words(F.col(f"f.links.{n}")) for n in ("internal", "external", "nofollow", "ugc", "sponsored")}, "rel": entries(F.transform_values(F.col("f.links.rel"), lambda k, x: words(x))), "regions": words(F.array_sort(F.map_keys("f.links.regions"))),
        "images": each("images", "src", "alt", "width", "noscript", mark="/"), "rels": words(F.array_sort(F.map_keys("f.rels"))), "inputs": each("inputs", "type", "autocomplete"), "text": f("text").cast("string"),
        "resources": words(F.array_sort(F.transform(f("resources"), lambda x: F.concat_ws(":", x["kind"], x["origin"])))),
    }
    rows = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), v.alias("v")) for k, v in facts.items()]))
    return df.select("id", rows.alias("x")).select("id", "x.*").where("v <> ''")


def html_parsed_pages(spark, sf_dir):
    """The parser over all pages."""
    pages = read(spark, sf_dir, "pages").select("page_id", D.page(F.col("html"), F.col("url")).alias("f"))
    return pages.select("page_id", "f.lang", F.col("f.charset.declared").alias("charset"), F.size("f.h1").alias("headings"), F.size("f.links.internal").alias("internal"), F.size("f.links.external").alias("external"), (F.size("f.resources") > 0).alias("loads"))


QUERIES["html_parsed_pages"] = html_parsed_pages
SQL["html_parsed_pages"] = r"""
WITH seen AS (SELECT page_id, regexp_replace(html, '(?is)<script\b.*?</script>|<style\b.*?</style>|<!--.*?-->', '', 'g') AS s, html FROM pages),
links AS (SELECT DISTINCT page_id, regexp_replace(unnest(regexp_extract_all(s, '(?is)<a\s[^>]*?href="([^"#]*)', 1)), '^$', '.') AS href FROM seen)
SELECT page_id, regexp_extract(html, '(?is)<html[^>]*\slang=["'']?([A-Za-z0-9-]+)', 1) AS lang, regexp_extract(html, '(?is)<meta\s[^>]*charset=["'']?([A-Za-z0-9_-]+)', 1) AS charset,
       len(regexp_extract_all(s, '(?i)<h1\b'))::INT AS headings, (SELECT count(*) FROM links l WHERE l.page_id = seen.page_id)::INT AS internal, 0::INT AS external,
       len(regexp_extract_all(html, '(?i)<(script|img|iframe)\s[^>]*src=')) > 0 AS loads FROM seen"""
