"""Queries over captured files, caches, reports, rules as data, structured data and observations, each with its SQL."""

from __future__ import annotations

import gzip

from pyspark.sql import functions as F

from pagesift.functions import document as D
from pagesift.operators import caching as C
from pagesift.operators import links as K
from pagesift.operators import mail as M
from pagesift.operators import observations as O
from pagesift.operators import rules as R
from pagesift.operators import structured_data as J
from pagesift.plans.cases import Cases
from pagesift.plans.pages import read
from pagesift.sources import files as S
from pagesift.sources import reports as W
from pagesift.sources.scratch import dealt_out

_C = Cases()
QUERIES, SQL = _C.queries, _C.sql


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def _add(name, columns, cases, make, names=("h",)):
    _C.add(name, columns, cases, make, names=names)


# Files

_ROBOTS = "User-agent: A\nUser-agent: b\nCrawl-delay: 2.5\nContent-Signal: search=yes, AI-Train = no\nDisallow: /x\nSitemap: https://e.example/s.xml\n\nUser-agent: *\nCrawl-delay: soon\nsitemap: /t.xml # two\nnonsense"
_add(
    "robots_txt_settings", "agent VARCHAR, field VARCHAR, value VARCHAR, line INTEGER",
    [
        (_ROBOTS, [("a", "crawl-delay", "2.5", 2), ("b", "crawl-delay", "2.5", 2), ("a", "content-signal", "search=yes", 3), ("b", "content-signal", "search=yes", 3), ("a", "content-signal", "ai-train=no", 3), ("b", "content-signal", "ai-train=no", 3), (None, "sitemap", "https://e.example/s.xml", 5), (None, "sitemap", "/t.xml", 9)]),
        ("Content-Signal: search=no\nUser-agent: *", [(None, "content-signal", "search=no", 0)]),
        ("", []),
    ],
    lambda df: S.robots_settings(df, "id", "h"),
)
_add(
    "robots_txt_policy", "allowed BOOLEAN",
    [(("200", "User-agent: *\nDisallow: /private"), (False,)), (("200", "User-agent: *\nDisallow: /other"), (True,)), (("404", "User-agent: *\nDisallow: /"), (True,)), (("503", ""), (False,)), ((None, None), (False,)), (("301", "x"), (False,))],
    lambda df: _policy(df), ("status", "text"),
)


def _policy(df):
    held = S.robots_policy(df.withColumn("status", F.col("status").cast("int")), "id", "status", "text")
    return S.allowed(held.select("id", F.lit("/private/x").alias("path")), S.robots_groups(held, "id", "text"), "id", "path", "bot")


_SITEMAP = """<?xml version="1.0"?><urlset xmlns:image="i" xmlns:video="v"><url><loc> https://e.example/?a=1&amp;b=2 </loc><lastmod>2024-05-06</lastmod><changefreq>Weekly</changefreq><priority>0.8</priority>
<xhtml:link rel="alternate" hreflang="de" href="https://e.example/de?x&amp;y"/><image:image><image:loc>https://e.example/i.png</image:loc></image:image><video:video><video:content_loc><![CDATA[https://e.example/v.mp4]]></video:content_loc></video:video></url>
<url><image:image><image:loc>https://e.example/only.png</image:loc></image:image></url><url><loc>https://e.example/b</loc><priority>high</priority></url><url><loc>broken</urlset>"""
_INDEX = "<sitemapindex><sitemap><loc>https://e.example/one.xml</loc></sitemap><sitemap><loc>https://other.example/two.xml</loc></sitemap></sitemapindex>"


def _shown(df):
    body = F.when(F.col("packed") == "gzip", F.unhex("body")).otherwise(F.encode("body", "UTF-8"))
    found = S.sitemap_files(df.select("id", "url", body.alias("body"), "content_type").withColumn("url", F.concat("url", F.lit("#"), F.col("id").cast("string"))))
    rows = found.select(F.split_part("url", F.lit("#"), F.lit(2)).cast("long").alias("id"), F.explode_outer("entries").alias("e"), "error")
    extra = F.concat_ws(" ", F.transform("e.alternates", lambda a: F.concat(a["lang"], F.lit("="), a["href"])), "e.images", "e.videos")
    return rows.select("id", "e.kind", "e.loc", "e.lastmod", "e.changefreq", "e.priority", F.nullif(extra, F.lit("")).alias("extra"), "error")


_add(
    "sitemap_files", "kind VARCHAR, loc VARCHAR, lastmod VARCHAR, changefreq VARCHAR, priority DOUBLE, extra VARCHAR, error VARCHAR",
    [
        (("https://e.example/s.xml", _SITEMAP, "", "application/xml"), [("url", "https://e.example/?a=1&b=2", "2024-05-06", "weekly", 0.8, "de=https://e.example/de?x&y https://e.example/i.png https://e.example/v.mp4", None), ("url", "https://e.example/b", None, None, None, None, None)]),
        (("https://e.example/i.xml", _INDEX, "", None), [("sitemap", "https://e.example/one.xml", None, None, None, None, None), ("sitemap", "https://other.example/two.xml", None, None, None, None, None)]),
        (("https://e.example/s.txt", "https://e.example/a\r\nnot a url\nhttps://e.example/b", "", None), [("url", "https://e.example/a", None, None, None, None, None), ("url", "https://e.example/b", None, None, None, None, None)]),
        (("https://e.example/z.xml.gz", gzip.compress(b"<urlset><url><loc>https://e.example/z</loc></url></urlset>", mtime=0).hex(), "gzip", "application/gzip"), [("url", "https://e.example/z", None, None, None, None, None)]),
        (("https://e.example/h.xml", "<html>", "", "text/html; charset=utf-8"), [(None, None, None, None, None, None, "no sitemap")]),
        (("https://e.example/e.xml", "<urlset/>", "", "text/xml"), [(None, None, None, None, None, None, "names no URL")]),
        (("https://e.example/n.xml", None, "", "text/xml"), [(None, None, None, None, None, None, "no answer")]),
    ],
    _shown, ("url", "body", "packed", "content_type"),
)


@query(
    """WITH RECURSIVE tree AS (SELECT 1 AS n UNION SELECT unnest([2 * n, 2 * n + 1]) FROM tree WHERE n < 500)
SELECT 'https://e.example/m' || n || '.xml' AS sitemap, 'https://e.example/p' || c_custkey AS loc FROM tree JOIN customer ON c_custkey % 999 + 1 = n"""
)
def sitemap_nesting(spark, sf_dir):
    """A thousand files, each an index of two more, with a page for each customer; every index names itself and one on another host, too."""
    n = F.col("n")
    maps = F.concat_ws("", F.transform(F.array(n, 2 * n, 2 * n + 1), lambda k: F.concat(F.lit("<sitemap><loc>https://e.example/m"), k.cast("string"), F.lit(".xml</loc></sitemap>"))), F.lit("<sitemap><loc>https://o.example/m1.xml</loc></sitemap>"))
    urls = read(spark, sf_dir, "customer").groupBy((F.col("c_custkey") % 999 + 1).alias("n")).agg(F.array_join(F.array_sort(F.collect_list(F.concat(F.lit("<url><loc>https://e.example/p"), F.col("c_custkey").cast("string"), F.lit("</loc></url>")))), "").alias("u"))
    files = spark.range(1, 1000).withColumnRenamed("id", "n").join(urls, "n", "left").select(F.concat(F.lit("https://e.example/m"), n.cast("string"), F.lit(".xml")).alias("url"), F.concat(F.when(n < 500, maps).otherwise(""), F.coalesce("u", F.lit(""))).cast("binary").alias("body"), F.lit("text/xml").alias("content_type"))
    return S.read_sitemaps(spark.createDataFrame([("https://e.example/m1.xml",)], "url string"), files).select("sitemap", "loc")


@query(
    """WITH o AS (SELECT s_suppkey AS k, 'https://h' || s_suppkey || '.example' AS origin FROM supplier)
SELECT origin, origin || '/listed.xml' AS url FROM o WHERE k % 2 = 0 UNION SELECT origin, origin || '/sitemap_index.xml.gz' FROM o WHERE k % 3 = 0
UNION SELECT origin, origin || '/sitemap.txt' FROM o WHERE k % 3 <> 0 AND k % 5 = 0"""
)
def sitemap_discovery(spark, sf_dir):
    k = F.col("s_suppkey")
    sup = read(spark, sf_dir, "supplier").select(k, F.concat(F.lit("https://h"), k.cast("string"), F.lit(".example")).alias("origin"))
    at = lambda path: F.concat("origin", F.lit(path)).alias("url")
    answers = sup.select(at("/sitemap.txt"), F.when(k % 5 == 0, 200).otherwise(404).alias("status")).unionByName(sup.select(at("/sitemap.xml"), F.lit(404).alias("status")))
    named = sup.where(k % 3 == 0).select(at("/sitemap_index.xml.gz")).unionByName(sup.select(at("/about.xml")))
    return S.discovered_sitemaps(sup.select("origin"), sup.where(k % 2 == 0).select("origin", at("/listed.xml")), named, answers)


@query("SELECT DISTINCT 'https://e.example/' || n AS url FROM (SELECT o_custkey AS n FROM orders UNION ALL SELECT unnest(range(1, 51)) UNION ALL VALUES (7), (9000000))")
def url_sources(spark, sf_dir):
    """A list file, seeds and a plugin's source together: an address for each order's customer, for 1 to 50, and two by hand."""
    from pagesift.sources import addresses

    addresses.register(spark)
    lines = read(spark, sf_dir, "orders").select(F.concat(F.lit(" https://e.example/"), F.col("o_custkey").cast("string"), F.lit(" # order")).alias("value"))
    plugin = spark.read.format("pagesift-urls").option("pattern", "https://e.example/{n}").option("count", 50).option("partitions", 3).load()
    return S.together(S.url_list(lines), S.seeds(spark, ["https://e.example/7", "https://e.example/9000000", "https://e.example/7"]), plugin)


# Caches


@query("SELECT o_orderkey AS key, ['pages', 'dns', 'robots', 'probes'][o_orderkey % 4 + 1] AS bucket FROM orders WHERE NOT (o_orderkey % 3 > 0 AND (o_orderkey % 100) * 7200 < [0, 60, 86400, 604800][o_orderkey % 4 + 1] AND o_orderkey % 4 <> 0)")
def cache_buckets(spark, sf_dir):
    """Entries for two of three orders, stored so many two hours ago as the key mod 100, in the store of one of four kinds."""
    k = F.col("o_orderkey")
    wanted = read(spark, sf_dir, "orders").select(k.alias("key"), F.element_at(F.array(*map(F.lit, ("pages", "dns", "robots", "probes"))), (k % 4 + 1).cast("int")).alias("bucket"))
    now = F.lit("2024-01-10 00:00:00").cast("timestamp")
    stored = wanted.where("key % 3 > 0").withColumn("stored_at", F.timestamp_seconds(F.unix_timestamp(now) - F.col("key") % 100 * 7200))
    return C.bucket_misses(wanted, stored, now)


def _map(*names):
    entries = F.filter(F.array(*[F.struct(F.lit(n.replace("_", "-")).alias("k"), F.col(n).alias("v")) for n in names]), lambda e: e["v"].isNotNull())
    return F.map_from_entries(entries)


_HTTP = ("status", "cache_control", "expires", "last_modified", "age")
_NOW = "Wed, 10 Jan 2024 00:00:00 GMT"
_add(
    "cache_freshness", "storable BOOLEAN, lifetime BIGINT, age BIGINT, fresh BOOLEAN",
    [
        (("200", "max-age=600", None, None, None), (True, 600, 0, True)),
        (("200", "max-age=600", None, None, "590"), (True, 600, 590, False)),
        (("200", "max-age=60", None, None, None), (True, 60, 0, False)),
        (("200", "no-store", None, None, None), (False, 0, 0, False)),
        (("200", "no-cache, max-age=600", None, None, None), (True, 0, 0, False)),
        (("500", None, "Wed, 10 Jan 2024 01:00:00 GMT", None, None), (True, 3600, 0, True)),
        (("200", None, "never", None, None), (True, 0, 0, False)),
        (("200", None, None, "Mon, 01 Jan 2024 00:00:00 GMT", None), (True, 77760, 0, False)),  # a tenth of nine days; its headers are silent, so the store's 60 s decide
        (("500", None, None, None, None), (False, 0, 0, False)),
    ],
    lambda df: df.withColumn("m", F.map_concat(_map(*_HTTP[1:]), F.create_map(F.lit("date"), F.lit(_NOW)))).withColumn("f", C.freshness(F.col("m"), F.col("status").cast("int"), F.lit("2024-01-10 00:00:00").cast("timestamp")))
    .select("id", "f.*", C.fresh(F.col("m"), F.col("status").cast("int"), F.lit("2024-01-10 00:00:00").cast("timestamp"), F.lit("2024-01-10 00:02:00").cast("timestamp"), 60).alias("fresh")),
    _HTTP,
)


@query(
    """WITH s AS (SELECT c_custkey AS k FROM customer WHERE c_custkey % 5 <> 0), n AS (SELECT c_custkey AS k, [304, 200, 404][c_custkey % 3 + 1] AS status FROM customer WHERE c_custkey % 4 <> 0)
SELECT coalesce(s.k, n.k) AS url, CASE WHEN n.k IS NULL OR (n.status = 304 AND s.k IS NOT NULL) THEN 200 ELSE n.status END AS status,
       CASE WHEN n.k IS NULL THEN 'old' ELSE 'new' END AS etag, CASE WHEN n.k IS NULL OR (n.status = 304 AND s.k IS NOT NULL) THEN 'text/html' END AS type,
       CASE WHEN n.k IS NULL OR (n.status = 304 AND s.k IS NOT NULL) THEN 'stored' WHEN n.status = 304 THEN NULL ELSE 'fresh' END AS body, coalesce(n.status = 304 AND s.k IS NOT NULL, false) AS revalidated FROM s FULL JOIN n ON s.k = n.k"""
)
def revalidation_merge(spark, sf_dir):
    k = F.col("c_custkey")
    c = read(spark, sf_dir, "customer").select(k)
    stored = c.where(k % 5 != 0).select(k.alias("url"), F.lit(200).alias("status"), F.create_map(F.lit("etag"), F.lit("old"), F.lit("content-type"), F.lit("text/html")).alias("headers"), F.lit("stored").alias("body"))
    status = F.element_at(F.array(F.lit(304), F.lit(200), F.lit(404)), (k % 3 + 1).cast("int"))
    answers = c.where(k % 4 != 0).select(k.alias("url"), status.alias("status"), F.create_map(F.lit("etag"), F.lit("new")).alias("headers"), F.when(status != 304, "fresh").alias("body"))
    merged = C.revalidated(stored, answers)
    return merged.select("url", "status", F.try_element_at("headers", F.lit("etag")).alias("etag"), F.try_element_at("headers", F.lit("content-type")).alias("type"), "body", "revalidated")


# Reports


@query(
    '''SELECT CASE c_custkey % 3 WHEN 0 THEN 'error,8.0' WHEN 1 THEN 'warning,5.0' ELSE 'hint,0.5' END || ',html/x,page,,"https://e.example/?a,b=' || c_custkey || '","said ""' || c_name || '""",,' || CASE WHEN c_custkey % 2 = 0 THEN '1:2 3:4' ELSE '' END AS line FROM customer'''
)
def report_csv(spark, sf_dir):
    k = F.col("c_custkey")
    found = read(spark, sf_dir, "customer").select(F.lit("page").alias("scope"), F.lit("html/x").alias("rule"), F.lit(None).cast("string").alias("group"), F.concat(F.lit("https://e.example/?a,b="), k.cast("string")).alias("url"), F.concat(F.lit('said "'), F.col("c_name"), F.lit('"')).alias("text"), F.when(k % 3 == 0, 8.0).when(k % 3 == 1, 5.0).otherwise(0.5).alias("score"), F.lit(None).cast("long").alias("occurrences"), F.when(k % 2 == 0, F.array(F.lit("1:2"), F.lit("3:4"))).otherwise(F.array().cast("array<string>")).alias("locations"))
    return W.csv_lines(found)


@query(
    """SELECT '{"ruleId":"html/x","level":"' || CASE c_custkey % 3 WHEN 0 THEN 'error' WHEN 1 THEN 'warning' ELSE 'note' END || '","message":{"text":"m"},"locations":[{"physicalLocation":{"artifactLocation":{"uri":"u' || c_custkey || '"}}}],"rank":' || CASE c_custkey % 3 WHEN 0 THEN '80.0' WHEN 1 THEN '50.0' ELSE '5.0' END
|| ',"occurrenceCount":' || c_custkey || CASE WHEN c_custkey % 2 = 0 THEN ',"relatedLocations":[{"id":0,"physicalLocation":{"artifactLocation":{"uri":"other"}}}]' ELSE '' END || '}' AS result FROM customer"""
)
def report_sarif(spark, sf_dir):
    k = F.col("c_custkey")
    own = F.concat(F.lit("u"), k.cast("string"))
    found = read(spark, sf_dir, "customer").select(F.lit("html/x").alias("rule"), own.alias("url"), F.lit("m").alias("text"), F.when(k % 3 == 0, 8.0).when(k % 3 == 1, 5.0).otherwise(0.5).alias("score"), k.alias("occurrences"), F.when(k % 2 == 0, F.array(own, F.lit("other"))).otherwise(F.array(own)).alias("samples"))
    return W.sarif_results(found)


_add(
    "report_checkstyle_escapes", "xml VARCHAR",
    [(("it's <b> & \"x\"", "8.0", "3:14"), ('<error line="3" column="14" severity="error" message="it&apos;s &lt;b&gt; &amp; &quot;x&quot;" source="r"/>',)), (("tab\there", "0.5", ""), ('<error severity="info" message="tab\\u{9}here" source="r"/>',))],
    lambda df: W.checkstyle_rows(df.select(F.col("id").cast("string").alias("url"), F.lit("r").alias("rule"), F.col("text"), F.col("score").cast("double").alias("score"), F.array("place").alias("locations"))).select(F.col("url").cast("long").alias("id"), "xml"),
    ("text", "score", "place"),
)

# Rules as data

_TITLE = R.Rule("t", "html.title", {"type": "string", "minLength": 3, "pattern": "^[A-Z]"}, text="{field}: {got}")
_IMAGES = R.Rule("i", "html.images", {"items": {"required": ["alt"], "properties": {"alt": {"maxLength": 2}}}})
_add(
    "rule_first_failure", "title VARCHAR, images VARCHAR",
    [(("ab", "x"), ("title: 2 characters: “ab”", None)), (("abc", "long"), ("title: 3 characters: “abc”", "html.images.0.alt breaks maxLength (got [{\"alt\":\"long\"}])")), ((None, None), ("title: none", "html.images.0 breaks required (got [{}])")), (("Abc", "ok"), (None, None))],
    lambda df: _failures(df), ("title", "alt"),
)


def _failures(df):
    facts = df.select("id", F.struct(F.col("title").alias("title"), F.array(F.struct(F.col("alt").alias("alt"))).alias("images")).alias("html"))
    told = lambda r: F.when(~R.verdict(facts, r), R.message(facts, r))
    return facts.select("id", told(_TITLE).alias("title"), told(_IMAGES).alias("images"))


_add(
    "rule_deep_equality", "list BOOLEAN, object BOOLEAN, one_of BOOLEAN",
    [(("a b", "1", "x"), (True, True, True)), (("b a", "1", "y"), (False, True, True)), (("a b c", "2", "z"), (False, False, False)), ((None, None, None), (False, False, False))],
    lambda df: _equal(df), ("l", "o", "e"),
)


def _equal(df):
    facts = df.select("id", F.struct(F.when(F.col("l").isNotNull(), F.split("l", " ")).alias("l"), F.struct(F.col("o").cast("int").alias("n")).alias("o"), F.col("e").alias("e")).alias("f"))
    ok = lambda path, schema: R.expectation(R.fact(facts, path), schema)
    return facts.select("id", ok("f.l", {"const": ["a", "b"]}).alias("list"), ok("f.o", {"const": {"n": 1}}).alias("object"), ok("f.e", {"enum": ["x", "y", ["a"]]}).alias("one_of"))


@query("SELECT page_id, CASE WHEN url LIKE 'https:%' THEN lower(regexp_extract(html, '(?is)<html[^>]*\\slang=[\"'']?([A-Za-z0-9-]+)', 1)) = 'en' END AS ok FROM pages")
def rule_site_guard(spark, sf_dir):
    """A rule for staging sites, over https pages; the site's one row says that it is one. A rule for production sites judges none of them."""
    from pagesift.functions import html as H
    from pagesift.functions import urls as U

    facts = read(spark, sf_dir, "pages").select("page_id", U.split_url(F.col("url")).alias("url"), F.struct(H.lang(F.col("html")).alias("lang")).alias("html"))
    pages = R.with_site(facts, spark.createDataFrame([("staging",)], "role string"))
    guards = {"url.protocol": "https:", "site.role": {"enum": ["staging"]}}
    mine, other = R.Rule("a", "html.lang", {"const": "en"}, when=guards), R.Rule("b", "html.lang", {"const": "en"}, when={"site.role": "production"})
    return pages.select("page_id", F.coalesce(R.verdict(pages, mine), R.verdict(pages, other)).alias("ok"))


@query(
    """SELECT 'h' || s_suppkey AS name, rule FROM supplier, (VALUES ('caa'), ('caa-linked'), ('probe')) r(rule)
WHERE (rule = 'caa' AND s_suppkey % 2 = 0 AND s_suppkey % 3 <> 0 AND s_suppkey % 4 > 0) OR (rule = 'caa-linked' AND s_suppkey % 2 = 0 AND s_suppkey % 3 <> 0) OR (rule = 'probe' AND s_suppkey % 5 = 1 AND s_suppkey % 4 > 0)"""
)
def rule_subjects(spark, sf_dir):
    """Hosts, a quarter of them only linked, half with DNS facts, a third of these with the record; of probes every fifth failed, every fifth was withheld."""
    k = F.col("s_suppkey")
    dns = F.when(k % 2 == 0, F.struct(F.when(k % 3 == 0, F.array(F.lit("0 issue"))).alias("caa")))
    probe = F.struct(F.struct(F.when(k % 5 == 1, 500).when(k % 5 != 2, 200).alias("status"), (k % 5 == 2).alias("disallowed")).alias("login"))
    subjects = read(spark, sf_dir, "supplier").select(F.concat(F.lit("h"), k.cast("string")).alias("name"), (k % 4 == 0).alias("linked"), dns.alias("dns"), probe.alias("probes"))
    rules = [
        R.Rule("caa", "site.hosts.*.dns.caa", {"type": "array", "minItems": 1}), R.Rule("caa-linked", "site.hosts.*.dns.caa", {"type": "array"}, linked=True), R.Rule("probe", "site.hosts.*.probes.login.status", {"const": 200}),
        R.Rule("origin", "site.origins.*.dns.caa", {"type": "array"}), R.Rule("guarded", "site.hosts.*.dns.caa", {"type": "array"}, when={"site.hosts.*.dns.caa": {"minItems": 9, "type": "array"}}),
    ]
    return R.subject_findings(subjects, rules, "hosts").select("name", "rule")


@query(
    """WITH k AS (SELECT p_partkey % 8 AS k, p_partkey FROM part) SELECT p_partkey AS page, rule, severity FROM k, (VALUES (0, 'a/one', 'hint'), (1, 'a/one', 'hint'), (1, 'a/two', 'error'), (2, 'b/three', 'info'), (3, 'a/two', 'error')) v(x, rule, severity)
WHERE k % 4 = x"""
)
def ruleset_resolve(spark, sf_dir):
    """Rules of a ruleset that extends two, with a level pinned, keywords merged, one off and one excluded, over parts as pages: n is the key mod 4."""
    from pagesift.operators.rulesets import Rulesets, compiled

    base = {"rules": {"a/one": {"fact": "f.n", "expect": {"minimum": 1, "maximum": 3}, "severity": "warning", "score": 5.0}, "a/two": {"fact": "f.n", "expect": {"enum": [0, 2]}, "severity": "error"}, "b/gone": {"fact": "f.n", "expect": {"const": 9}, "severity": "error"}}}
    more = {"extends": ["base"], "rules": {"b/three": {"fact": "f.n", "expect": {"not": {"const": 2}}, "severity": "info"}, "c/four": {"fact": "f.n", "expect": {"const": 9}, "severity": "error"}}}
    own = {"mine": {"extends": ["base", "more"], "rules": {"a/one": {"severity": "hint", "expect": {"minimum": 2}}, "b/gone": "off"}}}
    rules, _ = compiled(Rulesets({"base": base, "more": more}, own).select(["mine"], exclude=["c/*"]))
    pages = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("page"), F.struct((F.col("p_partkey") % 4).alias("n")).alias("f"))
    return R.findings(pages, rules, ["page"]).select("page", "rule", "severity")


# Structured data

_LD = '{"@context": "https://schema.org", "@graph": [{"@type": ["https://schema.org/Article"], "@id": "#a", "author": {"@id": "#kim"}, "publisher": {"@type": "Organization", "name": "Pub"}}, {"@id": "https://e.example/q#x"}]}'
_CRUMBS = '[{"@type": "BreadcrumbList", "itemListElement": [{"item": "/one"}, {"item": {"@id": "/two"}}, {"name": "three"}, {"item": "/one"}]}]'
_add(
    "jsonld_nodes", "path VARCHAR, node VARCHAR, types VARCHAR, name VARCHAR, defines BOOLEAN, crumbs VARCHAR",
    [
        ((_LD, "https://e.example/p"), [("", None, "", None, False, ""), ("@graph.0", "https://e.example/p#a", "Article", None, True, ""), ("@graph.0.author", "https://e.example/p#kim", "", None, False, ""), ("@graph.0.publisher", None, "Organization", "Pub", False, ""), ("@graph.1", "https://e.example/q#x", "", None, False, "")]),
        ((_CRUMBS, "https://e.example/p"), [("0", None, "BreadcrumbList", None, False, "https://e.example/one https://e.example/two"), ("0.itemListElement.0", None, "", None, False, ""), ("0.itemListElement.1", None, "", None, False, ""), ("0.itemListElement.1.item", "https://e.example/two", "", None, False, ""), ("0.itemListElement.2", None, "", "three", False, ""), ("0.itemListElement.3", None, "", None, False, "")]),
        (("{broken", "https://e.example/p"), []), ((None, "https://e.example/p"), []),
    ],
    lambda df: df.select("id", F.explode(J.nodes(F.array("ld"), F.col("url"))).alias("n")).select("id", "n.path", F.col("n.id").alias("node"), F.array_join("n.types", " ").alias("types"), "n.name", "n.defines", F.array_join("n.crumbs", " ").alias("crumbs")),
    ("ld", "url"),
)


def _marked(spark, sf_dir, *only):
    """A page for each order that defines a node, refers to one of the page of its customer's key, and has a trail; as JSON-LD,
    microdata or RDFa."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    page = lambda n: F.concat(F.lit("https://e.example/"), n.cast("string"))
    there, blank = F.concat(page(c), F.lit("#"), F.when(c % 2 == 0, "me").otherwise("you")), F.when(k % 3 == 0, "a").otherwise("b")
    ld = F.concat(F.lit('{"@graph": [{"@id": "#me", "name": "x"}, {"@id": "'), there, F.lit('"}, {"@id": "_:'), blank, F.lit('"}, {"@id": "_:a", "name": "y"}, {"@type": "BreadcrumbList", "itemListElement": [{"item": "'), page(c), F.lit('"}]}]}'))
    item = lambda scope, own, prop, trail: F.concat(
        F.lit(f'<main><p {scope} {own}="#me"><b {prop}="name">x</b></p><p {scope} {own}="'), there, F.lit(f'"></p><p {scope} {own}="_:'), blank,
        F.lit(f'"></p><p {scope} {own}="_:a"><b {prop}="name"> y\n</b></p><ol {trail}><li {prop}="itemListElement" {scope}><a {prop}="item" href="/'), c.cast("string"), F.lit('">up</a></li></ol></main>'),
    )
    html = F.when(k % 4 == 2, item("itemscope", "itemid", "itemprop", 'itemscope itemtype="https://schema.org/BreadcrumbList"')).when(k % 4 == 3, item('typeof=""', "resource", "property", 'typeof="schema:BreadcrumbList"')).otherwise("<main></main>")
    orders = dealt_out(read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), "o_orderkey")
    pages = orders.select(k, page(k).alias("href"), F.when(k % 4 < 2, F.array(ld)).alias("ld"), html.alias("html"))
    pages = pages.withColumn("jsonld", J.all_blocks(F.col("ld"), F.col("html"), F.col("href")))
    return J.page_nodes(pages, only=only), read(spark, sf_dir, "orders").select(k, page(k).alias("href")).select("href", F.when(k % 5 == 0, 404).otherwise(200).alias("status"), k)


def _products(spark, sf_dir):
    """Nodes of a page for each part in one of three syntaxes; some lack a name, some dates are no dates."""
    k, name, size = F.col("p_partkey"), F.col("p_name"), F.col("p_size")
    date = F.when(size % 2 == 0, F.concat(F.lit("2024-01-"), F.lpad((size % 28 + 1).cast("string"), 2, "0"))).otherwise(F.concat(size.cast("string"), F.lit("/2024")))
    named = lambda before, after: F.when(size % 5 > 0, F.concat(F.lit(before), name, F.lit(after))).otherwise("")
    ld = F.concat(F.lit('{"@type": "Product", '), named('"name": "', '", '), F.lit('"releaseDate": "'), date, F.lit('", "brand": {"@type": "Brand", "name": "'), F.col("p_brand"), F.lit('"}}'))
    item = lambda product, brand, prop: F.concat(F.lit(f"<div {product}>"), named(f"<h1 {prop}='name'>", "</h1>"), F.lit(f"<time {prop}='releaseDate' datetime='"), date, F.lit(f"'>soon</time><p {prop}='brand' {brand}>by <b {prop}='name'>"), F.col("p_brand"), F.lit("</b></div>"))
    html = F.when(k % 3 == 1, item("itemscope itemtype='https://schema.org/Product'", "itemscope itemtype='https://schema.org/Brand'", "itemprop")).when(k % 3 == 2, item("vocab='https://schema.org/' typeof='Product'", "typeof='Brand'", "property"))
    href = F.concat(F.lit("https://p.example/"), k.cast("string"))
    pages = read(spark, sf_dir, "part").select(href.alias("href"), F.when(k % 3 == 0, F.array(ld)).alias("ld"), html.alias("html"))
    return J.page_nodes(pages.withColumn("jsonld", J.all_blocks(F.col("ld"), F.col("html"), F.col("href"))))


@query("""
SELECT 'https://p.example/' || p_partkey AS href, '' AS path, 'Product' AS types, CASE WHEN p_size % 5 > 0 THEN p_name END AS name FROM part
UNION ALL SELECT 'https://p.example/' || p_partkey, 'brand', 'Brand', p_brand FROM part""")
def markup_nodes(spark, sf_dir):
    """Nodes are the same in whichever syntax a page has them."""
    return _products(spark, sf_dir).select("href", "path", F.array_join("types", " ").alias("types"), "name")


@query("""
SELECT 'https://p.example/' || p_partkey AS href, 'missing' AS fault, 'name' AS what FROM part WHERE p_size % 5 = 0
UNION ALL SELECT 'https://p.example/' || p_partkey, 'releaseDate', p_size || '/2024' FROM part WHERE p_size % 2 <> 0""")
def markup_faults(spark, sf_dir):
    found = _products(spark, sf_dir)
    missing = J.missing_properties(found).select("href", F.lit("missing").alias("fault"), F.array_join("missing", " ").alias("what"))
    return missing.unionByName(J.invalid_dates(found).select("href", F.col("property").alias("fault"), F.col("value").alias("what")))


_PAGE = "'https://e.example/' || "


@query(
    f"""WITH o AS (SELECT o_orderkey AS k, o_custkey AS c FROM orders)
SELECT {_PAGE} c || '#you' AS id, count(DISTINCT k) AS pages FROM o WHERE c % 2 = 1 AND c IN (SELECT k FROM o) GROUP BY c
UNION ALL SELECT '_:b', count(*) FROM o WHERE k % 3 <> 0 HAVING count(*) > 0"""
)
def jsonld_dangling(spark, sf_dir):
    return J.dangling(_marked(spark, sf_dir, "id", "defines")[0])


@query(
    f"""WITH o AS (SELECT o_orderkey AS k, o_custkey AS c FROM orders), f AS (SELECT o.c, o.k, CASE WHEN o.c % 7 = 0 THEN 'redirects to /new' WHEN t.k % 5 = 0 THEN 'answers 404' END AS fault FROM o LEFT JOIN o t ON t.k = o.c)
SELECT {_PAGE} c AS url, fault, count(*) AS pages FROM f WHERE fault IS NOT NULL GROUP BY ALL"""
)
def breadcrumb_status(spark, sf_dir):
    nodes, pages = _marked(spark, sf_dir, "crumbs")
    moved = read(spark, sf_dir, "customer").where("c_custkey % 7 = 0").select(F.concat(F.lit("https://e.example/"), F.col("c_custkey").cast("string")).alias("from"), F.lit("/new").alias("to"))
    return J.unreachable_crumbs(nodes, pages, moved)


# Relations


@query("SELECT DISTINCT l_orderkey AS page, l_suppkey AS origin FROM lineitem WHERE l_suppkey <> l_orderkey % 10 AND l_returnflag <> 'N' AND (l_orderkey, l_suppkey) NOT IN (SELECT (l_orderkey, l_suppkey) FROM lineitem WHERE l_linenumber % 2 = 0)")
def blocking_origins_cold(spark, sf_dir):
    line = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("page"), F.col("l_suppkey").alias("origin"), (F.col("l_orderkey") % 10).alias("own"), "l_returnflag", "l_linenumber")
    return K.cold_origins(line.where("l_returnflag <> 'N'"), line.where("l_linenumber % 2 = 0").select("page", "origin"))


@query("SELECT l_partkey AS target, CASE WHEN l_partkey % 4 = 0 THEN 404 END AS status, count(DISTINCT l_orderkey) AS pages FROM lineitem WHERE l_partkey % 4 = 0 OR l_partkey % 9 = 5 GROUP BY l_partkey")
def sitemap_media_broken(spark, sf_dir):
    media = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("href"), F.col("l_partkey").alias("target"))
    k = F.col("p_partkey")
    probes = read(spark, sf_dir, "part").select(k.alias("url"), F.when(k % 4 == 0, 404).when(k % 9 == 5, F.lit(None)).when(k % 9 == 6, 429).otherwise(200).cast("int").alias("status"), F.lit(False).alias("excluded"), F.lit(None).cast("boolean").alias("refused"), F.lit(False).alias("walled"))
    return K.broken_media(media, probes)


@query(
    """WITH a AS (SELECT DISTINCT o_custkey AS page, o_orderkey % 400 AS href FROM orders WHERE o_custkey <> o_orderkey % 400),
f AS (SELECT page, href, CASE WHEN href % 11 = 0 THEN 'redirects' WHEN href % 7 = 0 AND c_custkey IS NOT NULL THEN 'answers 410' END AS fault FROM a LEFT JOIN customer ON c_custkey = href)
SELECT href, fault, count(*) AS pages FROM f WHERE fault IS NOT NULL GROUP BY ALL"""
)
def hreflang_target_status(spark, sf_dir):
    alternates = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("page"), (F.col("o_orderkey") % 400).alias("href"))
    pages = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("href"), F.when(F.col("c_custkey") % 7 == 0, 410).otherwise(200).alias("status"))
    return K.unreachable_alternates(alternates, pages, spark.range(0, 400, 11).select(F.col("id").alias("from"), F.lit("x").alias("to")))


@query("SELECT o_custkey % 60 AS url, count(DISTINCT o_orderkey) AS pages, count(DISTINCT o_orderpriority) AS titles FROM orders WHERE o_orderkey % 3 = 0 AND o_custkey % 60 < 40 GROUP BY 1")
def feed_advertised(spark, sf_dir):
    k = F.col("o_orderkey")
    heads = read(spark, sf_dir, "orders").select(k.alias("page"), (F.col("o_custkey") % 60).alias("href"), F.when(k % 3 == 2, "icon").otherwise("home Alternate").alias("rel"), F.when(k % 3 == 0, "application/RSS+xml").otherwise("text/html").alias("type"), F.col("o_orderpriority").alias("title"))
    return K.advertised_feeds(spark.range(40).withColumnRenamed("id", "url"), heads)


@query(
    """WITH u AS (SELECT l_orderkey AS page, l_partkey AS url FROM lineitem), f AS (SELECT p_partkey AS url, CASE p_partkey % 3 WHEN 0 THEN 404 ELSE 200 END AS status, p_size AS hours FROM part WHERE p_partkey % 4 > 0)
SELECT url, count(DISTINCT page) AS pages FROM u WHERE url NOT IN (SELECT url FROM f WHERE NOT (status >= 400 AND hours > 20)) GROUP BY url"""
)
def resources_unread(spark, sf_dir):
    """Failures stay for twenty hours; parts were fetched as many hours ago as their size."""
    now = F.lit("2024-01-10 00:00:00").cast("timestamp")
    fetched = read(spark, sf_dir, "part").where("p_partkey % 4 > 0").select(F.col("p_partkey").alias("url"), F.when(F.col("p_partkey") % 3 == 0, 404).otherwise(200).alias("status"), F.lit(None).cast("long").alias("bytes"), F.col("p_size").cast("long").alias("declared"), F.timestamp_seconds(F.unix_timestamp(now) - F.col("p_size") * 3600).alias("fetched_at"))
    return K.unread(read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("page"), F.col("l_partkey").alias("url")), fetched, now, 20 * 3600)


@query(
    """WITH RECURSIVE w AS (SELECT 1::BIGINT AS url, 0 AS depth UNION SELECT unnest([url * 2, url * 3]), depth + 1 FROM w WHERE url * 2 <= (SELECT max(c_custkey) FROM customer) AND depth < 40)
SELECT url, min(depth) AS depth FROM w WHERE url <= (SELECT max(c_custkey) FROM customer) GROUP BY url"""
)
def crawl_frontier(spark, sf_dir):
    """Customer n links to 2n and 3n."""
    c = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("href"))
    links = c.select("href", F.explode(F.array(F.col("href") * 2, F.col("href") * 3)).alias("target")).join(c.select(F.col("href").alias("target")).hint("merge"), "target", "left_semi")
    return K.crawl_frontier(spark.createDataFrame([(1,)], "url long"), links)


# Mail

_SPF = [
    ("v=spf1 ip4:192.0.2.0/24 include:x.example -all", ("", 0, False, False)), ("v=spf1 a mx/33 -all", ("malformed: mx/33", 0, False, False)), ("v=spf1 -all mx include:y", ("", 2, False, False)), ("V=SPF1 redirect=a redirect=b -all", ("again: redirect", 0, True, False)),
    ("v=spf1 ptr ip4:1.2.3 ~all", ("malformed: ip4:1.2.3", 0, False, True)), ("v=spf10 all", None), ("v=spf1 a:Mail.example//64 exists:%{i}.x +mx:y/24 ip6:2001:db8::/32 ?all exp=e.example", ("", 0, False, False)),
]
_add("spf_faults", "errors VARCHAR, after_all BIGINT, redundant BOOLEAN, ptr BOOLEAN", [(a, [b] if b else []) for a, b in _SPF], lambda df: M.spf_faults(df.select(F.col("id").cast("string").alias("name"), F.col("h").alias("record"))).select(F.col("name").cast("long").alias("id"), F.array_join("errors", "; ").alias("errors"), "after_all", "redundant", "ptr"))


@query(
    """SELECT 'H' || s_suppkey || '.D' || s_suppkey % 20 || '.example' AS host, CASE WHEN s_suppkey % 3 = 0 THEN 'h' || s_suppkey || '.' ELSE '' END || 'd' || s_suppkey % 20 || '.example' AS at,
CASE WHEN s_suppkey % 3 = 0 THEN 'none' WHEN s_suppkey % 20 % 2 = 0 THEN 'quarantine' ELSE 'reject' END AS policy, CASE WHEN s_suppkey % 3 = 0 THEN 'wrong: pct' ELSE '' END AS errors FROM supplier WHERE s_suppkey % 3 = 0 OR s_suppkey % 20 <> 7"""
)
def dmarc_policy(spark, sf_dir):
    """Every third host has a record of its own, domains have one, of which half have a policy for their hosts; one domain has two records, so none."""
    k = F.col("s_suppkey")
    host = F.concat(F.lit("H"), k.cast("string"), F.lit(".D"), (k % 20).cast("string"), F.lit(".example"))
    sup = read(spark, sf_dir, "supplier").select(k, host.alias("host"))
    own = sup.where(k % 3 == 0).select(F.col("host").alias("name"), F.lit("v=DMARC1; p=none; pct=120").alias("record"))
    d = spark.range(20).withColumnRenamed("id", "d")
    domains = d.unionByName(d.where("d = 7")).select(F.concat(F.lit("d"), F.col("d").cast("string"), F.lit(".example")).alias("name"), F.concat(F.lit("v=DMARC1;p=reject"), F.when(F.col("d") % 2 == 0, ";sp=quarantine").otherwise("")).alias("record"))
    return M.dmarc(sup, own.unionByName(domains)).withColumn("errors", F.array_join("errors", "; "))


# Observations


@query(
    """WITH m AS (SELECT l_orderkey AS page, l_returnflag AS rule, l_linestatus AS text, l_linenumber AS line, (l_partkey % 3)::INT AS col FROM lineitem), d AS (SELECT page, rule, text, line, col, count(*) AS c FROM m GROUP BY ALL)
SELECT page, rule, text, sum(c)::BIGINT AS n, array_to_string(list(line || ':' || col ORDER BY line, col)[1:3], ' ') AS places FROM d WHERE rule <> 'A' GROUP BY ALL"""
)
def linter_messages(spark, sf_dir):
    line = read(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("page")).agg(F.collect_list(F.struct(F.col("l_returnflag").alias("rule"), F.col("l_linestatus").alias("text"), F.col("l_linenumber").alias("line"), (F.col("l_partkey") % 3).cast("int").alias("column"))).alias("messages"))
    return O.message_findings(line).where("rule <> 'A'").withColumn("places", F.array_join("places", " "))


@query("SELECT 'h' || c_custkey AS host, 4 AS algorithm FROM customer WHERE c_custkey % 3 = 1 OR (c_custkey % 3 = 2 AND c_custkey % 2 = 0)")
def sshfp_unmatched(spark, sf_dir):
    """Two of three hosts have records, those of half of one third are of another key."""
    k = F.col("c_custkey")
    keys = read(spark, sf_dir, "customer").select(k, F.concat(F.lit("h"), k.cast("string")).alias("host"), F.lit(4).alias("algorithm"), F.base64(F.encode("c_name", "UTF-8")).alias("key"))
    digest = F.when(k % 3 == 0, F.upper(F.sha1("c_name"))).otherwise(F.sha2(F.when(k % 2 == 0, F.concat("c_name", F.lit("x"))).otherwise(F.col("c_name")), 256))
    records = read(spark, sf_dir, "customer").where(k % 3 != 1).select(F.concat(F.lit("h"), k.cast("string")).alias("host"), F.lit(4).alias("algorithm"), F.when(k % 3 == 0, 1).otherwise(2).alias("kind"), digest.alias("digest"))
    return O.unmatched_keys(keys.drop("c_custkey"), records)


@query(
    """WITH a AS (SELECT o_custkey AS origin, o_orderpriority AS agent, CASE WHEN o_orderkey % 4 = 0 THEN 403 ELSE 200 END AS status, CASE WHEN o_orderkey % 2 = 0 THEN 'search' ELSE 'browser' END AS kind FROM orders)
SELECT origin, array_to_string(list_sort(list(DISTINCT agent)), ' ') AS agents FROM a WHERE kind = 'search' AND status >= 400 AND origin IN (SELECT origin FROM a WHERE kind = 'browser') GROUP BY origin"""
)
def crawlers_turned_away(spark, sf_dir):
    k = F.col("o_orderkey")
    return O.turned_away(read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("origin"), F.col("o_orderpriority").alias("agent"), F.when(k % 2 == 0, "search").otherwise("browser").alias("kind"), F.when(k % 4 == 0, 403).otherwise(200).alias("status")))


@query(
    """WITH i AS (SELECT l_orderkey AS page, l_partkey AS href, CASE l_linenumber % 3 WHEN 0 THEN '16x16 32X32' WHEN 1 THEN 'any' END AS sizes, CASE WHEN l_linenumber % 2 = 0 THEN 'image/PNG' END AS type FROM lineitem),
m AS (SELECT p_partkey AS href, CASE WHEN p_partkey % 5 = 0 THEN 404 ELSE 200 END AS status, (p_size % 3 + 1) * 16 AS w, CASE WHEN p_partkey % 2 = 0 THEN 'image/png' ELSE 'image/x-icon' END AS real FROM part WHERE p_partkey % 7 > 0),
f AS (SELECT page, href, CASE WHEN status IS NULL OR status = 404 THEN 'missing' WHEN sizes LIKE '16%' AND w = 48 THEN 'is 48x48' WHEN type IS NOT NULL AND real <> 'image/png' THEN 'is image/x-icon' END AS fault FROM i LEFT JOIN m USING (href))
SELECT page, href, fault FROM f WHERE fault IS NOT NULL"""
)
def icon_faults(spark, sf_dir):
    n, p = F.col("l_linenumber"), F.col("p_partkey")
    declared = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("page"), F.col("l_partkey").alias("href"), F.when(n % 3 == 0, "16x16 32X32").when(n % 3 == 1, "any").alias("sizes"), F.when(n % 2 == 0, "image/PNG").alias("type"))
    width = (F.col("p_size") % 3 + 1) * 16
    measured = read(spark, sf_dir, "part").where(p % 7 > 0).select(p.alias("href"), F.when(p % 5 == 0, 404).otherwise(200).alias("status"), width.alias("width"), width.alias("height"), F.when(p % 2 == 0, "image/png").otherwise("image/x-icon").alias("type"))
    return O.icon_faults(declared, measured)


@query("SELECT 'a' || c_custkey AS address, c_custkey % 3 = 0 AS confirmed FROM customer WHERE c_custkey % 4 > 0")
def forward_confirmed_names(spark, sf_dir):
    k = F.col("c_custkey")
    c = read(spark, sf_dir, "customer").select(k, F.concat(F.lit("a"), k.cast("string")).alias("address"), F.concat(F.lit("Name"), k.cast("string")).alias("name"))
    leads = F.when(k % 3 == 0, F.col("address")).otherwise("other")
    return O.forward_confirmed(c.where(k % 4 > 0).select("address", "name").unionByName(c.where(k % 8 == 1).select("address", F.lit("unknown").alias("name"))), c.where(k % 3 < 2).select(F.lower("name").alias("name"), leads.alias("address")))


# Joined streams


@query("SELECT a.event_id AS left_id, b.event_id AS right_id FROM events a JOIN events b ON a.user_id = b.user_id AND b.ts >= a.ts AND b.ts <= a.ts + INTERVAL 30 MINUTE WHERE a.event_type = 'view' AND b.event_type = 'click'")
def stream_stream_join(spark, sf_dir):
    """Views and the clicks of the same user within half an hour, each read as a stream, run until all is read."""
    import uuid

    from pagesift.sources.scratch import shared
    from pagesift.streaming import windows

    folder = f"{shared(spark)}/joined-{uuid.uuid4().hex}"
    table = read(spark, sf_dir, "events")

    def stream(kind: str, names: tuple[str, str]):
        rows = spark.readStream.schema(table.schema).option("pathGlobFilter", "*.parquet").parquet(f"{sf_dir}/events.parquet*")
        return rows.where(F.col("event_type") == kind).select("user_id", F.col("event_id").alias(names[0]), F.col("ts").cast("timestamp").alias(names[1]))

    both = windows.joined(stream("view", ("left_id", "at")), stream("click", ("right_id", "later")), ["user_id"], "at", "later", "30 MINUTES")
    return windows.drained(both.select("left_id", "right_id"), f"{folder}/out", f"{folder}/checkpoint")


def html_robots(spark, sf_dir):
    """Directives of the pages' own markup, through the parser; four pages in five are given an element in their head."""
    from pagesift.functions import headers as H

    n = F.col("page_id")
    said = F.when(n % 5 == 1, "noindex").when(n % 5 == 2, "NoFollow, noai").when(n % 5 == 3, "none").when(n % 5 == 4, "index, follow")
    html = F.when(said.isNull(), F.col("html")).otherwise(F.regexp_replace(F.col("html"), F.lit("(?i)<title"), F.concat(F.lit("<meta name=robots content='"), said, F.lit("'><title"))))
    pages = read(spark, sf_dir, "pages").select("page_id", D.page(html, F.col("url")).alias("f"))
    return pages.select("page_id", H.robots_directives(F.try_element_at("f.meta", F.lit("robots")), F.lit(None).cast("string")).alias("r")).select("page_id", "r.*")


QUERIES["html_robots"] = html_robots
SQL["html_robots"] = "SELECT page_id, page_id % 5 IN (1, 3) AS noindex, page_id % 5 IN (2, 3) AS nofollow, page_id % 5 = 2 AS noai FROM pages"
