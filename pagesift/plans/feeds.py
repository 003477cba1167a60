"""Queries over feeds: documents of all four formats are made of parts, and read again."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagesift.operators import feeds as O
from pagesift.plans.pages import read
from pagesift.sources.scratch import dealt_out

QUERIES: dict = {}
SQL: dict[str, str] = {}


def _feeds(spark, sf_dir):
    """A feed of two items for each part: RSS 2.0, Atom, RSS 1.0 or JSON Feed. Some second items repeat the first one's id,
    some dates name a wrong weekday or aren't dates."""
    k, size, name, brand = F.col("p_partkey"), F.col("p_size"), F.col("p_name"), F.col("p_brand")
    day = F.expr("timestamp'2024-01-01 10:00:00' + make_dt_interval(p_size)")
    wrong = size % 7 == 0
    named = lambda t: F.date_format(t, "EEE")
    mail_date = F.concat(F.when(wrong, named(F.expr("timestamp'2024-01-02 10:00:00' + make_dt_interval(p_size)"))).otherwise(named(day)), F.date_format(day, ", dd MMM yyyy HH:mm:ss"), F.lit(" GMT"))
    net_date = F.when(wrong, F.date_format(day, "yyyy-MM-dd HH:mm")).otherwise(F.date_format(day, "yyyy-MM-dd'T'HH:mm:ssXXX"))
    one, two = (F.concat(F.lit(f"urn:{x}:"), k.cast("string")) for x in "ab")
    two = F.when(size % 5 == 0, one).otherwise(two)
    link = lambda x: F.concat(F.lit(f"https://p.example/{x}/"), k.cast("string"))
    made = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    rss = lambda i, x, t: made("<item><title>", t, f"</title><link>", link(x), "</link><guid isPermaLink='false'>", i, "</guid><pubDate>", mail_date, "</pubDate><description><![CDATA[<b>", brand, "</b> one two]]></description></item>")  # noqa: E731, F541
    atom = lambda i, x, t: made("<a:entry><a:title>", t, "</a:title><a:link href='", link(x), "'/><a:id>", i, "</a:id><a:updated>", net_date, "</a:updated><a:summary>", brand, " one two</a:summary></a:entry>")
    rdf = lambda i, x, t: made("<r:item rdf:about='", i, "'><r:title>", t, "</r:title><r:link>", link(x), "</r:link><dc:date>", net_date, "</dc:date><r:description>", brand, " one two</r:description></r:item>")
    js = lambda i, x, t: made('{"id": "', i, '", "url": "', link(x), '", "title": "', t, '", "date_published": "', net_date, '", "content_text": "', brand, ' one two"}')
    items = lambda of: made(of(one, "a", name), of(two, "b", brand))
    body = (
        F.when(k % 4 == 0, made("<?xml version='1.0'?><rss version='2.0'><channel><title>t</title><link>https://p.example/</link><description>d</description><language>en-GB</language>", items(rss), "</channel></rss>"))
        .when(k % 4 == 1, made("<a:feed xmlns:a='http://www.w3.org/2005/Atom' xml:lang='x y'><a:id>f</a:id><a:title>t</a:title><a:updated>2024-01-01T00:00:00Z</a:updated><a:author><a:name>n</a:name></a:author>", items(atom), "</a:feed>"))
        .when(k % 4 == 2, made("<rdf:RDF xmlns:rdf='http://www.w3.org/1999/02/22-rdf-syntax-ns#' xmlns:r='http://purl.org/rss/1.0/' xmlns:dc='http://purl.org/dc/elements/1.1/'><r:channel><r:title>t</r:title><r:link>/</r:link></r:channel>", items(rdf), "</rdf:RDF>"))
        .otherwise(made('{"version": "https://jsonfeed.org/version/1", "title": "t", "items": [', js(one, "a", name), ", ", js(two, "b", brand), "]}"))
    )
    parts = dealt_out(read(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", "p_size"), "p_partkey")
    return O.parsed(parts.select(F.concat(F.lit("https://p.example/feed/"), k.cast("string")).alias("url"), body.alias("body")))


def feed_model(spark, sf_dir):
    """Items are the same in whichever format a feed is."""
    return O.items(_feeds(spark, sf_dir)).withColumn("at", F.unix_timestamp("at")).drop("format")


_AT = "CASE WHEN p_size % 7 <> 0 THEN epoch(TIMESTAMP '2024-01-01 10:00:00' + to_days(p_size))::BIGINT END"
SQL["feed_model"] = f"""
SELECT 'https://p.example/feed/' || p_partkey AS url, 1 AS position, 'urn:a:' || p_partkey AS id, 'https://p.example/a/' || p_partkey AS link, p_name AS title, {_AT} AS at, 3 AS words FROM part
UNION ALL SELECT 'https://p.example/feed/' || p_partkey, 2, CASE WHEN p_size % 5 = 0 THEN 'urn:a:' ELSE 'urn:b:' END || p_partkey, 'https://p.example/b/' || p_partkey, p_brand, {_AT}, 3 FROM part"""


def feed_faults(spark, sf_dir):
    """Faults of each feed by kind."""
    return O.faults(_feeds(spark, sf_dir)).groupBy("url", "fault").agg(F.count("*").alias("n"), F.min("position").alias("first"))


SQL["feed_faults"] = """
WITH p AS (SELECT 'https://p.example/feed/' || p_partkey AS url, p_partkey % 4 AS f, p_size AS s FROM part)
SELECT url, 'date' AS fault, 2::BIGINT AS n, 1 AS first FROM p WHERE s % 7 = 0
UNION ALL SELECT url, 'duplicate-id', 1, 2 FROM p WHERE s % 5 = 0
UNION ALL SELECT url, 'language', 1, NULL FROM p WHERE f = 1
UNION ALL SELECT url, 'required', 1, NULL FROM p WHERE f = 2
UNION ALL SELECT url, 'absolute-url', 1, NULL FROM p WHERE f = 2
UNION ALL SELECT url, 'required', 2, 1 FROM p WHERE f = 3
UNION ALL SELECT url, 'version', 1, NULL FROM p WHERE f = 3"""

QUERIES.update(feed_model=feed_model, feed_faults=feed_faults)
