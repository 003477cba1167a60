"""Queries over relations between pages, statistics, lookups and graphs, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagesift.functions import urls as U
from pagesift.operators import graph as G
from pagesift.operators import insights as I
from pagesift.operators import links as K
from pagesift.operators import lookups as J
from pagesift.plans.pages import FACTS, LINKS, links, read

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


# Observations that the tables lack, derived from ids alike on both sides.


def observed(spark, sf_dir) -> DataFrame:
    """(page_id, href, host, group, status)."""
    status = F.when(F.col("page_id") % 17 == 0, 404).when(F.col("page_id") % 29 == 0, 500).otherwise(200)
    return read(spark, sf_dir, "pages").select("page_id", U.without_fragment(F.col("url")).alias("href"), U.host(F.col("url")).alias("host"), U.pathname(F.col("url")).alias("path"), F.col("url").alias("raw"), status.alias("status"))


#: pages p with their next page in id order: redirect targets, alternates and feeds are made from these.
OBSERVED = FACTS + """,
observed AS (SELECT page_id, href, host, pathname AS path, raw, CASE WHEN page_id % 17 = 0 THEN 404 WHEN page_id % 29 = 0 THEN 500 ELSE 200 END AS status FROM facts),
named AS (SELECT page_id, href, '/p/' || page_id AS alias FROM observed)"""


def redirects(pages: DataFrame) -> DataFrame:
    """Every 13th page's alias leads to the page."""
    return pages.where("page_id % 13 = 0").select(F.concat(F.lit("/p/"), F.col("page_id").cast("string")).alias("from"), F.col("href").alias("to"))


def made_links(pages: DataFrame) -> DataFrame:
    """Page n links to the aliases of pages n/2 and 3n mod 1000."""
    to = F.explode(F.array(F.floor(F.col("page_id") / 2), (F.col("page_id") * 3) % 1000))
    return pages.select("page_id", "href", to.alias("to")).select("href", F.concat(F.lit("/p/"), F.col("to").cast("string")).alias("target"))


MADE = OBSERVED + """,
redirects AS (SELECT alias AS source, href AS dest FROM named WHERE page_id % 13 = 0),
made AS (SELECT href, '/p/' || unnest([page_id // 2, (page_id * 3) % 1000]) AS target FROM observed)"""


@query(f"WITH {MADE} SELECT target, dest AS \"to\", count(DISTINCT href) AS pages FROM made JOIN redirects ON target = source GROUP BY ALL")
def links_redirected(spark, sf_dir):
    pages = observed(spark, sf_dir)
    return K.redirected_links(made_links(pages), redirects(pages))


def probes(pages: DataFrame) -> DataFrame:
    alias = F.concat(F.lit("/p/"), F.col("page_id").cast("string"))
    status = F.when(F.col("page_id") % 7 == 0, F.lit(None).cast("int")).when(F.col("page_id") % 31 == 0, 429).otherwise(F.col("status"))
    return pages.select(alias.alias("url"), status.alias("status"), (F.col("page_id") % 5 == 0).alias("excluded"), F.lit(None).cast("boolean").alias("refused"), (F.col("page_id") % 11 == 0).alias("walled"))


@query(
    f"""WITH {MADE}, probes AS (SELECT '/p/' || page_id AS url, CASE WHEN page_id % 7 = 0 THEN NULL WHEN page_id % 31 = 0 THEN 429 ELSE status END AS status, page_id % 5 = 0 AS excluded, page_id % 11 = 0 AS walled FROM observed)
SELECT target, status, count(DISTINCT href) AS pages FROM made JOIN probes ON target = url WHERE NOT excluded AND NOT walled AND coalesce(status, 0) <> 429 AND (status IS NULL OR status >= 400) GROUP BY ALL"""
)
def links_broken_probe(spark, sf_dir):
    pages = observed(spark, sf_dir)
    return K.broken_links(made_links(pages), probes(pages))


def alternates(pages: DataFrame) -> DataFrame:
    """Pages n and n + 1 name each other, but for every ninth page."""
    other = pages.select((F.col("page_id") - 1).alias("page_id"), F.col("href").alias("other"))
    both = pages.join(other, "page_id")
    there = both.select("page_id", F.col("href").alias("page"), F.lit("fr").alias("lang"), F.col("other").alias("href"))
    back = both.where("page_id % 9 <> 0").select("page_id", F.col("other").alias("page"), F.lit("en").alias("lang"), "href")
    return there.unionByName(back)


ALTERNATES = OBSERVED + """,
pairs AS (SELECT a.page_id, a.href AS a, b.href AS b FROM observed a JOIN observed b ON b.page_id = a.page_id + 1),
alternates AS (SELECT page_id, a AS page, 'fr' AS lang, b AS href FROM pairs UNION ALL SELECT page_id, b, 'en', a FROM pairs WHERE page_id % 9 <> 0)"""


@query(f"WITH {ALTERNATES} SELECT page, lang, href FROM alternates x WHERE page <> href AND NOT EXISTS (SELECT 1 FROM alternates y WHERE y.page = x.href AND y.href = x.page)")
def hreflang_reciprocal(spark, sf_dir):
    return K.one_way_alternates(alternates(observed(spark, sf_dir)))


@query(
    f"""WITH {ALTERNATES}, a AS (SELECT DISTINCT page, lang, href FROM alternates WHERE page_id % 4 <> 0), b AS (SELECT DISTINCT page, lang, href FROM alternates WHERE page_id % 6 <> 0)
SELECT *, 'page' AS only FROM (SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL SELECT *, 'sitemap' FROM (SELECT * FROM b EXCEPT SELECT * FROM a)"""
)
def hreflang_symmetric_diff(spark, sf_dir):
    found = alternates(observed(spark, sf_dir))
    return K.alternates_apart(found.where("page_id % 4 <> 0"), found.where("page_id % 6 <> 0"))


@query(f"WITH {MADE} SELECT s.href, target FROM made s WHERE EXISTS (SELECT 1 FROM made n WHERE n.href = s.href AND n.target = s.target AND length(n.target) % 2 = 0)")
def semi_nofollow(spark, sf_dir):
    found = made_links(observed(spark, sf_dir)).select(F.col("href").alias("page"), F.col("target").alias("href"))
    return K.followed_and_not(found, found.where(F.length("href") % 2 == 0)).select(F.col("page").alias("href"), F.col("href").alias("target"))


@query(
    f"""WITH {LINKS}, declared AS (SELECT DISTINCT href AS page, 'https://' || host AS origin FROM links), used AS (SELECT DISTINCT href AS page, regexp_extract(target, '^[^:]*://[^/]*', 0) AS origin FROM links)
SELECT page, origin FROM declared EXCEPT SELECT page, origin FROM used"""
)
def anti_unused_preconnect(spark, sf_dir):
    found = links(read(spark, sf_dir, "pages"))
    declared = found.select(F.col("href").alias("page"), F.concat(F.lit("https://"), "host").alias("origin")).distinct()
    return K.unused_origins(declared, found.select(F.col("href").alias("page"), U.origin(F.col("target")).alias("origin")))


@query(
    f"""WITH {OBSERVED}, items AS (SELECT page_id AS item, CASE WHEN page_id % 3 = 0 THEN '/p/' || page_id WHEN page_id % 3 = 1 THEN href ELSE href || '?x' END AS link, CASE WHEN page_id % 4 = 0 THEN 'other' ELSE href END AS title FROM observed),
known AS (SELECT href AS url, href AS page FROM observed UNION SELECT '/p/' || page_id, href FROM observed WHERE page_id % 13 = 0)
SELECT * FROM (SELECT item, link, CASE WHEN p.href IS NULL THEN 'unknown' WHEN p.status >= 400 THEN 'status' WHEN i.title IS DISTINCT FROM p.href THEN 'title' END AS fault
FROM items i LEFT JOIN known k ON i.link = k.url LEFT JOIN observed p ON k.page = p.href) WHERE fault IS NOT NULL"""
)
def feed_join_pages(spark, sf_dir):
    pages = observed(spark, sf_dir)
    alias = F.concat(F.lit("/p/"), F.col("page_id").cast("string"))
    link = F.when(F.col("page_id") % 3 == 0, alias).when(F.col("page_id") % 3 == 1, F.col("href")).otherwise(F.concat("href", F.lit("?x")))
    items = pages.select(F.col("page_id").alias("item"), link.alias("link"), F.when(F.col("page_id") % 4 == 0, "other").otherwise(F.col("href")).alias("title"))
    return K.feed_items_apart(items, pages.select("href", "status", F.col("href").alias("title")), K.aliases(pages, redirects(pages)))


@query(
    """WITH d AS (SELECT doc_id, lang, source FROM documents)
SELECT source AS key, array_to_string(list_sort(list(DISTINCT lang)), '|') AS "values", count(DISTINCT (lang, doc_id))::BIGINT AS pages FROM d GROUP BY source HAVING count(DISTINCT lang) > 1"""
)
def entity_conflict(spark, sf_dir):
    return K.entity_conflicts(read(spark, sf_dir, "documents").select(F.col("source").alias("key"), F.col("lang").alias("value"), F.col("doc_id").alias("page")))


@query(
    """WITH refs AS (SELECT 'c' || o_custkey AS page, 's' || (o_orderkey % 90) || '#' || (o_orderkey % 7) AS id FROM orders),
defs AS (SELECT DISTINCT 's' || s_suppkey || '#' || (s_suppkey % 3) AS id FROM supplier), pages AS (SELECT 's' || s_suppkey AS href FROM supplier)
SELECT page, id FROM refs WHERE split_part(id, '#', 1) IN (SELECT href FROM pages) AND id NOT IN (SELECT id FROM defs)"""
)
def jsonld_reference_broken(spark, sf_dir):
    s = lambda c: F.col(c).cast("string")
    refs = read(spark, sf_dir, "orders").select(F.concat(F.lit("c"), s("o_custkey")).alias("page"), F.concat(F.lit("s"), (F.col("o_orderkey") % 90).cast("string"), F.lit("#"), (F.col("o_orderkey") % 7).cast("string")).alias("id"))
    sup = read(spark, sf_dir, "supplier").select(F.concat(F.lit("s"), s("s_suppkey")).alias("href"), F.concat(F.lit("s"), s("s_suppkey"), F.lit("#"), (F.col("s_suppkey") % 3).cast("string")).alias("id"))
    return K.dangling_references(refs, sup, sup)


@query("SELECT l_partkey AS url, min(l_returnflag) AS kind, count(DISTINCT l_orderkey) AS pages, any_value(p_retailprice) AS bytes FROM lineitem LEFT JOIN (SELECT * FROM part WHERE p_partkey % 2 = 0) ON l_partkey = p_partkey GROUP BY l_partkey")
def resource_rollup(spark, sf_dir):
    uses = read(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("url"), F.col("l_returnflag").alias("kind"), F.col("l_orderkey").alias("page"))
    return K.resource_rollup(uses, read(spark, sf_dir, "part").where("p_partkey % 2 = 0").select(F.col("p_partkey").alias("url"), F.col("p_retailprice").alias("bytes")))


@query(f"WITH {OBSERVED} SELECT host, count(*) FILTER (status = 200) AS have, count(*) AS total FROM observed GROUP BY host HAVING have > 0 AND have < total")
def group_partly_missing(spark, sf_dir):
    return K.partly_missing(observed(spark, sf_dir).withColumn("ok", F.col("status") == 200), "host", "ok")


@query(
    """WITH a AS (SELECT event_type AS rule, count(*) AS n FROM events WHERE event_id % 2 = 0 AND event_type <> 'click' GROUP BY 1), b AS (SELECT event_type AS rule, count(*) AS n FROM events WHERE event_id % 3 = 0 GROUP BY 1)
SELECT coalesce(a.rule, b.rule) AS rule, coalesce(a.n, 0) AS before, coalesce(b.n, 0) AS after FROM a FULL JOIN b ON a.rule = b.rule"""
)
def previous_run_compare(spark, sf_dir):
    events = read(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("rule"))
    return K.since_last(events.where("event_id % 2 = 0 AND rule <> 'click'"), events.where("event_id % 3 = 0"))


# Statistics

OUTLIER = """m AS (SELECT {by} median(v) AS median, count(*) AS n FROM x {group}),
o AS (SELECT x.*, median, n, abs(v - median) AS off FROM x {join}),
s AS (SELECT {by} median(off) AS mad, avg(off) AS mean_off FROM o {group}),
z AS (SELECT o.*, (v - median) / CASE WHEN mad > 0 THEN mad / 0.6745::DOUBLE ELSE mean_off / 0.797885::DOUBLE END AS z FROM o {join2} WHERE CASE WHEN mad > 0 THEN mad ELSE mean_off END > 0)"""


@query("WITH x AS (SELECT page_id, length(html)::BIGINT * CASE WHEN page_id % 50 = 7 THEN 20 ELSE 1 END AS v FROM pages), " + OUTLIER.format(by="", group="", join="CROSS JOIN m", join2="CROSS JOIN s") + " SELECT page_id, v AS length, median, round(z, 6) AS z FROM z WHERE n >= 20 AND z > 3.5 AND v >= 3.0 * median")
def insight_outlier(spark, sf_dir):
    """Pages whose length stands out, one in fifty being twenty times as long."""
    pages = read(spark, sf_dir, "pages").select("page_id", (F.length("html").cast("long") * F.when(F.col("page_id") % 50 == 7, 20).otherwise(1)).alias("length"))
    return I.outliers(pages, "page_id", "length").withColumn("z", F.round("z", 6))


@query(
    "WITH x AS (SELECT l_returnflag, l_orderkey * 10 + l_linenumber AS line, CASE WHEN l_orderkey % 500 = 3 THEN 64 * l_extendedprice ELSE l_extendedprice END AS v FROM lineitem), "
    + OUTLIER.format(by="l_returnflag,", group="GROUP BY l_returnflag", join="JOIN m USING (l_returnflag)", join2="JOIN s USING (l_returnflag)")
    + " SELECT l_returnflag, line, v, median, round(z, 6) AS z FROM z WHERE n >= 20 AND z > 3.5 AND v >= 3.0 * median"
)
def insight_outlier_by_group(spark, sf_dir):
    lines = read(spark, sf_dir, "lineitem").select("l_returnflag", (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("line"), F.when(F.col("l_orderkey") % 500 == 3, 64 * F.col("l_extendedprice")).otherwise(F.col("l_extendedprice")).alias("v"))
    return I.outliers(lines, "line", "v", ["l_returnflag"]).withColumn("z", F.round("z", 6))


@query(
    """WITH c AS (SELECT CASE WHEN p_partkey % 8 = 0 THEN p_brand ELSE 'usual' END AS p_brand, count(*) AS n FROM part GROUP BY 1), t AS (SELECT *, sum(n) OVER ()::BIGINT AS total, max(n) OVER () AS most FROM c)
SELECT p_brand, n, total FROM t WHERE total >= 20 AND most >= 0.8 * total AND n <= 0.1 * total"""
)
def insight_minority(spark, sf_dir):
    brands = read(spark, sf_dir, "part").select(F.when(F.col("p_partkey") % 8 == 0, F.col("p_brand")).otherwise("usual").alias("p_brand"))
    return I.minorities(brands, "p_brand")


@query(
    f"""WITH {FACTS}, f AS (SELECT grp, href, page_id, pathname LIKE '%/' AS slash FROM facts WHERE pathname <> '/' AND NOT regexp_matches(pathname, '[.][A-Za-z0-9]{{1,5}}$') AND pathname NOT LIKE '/.well-known/%'),
c AS (SELECT grp, slash, count(*) AS n, min(page_id) AS met FROM f GROUP BY ALL), u AS (SELECT grp, slash AS usual FROM c QUALIFY row_number() OVER (PARTITION BY grp ORDER BY n DESC, met) = 1)
SELECT grp AS "group", href, slash, usual FROM f JOIN u USING (grp) WHERE slash <> usual"""
)
def trailing_slash_minority(spark, sf_dir):
    from pagesift.operators.site import slash_form
    from pagesift.plans.lint import page_facts

    forms = page_facts(read(spark, sf_dir, "pages")).select("group", "page_id", F.col("url.href").alias("href"), slash_form(F.col("url.pathname")).alias("slash"))
    return I.majority_form(forms, "href", "slash", ["group"], "page_id")


@query(
    f"""WITH {FACTS}, v AS (SELECT host, 'lang' AS fact, lang AS value FROM facts UNION ALL SELECT host, 'scheme', scheme FROM facts)
SELECT host, fact, count(DISTINCT value) AS "values", array_to_string(list_sort(list(DISTINCT value)), '|') AS listed FROM v WHERE value IS NOT NULL GROUP BY ALL HAVING count(DISTINCT value) > 1"""
)
def host_inconsistent(spark, sf_dir):
    from pagesift.plans.lint import page_facts

    facts = page_facts(read(spark, sf_dir, "pages")).select(F.col("url.host").alias("host"), F.col("html.lang").alias("lang"), F.regexp_replace("url.protocol", ":", "").alias("scheme"))
    return I.inconsistent(facts, "host", ["lang", "scheme"])


@query(
    """WITH v AS (SELECT 'l_quantity' AS fact, l_quantity AS v FROM lineitem UNION ALL SELECT 'l_extendedprice', l_extendedprice FROM lineitem UNION ALL SELECT 'l_discount', l_discount FROM lineitem)
SELECT fact, count(*) AS count, round(min(v), 4) AS min, round(median(v), 4) AS median, round(quantile_disc(v, 0.95), 4) AS p95, round(max(v), 4) AS max, round(sum(v), 4) AS total FROM v GROUP BY fact"""
)
def stats_numeric_facts(spark, sf_dir):
    return I.numeric_summary(read(spark, sf_dir, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount"])


@query("SELECT user_id, count(*) AS n, (list_sort(list(value)))[(count(*) // 2) + 1] AS median FROM events WHERE value IS NOT NULL GROUP BY user_id")
def clock_skew_median(spark, sf_dir):
    return I.upper_median(read(spark, sf_dir, "events"), ["user_id"], "value")


@query(
    """WITH g AS (SELECT event_type, ts, event_id, epoch_us(ts) - lag(epoch_us(ts)) OVER w AS gap FROM events WINDOW w AS (PARTITION BY event_type ORDER BY ts, event_id)),
r AS (SELECT *, count(gap) OVER w AS gaps, sum(gap) OVER w AS elapsed, avg(gap / 1000000.0::DOUBLE) OVER w AS mean, var_samp(gap / 1000000.0::DOUBLE) OVER w AS v FROM g WINDOW w AS (PARTITION BY event_type ORDER BY ts, event_id ROWS BETWEEN 49 PRECEDING AND CURRENT ROW))
SELECT event_type, event_id, gaps, (elapsed // (gaps * 1000))::BIGINT AS mean_ms, round(mean - 2 * sqrt(v / gaps), 4) AS low, round(mean + 2 * sqrt(v / gaps), 4) AS high FROM r WHERE gaps >= 3"""
)
def eta_moving_window(spark, sf_dir):
    return I.gaps_eta(read(spark, sf_dir, "events"), ["event_type"], "ts", "event_id").select("event_type", "event_id", "gaps", F.expr("elapsed div (gaps * 1000)").alias("mean_ms"), "low", "high")


@query(f"WITH {FACTS} SELECT grp AS \"group\", href, row_number() OVER (PARTITION BY grp ORDER BY href)::INT AS place FROM facts QUALIFY place <= 3")
def sample_first_k(spark, sf_dir):
    from pagesift.plans.lint import page_facts

    return I.samples(page_facts(read(spark, sf_dir, "pages")).select("group", F.col("url.href").alias("href")), ["group"], "href")


# Lookups

BLOCKS = [("10.0.0.0/8", "a"), ("10.1.0.0/16", "b"), ("192.168.4.0/22", "c"), ("172.16.0.0/12", "d"), ("0.0.0.0/0", "e")]
ADDRESS = "concat({a}, '.', {k} % 4, '.', {k} % 7, '.', {k} % 251)"


@query(
    """WITH b(block, name) AS (VALUES ('10.0.0.0/8', 'a'), ('10.1.0.0/16', 'b'), ('192.168.4.0/22', 'c'), ('172.16.0.0/12', 'd'), ('0.0.0.0/0', 'e')),
n AS (SELECT *, string_split(split_part(block, '/', 1), '.') AS p, split_part(block, '/', 2)::INT AS bits FROM b),
r AS (SELECT *, ((p[1]::BIGINT * 256 + p[2]::BIGINT) * 256 + p[3]::BIGINT) * 256 + p[4]::BIGINT AS lo FROM n),
a AS (SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN '10' WHEN 1 THEN '172' ELSE '192' END || '.' || CASE c_custkey % 3 WHEN 2 THEN 168 ELSE c_custkey % 20 END || '.' || (c_custkey % 7) || '.' || (c_custkey % 251) AS address FROM customer),
q AS (SELECT *, string_split(address, '.') AS s FROM a),
t AS (SELECT *, ((s[1]::BIGINT * 256 + s[2]::BIGINT) * 256 + s[3]::BIGINT) * 256 + s[4]::BIGINT AS x FROM q)
SELECT c_custkey, address, name FROM t JOIN r ON x >= lo AND x < lo + (1::BIGINT << (32 - bits))"""
)
def cidr_range_join(spark, sf_dir):
    k = F.col("c_custkey")
    a = F.when(k % 3 == 0, "10").when(k % 3 == 1, "172").otherwise("192")
    b = F.when(k % 3 == 2, F.lit(168)).otherwise(k % 20).cast("string")
    address = F.concat_ws(".", a, b, (k % 7).cast("string"), (k % 251).cast("string"))
    blocks = spark.createDataFrame(BLOCKS, "block string, name string")
    return J.in_blocks(read(spark, sf_dir, "customer").select("c_custkey", address.alias("address")), F.broadcast(blocks), "address", "block").select("c_custkey", "address", "name")


SUFFIXES = [("example.com", "one"), ("example.org", "two"), ("blog.ththan.example.net", "three")]


@query(
    f"""WITH {FACTS}, s(suffix, name) AS (VALUES ('example.com', 'one'), ('example.org', 'two'), ('blog.ththan.example.net', 'three'))
SELECT page_id, host, name FROM facts JOIN s ON host = suffix OR host LIKE '%.' || suffix"""
)
def suffix_theta_join(spark, sf_dir):
    names = spark.createDataFrame(SUFFIXES, "suffix string, name string")
    return J.by_suffix(observed(spark, sf_dir).select("page_id", "host"), F.broadcast(names), "host", "suffix").select("page_id", "host", "name")


@query(
    f"""WITH {FACTS}, r(name, value) AS (VALUES ('com', 1), ('example.com', 2), ('example.net', 3), ('blog.ththan.example.net', 4)), h AS (SELECT DISTINCT host FROM facts)
SELECT host, name, value FROM h JOIN r ON host = name OR host LIKE '%.' || name QUALIFY row_number() OVER (PARTITION BY host ORDER BY length(name) DESC) = 1"""
)
def nearest_ancestor(spark, sf_dir):
    records = spark.createDataFrame([("com", 1), ("example.com", 2), ("example.net", 3), ("blog.ththan.example.net", 4)], "name string, value int")
    return J.nearest_ancestor(observed(spark, sf_dir), F.broadcast(records), "host", "name", "value")


@query(
    """WITH b AS (SELECT user_id, ts, max(value) AS price FROM events WHERE event_id % 3 = 0 GROUP BY ALL), a AS (SELECT event_id, user_id, ts FROM events WHERE event_id % 3 <> 0)
SELECT event_id, a.user_id, price FROM a ASOF LEFT JOIN b ON a.user_id = b.user_id AND a.ts >= b.ts"""
)
def asof_join(spark, sf_dir):
    events = read(spark, sf_dir, "events")
    right = events.where("event_id % 3 = 0").groupBy("user_id", "ts").agg(F.max("value").alias("price"))
    return J.asof(events.where("event_id % 3 <> 0").select("event_id", "user_id", "ts"), right, ["user_id"], "ts", "event_id", "price").select("event_id", "user_id", "price")


@query(
    """WITH i AS (SELECT event_id AS span, user_id, ts AS a, ts + INTERVAL 2 HOUR AS b FROM events)
SELECT event_id, span FROM events e JOIN i ON e.user_id = i.user_id AND e.ts >= a AND e.ts < b"""
)
def interval_join(spark, sf_dir):
    events = read(spark, sf_dir, "events")
    spans = events.select(F.col("event_id").alias("span"), "user_id", F.col("ts").alias("a"), (F.col("ts") + F.expr("INTERVAL 2 HOURS")).alias("b"))
    return J.within(events.select("event_id", "user_id", "ts"), spans, ["user_id"], "ts", "a", "b").select("event_id", "span")


# Graph of events: from each user to the next one in time.


def transitions(spark, sf_dir) -> DataFrame:
    """(src, dst): the links of users as pages, through the operator: every user is a page under its own address."""
    e = read(spark, sf_dir, "events").select(F.col("ts").cast("timestamp").alias("ts"), "event_id", "user_id")
    links = G.following(e, ["ts", "event_id"], "user_id").where("next IS NOT NULL").select(F.col("user_id").alias("href"), F.col("next").alias("target"))
    pages = e.select(F.col("user_id").alias("href")).distinct()
    return G.edges(pages, links, pages.select(F.col("href").alias("url"), F.col("href").alias("page")))


EDGES = """
t AS (SELECT user_id AS src, lead(user_id) OVER (ORDER BY ts, event_id) AS dst FROM events),
e AS (SELECT DISTINCT src, dst FROM t WHERE dst IS NOT NULL AND src <> dst),
nodes AS (SELECT src AS node FROM e UNION SELECT dst FROM e)"""


def nodes_of(e: DataFrame) -> DataFrame:
    return e.select(F.col("src").alias("node")).union(e.select("dst")).distinct()


@query(f"WITH {EDGES} SELECT src, dst FROM e")
def graph_edges(spark, sf_dir):
    return transitions(spark, sf_dir)


@query(f"WITH {EDGES} SELECT node, coalesce(i, 0) AS in_degree, coalesce(o, 0) AS out_degree FROM nodes LEFT JOIN (SELECT dst AS node, count(*) AS i FROM e GROUP BY dst) USING (node) LEFT JOIN (SELECT src AS node, count(*) AS o FROM e GROUP BY src) USING (node)")
def graph_degrees(spark, sf_dir):
    e = transitions(spark, sf_dir)
    return G.degrees(nodes_of(e), e)


@query(
    f"""WITH RECURSIVE {EDGES}, walk AS (SELECT min(src) AS node, 0 AS depth FROM e UNION SELECT dst, depth + 1 FROM walk JOIN e ON src = node WHERE depth < 60)
SELECT node, min(depth) AS depth FROM walk GROUP BY node"""
)
def graph_bfs_depth(spark, sf_dir):
    from pagesift.sources.scratch import cut

    e = cut(transitions(spark, sf_dir))
    return G.depths(e, e.agg(F.min("src").alias("node")))


@query()
def graph_pagerank(spark, sf_dir):
    """Rounds go on until the ranks settle, which SQL can't state on whole tables; tests hold the ranks against brute force."""
    from pagesift.sources.scratch import cut

    e = cut(transitions(spark, sf_dir))
    return G.pagerank(nodes_of(e), e).select("node", F.round("rank", 3).alias("rank"))
