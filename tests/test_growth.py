"""Steps whose work used to outgrow their tables, and rows that used to be lost, beside plain results."""

import json

import duckdb
from pyspark.sql import functions as F

from pagesift.functions import document, markup, weburl
from pagesift.operators import insights, site
from pagesift.operators import links as links_of
from pagesift.operators import patterns as P
from pagesift.operators import structured_data as J
from pagesift.plans import cases, certificates, feeds, registry, stores
from pagesift.sources import scratch

SF = "/root/testdata/sf0.01"


def agrees(spark, folder, name):
    """Whether a query's rows over the tables in ``folder`` are its SQL's."""
    db = duckdb.connect()
    for path in folder.glob("*.parquet"):
        db.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM read_parquet('{path}/*.parquet')").fetchall()
    df = registry.QUERIES[name](spark, str(folder))
    columns = ", ".join(f'"{c}"' for c in df.columns)
    want = db.execute(f"SELECT {columns} FROM ({registry.SQL[name]})").fetchall()
    got = df.collect()
    return len(want) > 0 and sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))


def test_no_side_of_dangling_references_is_broadcast(spark):
    rows = [("p", "p#me", True), ("p", "p#me", False), ("p", "q#x", False), ("p", "q#y", False), ("p", "_:a", False), ("q", "q#x", True), ("q", None, False), ("q", "_:a", True), ("r", "q#y", False), ("r", "_:a", False), ("r", "gone#z", False), ("r", "plain", False), ("q", "r#none", False)]
    found = J.dangling(spark.createDataFrame(rows, "href string, id string, defines boolean"))
    assert sorted(map(tuple, found.collect())) == [("_:a", 2), ("q#y", 2), ("r#none", 1)]
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()


def test_pages_weigh_what_their_template_loads(spark):
    pages = spark.range(50).select(F.col("id").alias("page"), F.lit(7).cast("long").alias("body"), (F.col("id") % 4).alias("t"))
    uses = spark.createDataFrame([(0, "a", 5), (0, "a", 9), (0, "b", 1), (1, "a", 2), (2, "c", None)], "t long, url string, body long")
    plain = site.page_weight(pages.select("page", "body"), pages.select("page", "t").join(uses, "t").select("page", "url", "body"))
    assert sorted(site.page_weight(pages, uses, by="t").collect()) == sorted(plain.collect())


def test_a_value_meets_a_glob_once_for_all_rows(spark):
    values = spark.range(3000).select(F.col("id").alias("n"), F.concat(F.lit("item00"), F.col("id") % 3).alias("value"))
    pats = spark.range(40).select(F.col("id").alias("m"), F.lit("item*00?").alias("glob"), F.lit("^item.*00.$").alias("regex"))
    assert P.glob_pairs(values, pats).count() == 3
    assert P.glob_matches(values, pats).select("n", "m").distinct().count() == 3000 * 40


def test_values_and_their_pieces_are_not_broadcast(spark, monkeypatch):
    values = spark.range(300).select("id", F.concat(F.lit("item"), F.col("id") % 50).alias("value"), (F.col("id") % 3).alias("kind"))
    globs = [("a", "item1?"), ("b", "item1?"), ("c", "*m?7*"), ("d", "?????"), ("e", "none*"), ("f", None)]
    rows = [(n, g, g and "^" + g.replace("*", ".*").replace("?", ".") + "$", k) for n, g in globs for k in range(2)]
    pats = spark.createDataFrame(rows, "name string, glob string, regex string, kind long")
    every = values.crossJoin(pats.withColumnRenamed("kind", "of")).where(F.rlike("value", F.col("regex")))
    for few in (0, 100):
        monkeypatch.setattr(P, "FEW", few, raising=False)
        for by in ([], ["kind"]):
            found = P.glob_matches(values, pats if by else pats.drop("kind"), by=by)
            plan = found._jdf.queryExecution().executedPlan().toString()
            assert plan.count("BroadcastExchange") == (1 if few else 0) and "BuildLeft" not in plan
            pairs = P.glob_pairs(values, pats, by=by)._jdf.queryExecution().executedPlan().toString()
            assert pairs.count("BroadcastExchange") == (2 if few else 0) and "BuildLeft" not in pairs
            want = every.where("kind = of") if by else every
            got, want = (df.select("id", "name", "glob").collect() for df in (found, want))
            assert sorted(got) == sorted(want) and len(want) > 50


def test_pages_that_share_an_address_are_all_judged(spark, tmp_path):
    pages = spark.read.parquet(f"{SF}/pages.parquet").where("page_id < 12")
    pages.unionByName(pages.withColumn("page_id", F.col("page_id") + 101)).write.parquet(f"{tmp_path}/pages.parquet")
    assert agrees(spark, tmp_path, "settled_cells")


def test_whole_trees_of_records_are_counted(spark, tmp_path):
    spark.range(1, 300).select(F.col("id").alias("s_suppkey")).write.parquet(f"{tmp_path}/supplier.parquet")
    assert agrees(spark, tmp_path, "spf_walk_lookups")


def test_rows_of_one_row_group_are_dealt_to_all_cores(spark):
    least = 2 * spark.sparkContext.defaultParallelism
    assert cases.dealt(spark, SF, ["a"]).rdd.getNumPartitions() == least
    assert certificates._customers(spark, SF).rdd.getNumPartitions() == least
    assert feeds._feeds(spark, SF).rdd.getNumPartitions() == least
    assert stores._marked(spark, SF)[0].rdd.getNumPartitions() == least


def test_repeated_pages_and_absent_ones_keep_their_places(spark):
    rows = [(0, "<title>a</title>", "http://e.example/"), (1, None, "http://e.example/"), (2, "<title>b</title>", "http://e.example/"), (3, "<title>a</title>", "http://e.example/"), (4, "<title>a</title>", None)]
    got = spark.createDataFrame(rows, "n int, h string, u string").coalesce(1).select("n", document.page(F.col("h"), F.col("u"))["title"].alias("t")).collect()
    assert {r.n: r.t for r in got} == {0: "a", 1: None, 2: "b", 3: "a", 4: None}


def test_a_crawl_broadcasts_no_links(spark):
    links = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (9, 10)], "href long, target long")
    broadcasts = []
    cut = scratch.cut

    def watched(df):
        broadcasts.append("Broadcast" in df._jdf.queryExecution().executedPlan().toString())
        return cut(df)

    scratch.cut = watched
    try:
        found = links_of.crawl_frontier(spark.createDataFrame([(1,)], "url long"), links).collect()
    finally:
        scratch.cut = cut
    assert sorted(map(tuple, found)) == [(1, 0), (2, 1), (3, 2)] and broadcasts and not any(broadcasts)


def test_nodes_with_no_more_than_what_is_asked(spark):
    ld = '[{"@id": "#a", "name": "x"}, {"@id": "#a", "name": "y"}, {"@type": "BreadcrumbList", "itemListElement": [{"item": "/one"}]}]'
    pages = spark.createDataFrame([("http://e.example/", [ld])], "href string, jsonld array<string>")
    assert J.page_nodes(pages, only=("id", "defines")).where("id IS NOT NULL").collect() == [("http://e.example/", "http://e.example/#a", True)]
    assert [r.crumbs for r in J.page_nodes(pages, only=("crumbs",)).where("size(crumbs) > 0").collect()] == [["http://e.example/one"]]


def test_few_groups_are_sent_to_the_rows(spark):
    groups = spark.range(3)
    rows = spark.range(100).select((F.col("id") % 3).alias("id"))
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = rows.join(insights._told_all(groups), "id")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    assert "BroadcastHashJoin" in plan


def test_plain_urls_and_simple_pages_are_read_without_the_long_way(monkeypatch):
    bases = ["https://e.example/", "http://e.example/a/b", "https://e.example/a#x", "https://e.example", "https://e.example/a?b", "https://e.example:443/", "https://E.example/a", "ftp://e.example/", "http://[::1/", ""]
    refs = ["", "#me", "#", "#a b", "#%41", "/7", "/", "/a/b/", "/a//b", "/a/../b", "/.a", "//h.example/x", "a/b", "_:a", "https://e.example/7#me", "https://e.example", "https://E.example/7", "https://e.example:443/7", "https:/e.example/7", "http://h.example/a/./b", "https://e.example/7\n", "https://\u00fc.example/7", "/a;b", "/a?b"]
    assert [weburl.resolve(b, r) for b in bases for r in refs] == [weburl._resolve(b, r) for b in bases for r in refs]
    item = '<p itemscope itemid="#me" itemid="#you"><b itemprop="name x">x<br> y > z</b>'
    pages = [item, item + "</p></i><li>q", item + "<table><tr><td typeof itemprop=\"c\" content=\"\">v<td itemprop=\"d\">w<tr>", item + '<a typeof="schema:A" property="p" href="/1">up</a>', item + "<!-- <p itemscope> -->", item + "&amp;", item + "<script><p itemscope></script>", item + "<title><p itemscope></title>", item + "<A ITEMPROP=q>x</A>", item + "<p itemscope", item + "<br/>< 3"]
    fast = [markup.read(p, "https://e.example/7") for p in pages]
    with monkeypatch.context() as m:
        m.setattr(markup, "_read_simple", lambda html, url: None)
        assert fast == [markup.read(p, "https://e.example/7") for p in pages]
    blocks = ['{"@graph": [{"@id": "#me", "name": "x"}, {"@context": {"@id": "#no"}, "@id": "/8#me"}, {"a": [[{"@id": "_:a", "b": {"@id": 3}}]]}]}', "[1, null]", "7"]
    for b in map(json.loads, blocks):
        assert J.ids(b, "https://e.example/7") == [{"id": n["id"], "defines": n["defines"]} for n in J.walk(b, "https://e.example/7")]
    with monkeypatch.context() as m:
        m.setattr(weburl, "urljoin", None)
        m.setattr(markup._Items, "feed", None)
        assert markup.read(item, "https://e.example/7")["microdata"] == ['{"@id": "https://e.example/7#me", "name": "x y > z", "x": "x y > z"}']
