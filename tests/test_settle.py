"""Cells that are judged once, in however many batches; reports on the way; names in the order of a language."""

import os

from pyspark.sql import functions as F

from pagesift.operators import rules as R
from pagesift.operators import verdicts as V
from pagesift.plans import lint as L
from pagesift.streaming.settle import CellStore, due_rules, judge_stream

RULES = [R.Rule("short", "title", {"maxLength": 3}, severity="error"), R.Rule("named", "title", {"type": "string"}), R.Rule("lower", "title", {"pattern": "^[a-z]*$"}, when={"group": "g"})]


def pages(spark, *rows):
    return spark.createDataFrame(rows, "group string, href string, title string").withColumn("digest", F.sha2(F.coalesce("title", F.lit("-")), 256))


def told(df):
    return {(r.group, r.href, r.rule): (r.ok, r.batch) for r in df.collect()}


def test_batches_and_replays_judge_each_cell_once(spark, tmp_path):
    store = CellStore(spark, f"file://{tmp_path}/cells")
    first = told(store.settle(pages(spark, ("g", "1", "ab"), (None, "2", "abcd")), 0, RULES[:2]))
    assert first == {("g", "1", "short"): (True, 0), ("g", "1", "named"): (True, 0), (None, "2", "short"): (False, 0), (None, "2", "named"): (True, 0)}
    again = told(store.settle(pages(spark, ("g", "1", "ab"), (None, "2", "abcd"), ("g", "3", "AB")), 1, RULES))
    assert set(again) == {("g", "1", "lower"), (None, "2", "lower"), *[("g", "3", r.id) for r in RULES]} and again[None, "2", "lower"] == (None, 1)
    assert told(store.settle(pages(spark, ("g", "1", "ab"), (None, "2", "abcd"), ("g", "3", "AB")), 1, RULES)) == again  # a replay
    assert store.settle(pages(spark, ("g", "1", "ab")), 2, RULES).count() == 0
    changed = told(store.settle(pages(spark, ("h", "1", "abcde"), ("h", "1", "abcde")), 3, RULES))
    assert changed["h", "1", "short"] == (False, 3) and len(changed) == 3
    cells = told(CellStore(spark, f"file://{tmp_path}/cells").cells())
    assert len(cells) == 9 and ("g", "1", "short") not in cells and cells["h", "1", "lower"] == (None, 3)
    assert {(r.group, r.rule): (r.applicable, r.failed) for r in store.report()["verdicts"].collect()}["h", "short"] == (1, 1)


def test_a_stream_settles_page_by_page_as_one_run_does(spark, tmp_path):
    source = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    os.makedirs(f"{tmp_path}/in")
    facts = lambda df: L.page_facts(df).join(df.select("page_id", F.col("url").alias("href"), F.sha2("html", 256).alias("digest")), "page_id")
    store, reports = CellStore(spark, f"file://{tmp_path}/cells"), []
    for half in (0, 1, 1):
        source.where(F.col("page_id") % 2 == half).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(source.schema).parquet(f"{tmp_path}/in")
        judge_stream(stream, store, L.RULES, f"{tmp_path}/c", facts, lambda n, r: reports.append((n, r["counters"].first().total, r["verdicts"].agg(F.sum("applicable")).first()[0])))
    whole = R.evaluate(facts(source), L.RULES, ["group", "href"])
    of = lambda df: sorted((r.group or "", r.href, r.rule, r.ok) for r in df.collect())
    assert of(store.cells().where("ok IS NOT NULL")) == of(whole)
    assert [n for n, _, _ in reports] == [0, 1] and reports[0][2] < reports[1][2] == whole.count()  # the third batch judged nothing


def test_rules_settle_with_their_last_phase():
    phases = {"short": "crawl", "named": "probes"}
    assert [[r.id for r in due_rules(RULES, phases, p)] for p in ("crawl", "resources", "probes", "lint")] == [["short"], ["short"], ["short", "named"], ["short", "named", "lower"]]


def test_order_of_a_language(spark):
    urls = ["/Zebra", "/apple", "/Äpfel", "/apfel", "/zebra", "/a-b", "/a/b", "/APPLE"]
    df = spark.createDataFrame([(u,) for u in urls], "u string")
    order = lambda c: [r.u for r in df.orderBy(V.sort_key(F.col("u"), c)).collect()]
    assert order(None) == sorted(urls)
    assert order("UNICODE") == ["/a-b", "/a/b", "/apfel", "/Äpfel", "/apple", "/APPLE", "/zebra", "/Zebra"]
    found = spark.createDataFrame([("r", "g", u, "t", 5.0) for u in urls], "rule string, group string, url string, text string, score double")
    applicable = spark.createDataFrame([("g", "r", 8)], "group string, rule string, applicable long")
    assert [(r.url, r.samples) for r in V.fold(found, applicable).collect()] == [("/APPLE", ["/APPLE", "/Zebra", "/a-b"])]
    got = V.fold(found, applicable, collation="UNICODE")
    assert [(r.url, r.samples) for r in got.collect()] == [("/a-b", ["/a-b", "/a/b", "/apfel"])] and dict(got.dtypes)["url"] == "string"
    folded = found.withColumn("severity", F.lit("error")).withColumn("scope", F.lit("page")).withColumn("occurrences", F.lit(1).cast("long"))
    assert [r.url for r in folded.orderBy(*V.urgency(folded, 8, collation="UNICODE")).limit(2).collect()] == ["/a-b", "/a/b"]
