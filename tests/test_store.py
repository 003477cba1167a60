"""The store of facts by run, audits through it, table functions and kept results of site extractors."""

import pytest
from pyspark.sql import functions as F

from pagesift.functions import language as N
from pagesift.operators import extensions as X
from pagesift.operators import rules, rulesets
from pagesift.plans import audit
from pagesift.sources.store import FactStore


def captures(spark, titles):
    rows = [(f"https://e{i % 2}.example/{i}", 200, "2", {"content-type": "text/html", "vary": "a b"}, f"<html lang=es><title>{t}</title><h1>x</h1>") for i, t in enumerate(titles)]
    return spark.createDataFrame(rows, "url string, status int, version string, headers map<string,string>, html string").withColumn("sent", F.lit("2024-01-02 00:00:00").cast("timestamp"))


def test_runs_are_kept_apart_and_pruned(spark, tmp_path):
    store = FactStore(spark, f"file://{tmp_path}/store")
    with pytest.raises(ValueError):
        store.read()
    first = store.write("one", audit.capture_facts(captures(spark, ["a", "b"])))
    assert store.before("one") is None
    store.write("two", audit.capture_facts(captures(spark, ["a"])))
    assert first.count() == 2 and store.read().count() == 1 and store.read("one").count() == 2 and store.before("two").count() == 2
    assert [(r.run, r.pages) for r in store.runs().orderBy("run").collect()] == [("one", 2), ("two", 1)]
    assert FactStore(spark, f"file://{tmp_path}/store").read("one").count() == 2
    store.write("one", audit.capture_facts(captures(spark, ["c"])))
    assert [r.t for r in store.read("one").select(F.col("html.title").alias("t")).collect()] == ["c"]
    plan = store.read("one").select("html.title", "http.status")._jdf.queryExecution().executedPlan().toString()
    assert "html:struct<title:string>" in plan and "http:struct<status:int>" in plan and "headers" not in plan.split("ReadSchema")[1]
    for bad in ("", "a/b", "../x"):
        with pytest.raises(ValueError):
            store.write(bad, first)


def test_only_what_rules_read_is_parsed(spark):
    own = {"mine": {"rules": {"x/vary": {"fact": "http.parsed.vary.errors", "expect": {"maxItems": 0}, "severity": "info", "score": 2.0}}}}
    got = audit.audit(captures(spark, ["a", "b"]), ["mine"], own)
    facts = got["facts"]
    assert facts.schema["http"].dataType["parsed"].dataType.fieldNames() == ["content-type", "vary"]
    assert facts.where("html IS NOT NULL").count() == 0 and [(r.rule, r.checks, r.failed) for r in got["tallies"].collect()] == [("x/vary", 2, 2)]
    assert {(r.kind, r.name): r.n for r in audit.summary(facts, got["findings"], got["verdicts"], []).collect()}["bytes", ""] == 2 * len("<html lang=es><title>a</title><h1>x</h1>")


def test_languages_in_an_audit(spark, tmp_path):
    model = N.learn(spark.createDataFrame([("en", "the other and the one in the end"), ("es", "el otro y uno y el fin y otro")], "lang string, text string"))
    store = FactStore(spark, f"file://{tmp_path}/store")
    got = audit.audit(captures(spark, ["the other and the one in the end", "el otro y uno y el fin y otro", "uno"]), ["i18n"], store=store, run="r1", languages=model)
    assert [(r.rule, r.url) for r in got["findings"].where("rule LIKE 'i18n/%'").collect()] == [("i18n/metadata-language/mismatch", "https://e0.example/0")]
    assert store.read("r1").where("html.detected.title.language = 'es'").count() == 1 and "vary" in store.read("r1").schema["http"].dataType["parsed"].dataType.fieldNames()


def test_extensions_that_an_audit_uses(spark, tmp_path):
    ext = X.Extensions()
    ext.preset("added", {"description": "", "rules": {"own/status": {"fact": "http.status", "expect": {"const": 404}, "severity": "warning", "score": 4.0}}})
    ext.rule_maker("starts", lambda path, begin: rules.Rule("", path, {"pattern": f"^{begin}"}, text="no beginning"))
    ext.formatter("urls", lambda found, path: found.select("url").write.text(path))
    ext.source("few", lambda n: spark.range(n).select(F.concat(F.lit("https://e.example/"), "id").alias("url")))
    own = {"mine": {"extends": ["pagesift:added"], "rules": {"own/title": {"maker": "starts", "options": {"path": "html.title", "begin": "a"}, "severity": "error"}, "own/linked": {"fact": "site.origins.*.seen.n", "expect": {"maximum": 0}, "severity": "info", "score": 1.5, "linked": True}}}}
    ext.site_extractor(X.SiteExtractor("seen", "origin", lambda pages: pages.groupBy("origin").agg(F.struct(F.count("*").alias("n")).alias("seen"))))
    got = audit.audit(captures(spark, ["a", "b", "c"]), ["mine"], own, extensions=ext, linked={"origins": spark.createDataFrame([("https://far.example",)], "name string")})
    assert {(r.rule, r.checks, r.failed) for r in got["tallies"].collect()} == {("own/status", 3, 3), ("own/title", 3, 2)}
    found = got["findings"]
    assert sorted(r.url for r in found.where("rule = 'own/linked'").collect()) == ["https://e0.example", "https://e1.example"]
    ext.write("urls", found.where("rule = 'own/linked'"), f"{tmp_path}/urls")
    assert spark.read.text(f"{tmp_path}/urls").count() == 2 and ext.urls("few", 3).count() == 3
    for bad in (lambda: ext.write("none", found, "x"), lambda: ext.urls("none"), lambda: ext.rule("i", {"maker": "none"})):
        with pytest.raises(rulesets.ConfigError):
            bad()


def test_table_functions_and_kept_results(spark, tmp_path):
    class Suffix:
        """Facts of a host from its name and the number of its pages; nothing for one page."""

        def eval(self, host: str, pages: int):
            if pages > 1:
                yield host.rsplit(".", 1)[-1], pages * 2

    gather = lambda pages: pages.groupBy("host").agg(F.count("*").alias("pages"))
    extractor = X.table_function("suffix", "host", Suffix, "suffix string, twice long", gather, ("host", "pages"))
    pages = spark.createDataFrame([("a.example",)] * 3 + [("b.test",)] * 2 + [("one.example",)], "host string")
    rows = lambda e, df: {r.host: (r.suffix.suffix, r.suffix.twice) if r.suffix else None for r in e.extract(df).collect()}
    assert rows(extractor, pages) == {"a.example": ("example", 6), "b.test": ("test", 4), "one.example": None}
    at = lambda t: F.lit(f"2024-01-01 {t}").cast("timestamp")
    kept = lambda e, t: X.kept_for(e, f"file://{tmp_path}/kept", 3600, at(t))
    assert rows(kept(extractor, "00:00:00"), pages) == rows(extractor, pages)
    more = pages.unionByName(spark.createDataFrame([("a.example",), ("c.new",), ("c.new",)], "host string"))
    assert rows(kept(extractor, "00:30:00"), more)["a.example"] == ("example", 6) and rows(kept(extractor, "00:30:00"), more)["c.new"] == ("new", 4)
    assert rows(kept(extractor, "01:10:00"), more)["a.example"] == ("example", 8)  # its time was over
    newer = X.table_function("suffix", "host", Suffix, "suffix string, twice long", gather, ("host", "pages"), version=2)
    assert rows(kept(newer, "01:10:00"), pages)["a.example"] == ("example", 6)
