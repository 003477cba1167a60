"""Rulesets, extensions, the audit of captures, whole report documents, and streams with late rows."""

import json
import os
import xml.etree.ElementTree as ET
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from pagesift.operators import extensions as X
from pagesift.operators import lookups, rules, rulesets
from pagesift.plans import audit, presets
from pagesift.sources import reports
from pagesift.streaming import windows

SETS = rulesets.Rulesets(presets.PRESETS, {"strict": {"extends": ["seo"], "rules": {"html/title/length": {"expect": {"maxLength": 70}}, "html/h1/missing": "hint", "html/lang/missing": "off"}}})


def test_every_preset_compiles_and_keeps_to_its_bands():
    for name in presets.PRESETS:
        compiled, unique = rulesets.compiled({k: v for k, v in SETS.resolve(rulesets.PRESET + name).items() if v.get("severity") != "off"})
        assert len(compiled) + len(unique) > 0
    assert len(SETS.resolve("all")) > 110
    assert audit.unparsed_headers() == []


def test_resolution():
    mine = SETS.resolve("strict")
    assert mine["html/title/length"]["expect"] == {"minLength": 30, "maxLength": 70} and mine["html/title/length"]["text"] == ""
    assert mine["html/h1/missing"]["pinned"] and mine["html/h1/missing"]["score"] == 7.4
    assert mine["html/title/length"]["when"]["http.status"] == {"minimum": 200, "maximum": 299}
    assert "html/lang/missing" not in SETS.select(["strict"])
    assert set(SETS.resolve("html/og-*/missing")) == {f"html/og-{x}/missing" for x in ("description", "image", "title", "type", "url")}
    assert SETS.select(["strict"], severity={"html/h1/*": "error"})["html/h1/missing"]["severity"] == "error"
    assert not [r for r in SETS.select(["strict"], exclude=["html/og-*"]) if "og-" in r]


@pytest.mark.parametrize("call", [
    lambda: SETS.resolve("nothing/here"), lambda: SETS.select(["seo"], exclude=["html/titel/*"]), lambda: rulesets.Rulesets({}, {"all": {}}), lambda: rulesets.Rulesets({"a": {"extends": ["b"]}, "b": {"extends": ["a"]}}).resolve("a"),
    lambda: rulesets.Rulesets({"a": {"rules": {"x": "error"}}}).resolve("a"), lambda: rulesets.compiled({"x": {"fact": "a.b"}}), lambda: rulesets.compiled({"x": {"fact": "a.b", "expect": {"not": {"unheard": 1}}}}),
])
def test_configurations_that_are_refused(call):
    with pytest.raises(rulesets.ConfigError):
        call()


def test_exit_status_and_hints():
    assert [rulesets.exit_status("warning", "error"), rulesets.exit_status("warning", "warning"), rulesets.exit_status("error", 9.0, 8.0), rulesets.exit_status(None, "hint"), rulesets.exit_status("error", "error", complete=False)] == [0, 1, 0, 0, 3]
    assert rulesets.nearest("html/titel/length", SETS.resolve("seo")) == "html/title/length" and rulesets.nearest("quite/another", SETS.resolve("seo")) is None


def test_catalogue(spark):
    rows = {r.rule: r for r in rulesets.catalogue(spark, SETS).collect()}
    assert rows["html/title/duplicate"].scope == "site" and rows["html/title/missing"].rulesets == ["recommended", "seo"]
    assert any("html.title" in line for line in rulesets.explain(SETS, "html/title/missing"))


def captures(spark):
    page = "<html lang=en><head><title>{}</title><meta charset=utf-8></head><body><h1>x</h1></body></html>"
    rows = [(f"https://e.example/{i}", 200 if i else 503, "2", {"content-type": "text/html", "strict-transport-security": "max-age=60" if i % 2 else "max-age=60; max-age=61", **({"retry-after": "5"} if not i else {})}, page.format("same title" if i < 3 else f"title {i}")) for i in range(6)]
    rows.append(("https://e.example/file.pdf", 200, "1.1", {"content-type": "application/pdf"}, None))
    df = spark.createDataFrame(rows, "url string, status int, version string, headers map<string,string>, html string")
    return df.withColumn("sent", F.lit("2024-01-02 00:00:00").cast("timestamp"))


def test_audit_of_captures(spark):
    got = audit.audit(captures(spark), groups={"files": ["content-type:application/pdf"], "pages": ["/[0-9]"]}, site=spark.createDataFrame([("production",)], "role string"))
    cells = {(r.group, r.href.rsplit("/", 1)[1], r.rule): r.ok for r in got["cells"].collect()}
    assert cells["pages", "1", "http/hsts/weak"] is False and ("pages", "2", "http/hsts/weak") not in cells
    assert cells["pages", "2", "http/hsts/invalid"] is False and cells["pages", "1", "http/hsts/invalid"] is True
    assert cells["files", "file.pdf", "http/version/outdated"] is False and ("files", "file.pdf", "html/title/missing") not in cells
    assert cells["pages", "0", "http/retry-after/weak"] is False and ("pages", "0", "html/title/missing") not in cells
    found = got["findings"].collect()
    assert [(r.text, r.occurrences, r.samples) for r in found if r.rule == "html/title/duplicate"] == [("html.title is shared by 2 pages", 2, ["https://e.example/1", "https://e.example/2"])]
    weak = {r.url: r.text for r in found if r.rule == "http/hsts/weak"}
    assert weak and set(weak.values()) == {"strict transport lasts 60 seconds"}
    told = {(r.kind, r.name): r.n for r in audit.summary(got["facts"], got["findings"], got["verdicts"], [*{r.rule for r in got["cells"].collect()}, "never/judged"]).collect()}
    assert told["pages", ""] == 7 and told["status", "503"] == 1 and told["group", "files"] == 1 and [n for k, n in told if k == "untested"] == ["never/judged"]
    assert got["rating"].first().grade in "ABCDEF"


def test_extensions(spark):
    ext = X.Extensions()
    ext.page_extractor(X.PageExtractor("length", lambda html: F.struct(F.length(html).alias("n")), ("html",)))
    ext.page_extractor(X.PageExtractor("unread", lambda html: F.raise_error(F.lit("must not run")), ("html",)))
    ext.resource_extractor(X.ResourceExtractor("css", "text/css", lambda body: F.length(body), ("body",)))
    ext.site_extractor(X.SiteExtractor("counted", "host", lambda pages: pages.groupBy("host").agg(F.struct(F.count("*").alias("n")).alias("counted"))))
    ext.setting("depth", {"type": "integer", "minimum": 1, "default": 3})
    asked = [rules.Rule("a", "length.n", {"minimum": 3}), rules.Rule("b", "site.hosts.*.counted.n", {"maximum": 1}), rules.Rule("c", "css", {"maximum": 2})]
    pages = spark.createDataFrame([("h", "x"), ("h", "xyz"), ("i", "y")], "host string, html string")
    with_facts = ext.with_facts(pages, asked)
    assert with_facts.columns == ["host", "html", "length"]
    assert sorted((r.host, r.html) for r in rules.findings(with_facts, asked[:1], ["host", "html"]).collect()) == [("h", "x"), ("i", "y")]
    subjects = ext.subjects(pages, asked, "host", spark.createDataFrame([("far",), ("h",)], "name string"))
    assert {(r.name, r.linked) for r in subjects.collect()} == {("h", False), ("i", False), ("far", True)}
    assert [r.name for r in rules.subject_findings(subjects, asked, "hosts").collect()] == ["h"]
    files = ext.with_resource_facts(spark.createDataFrame([("Text/CSS; x", "abc"), ("text/html", "abc")], "type string, body string"), asked)
    assert sorted((r.css or 0) for r in files.collect()) == [0, 3]
    assert ext.configured({}) == {"depth": 3} and ext.configured({"depth": 5}) == {"depth": 5}
    for bad in (lambda: ext.configured({"depth": 0}), lambda: ext.configured({"dept": 1}), lambda: ext.page_extractor(X.PageExtractor("css", F.length, ("html",))), lambda: ext.rule_maker("a b", None), lambda: ext.page_extractor(X.PageExtractor("html", F.length, ("html",)))):
        with pytest.raises(rulesets.ConfigError):
            bad()


def joined_files(path: Path) -> str:
    return "".join(p.read_text() for p in sorted(path.glob("part-*")))


def test_whole_report_documents(spark, tmp_path):
    rows = [("page", r, "g", f"https://e.example/{i}?a&b", f"it's <{i}> \t", s, 2, ["3:4"], [f"https://e.example/{i}?a&b", "other"]) for i in range(5) for r, s in (("http/csp/missing", 6.4), ("html/x", 0.5))]
    found = spark.createDataFrame(rows, "scope string, rule string, group string, url string, text string, score double, occurrences long, locations array<string>, samples array<string>")
    reports.write_sarif(found, f"{tmp_path}/sarif")
    document = json.loads(joined_files(tmp_path / "sarif"))
    run = document["runs"][0]
    assert len(run["results"]) == 10 and document["version"] == "2.1.0"
    security = {r["id"]: r.get("properties", {}).get("security-severity") for r in run["tool"]["driver"]["rules"]}
    assert security == {"http/csp/missing": "6.4", "html/x": None}
    reports.write_checkstyle(found, f"{tmp_path}/checkstyle")
    root = ET.fromstring(joined_files(tmp_path / "checkstyle"))
    assert [f.get("name") for f in root] == [f"https://e.example/{i}?a&b" for i in range(5)]
    assert {(e.get("severity"), e.get("line"), e.get("column")) for e in root.iter("error")} == {("warning", "3", "4"), ("info", "3", "4")}
    assert next(root.iter("error")).get("message") == "it's <0> \\u{9}"
    empty = found.limit(0)
    reports.write_sarif(empty, f"{tmp_path}/none")
    assert json.loads(joined_files(tmp_path / "none"))["runs"][0]["results"] == []
    table = reports.facts_table(spark.createDataFrame([(1, (2.5, (3,)))], "id int, f struct<weight: double, size: struct<body: int>>"), "id", ["f"])
    reports.write_facts(table, f"{tmp_path}/yaml", "yaml")
    assert joined_files(tmp_path / "yaml").split("\n")[:2] == ["---", '"id": 1']


def test_addresses_of_both_families(spark):
    rows = spark.createDataFrame([("2001:db8::1",), ("2001:DB8:0:0:1::",), ("::ffff:192.0.2.9",), ("192.0.2.9",), ("2001:db8:::1",), ("1:2:3",), ("fe80::1%eth0",), (None,)], "a string")
    blocks = spark.createDataFrame([("2001:db8::/33", 1), ("2001:db8::/127", 2), ("::/0", 3), ("192.0.2.8/31", 4), ("192.0.2.8/99", 5), ("::ffff:192.0.2.0/124", 6)], "b string, n int")
    got = {}
    for r in lookups.in_blocks(rows, blocks, "a", "b").collect():
        got.setdefault(r.a, set()).add(r.n)
    assert got == {"2001:db8::1": {1, 2, 3}, "2001:DB8:0:0:1::": {1, 3}, "::ffff:192.0.2.9": {3, 6}, "192.0.2.9": {4}}


def test_intervals_of_any_length(spark):
    import random

    rng = random.Random(4)
    spans = [(i, s := rng.randint(0, 10**6), s + rng.choice([0, 1, 50, 5000, 400_000])) for i in range(60)]
    points = [(i, rng.randint(0, 10**6)) for i in range(300)]
    at = lambda c: F.timestamp_seconds(c)
    left = spark.createDataFrame(points, "p int, t long").select("p", F.lit(1).alias("k"), at("t").alias("t"))
    right = spark.createDataFrame(spans, "s int, a long, b long").select("s", F.lit(1).alias("k"), at("a").alias("a"), at("b").alias("b"))
    got = sorted((r.p, r.s) for r in lookups.within(left, right, ["k"], "t", "a", "b", width=60).select("p", "s").collect())
    assert got == sorted((p, s) for p, t in points for s, a, b in spans if a <= t < b)


def test_late_rows_of_a_stream_are_dropped(spark, tmp_path):
    """Five files, one a batch: a row of the fourth is behind the watermark that the second set, which holds from the batch after the next."""
    schema = "ts string, k string, value double"
    for i, rows in enumerate([[("2024-01-01 00:10:00", "a", 1.0)], [("2024-01-01 09:00:00", "b", 1.0)], [("2024-01-01 09:01:00", "b", 1.0)], [("2024-01-01 00:20:00", "a", 5.0), ("2024-01-01 09:05:00", "a", 2.0)], [("2024-01-02 09:00:00", "b", 1.0)]]):
        spark.createDataFrame(rows, schema).coalesce(1).write.json(f"{tmp_path}/in/{i}")
        for file in (tmp_path / "in" / str(i)).glob("part-*"):
            os.utime(file, (1_700_000_000 + 60 * i,) * 2)  # files are read in the order of their times
    stream = lambda: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").json(f"{tmp_path}/in").withColumn("ts", F.col("ts").cast("timestamp"))
    out = windows.drained(windows.counts(stream(), "ts", ["k"], "1 hour"), f"{tmp_path}/counts", f"{tmp_path}/c1")
    assert sorted((r.k, r.total) for r in out.collect()) == [("a", 1.0), ("a", 2.0), ("b", 2.0)]
    once = windows.drained(windows.first_seen(stream(), "ts", ["k"]).select("k", "ts", "value"), f"{tmp_path}/first", f"{tmp_path}/c2")
    # The first a is forgotten when the second comes; the first b isn't yet when the last comes, as its own batch doesn't move the watermark.
    assert sorted((r.k, r.value) for r in once.collect()) == [("a", 1.0), ("a", 2.0), ("b", 1.0)]
