"""Operators on small inputs with known results."""

import random

import pytest
from pyspark.sql import functions as F

from pagesift.functions import headers, html, scoring, urls
from pagesift.operators import caching, graph, insights, lookups, mail, rules, verdicts
from pagesift.sources import files, reports
from pagesift.streaming import runs, windows


def one(spark, column, **values):
    schema = ", ".join(f"{k} string" for k in values)
    return spark.createDataFrame([tuple(values.values())], schema).select(column.alias("x")).first().x


@pytest.mark.parametrize(
    ("ref", "want"),
    [("/a", "https://e.example/a"), ("b?c#d", "https://e.example/x/b?c"), ("?q", "https://e.example/x/y?q"), ("//o.example/z", "https://o.example/z"), ("mailto:a@b", "mailto:a@b"), ("#f", "https://e.example/x/y?p"), ("", "https://e.example/x/y?p")],
)
def test_resolve(spark, ref, want):
    assert one(spark, urls.resolve(F.col("base"), F.col("ref")), base="https://e.example/x/y?p", ref=ref) == want


def test_url_null(spark):
    assert one(spark, urls.host(F.col("u")), u=None) is None


def test_html_ignores_scripts(spark):
    page = '<html lang=en><title> A </title><script>var t="<h1>no</h1>"</script><!-- <h1>no</h1> --><h1>b<b>c</b></h1><img src=""><img alt="" src="x">'
    assert one(spark, html.headings(F.col("h")), h=page) == ["bc"]
    assert one(spark, html.title(F.col("h")), h=page) == "A"
    assert [i.alt for i in one(spark, html.images(F.col("h")), h=page)] == [None, ""]
    assert one(spark, html.title(F.col("h")), h="<p>") is None


def reference(value, schema):
    """The keywords once more, over Python values."""
    kinds = {"string": str, "array": list, "object": dict, "boolean": bool}
    number = isinstance(value, (int, float)) and not isinstance(value, bool)
    ok = True
    for k, w in schema.items():
        if k == "type":
            ok &= any(number if t in ("number", "integer") else isinstance(value, kinds[t]) for t in ([w] if isinstance(w, str) else w))
        elif k == "const":
            ok &= value == w
        elif k == "enum":
            ok &= value in w
        elif k in ("minLength", "maxLength") and isinstance(value, str):
            ok &= len(value) >= w if k == "minLength" else len(value) <= w
        elif k in ("minimum", "maximum") and number:
            ok &= value >= w if k == "minimum" else value <= w
        elif k in ("minItems", "maxItems") and isinstance(value, list):
            ok &= len(value) >= w if k == "minItems" else len(value) <= w
        elif k == "items" and isinstance(value, list):
            ok &= all(reference(v, w) for v in value)
        elif k == "contains" and isinstance(value, list):
            ok &= schema.get("minContains", 1) <= sum(reference(v, w) for v in value) <= schema.get("maxContains", 10**9)
        elif k == "not":
            ok &= not reference(value, w)
        elif k == "anyOf":
            ok &= any(reference(value, s) for s in w)
        elif k == "allOf":
            ok &= all(reference(value, s) for s in w)
        elif k == "if":
            ok &= reference(value, schema.get("then", {}) if reference(value, w) else schema.get("else", {}))
    return bool(ok)


def made_schema(rng, depth=0):
    leaf = [
        {"type": rng.choice(["string", "number", "array", ["string", "array"]])}, {"const": rng.choice(["a", 3])}, {"enum": ["b", 2]}, {"minLength": rng.randint(0, 3)}, {"maxLength": rng.randint(0, 3)},
        {"minimum": rng.randint(0, 4)}, {"maximum": rng.randint(0, 4)}, {"minItems": rng.randint(0, 2)}, {"maxItems": rng.randint(0, 2)},
    ]
    if depth > 2 or rng.random() < 0.4:
        return rng.choice(leaf)
    sub = lambda: made_schema(rng, depth + 1)
    return rng.choice([lambda: {"not": sub()}, lambda: {"anyOf": [sub(), sub()]}, lambda: {"allOf": [sub(), sub()]}, lambda: {"if": sub(), "then": sub(), "else": sub()}, lambda: {"items": sub()}, lambda: {"contains": sub(), "minContains": 0, "maxContains": 1}, lambda: {"contains": sub()}])()


def test_expectations_against_reference(spark):
    rng = random.Random(5)
    rows = [(s, n, a) for s in (None, "", "a", "bcd") for n in (None, 0, 3) for a in (None, [], ["a"], ["a", "b", None])]
    df = spark.createDataFrame(rows, "s string, n long, a array<string>").coalesce(1)
    cases = [(c, made_schema(rng)) for c in "sna" for _ in range(25)]
    got = df.select(*[rules.expectation(rules.fact(df, c), s).alias(f"x{i}") for i, (c, s) in enumerate(cases)]).collect()
    for row, values in zip(got, rows, strict=True):
        for i, (c, schema) in enumerate(cases):
            assert row[i] == reference(values["sna".index(c)], schema), (values, c, schema)


def test_rule_skips_and_scale(spark):
    df = spark.createDataFrame([("a", 50), (None, None), ("b", 150)], "k string, n int").select("k", F.when(F.col("n").isNotNull(), F.struct("n")).alias("f"))
    rule = rules.Rule("r", "f.n", {"minimum": 100}, when={"k": {"enum": ["a", "b"]}}, scale=((0, 6.5), (100, 3.3)))
    cells = {r.k: (r.ok, r.score) for r in rules.evaluate(df, [rule], ["k"]).collect()}
    assert cells == {"a": (False, 4.9), "b": (True, 3.3)}
    with pytest.raises(ValueError):
        rules.expectation(rules.fact(df, "k"), {"unheard": 1})


def test_map_path_with_dots(spark):
    df = spark.createDataFrame([({"og:title.x": "t"},)], "m map<string,string>")
    assert df.select(rules.fact(df, "m.og:title.x").column.alias("x")).first().x == "t"


@pytest.mark.parametrize(("glob", "path", "hit"), [("/a/*", "/a/b", True), ("/a/*", "/a/b/c", False), ("/a/**", "/a/b/c", True), ("/{a,b}/x.?", "/b/x.1", True), ("/a+", "/aa", False)])
def test_glob(spark, glob, path, hit):
    assert one(spark, F.col("p").rlike(rules.glob_pattern(glob)), p=path) is hit


def test_scores(spark):
    row = spark.range(1).select(scoring.tenths(F.lit(3.25)).alias("a"), scoring.level_of(F.lit(3.25)).alias("b"), scoring.pinned(F.lit("info"), F.lit(9)).alias("c"), scoring.interpolated(F.lit(5), [(10, 2.0), (0, 1.0)]).alias("d"), scoring.level_of(F.lit(0.94)).alias("e")).first()
    assert (row.a, row.b, row.c, row.d, row.e) == (3.3, "warning", 3.2, 1.5, "hint")


@pytest.mark.parametrize(("failed", "errored", "cost", "grade"), [(0, 0, 0.0, "S"), (1, 0, 1.0, "A"), (1, 1, 1.0, "B"), (3, 0, 3.5, "C"), (9, 0, 30.0, "F")])
def test_rating(spark, failed, errored, cost, grade):
    df = spark.createDataFrame([(10, failed, errored, cost)], "total long, failed long, errored long, cost double")
    assert verdicts.rating(df).first().grade == grade


def folded_by_hand(found, applicable, threshold=0.8, least=3):
    """Scopes of what folding gives, by (scope, rule, group, says), with occurrences."""
    cells = {}
    for rule, group, url, text, place in found:
        cells.setdefault((group, rule), []).append((url, (text, place)))
    whole, out = {}, {}
    for (group, rule), hits in cells.items():
        failed, of = len({u for u, _ in hits}), applicable[group, rule]
        is_folded, says = of >= least and failed / of >= threshold, {x for _, x in hits}
        if (is_folded or failed == of) and len(says) == 1:
            whole.setdefault((rule, *says), []).append((group, failed, is_folded))
        elif is_folded:
            out["group", rule, group] = failed
        else:
            out["page", rule, group] = failed
            if of >= least and failed / of > 0.2:
                out["group", "groups/heterogeneous", group, rule] = None
    for (rule, says), groups in whole.items():
        if len(groups) > 1:
            out["site", rule, *says] = sum(f for _, f, _ in groups)
        else:
            ((group, failed, is_folded),) = groups
            out["group" if is_folded else "page", rule, group] = failed
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_fold_against_a_plain_version(spark, seed):
    rng = random.Random(seed)
    found, applicable = [], {}
    for rule in ("x/a", "x/b", "y/c", "z/d"):
        for group in ("news", "shop", "help", "misc"):
            of = rng.randint(1, 7)
            applicable[group, rule] = of
            say = rng.choice(["same", "other"])
            for i in rng.sample(range(of), rng.choice([0, of, of, max(1, of // 2)])):
                found.append((rule, group, f"/{group}/{i}", say if rng.random() < 0.9 else "odd", rng.choice(["1:1", "1:1", "1:1", "2:2"]) if rule == "y/c" else "-"))
    df = spark.createDataFrame([(*f[:4], 5.0, [f[4]]) for f in found], "rule string, group string, url string, text string, score double, locations array<string>")
    of = spark.createDataFrame([(g, r, n) for (g, r), n in applicable.items()], "group string, rule string, applicable long")
    got = {}
    for r in verdicts.fold(df, of).collect():
        if r.rule == "groups/heterogeneous":
            got["group", r.rule, r.group, r.text.split(" break ")[1].split(",")[0]] = None
        elif r.scope == "page":
            got["page", r.rule, r.group] = got.get(("page", r.rule, r.group), 0) + 1
        elif r.scope == "group":
            got["group", r.rule, r.group] = r.occurrences
        else:
            got["site", r.rule, r.text, r.occurrences] = sorted(r.groups)
            assert r.coverage == round(r.occurrences / sum(applicable[g, r.rule] for g in r.groups), 2)
            assert r.samples == sorted(f[2] for f in found if f[0] == r.rule and f[1] in r.groups)[:3]
    want = {}
    for k, v in folded_by_hand([(*f[:4], f[4]) for f in found], applicable).items():
        want[("site", k[1], k[2], v) if k[0] == "site" else k] = v
    assert set(got) == set(want)
    assert {k: v for k, v in got.items() if k[0] != "site"} == {k: v for k, v in want.items() if k[0] != "site"}


def test_fold_switched_off_and_other_scopes(spark):
    rows = [("page", "r", "g", f"/{i}", "t", 5.0) for i in range(4)] + [("site", "s", None, "/", "u", 6.0)]
    df = spark.createDataFrame(rows, "scope string, rule string, group string, url string, text string, score double")
    of = spark.createDataFrame([("g", "r", 4)], "group string, rule string, applicable long")
    assert verdicts.fold(df, of, folding=False).count() == 5
    assert sorted((r.scope, r.rule) for r in verdicts.fold(df, of).collect()) == [("group", "r"), ("site", "s")]


@pytest.mark.parametrize("seed", [5, 6])
def test_graph_against_a_plain_version(spark, seed):
    rng = random.Random(seed)
    names = [f"n{i}" for i in range(12)]
    pairs = sorted({(a, b) for a in names[:10] for b in rng.sample(names, 3) if a != b})
    out = {n: [b for a, b in pairs if a == n] for n in names}
    e = spark.createDataFrame(pairs, "src string, dst string")
    nodes = spark.createDataFrame([(n,) for n in names], "node string")
    links = spark.createDataFrame([*pairs, ("n0", "elsewhere"), ("n0", "n0")], "src string, target string")
    degree = {r.node: (r.in_degree, r.out_degree) for r in graph.degrees(nodes, e, links).collect()}
    assert degree == {n: (sum(b == n for _, b in pairs), len(out[n]) + (n == "n0")) for n in names}
    depth = frontier = {"n0": 0}
    while frontier:
        frontier = {b: d + 1 for a, d in frontier.items() for b in out[a] if b not in depth}
        depth = depth | frontier
    reached = graph.depths(e, nodes.where("node = 'n0'"))
    assert {r.node: r.depth for r in reached.collect()} == depth
    rank = dict.fromkeys(names, 1 / 12)
    for _ in range(100):
        held = sum(rank[n] for n in names if not out[n])
        rank = {n: (0.15 + 0.85 * held) / 12 + 0.85 * sum(rank[a] / len(out[a]) for a, b in pairs if b == n) for n in names}
    assert {r.node: r["rank"] for r in graph.pagerank(nodes, e).collect()} == pytest.approx({n: 12 * r for n, r in rank.items()}, abs=1e-6)
    assert graph.pagerank(nodes.limit(0), e.limit(0)).count() == 0
    told = graph.summary(nodes, e, reached, complete=False).first()
    assert (told.pages, told.edges, told.unreached, told.deepest, told.complete) == (12, len(pairs), 12 - len(depth), max(depth.values()), False)


def test_previous_page_and_partial_marks(spark):
    nexts = spark.createDataFrame([("/1", "/2", 1), ("/x", "/2", 2), ("/2", "/gone", 3)], "page string, target string, ordinal int")
    known = spark.createDataFrame([("/2", "/2"), ("/old", "/1")], "url string, page string")
    assert graph.previous_pages(nexts, known).collect() == [("/2", "/x")]
    found = spark.createDataFrame([("links/depth", "deep"), ("html/x", "y")], "rule string, text string")
    assert sorted(r.text for r in graph.marked_partial(found, ["links/depth"], False).collect()) == ["deep (as far as the crawl went)", "y"]
    assert graph.marked_partial(found, ["links/depth"], True).count() == 2


def test_following_over_many_ranges(spark):
    rows = [(i * 7919 % 1000, i % 3, i) for i in range(1000)]
    got = graph.following(spark.createDataFrame(rows, "at int, tie int, v int"), ["at", "tie", "v"], "v", parts=13)
    order = [v for *_, v in sorted(rows)]
    assert {r.v: r.next for r in got.collect()} == dict(zip(order, [*order[1:], None]))


@pytest.mark.parametrize("n", [1, 2, 3, 50, 101])
def test_ranks_from_counts(spark, n):
    rng = random.Random(n)
    values = {g: [rng.choice([rng.random(), 0.5, -1.0]) for _ in range(n + k)] for k, g in enumerate("ab")}
    df = spark.createDataFrame([(g, v) for g, vs in values.items() for v in vs] + [("a", None), ("none", None)], "g string, v double")
    got = {r.g: r for r in insights.ranked(df, ["g"], "v", {**insights.MIDDLE, "p95": lambda m: F.ceil(m * 0.95)}).collect()}
    assert set(got) == {"a", "b"}
    for g, vs in values.items():
        ordered = sorted(vs)
        m = len(ordered)
        assert (got[g].n, got[g].low, got[g].high, got[g].p95) == (m, ordered[(m - 1) // 2], ordered[m // 2], ordered[-(-m * 95 // 100) - 1])


def test_dominating(spark):
    df = spark.createDataFrame([(i, float(i)) for i in range(20)] + [(99, 1000.0), (98, None)], "id int, v double")
    assert insights.dominating(df, "id", "v").collect() == [(99, 1000.0, sum(range(10, 20)))]
    assert insights.dominating(df.where("id < 50"), "id", "v").count() == 0


def test_value_counts_ignore_a_fact(spark):
    df = spark.createDataFrame([("h", "1", "a", None), ("h", "2", "b", "address"), ("h", "1", "a", None)], "host string, version string, address string, no string")
    got = insights.value_counts(df, "host", ["version", "address"], F.col("no"))
    assert sorted((r.fact, r.value, r.n) for r in got.collect()) == [("version", "1", 2), ("version", "2", 1)]


def test_outlier_and_minority(spark):
    df = spark.createDataFrame([(i, 1000.0 if i == 2 else 100.0 + i % 3, "h1" if i == 1 else "h2") for i in range(25)], "id int, v double, http string")
    assert [r.id for r in insights.outliers(df, "id", "v").collect()] == [2]
    assert [(r.http, r.n) for r in insights.minorities(df, "http").collect()] == [("h1", 1)]
    assert insights.outliers(df.limit(5), "id", "v").count() == 0


def test_lookups(spark):
    at = spark.createDataFrame([("10.1.2.3",), ("300.1.1.1",), (None,), ("11.0.0.1",)], "a string")
    blocks = spark.createDataFrame([("10.0.0.0/8", 1), ("10.1.2.3/32", 2)], "b string, n int")
    assert sorted(r.n for r in lookups.in_blocks(at, blocks, "a", "b").collect()) == [1, 2]
    hosts = spark.createDataFrame([("a.b.example",)], "h string")
    records = spark.createDataFrame([("example", 1), ("b.example", 2), ("xb.example", 3)], "n string, v int")
    assert lookups.nearest_ancestor(hosts, records, "h", "n", "v").first().v == 2


def test_asof_keeps_null_values(spark):
    left = spark.createDataFrame([(1, 5), (1, 1), (2, 9)], "k int, t int")
    right = spark.createDataFrame([(1, 2, 7), (1, 5, None)], "k int, t int, v int")
    assert sorted((r.k, r.t, r.v) for r in lookups.asof(left, right, ["k"], "t", "t", "v").collect() if r.k == 1 and r.t == 1) == [(1, 1, None)]
    assert [r.v for r in lookups.asof(left, right, ["k"], "t", "t", "v").where("t = 5").collect()] == [None]


def test_headers(spark):
    assert one(spark, headers.http_date(F.col("d")), d="Tue, 02 Jan 2024 03:04:05 GMT").isoformat() == "2024-01-02T03:04:05"
    assert one(spark, headers.http_date(F.col("d")), d="Mon, 02 Jan 2024 03:04:05 GMT") is None
    assert one(spark, headers.cache_control(F.col("h")), h=None) is None
    assert one(spark, headers.vary(F.col("h")), h="B, a , b").value == ["b", "a", "b"]
    policy = one(spark, headers.content_policy(F.col("h")), h="script-src 'nonce-a' 'unsafe-inline'; script-src x")
    assert policy == {"script-src": ["'nonce-a'"]}


def test_robots_longest_rule_wins(spark):
    text = "User-agent: *\nDisallow: /\nAllow: /a\nUser-agent: bot\nDisallow: /a/b"
    groups = files.robots_groups(spark.createDataFrame([("o", text)], "o string, text string"), "o", "text")
    paths = spark.createDataFrame([("o", "/a/b/c"), ("o", "/z")], "o string, p string")
    assert {r.p: r.allowed for r in files.allowed(paths, groups, "o", "p", "Bot").collect()} == {"/a/b/c": False, "/z": True}
    assert {r.p: r.allowed for r in files.allowed(paths, groups, "o", "p", "other").collect()} == {"/a/b/c": True, "/z": False}


def test_spf_loop_ends(spark):
    records = spark.createDataFrame([("a", "v=spf1 include:b -all"), ("b", "v=spf1 redirect=a")], "name string, record string")
    assert mail.spf_walk(spark.createDataFrame([("a",), ("none",)], "domain string"), records).orderBy("domain").collect() == [("a", 2, True), ("none", 0, True)]


def test_durations_and_digest(spark):
    assert [one(spark, caching.seconds(F.col("d")), d=d) for d in ("90", "30m", "7d", "x")] == [90, 1800, 604800, None]
    assert one(spark, caching.digest("d"), d=None) != one(spark, caching.digest("d"), d="")


def test_reports(spark, tmp_path):
    found = spark.createDataFrame([("page", "r", "g", "u", 'a "b", c', 5.0, None)], "scope string, rule string, group string, url string, text string, score double, occurrences long")
    reports.write_csv(found, f"{tmp_path}/csv")
    assert spark.read.csv(f"{tmp_path}/csv", header=True, escape='"').first().message == 'a "b", c'
    reports.write_json(found, f"{tmp_path}/json")
    assert spark.read.json(f"{tmp_path}/json").first().severity == "warning"
    assert '"rank":50.0' in reports.sarif_results(found).first().result


def test_stream_windows_with_watermark(spark, tmp_path):
    rows = spark.createDataFrame([("2024-01-01 00:10:00", 1.0), ("2024-01-01 05:00:00", 2.0)], "ts string, value double").select(F.col("ts").cast("timestamp"), "value")
    rows.write.parquet(f"{tmp_path}/in")
    stream = windows.counts(spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in"), "ts", [], "1 hour")
    out = windows.drained(stream, f"{tmp_path}/out", f"{tmp_path}/c")
    assert [(r.n, r.total) for r in out.collect()] == [(1, 1.0)]
