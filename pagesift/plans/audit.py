"""Judging captured pages by rulesets: facts of each response once, in a stored table; verdicts and findings from it."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagesift.functions import document as D
from pagesift.functions import headers as H
from pagesift.functions import language as N
from pagesift.functions import scoring
from pagesift.functions import urls as U
from pagesift.functions.language import LanguageModel
from pagesift.operators import rules as R
from pagesift.operators import verdicts as V
from pagesift.operators.extensions import Extensions
from pagesift.operators.rulesets import Rulesets, compiled
from pagesift.plans.presets import PARSED, PRESETS
from pagesift.sources.scratch import cut, small_batches
from pagesift.sources.store import FactStore

PARSERS = {
    "accept-ch": H.accept_ch, "alt-svc": H.alt_svc, "cache-control": H.cache_control, "cache-status": H.cache_status, "cross-origin-embedder-policy": H.embedder_policy, "content-type": H.content_type,
    "cross-origin-opener-policy": H.opener_policy, "content-security-policy": H.content_policies, "strict-transport-security": H.hsts, "link": H.link, "permissions-policy": H.permissions_policy, "priority": H.priority,
    "referrer-policy": H.referrer_policy, "reporting-endpoints": H.reporting_endpoints, "use-as-dictionary": H.use_as_dictionary, "vary": H.vary,
}


def paths_read(rules: Sequence[R.Rule], unique: Sequence[Mapping] = ()) -> set[str]:
    """All paths that rules read, as their facts or in guards."""
    return {p for r in rules for p in (r.fact, *r.when)} | {p for s in unique for p in (s["fact"], *s["when"])}


def capture_facts(captures: DataFrame, groups: Mapping[str, Sequence[str]] | None = None, scope: str = "host", reads: set[str] | None = None, languages: LanguageModel | None = None, resources: int | None = None) -> DataFrame:
    """(url, http, html, robots, group, i18n) of captures (url, status, version, headers map, sent, html).

    ``html`` is null for what isn't HTML. ``reads`` are the paths that somebody will read: headers and pages that nobody
    reads aren't parsed. With a model of ``languages`` titles and descriptions are judged. ``resources`` limits a page's list of them."""
    asked = lambda *roots: reads is None or any(p == r or p.startswith(f"{r}.") or r.startswith(f"{p}.") for p in reads for r in roots)
    header = lambda n: F.try_element_at("headers", F.lit(n))
    parsed = [parse(header(n)).alias(n) for n, parse in PARSERS.items() if n == "content-type" or asked(f"http.parsed.{n}")]
    if asked("http.parsed.retry-after"):
        parsed.append(H.retry_after(header("retry-after"), F.coalesce(H.http_date(header("date")), F.col("sent"))).alias("retry-after"))
    is_html = F.coalesce(F.lower(header("content-type")).startswith("text/html"), F.lit(True))
    page = D.page(F.col("html"), F.col("url"), scope, resources) if asked("html", "robots", "http.csp", "i18n") else F.lit(None).cast(D.DDL)
    df = captures.withColumns({"__size": F.octet_length("html").cast("long"), "html": F.when(is_html, page)})
    none = F.array().cast("array<map<string, array<string>>>")
    policies = F.concat(
        F.coalesce(F.transform(F.filter(F.split(header("content-security-policy"), ","), lambda t: F.trim(t) != ""), lambda t: H.content_policy(t)), none),
        F.coalesce(F.transform(F.filter("html.http_equiv", lambda m: m["name"] == "content-security-policy"), lambda m: H.content_policy(m["content"], meta=True)), none),
    )
    csp = F.when(F.size(policies) > 0, F.struct(F.size(policies).alias("policies"), H.combined(policies).alias("directives")))
    http = [
        F.col("status"), F.col("version"), F.col("headers"), F.coalesce(header("content-type"), F.lit("")).alias("content-type"), H.document(header("content-type")).alias("document"), F.struct(*parsed).alias("parsed"),
        F.struct(F.col("__size").alias("body")).alias("size"), *([csp.alias("csp")] if asked("http.csp") else []), *([H.cookie(header("set-cookie"), F.col("sent")).alias("cookie")] if asked("http.cookie") else []),
    ]
    html = F.col("html").withField("head", F.struct(F.col("html.head_links").alias("links")))
    i18n = []
    if languages is not None:
        guesses = N.detected(F.col("html"), languages)
        html = html.withField("detected", guesses)
        i18n = [F.struct(N.disagreeing(F.col("html.lang"), guesses).alias("off")).alias("i18n")]
    robots = H.robots_directives(F.try_element_at("html.meta", F.lit("robots")), header("x-robots-tag"))
    split = U.split_url(F.col("url"))
    group = R.assign_group(F.concat(split["pathname"], split["search"]), header("content-type"), {k: list(v) for k, v in (groups or {}).items()})
    return df.select(split.alias("url"), F.struct(*http).alias("http"), F.when(F.col("html").isNotNull(), html).alias("html"), robots.alias("robots"), group.alias("group"), *i18n)


def audit(
    captures: DataFrame, rulesets: Sequence[str] = ("recommended",), own: Mapping[str, Mapping] | None = None, groups: Mapping[str, Sequence[str]] | None = None, site: DataFrame | None = None,
    extensions: Extensions | None = None, store: FactStore | None = None, run: str = "now", languages: LanguageModel | None = None, linked: Mapping[str, DataFrame] | None = None, collation: str | None = "UNICODE", **options,
) -> dict[str, DataFrame]:
    """facts, cells (every judged rule and page), verdicts, findings (folded), tallies, counters and rating of captures.

    ``own`` are the caller's rulesets, ``site`` one row of facts about the site; ``options`` are exclude and severity.
    ``extensions`` bring presets, makers of rules (a rule's ``maker`` and ``options``), and extractors, which run if a chosen rule
    reads what they give; ``linked`` has further origins and hosts (name) that the site links to. Facts are written to
    ``store`` under the name ``run``, all of them; without a store only those that rules read are made, and kept for this job."""
    ext = extensions or Extensions()
    specs = Rulesets({**PRESETS, **ext.presets}, own).select(rulesets, **options)
    made = {i: s for i, s in specs.items() if s.get("maker")}
    chosen, unique = compiled({i: s for i, s in specs.items() if i not in made})
    chosen += [ext.rule(i, s) for i, s in made.items()]
    reads = paths_read(chosen, unique) | {c for e in ext.needed(chosen) for c in e.inputs}
    every = capture_facts(small_batches(captures), groups, reads=None if store else reads, languages=languages)
    facts = (store or FactStore(captures.sparkSession)).write(run, ext.with_facts(every, chosen))
    pages = facts.withColumn("href", F.col("url.href"))
    if site is not None:
        pages = R.with_site(pages, site)
    page_rules = [r for r in chosen if not r.fact.startswith("site.")]
    cells = cut(R.evaluate(pages, page_rules, ["group", "href"]))
    verdicts = V.verdict_cells(cells)
    failing = cut(R.findings(pages, page_rules, ["group", "href"]))
    found = V.fold(failing.select("rule", "group", F.col("href").alias("url"), "text", "score"), verdicts.select("group", "rule", "applicable"), collation=collation)
    for spec in unique:
        found = found.unionByName(unique_findings(pages, spec, collation))
    for kind, per, name in (("origins", "origin", "url.origin"), ("hosts", "host", "url.host")):
        if any(r.fact.startswith(f"site.{kind}.") for r in chosen):
            subjects = ext.subjects(facts.withColumn(per, F.col(name)), chosen, per, (linked or {}).get(kind))
            found = found.unionByName(site_findings(R.subject_findings(R.with_site(subjects, site) if site is not None else subjects, chosen, kind)))
    counters = V.check_counters(verdicts)
    return {"facts": facts, "cells": cells, "verdicts": verdicts, "findings": found, "tallies": rule_tallies(cells), "counters": counters, "rating": V.rating(counters)}


def site_findings(found: DataFrame) -> DataFrame:
    """Findings about origins or hosts in the form that folding gives, one for each."""
    none = lambda kind: F.lit(None).cast(kind)
    return found.select(
        F.lit("site").alias("scope"), "rule", none("string").alias("group"), F.col("name").alias("url"), "text", "score", F.lit(1).cast("long").alias("occurrences"), none("double").alias("coverage"),
        F.array("name").alias("samples"), none("array<string>").alias("groups"),
    )


def rule_tallies(cells: DataFrame) -> DataFrame:
    """(rule, checks, failed, groups): how often each rule was judged and failed, and in how many groups of pages it failed."""
    return cells.groupBy("rule").agg(F.count("*").alias("checks"), F.count_if(~F.col("ok")).alias("failed"), F.count_distinct(F.when(~F.col("ok"), F.coalesce("group", F.lit("")))).alias("groups"))


def unique_findings(pages: DataFrame, spec: Mapping, collation: str | None = None) -> DataFrame:
    """Findings of a unique rule, in the form that folding gives: one for each value that pages share, with three of them."""
    value = R.fact(pages, spec["fact"]).column
    guards = [R.expectation(R.fact(pages, p), w if isinstance(w, Mapping) else {"const": w}) for p, w in spec["when"].items()]
    kept = pages.where(F.forall(F.array(*guards), lambda g: g)) if guards else pages
    within = ["group"] if spec["scope"] == "group" else []
    shared = R.shared_values(kept.select("group", "href", value.cast("string").alias("value")), "value", "href", within)
    by = [*within, "value", "pages"]
    listed = first_urls(shared, by, collation=collation)
    text = F.concat(F.lit(f"{spec['fact']} is shared by "), F.col("pages").cast("string"), F.lit(" pages"))
    group = F.col("group") if within else F.lit(None).cast("string")
    return listed.select(
        F.lit(spec["scope"]).alias("scope"), F.lit(spec["id"]).alias("rule"), group.alias("group"), F.get("samples", F.lit(0)).alias("url"), text.alias("text"), F.lit(float(spec["score"])).alias("score"),
        F.col("pages").alias("occurrences"), F.lit(None).cast("double").alias("coverage"), "samples", F.lit(None).cast("array<string>").alias("groups"),
    )


def first_urls(shared: DataFrame, by: list[str], k: int = 3, collation: str | None = None) -> DataFrame:
    """(by, samples): the first ``k`` URLs of each, cut within tasks before the shuffle."""
    from pyspark.sql import Window

    key = V.sort_key(F.col("href"), collation)
    place = F.row_number().over(Window.partitionBy(*by).orderBy(key))
    first = shared.withColumn("place", place).where(F.col("place") <= k).groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("place", "href"))).alias("s"))
    return first.select(*by, F.col("s.href").alias("samples"))


def summary(facts: DataFrame, findings: DataFrame, verdicts: DataFrame, rules: Sequence[str]) -> DataFrame:
    """(kind, name, n): pages, bytes of their bodies, pages by group and by status, findings by level and by rule, and rules that were judged nowhere."""
    spark = facts.sparkSession
    count = lambda df, kind, name: df.groupBy(name.cast("string").alias("name")).agg(F.count("*").alias("n")).select(F.lit(kind).alias("kind"), "name", "n")
    known = spark.createDataFrame([(r,) for r in rules], "rule string")
    out = facts.agg(F.count("*").alias("n")).select(F.lit("pages").alias("kind"), F.lit("").alias("name"), "n")
    more = [facts.agg(F.coalesce(F.sum("http.size.body"), F.lit(0)).alias("n")).select(F.lit("bytes").alias("kind"), F.lit("").alias("name"), "n")]
    more += [count(facts, "group", F.col("group")), count(facts, "status", F.col("http.status")), count(findings, "severity", scoring.level_of(F.col("score"))), count(findings, "rule", F.col("rule"))]
    more.append(V.untested(known, verdicts).select(F.lit("untested").alias("kind"), F.col("rule").alias("name"), F.lit(1).cast("long").alias("n")))
    for m in more:
        out = out.unionByName(m)
    return out


def unparsed_headers() -> list[str]:
    """Headers that a preset judges by grammar but no parser reads; there should be none."""
    return sorted({h for h, _, _ in PARSED.values()} - {*PARSERS, "retry-after"})
