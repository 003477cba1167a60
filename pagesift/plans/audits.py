"""Queries that run the whole audit over the pages table, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagesift.operators.extensions import Extensions, PageExtractor, SiteExtractor
from pagesift.operators.rules import Rule
from pagesift.plans.audit import audit
from pagesift.plans.pages import FACTS, read

QUERIES: dict = {}
SQL: dict[str, str] = {}

#: A ruleset of the caller's: facts of the parser, a header, a shared value, what extractors give, and a rule that a maker makes.
OWN = {
    "mine": {
        "rules": {
            "own/lang": {"fact": "html.lang", "expect": {"enum": ["en", "fr"]}, "severity": "error", "score": 7.5},
            "own/heading": {"fact": "html.h1", "expect": {"maxItems": 1, "minItems": 1}, "severity": "warning", "score": 5.0},
            "own/https": {"fact": "url.protocol", "expect": {"const": "https:"}, "severity": "warning", "score": 4.0},
            "own/vary": {"fact": "http.parsed.vary.errors", "expect": {"maxItems": 0}, "severity": "info", "score": 2.0, "when": {"html.lang": "en"}},
            "own/marks": {"fact": "marks.n", "expect": {"maximum": 1}, "severity": "hint", "score": 0.5},
            "own/pages": {"fact": "site.hosts.*.counted.pages", "expect": {"maximum": 4}, "severity": "info", "score": 1.5},
            "own/short": {"maker": "at-most", "options": {"path": "url.pathname", "n": 8}, "severity": "hint"},
        }
    }
}


def _extensions() -> Extensions:
    ext = Extensions()
    ext.page_extractor(PageExtractor("marks", lambda url: F.struct(F.regexp_count(url["search"], F.lit("[=&]")).alias("n")), ("url",)))
    ext.page_extractor(PageExtractor("never", lambda html: F.raise_error(F.lit("no rule reads this")), ("html",)))
    ext.site_extractor(SiteExtractor("counted", "host", lambda pages: pages.groupBy("host").agg(F.struct(F.count_distinct("url.href").alias("pages")).alias("counted"))))
    ext.rule_maker("at-most", lambda path, n: Rule("", path, {"maxLength": n}))
    return ext


def _captures(spark, sf_dir) -> DataFrame:
    n = F.col("page_id")
    headers = F.create_map(F.lit("content-type"), F.lit("text/html"), F.lit("vary"), F.when(n % 3 == 0, "accept encoding").otherwise("accept-encoding"))
    return read(spark, sf_dir, "pages").select("url", F.lit(200).alias("status"), F.lit("2").alias("version"), headers.alias("headers"), F.lit("2024-01-01 00:00:00").cast("timestamp").alias("sent"), "html")


def audit_tallies(spark, sf_dir):
    """How often each page rule was judged and failed, by way of the store of facts."""
    return audit(_captures(spark, sf_dir), ["mine"], OWN, extensions=_extensions())["tallies"].select("rule", "checks", "failed")


def audit_hosts(spark, sf_dir):
    """Findings about hosts, from a site extractor."""
    found = audit(_captures(spark, sf_dir), ["mine"], OWN, extensions=_extensions())["findings"]
    return found.where("scope = 'site' AND rule = 'own/pages'").select("rule", "url", "score", "samples")


_JUDGED = f"""WITH {FACTS},
judged AS (
  SELECT unnest([{{'rule': 'own/lang', 'ok': coalesce(lang IN ('en', 'fr'), false)}}, {{'rule': 'own/heading', 'ok': len(h1) = 1}}, {{'rule': 'own/https', 'ok': scheme = 'https'}},
    CASE WHEN lang = 'en' THEN {{'rule': 'own/vary', 'ok': page_id % 3 <> 0}} END,
    {{'rule': 'own/marks', 'ok': len(regexp_extract_all(search, '[=&]')) <= 1}}, {{'rule': 'own/short', 'ok': length(pathname) <= 8}}]) AS c
  FROM facts)"""
SQL["audit_tallies"] = f"{_JUDGED} SELECT c.rule AS rule, count(*) AS checks, count(*) FILTER (NOT c.ok) AS failed FROM judged WHERE c IS NOT NULL GROUP BY ALL"
SQL["audit_hosts"] = f"""WITH {FACTS}, h AS (SELECT regexp_replace(lower(split_part(split_part(raw, '://', 2), '/', 1)), ':[0-9]+$', '') AS host, count(DISTINCT href) AS n FROM facts GROUP BY ALL)
SELECT 'own/pages' AS rule, host AS url, 1.5::DOUBLE AS score, [host] AS samples FROM h WHERE n > 4"""
QUERIES.update(audit_tallies=audit_tallies, audit_hosts=audit_hosts)
