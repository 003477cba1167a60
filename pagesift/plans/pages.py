"""Queries over pages: URLs, markup, rules, verdicts and folding, each with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagesift.functions import html as H
from pagesift.functions import scoring as S
from pagesift.functions import urls as U
from pagesift.operators import rules as R
from pagesift.operators import verdicts as V
from pagesift.plans import lint as L

QUERIES: dict[str, Callable] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a function (pages and the like are read from spark and sf_dir) with its SQL."""

    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def read(spark, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


URL = r"'^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^?#]*)(?:\?([^#]*))?(?:#(.*))?$'"
SEEN = r"regexp_replace(html, '<script\b.*?</script>|<style\b.*?</style>|<!--.*?-->', '', 'gsi')"
#: Facts of pages as the library's regular expressions give them.
FACTS = rf"""
parts AS (
  SELECT page_id, url AS raw, html, regexp_replace(url, '#.*$', '') AS href, lower(regexp_extract(url, {URL}, 1)) AS scheme,
         lower(regexp_extract(url, {URL}, 2)) AS netloc, regexp_extract(url, {URL}, 3) AS path, regexp_extract(url, {URL}, 4) AS q, {SEEN} AS seen
  FROM pages),
facts AS (
  SELECT page_id, raw, html, seen, href, scheme, scheme || '://' || netloc AS origin, regexp_replace(netloc, ':\d+$', '') AS host,
         CASE WHEN path = '' THEN '/' ELSE path END AS pathname, CASE WHEN q = '' THEN '' ELSE '?' || q END AS search, q,
         nullif(trim(regexp_extract(seen, '(?is)<title[^>]*>(.*?)</title>', 1)), '') AS title,
         nullif(regexp_extract(html, '(?is)<html[^>]*\slang=["'']?([A-Za-z0-9-]+)', 1), '') AS lang,
         nullif(lower(regexp_extract(html, '(?is)<meta[^>]*charset=["'']?([A-Za-z0-9_-]+)', 1)), '') AS charset,
         list_transform(regexp_extract_all(seen, '(?is)<h1\b[^>]*>(.*?)</h1>', 1), lambda x: trim(regexp_replace(x, '<[^>]*>', '', 'g'))) AS h1,
         regexp_extract_all(seen, '(?is)<a\s[^>]*?href=["'']([^"'']*)["'']', 1) AS hrefs,
         trim(regexp_replace(regexp_replace(seen, '(?s)<[^>]*>', ' ', 'g'), '\s+', ' ', 'g')) AS body,
         length(html)::BIGINT AS len,
         CASE WHEN regexp_matches(path, '^/en(/|$)') THEN 'en' WHEN regexp_matches(path, '^/fr(/|$)') THEN 'fr'
              WHEN regexp_matches(path, '^/de(/|$)') THEN 'de' WHEN regexp_matches(path, '^/es(/|$)') THEN 'es' ELSE 'default' END AS grp
  FROM parts)"""
WORDS = "CASE WHEN body = '' THEN 0 ELSE len(string_split(body, ' ')) END::BIGINT"


@query(f"WITH {FACTS} SELECT page_id, href, origin, scheme || ':' AS protocol, host, pathname, search FROM facts")
def url_split(spark, sf_dir):
    return read(spark, sf_dir, "pages").select("page_id", U.split_url(F.col("url")).alias("u")).select("page_id", "u.*")


@query(
    f"""WITH {FACTS}, kept AS (
  SELECT page_id, regexp_extract(raw, '^[^?#]*', 0) AS base,
         array_to_string(list_filter(string_split(q, '&'), lambda p: NOT (lower(split_part(p, '=', 1)) IN ('ref', 'fbclid', 'gclid') OR starts_with(lower(split_part(p, '=', 1)), 'utm_'))), '&') AS rest
  FROM facts)
SELECT page_id, base || CASE WHEN rest = '' THEN '' ELSE '?' || rest END AS url FROM kept"""
)
def url_strip_tracking(spark, sf_dir):
    return read(spark, sf_dir, "pages").select("page_id", U.strip_parameters(F.col("url")).alias("url"))


@query(f"WITH {FACTS} SELECT page_id, title, lang, charset, array_to_string(h1, '|') AS h1 FROM facts")
def html_title_lang_h1(spark, sf_dir):
    h = F.col("html")
    return read(spark, sf_dir, "pages").select("page_id", H.title(h).alias("title"), H.lang(h).alias("lang"), H.charset(h).alias("charset"), F.array_join(H.headings(h), "|").alias("h1"))


@query(f"WITH {FACTS} SELECT page_id, {WORDS} AS words, len AS length FROM facts")
def word_count_main(spark, sf_dir):
    return read(spark, sf_dir, "pages").select("page_id", H.words(F.col("html")).alias("words"), F.length("html").cast("long").alias("length"))


def links(pages: DataFrame) -> DataFrame:
    """(page_id, href, origin, position, target): one row per anchor, its target resolved."""
    raw = pages.select("page_id", F.col("url"), F.posexplode(H.hrefs(F.col("html"))).alias("position", "ref"))
    return raw.select("page_id", U.without_fragment(F.col("url")).alias("href"), U.host(F.col("url")).alias("host"), "position", "ref", U.resolve(F.col("url"), F.col("ref")).alias("target"))


#: Root-relative, absolute and plain relative references, as in the test pages.
LINKS = FACTS + r""",
refs AS (SELECT page_id, href, host, origin, scheme, pathname, unnest(hrefs) AS ref, generate_subscripts(hrefs, 1) - 1 AS position FROM facts),
links AS (
  SELECT page_id, href, host, position, ref,
         regexp_replace(CASE WHEN regexp_matches(ref, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN ref WHEN starts_with(ref, '//') THEN scheme || ':' || ref
              WHEN starts_with(ref, '/') THEN origin || ref WHEN starts_with(ref, '?') THEN origin || pathname || ref WHEN ref = '' OR starts_with(ref, '#') THEN href
              ELSE origin || regexp_replace(pathname, '[^/]*$', '') || ref END, '#.*$', '') AS target
  FROM refs)"""


@query(f"WITH {LINKS} SELECT page_id, position::INT AS position, ref FROM links")
def links_explode(spark, sf_dir):
    return links(read(spark, sf_dir, "pages")).select("page_id", "position", "ref")


@query(f"WITH {LINKS} SELECT DISTINCT page_id, target FROM links")
def links_resolve(spark, sf_dir):
    return links(read(spark, sf_dir, "pages")).select("page_id", "target").distinct()


@query(
    f"""WITH {LINKS} SELECT page_id, count(DISTINCT target) FILTER (lower(regexp_extract(target, {URL}, 2)) = host) AS internal,
  count(DISTINCT target) FILTER (lower(regexp_extract(target, {URL}, 2)) <> host) AS external FROM links GROUP BY page_id"""
)
def links_distinct_internal_external(spark, sf_dir):
    found = links(read(spark, sf_dir, "pages")).withColumn("inside", U.host(F.col("target")) == F.col("host"))
    return found.groupBy("page_id").agg(F.count_distinct(F.when(F.col("inside"), F.col("target"))).alias("internal"), F.count_distinct(F.when(~F.col("inside"), F.col("target"))).alias("external"))


@query(
    f"""WITH {FACTS}, uses AS (
  SELECT page_id, 'script' AS kind, unnest(regexp_extract_all(html, '(?is)<script[^>]*\\ssrc=["'']([^"'']*)["'']', 1)) AS url FROM facts
  UNION ALL SELECT page_id, 'image', unnest(regexp_extract_all(html, '(?is)<img[^>]*\\ssrc=["'']([^"'']*)["'']', 1)) FROM facts
  UNION ALL SELECT page_id, 'anchor', unnest(hrefs) FROM facts)
SELECT DISTINCT page_id, kind, url FROM uses"""
)
def resources_dedupe(spark, sf_dir):
    pages, h = read(spark, sf_dir, "pages"), F.col("html")
    of = lambda tag: F.regexp_extract_all(h, F.lit(rf"""(?is)<{tag}[^>]*\ssrc=["']([^"']*)["']"""), 1)
    kinds = {"script": of("script"), "image": of("img"), "anchor": H.hrefs(h)}

    def uses(kind, urls):
        return F.transform(urls, lambda u: F.struct(F.lit(kind).alias("kind"), u.alias("url")))

    every = F.concat(*[uses(k, c) for k, c in kinds.items()])
    return pages.select("page_id", F.explode(every).alias("r")).select("page_id", "r.kind", "r.url").dropDuplicates(["page_id", "kind", "url"])


@query(f"WITH {FACTS} SELECT grp AS \"group\", count(*) AS pages, count(DISTINCT host) AS hosts FROM facts GROUP BY grp")
def group_assign_first_match(spark, sf_dir):
    facts = L.page_facts(read(spark, sf_dir, "pages"))
    return facts.groupBy("group").agg(F.count("*").alias("pages"), F.count_distinct("url.host").alias("hosts"))


def _verdicts(spark, sf_dir, rule: R.Rule) -> DataFrame:
    facts = L.page_facts(read(spark, sf_dir, "pages"))
    return facts.select("page_id", R.verdict(facts, rule).alias("ok"))


def _rule_query(name: str, rule: R.Rule, sql: str) -> None:
    def run(spark, sf_dir):
        return _verdicts(spark, sf_dir, rule)

    run.__name__ = name
    query(f"WITH {FACTS} SELECT page_id, {sql} AS ok FROM facts")(run)


_rule_query("rule_title_length", R.Rule("title", "html.title", {"type": "string", "minLength": 10, "maxLength": 60}), "coalesce(length(title) BETWEEN 10 AND 60, false)")
_rule_query("rule_h1_single", R.Rule("h1", "html.h1", {"type": "array", "minItems": 1, "maxItems": 1}), "len(h1) = 1")
_rule_query("rule_charset_present", R.Rule("charset", "html.charset", {"const": "utf-8"}), "coalesce(charset = 'utf-8', false)")
_rule_query("rule_lang_pattern", R.Rule("lang", "html.lang", {"type": "string", "pattern": "^(en|de)$"}), "coalesce(regexp_matches(lang, '^(en|de)$'), false)")
_rule_query("rule_when_guard", R.Rule("words", "html.words", {"minimum": 300}, when={"html.lang": {"enum": ["en", "de"]}, "url.protocol": "https:"}), f"CASE WHEN lang IN ('en', 'de') AND scheme = 'https' THEN {WORDS} >= 300 END")
_rule_query("rule_contains_counts", R.Rule("hrefs", "html.hrefs", {"contains": {"pattern": "^/t"}, "minContains": 1, "maxContains": 2}), "len(list_filter(hrefs, lambda x: regexp_matches(x, '^/t'))) BETWEEN 1 AND 2")
_rule_query("rule_items", R.Rule("hrefs", "html.hrefs", {"items": {"maxLength": 12, "not": {"pattern": ",$"}}}), "len(list_filter(hrefs, lambda x: NOT (length(x) <= 12 AND NOT regexp_matches(x, ',$')))) = 0")
_rule_query("rule_first_item", R.Rule("h1", "html.h1.0", {"anyOf": [{"maxLength": 30}, {"pattern": "%%%"}]}), "coalesce(length(h1[1]) <= 30, true) OR coalesce(regexp_matches(h1[1], '%%%'), true)")
_rule_query("rule_if_then", R.Rule("if", "html", {"if": {"properties": {"lang": {"const": "en"}}}, "then": {"properties": {"words": {"minimum": 200}}}, "else": {"properties": {"words": {"maximum": 1000}}}}), f"CASE WHEN coalesce(lang = 'en', true) THEN {WORDS} >= 200 ELSE {WORDS} <= 1000 END")
_rule_query("rule_absent_fact", R.Rule("absent", "html.description", {"not": {"type": "string"}}), "true")


@query(f"WITH {FACTS} SELECT title, count(DISTINCT href) AS pages, array_to_string(list_sort(list(DISTINCT href)), ' ') AS urls FROM facts WHERE title IS NOT NULL GROUP BY title HAVING count(DISTINCT href) > 1")
def rule_unique_title(spark, sf_dir):
    facts = L.page_facts(read(spark, sf_dir, "pages")).select(F.col("html.title").alias("title"), F.col("url.href").alias("href"))
    return R.unique_violations(facts, "title", "href").select("title", "pages", F.array_join("keys", " ").alias("urls"))


@query(f"WITH {FACTS} SELECT grp AS \"group\", title, count(DISTINCT href) AS pages FROM facts WHERE title IS NOT NULL GROUP BY ALL HAVING count(DISTINCT href) > 1")
def rule_unique_group_scope(spark, sf_dir):
    facts = L.page_facts(read(spark, sf_dir, "pages")).select("group", F.col("html.title").alias("title"), F.col("url.href").alias("href"))
    return R.unique_violations(facts, "title", "href", ["group"]).select("group", "title", "pages")


#: The lint plan's rules as cells (group, href, rule, ok, severity, score).
CELLS = FACTS + f""",
cells AS (
  SELECT grp, href, rule, ok, score FROM (
    SELECT *, {WORDS} AS words FROM facts) f,
    LATERAL (VALUES
      ('html/title/missing', title IS NOT NULL, 8.0::DOUBLE), ('html/title/length', coalesce(length(title) <= 60, true), 5.0::DOUBLE),
      ('html/h1/single', len(h1) = 1, 5.0::DOUBLE), ('html/charset/utf-8', coalesce(charset = 'utf-8', false), 8.0::DOUBLE),
      ('html/lang/pattern', coalesce(regexp_matches(lang, '^[a-z]{{2}}(-[A-Z]{{2}})?$'), false), 5.0::DOUBLE), ('html/description/missing', false, 2.0::DOUBLE),
      ('html/images/alt', true, 5.0::DOUBLE),
      ('html/words/thin', CASE WHEN lang IN ('en', 'de') THEN words >= 100 END,
        CASE WHEN words <= 0 THEN 3.2 WHEN words >= 100 THEN 1.0 ELSE floor((3.2::DOUBLE + (1.0::DOUBLE - 3.2::DOUBLE) * words / 100.0::DOUBLE) * 10 + 0.5) / 10 END::DOUBLE),
      ('url/https', scheme = 'https', 7.5::DOUBLE), ('url/query', search = '', 0.5::DOUBLE)) v(rule, ok, score)
  WHERE ok IS NOT NULL)"""


@query(f"WITH {CELLS} SELECT grp AS \"group\", href, rule, score FROM cells WHERE NOT ok")
def rule_fused_many(spark, sf_dir):
    facts = L.page_facts(read(spark, sf_dir, "pages")).withColumn("href", F.col("url.href"))
    return R.findings(facts, L.RULES, ["group", "href"]).select("group", "href", "rule", "score")


VERDICTS = CELLS + """,
verdicts AS (SELECT grp, rule, count(*) AS applicable, count(*) FILTER (NOT ok) AS failed, max(score) FILTER (NOT ok) AS worst FROM cells GROUP BY grp, rule)"""


@query(f"WITH {VERDICTS} SELECT grp AS \"group\", rule, applicable, failed, worst FROM verdicts")
def verdict_cells(spark, sf_dir):
    return L.lint(read(spark, sf_dir, "pages"))[0]


RATED = VERDICTS + """,
counters AS (
  SELECT count(*) AS total, count(*) FILTER (worst >= 3.3) AS failed, count(*) FILTER (worst >= 6.6) AS errored,
         round(coalesce(sum((worst / 5.0::DOUBLE) * (worst / 5.0::DOUBLE)) FILTER (worst >= 3.3), 0), 4) AS cost
  FROM verdicts WHERE worst IS NULL OR worst >= 1.0)"""


@query(
    f"""WITH {RATED}, shares AS (SELECT *, greatest(0.0::DOUBLE, total - cost) / total AS share FROM counters)
SELECT total, failed, errored, cost, round(share, 4) AS share,
       CASE WHEN failed = 0 THEN 'S' WHEN share >= 0.9 AND errored = 0 THEN 'A' WHEN share >= 0.7 THEN 'B' WHEN share >= 0.6 THEN 'C' WHEN share >= 0.4 THEN 'D' WHEN share >= 0.2 THEN 'E' ELSE 'F' END AS grade FROM shares"""
)
def rating_grade(spark, sf_dir):
    return V.rating(V.check_counters(L.lint(read(spark, sf_dir, "pages"))[0]))


@query(
    f"""WITH {CELLS}, failing AS (SELECT grp, rule, href AS url, 'fails ' || rule AS text, score FROM cells WHERE NOT ok),
applicable AS (SELECT grp, rule, count(*) AS applicable FROM cells GROUP BY grp, rule),
c AS (
  SELECT grp, rule, count(DISTINCT url) AS failed, count(DISTINCT text) AS said, min(text) AS text, max(score) AS score, min(url) AS url,
         list_sort(list(DISTINCT url))[1:3] AS samples, applicable
  FROM failing JOIN applicable USING (grp, rule) GROUP BY grp, rule, applicable),
k AS (SELECT *, applicable >= 3 AND failed / applicable >= 0.8 AS folded, ((applicable >= 3 AND failed / applicable >= 0.8) OR failed >= applicable) AND said = 1 AS whole FROM c),
s AS (SELECT *, CASE WHEN whole AND count(*) FILTER (whole) OVER (PARTITION BY rule, text) > 1 THEN 'site' WHEN folded THEN 'group' ELSE 'page' END AS scope FROM k)
SELECT 'group' AS scope, rule, grp AS "group", url, text, score, failed AS occurrences, round(failed / applicable, 2) AS coverage, array_to_string(samples, ' ') AS samples, NULL AS groups FROM s WHERE scope = 'group'
UNION ALL SELECT 'site', rule, NULL, min(url), text, max(score), sum(failed)::BIGINT, round(sum(failed) / sum(applicable), 2), array_to_string(list_sort(flatten(list(samples)))[1:3], ' '), array_to_string(list_sort(list(grp)), ' ') FROM s WHERE scope = 'site' GROUP BY rule, text
UNION ALL SELECT 'page', f.rule, f.grp, f.url, f.text, f.score, NULL, NULL, NULL, NULL FROM failing f JOIN s USING (grp, rule) WHERE s.scope = 'page'
UNION ALL SELECT 'group', 'groups/heterogeneous', grp, url, failed || ' pages of ' || applicable || ' break ' || rule || ', so one template can''t be the cause', 2.0, NULL, NULL, NULL, NULL FROM s WHERE scope = 'page' AND NOT whole AND applicable >= 3 AND failed / applicable > 0.2"""
)
def fold_by_template(spark, sf_dir):
    folded = L.lint_pages(spark, sf_dir)
    return folded.withColumn("samples", F.array_join("samples", " ")).withColumn("groups", F.array_join("groups", " "))


@query(
    """WITH v AS (SELECT o_orderkey, o_totalprice AS v FROM orders)
SELECT o_orderkey, least(9.9::DOUBLE, greatest(0.0::DOUBLE, floor((CASE WHEN v <= 1000 THEN 1.0 WHEN v <= 100000 THEN 1.0 + 4.0 * (v - 1000.0) / 99000.0 WHEN v <= 400000 THEN 5.0 + 4.9::DOUBLE * (v - 100000.0) / 300000.0 ELSE 9.9 END)::DOUBLE * 10 + 0.5) / 10)) AS score FROM v"""
)
def score_interpolate(spark, sf_dir):
    scale = ((1000, 1.0), (100000, 5.0), (400000, 9.9))
    return read(spark, sf_dir, "orders").select("o_orderkey", S.interpolated(F.col("o_totalprice"), scale).alias("score"))


@query(
    """WITH s AS (SELECT l_orderkey, l_linenumber, least(9.9::DOUBLE, floor(l_quantity / 5.0::DOUBLE * 10 + 0.5) / 10) AS score FROM lineitem)
SELECT l_orderkey, l_linenumber, score, CASE WHEN score >= 6.6 THEN 'error' WHEN score >= 3.3 THEN 'warning' WHEN score >= 1.0 THEN 'info' ELSE 'hint' END AS level,
       least(6.5::DOUBLE, greatest(3.3::DOUBLE, score)) AS pinned FROM s"""
)
def score_bands(spark, sf_dir):
    score = S.tenths(F.col("l_quantity") / 5.0)
    return read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", score.alias("score"), S.level_of(score).alias("level"), S.pinned(F.lit("warning"), score).alias("pinned"))


@query(
    """WITH f AS (SELECT 'r' || l_linenumber AS rule, 'u' || l_orderkey AS url, least(9.9::DOUBLE, floor(l_quantity / 5.0::DOUBLE * 10 + 0.5) / 10) AS score, (l_extendedprice / 100)::BIGINT AS occurrences FROM lineitem),
o AS (SELECT *, CASE WHEN score >= 6.6 THEN 0 WHEN score >= 3.3 THEN 1 WHEN score >= 1.0 THEN 2 ELSE 3 END AS level FROM f)
SELECT row_number() OVER (ORDER BY level, score * occurrences DESC, rule, url)::INT AS place, rule, url, score, occurrences FROM o QUALIFY place <= 100"""
)
def impact_order_topk(spark, sf_dir):
    """A top-k report: the limit is the feature."""
    score = S.tenths(F.col("l_quantity") / 5.0)
    found = read(spark, sf_dir, "lineitem").select(F.concat(F.lit("r"), "l_linenumber").alias("rule"), F.concat(F.lit("u"), "l_orderkey").alias("url"), score.alias("score"), S.level_of(score).alias("severity"), F.lit("page").alias("scope"), F.round(F.col("l_extendedprice") / 100).cast("long").alias("occurrences"))
    best = found.orderBy(*V.urgency(found, 0)).limit(100)
    from pyspark.sql import Window

    return best.withColumn("place", F.row_number().over(Window.orderBy(*V.urgency(best, 0)))).select("place", "rule", "url", "score", "occurrences")


@query("SELECT r_name AS rule FROM region WHERE r_regionkey NOT IN (SELECT n_regionkey FROM nation WHERE n_nationkey % 3 = 0 AND n_regionkey < 3)")
def untested_rules(spark, sf_dir):
    judged = read(spark, sf_dir, "nation").where("n_nationkey % 3 = 0 AND n_regionkey < 3").join(read(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("r_name").alias("rule"))
    return V.untested(read(spark, sf_dir, "region").select(F.col("r_name").alias("rule")), judged)


@query(f"WITH {VERDICTS} SELECT grp AS \"group\", rule, sum(failed)::BIGINT AS failed FROM verdicts GROUP BY ROLLUP (grp, rule)")
def rollup_findings(spark, sf_dir):
    return L.lint(read(spark, sf_dir, "pages"))[0].rollup("group", "rule").agg(F.sum("failed").alias("failed"))


@query(f"WITH {VERDICTS} SELECT grp AS \"group\", rule, sum(failed)::BIGINT AS failed FROM verdicts GROUP BY CUBE (grp, rule)")
def cube_findings(spark, sf_dir):
    return L.lint(read(spark, sf_dir, "pages"))[0].cube("group", "rule").agg(F.sum("failed").alias("failed"))
