"""The lint plan: facts of pages, rules over them in one scan, verdicts, folded findings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagesift.functions import html as H
from pagesift.functions import urls as U
from pagesift.operators import rules as R
from pagesift.operators import verdicts as V
from pagesift.sources.scratch import cut

#: First path segments that make the groups of the test pages.
LANGUAGES = ("en", "fr", "de", "es")
GROUPS = [(lang, f"^/{lang}(/|$)") for lang in LANGUAGES]


def page_facts(pages: DataFrame) -> DataFrame:
    """(page_id, url, html, group): url and html as structs of facts. A null page has no facts in html."""
    u, h = F.col("url"), F.col("html")
    facts = F.struct(
        H.title(h).alias("title"), H.lang(h).alias("lang"), H.charset(h).alias("charset"), H.meta(h, "description").alias("description"), H.canonical(h).alias("canonical"),
        H.headings(h).alias("h1"), H.images(h).alias("images"), H.hrefs(h).alias("hrefs"), H.words(h).alias("words"), F.length(h).cast("long").alias("length"),
    )
    return pages.select("page_id", U.split_url(u).alias("url"), F.when(h.isNotNull(), facts).alias("html"), R.first_match(U.pathname(u), GROUPS).alias("group"))


RULES = [
    R.Rule("html/title/missing", "html.title", {"type": "string"}, severity="error"),
    R.Rule("html/title/length", "html.title", {"maxLength": 60}, severity="warning"),
    R.Rule("html/h1/single", "html.h1", {"type": "array", "minItems": 1, "maxItems": 1}),
    R.Rule("html/charset/utf-8", "html.charset", {"const": "utf-8"}, severity="error"),
    R.Rule("html/lang/pattern", "html.lang", {"type": "string", "pattern": "^[a-z]{2}(-[A-Z]{2})?$"}),
    R.Rule("html/description/missing", "html.description", {"type": "string"}, severity="info"),
    R.Rule("html/images/alt", "html.images", {"items": {"required": ["alt"]}}),
    R.Rule("html/words/thin", "html.words", {"minimum": 100}, when={"html.lang": {"enum": ["en", "de"]}}, severity="info", scale=((0, 3.2), (100, 1.0))),
    R.Rule("url/https", "url.protocol", {"const": "https:"}, severity="error", score=7.5),
    R.Rule("url/query", "url.search", {"maxLength": 0}, severity="hint"),
]


def lint(pages: DataFrame, rules: list[R.Rule] = RULES) -> tuple[DataFrame, DataFrame]:
    """(verdict cells, folded findings) of the rules over the pages' facts."""
    facts = page_facts(pages)
    # Written once: every branch of the folding reads these narrow rows, none parses HTML again.
    cells = cut(R.evaluate(facts.withColumn("href", F.col("url.href")), rules, ["group", "href"]))
    verdicts = V.verdict_cells(cells)
    failing = cells.where(~F.col("ok")).select("rule", "group", F.col("href").alias("url"), F.concat(F.lit("fails "), "rule").alias("text"), "score")
    return verdicts, V.fold(failing, verdicts.select("group", "rule", "applicable"))


def lint_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lint(spark.read.parquet(f"{sf_dir}/pages.parquet"))[1]
