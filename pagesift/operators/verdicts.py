"""From rule cells to verdicts, counters, a rating, and findings folded by template."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagesift.functions import scoring

THRESHOLD, LEAST, HETEROGENEOUS = 0.8, 3, 0.2


def verdict_cells(cells: DataFrame) -> DataFrame:
    """(group, rule, applicable, failed, worst): one row for each group and rule that applied somewhere."""
    return cells.groupBy("group", "rule").agg(F.count("*").alias("applicable"), F.count_if(~F.col("ok")).alias("failed"), F.max(F.when(~F.col("ok"), F.col("score"))).alias("worst"))


def check_counters(verdicts: DataFrame) -> DataFrame:
    """One row: total, failed (beyond a hint or an information), errored, cost."""
    level = scoring.level_of(F.col("worst"))
    counted = verdicts.where((F.col("applicable") > 0) & (F.col("worst").isNull() | (level != "hint")))
    failed = level.isin("warning", "error")
    return counted.agg(
        F.count("*").alias("total"), F.count_if(failed).alias("failed"), F.count_if(level == "error").alias("errored"),
        F.round(F.coalesce(F.sum(F.when(failed, scoring.weight(F.col("worst")))), F.lit(0.0)), 4).alias("cost"),
    )


def rating(counters: DataFrame) -> DataFrame:
    """Adds share and grade: S without failure; else by the share left after costs, in tenths; an error rules out A. Nothing judged, no grade."""
    share = F.greatest(F.lit(0.0), F.col("total") - F.col("cost")) / F.col("total")
    grade = F.when(F.col("failed") == 0, "S").when((share >= 0.9) & (F.col("errored") == 0), "A")
    for floor, name in ((0.7, "B"), (0.6, "C"), (0.4, "D"), (0.2, "E")):
        grade = grade.when(share >= floor, name)
    grade = F.when(F.col("total") > 0, grade.otherwise("F"))
    return counters.select("*", F.when(F.col("total") > 0, F.round(share, 4)).alias("share"), grade.alias("grade"))


def untested(rules: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Rules that were judged nowhere."""
    return rules.join(verdicts.select("rule").distinct(), "rule", "left_anti")


def sort_key(text: Column, collation: str | None = None) -> Column:
    """What texts are sorted by: themselves, byte by byte, or their place in a collation (``UNICODE`` sorts by letters, then accents,
    then case), of texts that it holds equal byte by byte."""
    return F.struct((F.collate(text, collation) if collation else text).alias("in_order"), text.alias("text"))


def _least(text: str, collation: str | None) -> Column:
    return F.min(sort_key(F.col(text), collation))["text"] if collation else F.min(text)


def _sorted(texts: Column, collation: str | None) -> Column:
    if not collation:
        return F.array_sort(texts)
    return F.transform(F.array_sort(F.transform(texts, lambda t: sort_key(t, collation))), lambda k: k["text"])


def fold(findings: DataFrame, applicable: DataFrame, threshold: float = THRESHOLD, least: int = LEAST, folding: bool = True, collation: str | None = None) -> DataFrame:
    """Page findings (rule, group, url, text, score) folded by template.

    What a finding says is its text together with its ``variables`` and ``locations``, if there are such columns: findings
    that differ in them never merge over groups. Findings with a ``scope`` other than page pass through as they are.
    Without ``folding`` all do.

    ``applicable`` is (group, rule, applicable). A cell folds if it has ``least`` pages and the share
    ``threshold`` of them fails. Cells that fold, or fail whole, and say one thing throughout merge over
    groups by rule and text. Otherwise a folded cell is one group finding, and others stay page findings,
    with an advisory where over a fifth of ``least`` pages or more fails. Result: scope, rule, group (null
    for a site finding), url (the first), text, score, occurrences, coverage, samples (three first URLs),
    groups. Each step groups by cell or text, after counting within tasks. URLs and groups are in the order of ``collation``,
    by default that of their bytes.
    """
    columns = ["scope", "rule", "group", "url", "text", "score", "occurrences", "coverage", "samples", "groups"]
    no_list = F.lit(None).cast("array<string>")
    asked = {"occurrences": "long", "coverage": "double", "samples": "array<string>", "groups": "array<string>"}
    as_they_are = lambda df: df.withColumns({c: F.lit(None).cast(t) for c, t in asked.items() if c not in df.columns}).withColumn("scope", F.col("scope") if "scope" in df.columns else F.lit("page")).select(columns)
    if not folding:
        return as_they_are(findings)
    others = None
    if "scope" in findings.columns:
        others = as_they_are(findings.where("scope <> 'page'"))
        findings = findings.where("scope = 'page'").drop("scope")
    extra = [c for c in ("variables", "locations") if c in findings.columns]
    said = F.concat_ws("\u0001", "text", *[F.to_json(F.struct(F.col(c))) for c in extra])
    cells = (
        findings.withColumn("says", said)
        .groupBy("group", "rule")
        .agg(F.count_distinct("url").alias("failed"), F.count_distinct("says").alias("said"), F.min("says").alias("says"), F.min("text").alias("text"), F.max("score").alias("score"), _least("url", collation).alias("url"))
        .join(applicable, ["group", "rule"], "left")
        .withColumn("applicable", F.coalesce("applicable", "failed"))
        .withColumn("folded", (F.col("applicable") >= least) & (F.col("failed") / F.col("applicable") >= threshold))
        .withColumn("whole", (F.col("folded") | (F.col("failed") >= F.col("applicable"))) & (F.col("said") == 1))
    )
    merged = F.count("*").over(Window.partitionBy("rule", "says"))  # a row for each group
    whole = cells.where("whole").withColumn("alike", merged)
    cells = whole.unionByName(cells.where("NOT whole").withColumn("alike", F.lit(1).cast("long")))
    kind = F.when(F.col("whole") & (F.col("alike") > 1), "site").when(F.col("folded"), "group").otherwise("page")
    cells = cells.withColumn("scope", kind)
    urls = findings.select("group", "rule", "url").distinct()
    sampled = urls.withColumn("r", F.row_number().over(Window.partitionBy("group", "rule").orderBy(sort_key(F.col("url"), collation)))).where("r <= 3").groupBy("group", "rule").agg(_sorted(F.collect_list("url"), collation).alias("samples"))
    cells = cells.join(sampled, ["group", "rule"])
    tenths = scoring.tenths(F.col("score"))
    coverage = lambda failed, of: F.round(failed / of, 2)
    groups = cells.where("scope = 'group'").select("scope", "rule", "group", "url", "text", tenths.alias("score"), F.col("failed").alias("occurrences"), coverage(F.col("failed"), F.col("applicable")).alias("coverage"), "samples", no_list.alias("groups"))
    sites = (
        cells.where("scope = 'site'")
        .groupBy("rule", "says")
        .agg(F.min("text").alias("text"), _least("url", collation).alias("url"), scoring.tenths(F.max("score")).alias("score"), F.sum("failed").alias("occurrences"), F.sum("applicable").alias("applicable"), F.slice(_sorted(F.flatten(F.collect_list("samples")), collation), 1, 3).alias("samples"), _sorted(F.collect_list("group"), collation).alias("groups"))
        .select(F.lit("site").alias("scope"), "rule", F.lit(None).cast("string").alias("group"), "url", "text", "score", "occurrences", coverage(F.col("occurrences"), F.col("applicable")).alias("coverage"), "samples", "groups")
    )
    pages = findings.join(cells.where("scope = 'page'").select("group", "rule"), ["group", "rule"], "left_semi").select(F.lit("page").alias("scope"), "rule", "group", "url", "text", "score", F.lit(None).cast("long").alias("occurrences"), F.lit(None).cast("double").alias("coverage"), no_list.alias("samples"), no_list.alias("groups"))
    mixed = cells.where((F.col("scope") == "page") & ~F.col("whole") & (F.col("applicable") >= least) & (F.col("failed") / F.col("applicable") > HETEROGENEOUS))
    advice = mixed.select(F.lit("group").alias("scope"), F.lit("groups/heterogeneous").alias("rule"), "group", "url", F.concat(F.col("failed").cast("string"), F.lit(" pages of "), F.col("applicable").cast("string"), F.lit(" break "), F.col("rule"), F.lit(", so one template can't be the cause")).alias("text"), F.lit(2.0).alias("score"), F.lit(None).cast("long").alias("occurrences"), F.lit(None).cast("double").alias("coverage"), no_list.alias("samples"), no_list.alias("groups"))
    out = groups.select(columns)
    for more in (sites, pages, advice):
        out = out.unionByName(more.select(columns))
    return out if others is None else out.unionByName(others)


def urgency(findings: DataFrame, total: int, by: str = "severity", collation: str | None = None) -> list[Column]:
    """Sort keys: level first unless by impact, then score times pages touched, then rule and url."""
    pages = F.coalesce(F.col("occurrences"), F.size("urls").cast("long") if "urls" in findings.columns else F.lit(None), F.when(F.col("scope") == "site", F.lit(total)).otherwise(F.lit(1)))
    first = [scoring.level_rank(F.col("severity")).asc()] if by == "severity" else []
    return [*first, (F.col("score") * pages).desc(), *[sort_key(F.col(c), collation).asc() for c in ("rule", "url")]]
