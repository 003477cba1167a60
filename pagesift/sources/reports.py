"""Reports of findings: CSV, JSON lines, SARIF and Checkstyle. Files are written by the executors, one set per report."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagesift.functions import scoring, strings

#: Columns of the CSV report, and names that the SARIF and Checkstyle formats define.
CSV_COLUMNS = ["severity", "score", "rule", "scope", "group", "url", "message", "occurrences", "locations"]
SARIF = "https://json.schemastore.org/sarif-2.1.0.json"
SECURITY = r"^(http/(csp|hsts|coop|coep|corp|content-type-options|referrer-policy|permissions-policy|x-xss)|cookies/|tls)"


def with_severity(findings: DataFrame) -> DataFrame:
    return findings.withColumn("severity", scoring.level_of(F.col("score")))


def report_rows(findings: DataFrame) -> DataFrame:
    """The CSV report's columns of findings (scope, rule, group, url, text, score, occurrences, and locations or samples if they have any)."""
    held = next((c for c in ("locations", "samples") if c in findings.columns), None)
    locations = F.array_join(held, " ") if held else F.lit("")
    return with_severity(findings).select("severity", F.format_string("%.1f", scoring.tenths(F.col("score"))).alias("score"), "rule", "scope", "group", "url", F.col("text").alias("message"), "occurrences", locations.alias("locations"))


def csv_lines(findings: DataFrame) -> DataFrame:
    """(line): rows of the CSV report: fields with a comma, quote or line break are quoted, quotes doubled."""
    cell = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    quoted = lambda x: F.when(x.rlike('[\n\r",]'), F.concat(F.lit('"'), F.replace(x, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(x)
    return report_rows(findings).select(F.concat_ws(",", *[quoted(cell(c)) for c in CSV_COLUMNS]).alias("line"))


def write_csv(findings: DataFrame, path: str) -> None:
    """Files of rows that end in CR LF, each with the column names first."""
    report_rows(findings).write.mode("overwrite").csv(path, header=True, escape='"', quoteAll=False, lineSep="\r\n")


def write_json(findings: DataFrame, path: str) -> None:
    with_severity(findings).write.mode("overwrite").json(path)


def sarif_results(findings: DataFrame) -> DataFrame:
    """(result): one JSON result per finding; rank is the score of 100. Samples beside the first URL are related locations."""
    severity = scoring.level_of(F.col("score"))
    level = F.when(severity == "error", "error").when(severity == "warning", "warning").otherwise("note")
    place = lambda url: F.struct(F.struct(F.struct(url.alias("uri")).alias("artifactLocation")).alias("physicalLocation"))
    fields = [F.col("rule").alias("ruleId"), level.alias("level"), F.struct(F.col("text")).alias("message"), F.array(place(F.col("url"))).alias("locations"), F.round(F.col("score") * 10, 1).alias("rank")]
    if "occurrences" in findings.columns:
        fields.append(F.col("occurrences").alias("occurrenceCount"))
    if "samples" in findings.columns:
        others = F.filter("samples", lambda u: u != F.col("url"))
        related = F.transform(others, lambda u, i: F.struct(i.alias("id"), place(u)["physicalLocation"].alias("physicalLocation")))
        fields.append(F.when(F.size(others) > 0, related).alias("relatedLocations"))
    return findings.select(F.to_json(F.struct(*fields)).alias("result"))


def sarif_rules(findings: DataFrame) -> DataFrame:
    """(rule): one JSON rule for each id that findings have; rules about security carry their worst score."""
    worst = findings.groupBy("rule").agg(F.max(scoring.tenths(F.col("score"))).alias("worst"))
    security = F.when(F.col("rule").rlike(SECURITY), F.struct(F.format_string("%.1f", F.col("worst")).alias("security-severity"), F.array(F.lit("security")).alias("tags")))
    return worst.select(F.to_json(F.struct(F.col("rule").alias("id"), F.struct(F.col("rule").alias("text")).alias("shortDescription"), security.alias("properties"))).alias("rule"))


def write_sarif(findings: DataFrame, path: str, tool: str = "pagesift", version: str = "1") -> None:
    """A SARIF document as the text files of one folder, to be joined in the order of their names: the head with the rules, the results, the end.

    Rules are as many as the catalogue has; results are written by the executors, one on a line."""
    head = f'{{"$schema":"{SARIF}","version":"2.1.0","runs":[{{"tool":{{"driver":{{"name":"{tool}","version":"{version}","rules":['
    rules = sarif_rules(findings).select(F.lit(1).alias("part"), F.col("rule").alias("line"))
    results = sarif_results(findings).select(F.lit(3).alias("part"), F.col("result").alias("line"))
    spark = findings.sparkSession
    marks = spark.createDataFrame([(0, head), (2, ']}},"results":['), (4, "]}]}")], "part int, line string")
    # A comma stands before each row but the first of its part, so rows need no neighbour.
    firsts = lambda df: df.agg(F.min("line").alias("line")).select("line")
    out = marks
    for df in (rules, results):
        first = firsts(df)
        out = out.unionByName(df.join(F.broadcast(first.withColumnRenamed("line", "first"))).select("part", F.when(F.col("line") == F.col("first"), F.col("line")).otherwise(F.concat(F.lit(","), "line")).alias("line")))
    ordered = out.orderBy("part", F.col("line").startswith(","), "line")
    ordered.select("line").write.mode("overwrite").text(path)


def _escaped(c):
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def checkstyle_rows(findings: DataFrame) -> DataFrame:
    """(url, line, xml): the error element of each finding, to be written sorted by URL. Hints are told as infos, as the format has no hints.

    Line and column are read from the first location, where there is one of the form line:column."""
    level = scoring.level_of(F.col("score"))
    place = F.get("locations", F.lit(0)) if "locations" in findings.columns else F.lit(None).cast("string")
    at = F.when(place.rlike(r"^\d+:\d+"), F.concat(F.lit(' line="'), F.regexp_extract(place, r"^(\d+):(\d+)", 1), F.lit('" column="'), F.regexp_extract(place, r"^(\d+):(\d+)", 2), F.lit('"'))).otherwise("")
    text = lambda c: _escaped(strings.printable(F.col(c)))
    row = F.concat(F.lit("<error"), at, F.lit(' severity="'), F.when(level == "hint", "info").otherwise(level), F.lit('" message="'), text("text"), F.lit('" source="'), text("rule"), F.lit('"/>'))
    return findings.select("url", row.alias("xml"))


def checkstyle_files(findings: DataFrame) -> DataFrame:
    """(url, xml): one file element per URL with its findings' error elements, sorted; for URLs whose findings fit into a row."""
    lists = checkstyle_rows(findings).groupBy("url").agg(F.array_sort(F.collect_list("xml")).alias("errors"))
    return lists.select("url", F.concat(F.lit('<file name="'), _escaped(strings.printable(F.col("url"))), F.lit('">'), F.array_join("errors", ""), F.lit("</file>")).alias("xml"))


def write_checkstyle(findings: DataFrame, path: str) -> None:
    """A Checkstyle document as the text files of one folder, to be joined in the order of their names: rows sorted by URL, no URL held in one row."""
    rows = checkstyle_rows(findings).select(F.lit(1).alias("part"), "url", F.lit(1).alias("place"), F.col("xml").alias("line"))
    urls = findings.select("url").distinct()
    opened = urls.select(F.lit(1).alias("part"), "url", F.lit(0).alias("place"), F.concat(F.lit('<file name="'), _escaped(strings.printable(F.col("url"))), F.lit('">')).alias("line"))
    closed = urls.select(F.lit(1).alias("part"), "url", F.lit(2).alias("place"), F.lit("</file>").alias("line"))
    ends = findings.sparkSession.createDataFrame([(0, "", 0, '<?xml version="1.0" encoding="UTF-8"?>\n<checkstyle version="10.12.0">'), (2, "", 0, "</checkstyle>")], "part int, url string, place int, line string")
    ends.unionByName(opened).unionByName(rows).unionByName(closed).orderBy("part", "url", "place", "line").select("line").write.mode("overwrite").text(path)


#: Columns that stand first in an export, before the others by name.
FIRST = ("co2", "size", "weight", "resources.length", "timing")


def ranked_columns(columns: list[str]) -> list[str]:
    """Column names as exports list them: what a page costs first, the rest by name."""
    place = lambda c: next((i for i, f in enumerate(FIRST) if c == f or f in c.split(".") or c.endswith(f)), len(FIRST))
    return sorted(columns, key=lambda c: (place(c), c))


def facts_table(df: DataFrame, key: str, facts: list[str]) -> DataFrame:
    """The key and the flattened scalar facts of several struct columns, ranked."""
    for column in facts:
        df = flatten(df, column)
    return df.select(F.col(key), *[F.col(f"`{c}`") for c in ranked_columns([c for c in df.columns if c != key])])


def write_facts(df: DataFrame, path: str, form: str = "csv") -> None:
    """Flattened facts as CSV, JSON lines or YAML documents, one for each row."""
    if form == "csv":
        df.write.mode("overwrite").csv(path, header=True)
    elif form == "json":
        df.write.mode("overwrite").json(path)
    elif form == "yaml":
        lines = [F.when(F.col(f"`{c}`").isNotNull(), F.concat(F.lit(f'"{c}": '), F.to_json(F.array(F.col(f"`{c}`"))))) for c in df.columns]
        text = F.regexp_replace(F.concat_ws("\n", F.lit("---"), *lines), r'(?m)^("[^"\n]*": )\[(.*)\]$', "$1$2")
        df.select(text.alias("value")).write.mode("overwrite").text(path)
    else:
        raise ValueError("form is csv, json or yaml")


def write_catalogue(catalogue: DataFrame, path: str) -> None:
    """Every rule that ships, as JSON lines."""
    catalogue.write.mode("overwrite").json(path)


def flatten(df: DataFrame, column: str) -> DataFrame:
    """``df`` with the scalar leaves of a struct column as dotted columns, and the lengths of its arrays."""
    from pyspark.sql import types as T

    def leaves(path, kind):
        if isinstance(kind, T.StructType):
            for f in kind.fields:
                yield from leaves(f"{path}.{f.name}", f.dataType)
        elif isinstance(kind, T.ArrayType):
            yield F.size(path).alias(f"{path}.length")
        elif not isinstance(kind, T.MapType):
            yield F.col(path).alias(path)

    rest = [c for c in df.columns if c != column]
    return df.select(*rest, *leaves(column, df.schema[column].dataType))
