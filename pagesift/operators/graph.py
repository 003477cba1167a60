"""The link graph: edges, degrees, depth, PageRank. Each round is a join and a grouping, written to the checkpoint folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagesift.sources.scratch import cut

DAMPING, ROUNDS, SETTLED = 0.85, 100, 1e-9


def edges(pages: DataFrame, links: DataFrame, known: DataFrame) -> DataFrame:
    """(src, dst): distinct links between stored pages through the alias table, without links to oneself."""
    joined = links.join(known, links.target == known.url).select(F.col("href").alias("src"), F.col("page").alias("dst"))
    return joined.where("src <> dst").join(pages.select(F.col("href").alias("src")), "src", "left_semi").distinct()


def degrees(nodes: DataFrame, e: DataFrame, links: DataFrame | None = None) -> DataFrame:
    """(node, in_degree, out_degree). In-degree counts stored pages that link; out-degree the targets of ``e``, or of all
    ``links`` (src, target), distinct and without those to oneself, so that targets that aren't stored count as well."""
    out_of = e.select("src", F.col("dst").alias("target")) if links is None else links.where("src <> target").select("src", "target").distinct()
    into, out = e.groupBy("dst").agg(F.count("*").alias("i")), out_of.groupBy("src").agg(F.count("*").alias("o"))
    joined = nodes.join(into, nodes.node == into.dst, "left").join(out, nodes.node == out.src, "left")
    return joined.select("node", F.coalesce("i", F.lit(0)).alias("in_degree"), F.coalesce("o", F.lit(0)).alias("out_degree"))


def previous_pages(nexts: DataFrame, known: DataFrame) -> DataFrame:
    """(node, prev): the page that names a page as its next one; of several the last by ``ordinal``. ``nexts`` is (page, target, ordinal), ``known`` the alias table."""
    named = nexts.join(known.withColumnRenamed("page", "node"), nexts.target == known.url)
    return named.groupBy("node").agg(F.max_by("page", "ordinal").alias("prev"))


def summary(nodes: DataFrame, e: DataFrame, reached: DataFrame, complete: bool = True) -> DataFrame:
    """One row: pages, edges, pages that no path reaches, the deepest level, and whether these are of a whole crawl."""
    deep = reached.agg(F.max("depth").alias("deepest"), F.count("*").alias("reached"))
    counted = nodes.agg(F.count("*").alias("pages")).crossJoin(F.broadcast(e.agg(F.count("*").alias("edges")))).crossJoin(F.broadcast(deep))
    return counted.select("pages", "edges", (F.col("pages") - F.col("reached")).alias("unreached"), "deepest", F.lit(complete).alias("complete"))


def marked_partial(findings: DataFrame, rules: list[str], complete: bool, text: str = "text") -> DataFrame:
    """Findings with a note on those of rules that read the graph, where the crawl didn't see the whole site."""
    note = F.when(F.col("rule").isin(*rules), F.concat(F.col(text), F.lit(" (as far as the crawl went)"))).otherwise(F.col(text))
    return findings if complete or not rules else findings.withColumn(text, note)


def following(df: DataFrame, order: list[str], value: str, parts: int | None = None) -> DataFrame:
    """(value, next): each row's value with that of the row after it in the order of all rows; the last row has null.

    Rows are dealt to ranges of the order; inside a range the next row is a window, and each range's last row gets
    the next range's first value from a table with one row for each range. No task holds more than a range."""
    parts = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = cut(df.select(*order, value).repartitionByRange(parts, *order).withColumn("__range", F.spark_partition_id()))
    inside = ranged.withColumn("next", F.lead(value).over(Window.partitionBy("__range").orderBy(*order))).withColumn("__last", F.lead(F.lit(1)).over(Window.partitionBy("__range").orderBy(*order)).isNull())
    firsts = ranged.groupBy("__range").agg(F.min_by(value, F.struct(*order)).alias("first"))
    after = firsts.select("__range", F.lead("first").over(Window.orderBy("__range")).alias("after"))  # one row for each range
    return inside.join(F.broadcast(after), "__range").select(value, F.when(F.col("__last"), F.col("after")).otherwise(F.col("next")).alias("next"))


#: So many levels of ``depths`` are united before they are written as one.
UNITED = 50


def depths(e: DataFrame, seeds: DataFrame) -> DataFrame:
    """(node, depth): fewest links from a seed; nodes that no path reaches are left out. One round per level, until no new node is met."""
    reached = cut(seeds.select("node").distinct().withColumn("depth", F.lit(0)))
    frontier, depth = reached, 0
    while True:
        depth += 1
        new = frontier.join(e, frontier.node == e.src).select(F.col("dst").alias("node")).distinct().join(reached, "node", "left_anti").withColumn("depth", F.lit(depth))
        frontier = cut(new)
        if not frontier.limit(1).count():
            break
        reached = reached.unionByName(frontier)
        if depth % UNITED == 0:
            reached = cut(reached)
    return reached


def pagerank(nodes: DataFrame, e: DataFrame, damping: float = DAMPING, rounds: int = ROUNDS, settled: float = SETTLED) -> DataFrame:
    """(node, rank): ranks sum to the number of nodes. What nodes without links hold is spread evenly; rounds end when the ranks' total change is under ``settled``."""
    n = nodes.count()
    if not n:
        return nodes.select("node", F.lit(0.0).alias("rank"))
    out = e.groupBy("src").agg(F.count("*").alias("o"))
    weighted = cut(e.join(out, "src").select("src", "dst", (F.lit(1.0) / F.col("o")).alias("w")))
    rank = cut(nodes.join(out, nodes.node == out.src, "left").select("node", F.col("o").isNull().alias("dangling"), F.lit(1.0 / n).alias("rank")))
    for _ in range(rounds):
        held = rank.where("dangling").agg(F.coalesce(F.sum("rank"), F.lit(0.0))).first()[0]
        passed = weighted.join(rank, weighted.src == rank.node).groupBy("dst").agg(F.sum(F.col("w") * F.col("rank")).alias("got"))
        next_rank = F.lit((1 - damping + damping * held) / n) + damping * F.coalesce("got", F.lit(0.0))
        step = cut(rank.join(passed, rank.node == passed.dst, "left").select("node", "dangling", next_rank.alias("rank"), F.abs(next_rank - F.col("rank")).alias("moved")))
        moved = step.agg(F.sum("moved")).first()[0]
        rank = step.drop("moved")
        if moved < settled:
            break
    return rank.select("node", (F.col("rank") * n).alias("rank"))
