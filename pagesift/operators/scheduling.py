"""What a crawl takes next: candidates spread over the directories of a site, and groups of pages settled on a way of fetching.

Spreading: a page belongs to a directory, a directory to the one above it, up to the host and the root that holds all hosts.
At each directory the next page comes from the child that has had the fewest so far, or from the directory's own pages,
which count as a share of them. The j-th page of a child therefore comes at j - 1, the j-th own page at
(j - 1) / min(own pages, FANOUT), and a directory's sequence is its children's sequences merged by these numbers. That
gives each page's place from the bottom up, a sort for each level, without a pass that picks pages one by one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagesift.functions import urls as U
from pagesift.operators.ranking import place_within
from pagesift.sources.scratch import cut

#: Names of a directory that are kept apart; all later ones share a child.
FANOUT = 32
#: Pages of a group that are compared before it is fetched without a browser.
DETECTIONS = 3
#: Between the names of a node, and in place of the names that share a child; neither stands in a URL.
_SEP, _REST = "\x01", "\x02"


def _directories(url: Column) -> Column:
    """The host and the directories above a page."""
    parts = F.filter(F.split(U.pathname(url), "/"), lambda p: p != "")
    return F.concat(F.array(U.authority(url)), F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0))))


def _tree(rows: DataFrame) -> tuple[DataFrame, DataFrame, int]:
    """(rows with node and depth, children (node, parent, at), greatest depth): names beyond a directory's first ``FANOUT`` share a child."""
    rows = cut(rows.withColumns({"names": _directories(F.col("url")), "node": F.lit("")}))
    deepest = rows.agg(F.max(F.size("names"))).first()[0] or 0
    children = None
    for d in range(1, deepest + 1):
        name = F.get("names", F.lit(d - 1))
        first = rows.where(F.size("names") >= d).groupBy("node", name.alias("name")).agg(F.min("seq").alias("seq"))
        # A limit below Spark's threshold for window groups: tasks keep their first names before the shuffle.
        kept = first.withColumn("at", F.row_number().over(Window.partitionBy("node").orderBy("seq", "name"))).where(F.col("at") <= FANOUT)
        kept = cut(kept.select(F.col("node").alias("parent"), "name", "at"))
        met = rows.join(kept, (F.col("node") == F.col("parent")) & (name == F.col("name")), "left")
        child = F.concat("node", F.lit(_SEP), F.coalesce("name", F.lit(_REST)))
        there = F.size("names") >= d
        rows = cut(met.withColumn("node", F.when(there, child).otherwise(F.col("node"))).drop("parent", "name", "at"))
        level = kept.select(F.concat("parent", F.lit(_SEP), "name").alias("node"), "parent", "at").unionByName(
            kept.select("parent").distinct().select(F.concat("parent", F.lit(_SEP + _REST)).alias("node"), "parent", F.lit(FANOUT + 1).alias("at"))
        )
        children = level if children is None else children.unionByName(level)
    return rows.withColumn("depth", F.size("names")).drop("names"), children, deepest


def spread(candidates: DataFrame, noted: DataFrame | None = None, limit: int | None = None) -> DataFrame:
    """``candidates`` (url, seq, ...) with place: the order in which a budget takes them. ``seq`` is the order in which they came.

    URLs that differ only in the fragment are one page, the first counts. ``noted`` (url, seq) are pages scheduled elsewhere:
    they count as taken from their directories. A directory holds ``limit`` candidates at most, the first ones: the
    others are refused, as a budget of ``limit`` can't reach them. Null URLs are left out."""
    keep = candidates.columns
    rows = candidates.where("url IS NOT NULL").withColumns({"page": U.without_fragment(F.col("url")), "noted": F.lit(False)})
    if noted is not None:
        rows = rows.unionByName(noted.where("url IS NOT NULL").select("url", "seq").withColumns({"page": U.without_fragment(F.col("url")), "noted": F.lit(True)}), allowMissingColumns=True)
    first = rows.groupBy("page").agg(F.min(F.struct("seq", F.when(F.col("noted"), 0).otherwise(1).alias("kind"))).alias("first"))
    rows = rows.join(first, "page").where((F.col("seq") == F.col("first.seq")) & (F.col("noted") == (F.col("first.kind") == 0))).dropDuplicates(["page"]).drop("first", "page")
    rows, children, deepest = _tree(rows)
    if children is None:
        return candidates.limit(0).withColumn("place", F.lit(None).cast("long"))
    own = cut(place_within(rows.where("NOT noted"), ["node"], [F.col("seq")], "j"))
    if limit is not None:
        own = own.where(F.col("j") <= limit)
    before = cut(rows.where("noted").groupBy("node").agg(F.count("*").alias("had")))
    held = own.groupBy("node").agg(F.count("*").alias("pages")).join(before, "node", "left").select("node", F.coalesce("had", F.lit(0)).alias("had"), (F.col("pages") + F.coalesce("had", F.lit(0))).alias("pages"))
    leaves = own.join(held, "node").withColumns({"key": (F.col("had") + F.col("j") - 1) / F.least("pages", F.lit(FANOUT)), "at": F.lit(0)}).drop("had", "pages", "j")
    # Pages taken from a directory and all below it, before the first candidate is.
    above = F.transform(F.sequence(F.lit(2), F.size(F.split("node", _SEP))), lambda k: F.array_join(F.slice(F.split("node", _SEP), F.lit(1), k), _SEP))
    taken = before.where("node <> ''").select(F.explode(above).alias("node"), "had").groupBy("node").agg(F.sum("had").alias("taken"))
    children = cut(children.join(taken, "node", "left").fillna(0, ["taken"]))
    items = None
    for d in range(deepest, -1, -1):
        here = leaves.where(F.col("depth") == d)
        here = here if items is None else here.unionByName(items)
        placed = place_within(here, ["node"], [F.col("key"), F.when(F.col("at") > 0, 1).otherwise(0), F.col("at")])
        if d == 0:
            return placed.select(*keep, "place")
        up = placed.drop("key", "at").join(children, "node")
        items = up.withColumns({"key": (F.col("taken") + F.col("place") - 1).cast("double"), "node": F.col("parent"), "depth": F.lit(d - 1)}).drop("parent", "taken", "place")
    raise AssertionError


def reads_same(static: Column, live: Column) -> Column:
    """Whether a page says the same without a browser: title, lang, canonical, headings, meta and property, and internal links in
    any order. A page without facts on both sides agrees."""
    listed = lambda m: F.array_sort(F.map_entries(m))
    told = lambda h: F.struct(h["title"], h["lang"], h["canonical"], h["h1"], listed(h["meta"]), listed(h["property"]), F.array_sort(h["links"]["internal"]))
    return F.when(static.isNull() | live.isNull(), static.isNull() & live.isNull()).otherwise(told(static).eqNullSafe(told(live)))


def settled_modes(pairs: DataFrame, group: str = "group", order: str = "seq", same: str = "same", detections: int = DETECTIONS) -> DataFrame:
    """(group, mode, at, agreed) of compared pages: browser at the first that differs, http at the ``detections``-th that agrees,
    whichever comes first in ``order``; adaptive, with a null place, for a group that neither has settled. ``agreed`` counts
    the agreements up to there. Pages with a null comparison aren't compared."""
    known = pairs.where(F.col(same).isNotNull()).select(F.col(group).alias("group"), F.col(order).alias("at"), F.col(same).alias("same"))
    differs = known.where("NOT same").groupBy("group").agg(F.min("at").alias("apart"))
    # At most as many rows for each group and task reach the shuffle.
    nth = F.row_number().over(Window.partitionBy("group").orderBy("at"))
    agrees = known.where("same").withColumn("nth", nth).where(F.col("nth") <= detections).groupBy("group").agg(F.collect_list("at").alias("agrees"))
    both = known.select("group").distinct().join(differs, "group", "left").join(agrees, "group", "left")
    before = F.filter(F.coalesce("agrees", F.array().cast(f"array<{dict(pairs.dtypes)[order]}>")), lambda a: F.col("apart").isNull() | (a < F.col("apart")))
    is_http = F.size(before) >= detections
    mode = F.when(is_http, "http").when(F.col("apart").isNotNull(), "browser").otherwise("adaptive")
    at = F.when(is_http, F.array_max(before)).otherwise(F.col("apart"))
    return both.select("group", mode.alias("mode"), at.alias("at"), F.size(before).cast("long").alias("agreed"))


def routes(pages: DataFrame, modes: DataFrame, group: str = "group", order: str = "seq", detections: int = DETECTIONS) -> DataFrame:
    """``pages`` with mode and detects: the first ``detections`` pages of a group that was adaptive are rendered to be compared,
    the others follow what the group has settled on, and the browser where it hasn't. Groups that ``modes`` lacks are fetched."""
    nth = F.row_number().over(Window.partitionBy(group).orderBy(order))
    slots = pages.select(group, order).withColumn("nth", nth).where(F.col("nth") <= detections).select(group, order, F.lit(True).alias("slot"))
    told = pages.join(modes.select(F.col("group").alias("__g"), F.col("mode").alias("of_group")), F.col(group) == F.col("__g"), "left").join(slots, [group, order], "left")
    detects = F.col("slot").isNotNull() & F.col("of_group").isNotNull()
    mode = F.when(detects | F.col("of_group").isin("browser", "adaptive"), "browser").otherwise("http")
    return told.withColumns({"mode": mode, "detects": detects}).drop("__g", "of_group", "slot")
