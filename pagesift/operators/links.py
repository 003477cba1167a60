"""Relations between pages: redirects, broken targets, language alternates, references, feeds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def aliases(pages: DataFrame, redirects: DataFrame) -> DataFrame:
    """(url, page): what each known URL stands for. A page's own URL goes before a redirect to another page."""
    direct = pages.select(F.col("href").alias("url"), F.col("href").alias("page"), F.lit(0).alias("far"))
    landed = redirects.join(pages.select(F.col("href").alias("to")), "to", "left_semi").select(F.col("from").alias("url"), F.col("to").alias("page"), F.lit(1).alias("far"))
    return direct.unionByName(landed).groupBy("url").agg(F.min_by("page", F.struct("far", "page")).alias("page"))


def redirected_links(links: DataFrame, redirects: DataFrame) -> DataFrame:
    """(target, to, pages): links whose target moved, with how many pages hold them."""
    return links.join(redirects, links.target == F.col("from")).groupBy("target", "to").agg(F.count_distinct("href").alias("pages"))


def judged(probes: DataFrame) -> DataFrame:
    """Probes that say something of their target: not withheld, refused, walled off or throttled."""
    no = lambda c: ~F.coalesce(F.col(c), F.lit(False))
    return probes.where(no("excluded") & no("refused") & no("walled") & (F.coalesce("status", F.lit(0)) != 429))


def broken_links(links: DataFrame, probes: DataFrame) -> DataFrame:
    """(target, status, pages): links to targets that answer with an error or not at all."""
    bad = judged(probes).where("status IS NULL OR status >= 400")
    return links.join(bad, links.target == bad.url).groupBy("target", "status").agg(F.count_distinct("href").alias("pages"))


def one_way_alternates(alternates: DataFrame) -> DataFrame:
    """(page, lang, href): alternates that don't name the page in turn. Naming oneself needs no answer."""
    back = alternates.select(F.col("href").alias("page"), F.col("page").alias("href")).distinct()
    return alternates.where("page <> href").join(back, ["page", "href"], "left_anti").select("page", "lang", "href")


def alternates_apart(page: DataFrame, sitemap: DataFrame) -> DataFrame:
    """(page, lang, href, only): alternates that only the page or only the sitemap has."""
    a, b = (df.select("page", "lang", "href").distinct().withColumn(f"in_{n}", F.lit(True)) for df, n in ((page, "page"), (sitemap, "sitemap")))
    both = a.join(b, ["page", "lang", "href"], "full")
    return both.where("in_page IS NULL OR in_sitemap IS NULL").select("page", "lang", "href", F.when(F.col("in_page").isNotNull(), "page").otherwise("sitemap").alias("only"))


def followed_and_not(links: DataFrame, nofollow: DataFrame) -> DataFrame:
    """Links of a page that also occur there as nofollow."""
    return links.join(nofollow, ["page", "href"], "left_semi")


def unused_origins(declared: DataFrame, used: DataFrame) -> DataFrame:
    """Origins a page connects to ahead of time but never uses."""
    return declared.join(used, ["page", "origin"], "left_anti")


def dangling_references(references: DataFrame, definitions: DataFrame, pages: DataFrame) -> DataFrame:
    """(page, id): references to a node of a known page that defines no such node."""
    target = references.withColumn("at", F.split_part("id", F.lit("#"), F.lit(1)))
    return target.join(pages.select(F.col("href").alias("at")).distinct(), "at", "left_semi").join(definitions.select("id").distinct(), "id", "left_anti").select("page", "id")


def entity_conflicts(sightings: DataFrame) -> DataFrame:
    """(key, values, pages): entities that pages describe differently. Sightings are (key, value, page)."""
    distinct = sightings.groupBy("key", "value").agg(F.count_distinct("page").alias("pages"))
    return distinct.groupBy("key").agg(F.array_join(F.array_sort(F.collect_set("value")), "|").alias("values"), F.sum("pages").alias("pages"), F.count("*").alias("n")).where("n > 1").drop("n")


def feed_items_apart(items: DataFrame, pages: DataFrame, known: DataFrame) -> DataFrame:
    """(item, link, fault): feed items whose page is missing, answers with an error, or has another title.

    ``known`` is the alias table; pages are (href, status, title)."""
    found = items.join(known, items.link == known.url, "left").join(pages.withColumnsRenamed({"title": "page_title"}), F.col("page") == pages.href, "left")
    fault = F.when(F.col("href").isNull(), "unknown").when(F.col("status") >= 400, "status").when(~F.col("title").eqNullSafe(F.col("page_title")), "title")
    return found.withColumn("fault", fault).where("fault IS NOT NULL").select("item", "link", "fault")


def resource_rollup(uses: DataFrame, resources: DataFrame) -> DataFrame:
    """(url, kind, pages, bytes): each fetched resource with the number of pages that use it; uses not fetched have null bytes."""
    counted = uses.groupBy("url").agg(F.min("kind").alias("kind"), F.count_distinct("page").alias("pages"))
    return counted.join(resources.select("url", "bytes"), "url", "left").select("url", "kind", "pages", "bytes")


def partly_missing(pages: DataFrame, by: str, flag: str) -> DataFrame:
    """(by, have, total): groups in which some pages, but not all, have the flag."""
    return pages.groupBy(by).agg(F.count_if(F.coalesce(flag, F.lit(False))).alias("have"), F.count("*").alias("total")).where("have > 0 AND have < total")


def since_last(previous: DataFrame, now: DataFrame) -> DataFrame:
    """(rule, before, after): counts of findings by rule in two runs; a rule that one run lacks has 0 there."""
    a, b = (df.groupBy("rule").agg(F.count("*").alias(n)) for df, n in ((previous, "before"), (now, "after")))
    return a.join(b, "rule", "full").select("rule", F.coalesce("before", F.lit(0)).alias("before"), F.coalesce("after", F.lit(0)).alias("after"))


def cold_origins(blocking: DataFrame, warmed: DataFrame) -> DataFrame:
    """(page, origin): other origins that resources block the page's first view from, and that it doesn't connect to ahead of time."""
    return blocking.where(F.col("origin") != F.col("own")).select("page", "origin").distinct().join(warmed, ["page", "origin"], "left_anti")


def broken_media(media: DataFrame, probes: DataFrame) -> DataFrame:
    """(target, status, pages): images and videos that sitemap entries list and that answer with an error; ``media`` is (href, target)."""
    return broken_links(media, probes)


def unreachable_alternates(alternates: DataFrame, pages: DataFrame, redirects: DataFrame) -> DataFrame:
    """(href, fault, pages): language alternates that redirect or answer outside 2xx; those never fetched say nothing."""
    moved = redirects.select(F.col("from").alias("href"), F.col("to").alias("landing")).dropDuplicates(["href"])
    told = alternates.where("page <> href").select("page", "href").distinct().join(pages.select("href", "status"), "href", "left").join(moved, "href", "left")
    fault = F.when(F.col("landing").isNotNull(), "redirects").when(~F.col("status").between(200, 299), F.concat(F.lit("answers "), F.col("status").cast("string")))
    return told.withColumn("fault", fault).where("fault IS NOT NULL").groupBy("href", "fault").agg(F.count("*").alias("pages"))


def advertised_feeds(feeds: DataFrame, head_links: DataFrame) -> DataFrame:
    """(url, pages, titles): feeds with the pages whose head links to them as alternates of a feed's type, and how many titles those give."""
    kinds = F.lower(F.trim("type")).rlike(r"^application/(rss\+xml|atom\+xml|feed\+json|json)\b")
    ads = head_links.where(F.lower("rel").rlike(r"(^|\s)alternate(\s|$)") & kinds)
    return feeds.join(ads, feeds.url == ads.href).groupBy("url").agg(F.count_distinct("page").alias("pages"), F.count_distinct("title").alias("titles"))


def attached_resources(uses: DataFrame, fetched: DataFrame, now, failure_ttl: int = 3600) -> DataFrame:
    """Uses with what was fetched of their URL (url, status, bytes, fetched_at): a failure older than ``failure_ttl`` seconds counts as not fetched yet.

    Of types that are not read only the head was asked, so their size is the declared one: ``declared`` where ``bytes`` is null."""
    stale = (F.coalesce("status", F.lit(0)) >= 400) & (F.unix_timestamp(now) - F.unix_timestamp("fetched_at") > failure_ttl)
    return uses.join(fetched.where(~stale).select("url", "status", F.coalesce("bytes", "declared").alias("bytes")), "url", "left")


def unread(uses: DataFrame, fetched: DataFrame, now, failure_ttl: int = 3600) -> DataFrame:
    """(url, pages): URLs to be fetched: never fetched, or failed longer ago than ``failure_ttl`` seconds."""
    known = attached_resources(uses.select("url").distinct(), fetched, now, failure_ttl).where("status IS NOT NULL").select("url")
    return uses.groupBy("url").agg(F.count_distinct("page").alias("pages")).join(known, "url", "left_anti")


def crawl_frontier(seeds: DataFrame, links: DataFrame, budget: int | None = None, depth: int | None = None) -> DataFrame:
    """(url, depth): what a crawl of stored links visits: level by level from the seeds, each URL once, no deeper than ``depth`` and, as a
    feature of the crawl, ``budget`` URLs at most, of the last level the first by name."""
    from pagesift.sources.scratch import cut

    # Links are read once, and neither they nor what was visited is broadcast: both grow with the site.
    links = cut(links.select("href", "target").repartition("href").sortWithinPartitions("href"))
    frontier = cut(seeds.select("url").distinct().withColumn("depth", F.lit(0)))
    visited, level = frontier, 0
    while (depth is None or level < depth) and (budget is None or visited.count() < budget):
        level += 1
        new = frontier.join(links.hint("merge"), frontier.url == links.href).select(F.col("target").alias("url")).distinct().join(visited.hint("merge"), "url", "left_anti").withColumn("depth", F.lit(level))
        frontier = cut(new)
        if not frontier.limit(1).count():
            break
        visited = cut(visited.unionByName(frontier))
    return visited if budget is None else visited.orderBy("depth", "url").limit(budget)
