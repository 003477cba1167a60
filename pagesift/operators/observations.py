"""Facts of hosts and pages from captured observations: messages of linters, host keys, crawlers' answers, icons, addresses and names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def message_findings(messages: DataFrame, rule: str | None = None) -> DataFrame:
    """(page, rule, text, n, places): messages of an external linter, alike ones of a page together, with their first three places.

    ``messages`` is (page, messages array<struct<rule, text, line, column>>)."""
    rows = messages.select("page", F.explode("messages").alias("m")).select("page", "m.*")
    rows = rows.where(F.col("rule") == rule) if rule else rows
    place = F.struct(F.col("line").alias("line"), F.col("column").alias("column"))
    counted = rows.groupBy("page", "rule", "text", place.alias("p")).agg(F.count("*").alias("c"))
    grouped = counted.groupBy("page", "rule", "text").agg(F.sum("c").alias("n"), F.slice(F.array_sort(F.collect_list("p")), 1, 3).alias("p"))
    return grouped.select("page", "rule", "text", "n", F.transform("p", lambda p: F.concat_ws(":", p["line"].cast("string"), p["column"].cast("string"))).alias("places"))


def key_fingerprint(key: Column, kind: Column) -> Column:
    """The digest of a host key (base64) as SSHFP records have it: kind 1 is SHA-1, 2 SHA-256."""
    raw = F.try_to_binary(key, F.lit("base64"))
    return F.when(kind == 1, F.sha1(raw)).when(kind == 2, F.sha2(raw, 256))


def unmatched_keys(keys: DataFrame, records: DataFrame) -> DataFrame:
    """(host, algorithm): host keys that no SSHFP record of the host matches; keys is (host, algorithm, key), records (host, algorithm, kind, digest)."""
    told = records.join(keys, ["host", "algorithm"]).where(F.lower("digest") == key_fingerprint(F.col("key"), F.col("kind")))
    return keys.select("host", "algorithm").distinct().join(told.select("host", "algorithm"), ["host", "algorithm"], "left_anti")


def turned_away(answers: DataFrame, agent_kind: str = "search") -> DataFrame:
    """(origin, agents): agents of a kind that an origin answers otherwise than a browser: an error where the browser gets none.

    ``answers`` is (origin, agent, kind, status); the browser's kind is browser."""
    browser = answers.where("kind = 'browser' AND status < 400").select("origin").distinct()
    refused = answers.where((F.col("kind") == agent_kind) & (F.col("status") >= 400)).join(browser, "origin", "left_semi")
    return refused.groupBy("origin").agg(F.array_join(F.array_sort(F.collect_set("agent")), " ").alias("agents"))


def icon_faults(declared: DataFrame, measured: DataFrame) -> DataFrame:
    """(page, href, fault): icons that are missing, or not of the size or type they declare; declared is (page, href, sizes, type), measured (href, status, width, height, type)."""
    both = declared.join(measured.select("href", "status", "width", "height", F.col("type").alias("real")), "href", "left")
    size = F.concat_ws("x", F.col("width").cast("string"), F.col("height").cast("string"))
    fits = F.array_contains(F.split(F.lower("sizes"), r"\s+"), size) | (F.lower(F.trim("sizes")) == "any")
    fault = (
        F.when(F.col("status").isNull() | ~F.coalesce(F.col("status").between(200, 299), F.lit(False)), "missing")
        .when(F.col("sizes").isNotNull() & F.col("width").isNotNull() & ~fits, F.concat(F.lit("is "), size))
        .when(F.col("type").isNotNull() & (F.lower("type") != F.lower("real")), F.concat(F.lit("is "), F.lower("real")))
    )
    return both.withColumn("fault", fault).where("fault IS NOT NULL").select("page", "href", "fault")


def forward_confirmed(names: DataFrame, addresses: DataFrame) -> DataFrame:
    """(address, confirmed): whether a name that an address points back to leads to the address again; names is (address, name), addresses (name, address)."""
    back = addresses.select(F.lower("name").alias("name"), F.col("address").alias("to")).distinct()
    again = names.select("address", F.lower("name").alias("name")).join(back, "name", "left")
    return again.groupBy("address").agg(F.coalesce(F.max(F.col("address") == F.col("to")), F.lit(False)).alias("confirmed"))


def generic_link_texts(links: DataFrame, generic: DataFrame) -> DataFrame:
    """(page, href, text): links whose text says nothing of their target, by lists of such texts in the page's own language; generic is (lang, text)."""
    said = F.lower(F.trim(F.regexp_replace("text", r"[\s.…»›>→!]+", " ")))
    rows = links.withColumn("said", said).withColumn("primary", F.lower(F.split_part("lang", F.lit("-"), F.lit(1))))
    told = generic.select(F.lower("lang").alias("primary"), F.lower("text").alias("said")).distinct()
    return rows.join(told, ["primary", "said"], "left_semi").select("page", "href", "text")


def soft_errors(probes: DataFrame) -> DataFrame:
    """(origin): origins that answer 2xx for an address that can't exist; probes is (origin, kind, status)."""
    return probes.where("kind = 'missing' AND status BETWEEN 200 AND 299").select("origin").distinct()


def entry_variants(probes: DataFrame) -> DataFrame:
    """(host, landings): hosts whose entries with and without www and TLS end at different addresses; probes is (host, variant, landing)."""
    return probes.groupBy("host").agg(F.count_distinct("landing").alias("landings")).where("landings > 1")
