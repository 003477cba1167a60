"""Stored results that stay valid for a time, and work that is only done where none is stored."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagesift.functions import headers as H

#: Seconds that entries of each kind of store stay fresh, unless configured; 0 is for stores that are asked each time.
BUCKETS = {"pages": 0, "extractors": 0, "dns": 60, "profiles": 3600, "resources": 86400, "robots": 86400, "sitemaps": 86400, "origins": 86400, "probes": 604800, "lists": 604800}


def seconds(literal: Column) -> Column:
    """Seconds of 90, 45s, 30m, 24h or 7d; null for anything else."""
    n = F.regexp_extract(literal, r"^(\d{1,9})([smhd]?)$", 1).try_cast("bigint")
    unit = F.regexp_extract(literal, r"^(\d{1,9})([smhd]?)$", 2)
    return n * F.when(unit == "m", 60).when(unit == "h", 3600).when(unit == "d", 86400).otherwise(1)


def misses(wanted: DataFrame, stored: DataFrame, key: str, now: Column, ttl: int) -> DataFrame:
    """Rows of ``wanted`` with no entry in ``stored`` (key, stored_at) younger than ``ttl`` seconds."""
    fresh = stored.where(F.col("stored_at") > now - F.make_dt_interval(secs=F.lit(ttl).cast("decimal(18,6)")))
    return wanted.join(fresh.select(key), key, "left_anti")


def digest(*columns: str) -> Column:
    """A key of what a result depends on; null and empty differ."""
    return F.sha2(F.concat_ws("\u0001", *[F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("-")) for c in columns]), 256)


def newest(df: DataFrame, keys: list[str], at: str) -> DataFrame:
    """The last state of each key."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col(at)).alias("s")).select(*keys, "s.*")


def bucket_misses(wanted: DataFrame, stored: DataFrame, now: Column, ttl: Mapping[str, int] | None = None) -> DataFrame:
    """Rows of ``wanted`` (bucket, key) without a fresh entry in ``stored`` (bucket, key, stored_at), each bucket by its own time."""
    times = {**BUCKETS, **(ttl or {})}
    seconds_of = F.element_at(F.create_map(*[F.lit(x) for e in times.items() for x in e]), F.col("bucket")).cast("long")
    age = F.unix_micros(now) - F.unix_micros("stored_at")
    return wanted.join(stored.where(age < seconds_of * 1_000_000).select("bucket", "key"), ["bucket", "key"], "left_anti")


#: Statuses that may be kept without being told for how long.
KEEPABLE = (200, 203, 204, 300, 301, 308, 404, 405, 410, 414, 501)


def freshness(headers: Column, status: Column, stored: Column, heuristic: float = 0.1) -> Column:
    """struct(storable, lifetime, age): what a shared-nothing cache may do with a response (RFC 9111).

    Lifetime is s of max-age, else of Expires after Date, else a tenth of the time since Last-Modified for statuses that
    allow it; no-store forbids keeping, no-cache and a broken Expires make it stale at once. Age is the header's."""
    get = lambda n: F.try_element_at(headers, F.lit(n))
    directives = H.cache_control(get("cache-control"))
    v = directives["value"]
    date = F.coalesce(H.http_date(get("date")), stored)
    span = lambda a, b: (F.unix_timestamp(a) - F.unix_timestamp(b)).cast("long")
    expires = F.when(get("expires").isNotNull(), F.greatest(F.lit(0), F.coalesce(span(H.http_date(get("expires")), date), F.lit(0))))
    modified = H.http_date(get("last-modified"))
    guessed = F.when(status.isin(*KEEPABLE) & modified.isNotNull(), F.floor(F.greatest(F.lit(0), span(date, modified)) * heuristic))
    told = F.coalesce(v["max_age"], expires)
    lifetime = F.when(F.coalesce(v["no_cache"], F.lit(False)), 0).otherwise(F.coalesce(told, guessed, F.lit(0)))
    storable = ~F.coalesce(v["no_store"], F.lit(False)) & (status.isin(*KEEPABLE) | told.isNotNull())
    age = F.coalesce(F.when(get("age").rlike(r"^\d{1,18}$"), get("age").try_cast("bigint")), F.lit(0))
    return F.struct(F.coalesce(storable, F.lit(False)).alias("storable"), lifetime.cast("bigint").alias("lifetime"), age.alias("age"))


def fresh(headers: Column, status: Column, stored: Column, now: Column, ttl: int, offline: bool = False) -> Column:
    """Whether a stored answer still stands: always offline; by its bucket's time where its headers are silent; else by their freshness."""
    get = lambda n: F.try_element_at(headers, F.lit(n))
    since = F.unix_timestamp(now) - F.unix_timestamp(stored)
    f = freshness(headers, status, stored)
    silent = get("cache-control").isNull() & get("expires").isNull()
    return F.lit(offline) | F.when(silent, since < ttl).otherwise(f["storable"] & (f["age"] + since < f["lifetime"]))


def validators(headers: Column) -> Column:
    """Request headers that ask whether a stored answer has changed."""
    pairs = F.array(*[F.struct(F.lit(name).alias("k"), F.try_element_at(headers, F.lit(source)).alias("v")) for name, source in (("if-none-match", "etag"), ("if-modified-since", "last-modified"))])
    return F.map_from_entries(F.filter(pairs, lambda p: p["v"].isNotNull()))


def revalidated(stored: DataFrame, answers: DataFrame, key: str = "url") -> DataFrame:
    """(url, status, headers, body, revalidated) after asking again: an answer 304 keeps the stored status and body and puts its headers over the stored ones.

    A 304 for what isn't stored has no body. What wasn't asked stays as it is. Both sides are (url, status, headers map, body)."""
    old = stored.select(key, F.struct("status", "headers", "body").alias("o"))
    new = answers.select(key, F.struct("status", "headers", "body").alias("n"))
    both = old.join(new, key, "full")
    kept = (F.col("n.status") == 304) & F.col("o").isNotNull()
    over = F.map_concat(F.map_filter("o.headers", lambda k, v: ~F.coalesce(F.map_contains_key("n.headers", k), F.lit(False))), F.col("n.headers"))
    pick = lambda c: F.when(kept | F.col("n").isNull(), F.col(f"o.{c}")).otherwise(F.col(f"n.{c}")).alias(c)
    headers = F.when(kept, over).otherwise(F.coalesce("n.headers", "o.headers")).alias("headers")
    return both.select(key, pick("status"), headers, pick("body"), F.coalesce(kept, F.lit(False)).alias("revalidated"))
