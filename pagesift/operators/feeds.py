"""Judgements over feeds: what their formats ask for, and what readers stumble over. One row for each fault."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagesift.functions import feeds as E
from pagesift.functions import strings as S
from pagesift.functions import urls as U
from pagesift.sources.scratch import cut

#: An address with a name behind it or not; a URL that says its scheme.
_MAIL, _ABSOLUTE = r"^\S+@\S+\.\S+(\s+\(.+\))?$", "^[A-Za-z][A-Za-z0-9+.-]*:"


def parsed(captures: DataFrame, url: str = "url", body: str = "body") -> DataFrame:
    """(url, feed) of captured bodies."""
    return captures.select(F.col(url).alias("url"), E.feed(F.col(body), F.col(url)).alias("feed"))


def items(feeds: DataFrame) -> DataFrame:
    """(url, format, position, id, link, title, at, words): the items of all feeds that can be read, whatever their format; ``at``
    is when an item was published, or updated where that isn't said."""
    rows = feeds.select("url", "feed.format", F.explode("feed.items").alias("i"))
    at = F.coalesce(E.moment(F.col("format"), F.col("i.published")), E.moment(F.col("format"), F.col("i.updated")))
    return rows.select("url", "format", "i.position", "i.id", "i.link", "i.title", at.alias("at"), "i.words")


def _told(df: DataFrame, fault: str, details: Column, position: Column | None = None) -> DataFrame:
    """A row for each of an array of details."""
    place = position if position is not None else F.lit(None).cast("int")
    return df.select("url", F.lit(fault).alias("fault"), place.alias("position"), F.explode(details).alias("detail"))


def _if(holds: Column, detail: Column) -> Column:
    return F.when(holds, F.array(detail)).otherwise(F.array().cast("array<string>"))


def faults(feeds: DataFrame) -> DataFrame:
    """(url, fault, position, detail) of feeds (url, feed): position is the item's, null for the feed as a whole.

    document: it can't be read. required: an element, an attribute or an author is missing. date: one that its format's grammar
    doesn't allow, or with a wrong weekday. duplicate-id, id-tracking, permalink: ids that repeat, that carry
    parameters of trackers, or that say they are links and aren't. absolute-url, unknown-element, email, language, version."""
    feeds = cut(feeds.where("feed IS NOT NULL"))  # read once for each kind of fault, parsed once
    bad = feeds.where("feed.error IS NOT NULL").select("url", F.lit("document").alias("fault"), F.lit(None).cast("int").alias("position"), F.col("feed.error").alias("detail"))
    f = feeds.where("feed.error IS NULL").select("url", "feed.*")
    form, shown = F.col("format"), lambda d: F.concat(d["field"], F.lit(" "), d["raw"])
    no_mail = lambda a: F.filter(a, lambda m: ~m.rlike(_MAIL))
    relative = lambda c: c.isNotNull() & (form != "atom") & ~c.rlike(_ABSOLUTE)
    i = f.select("url", "format", F.col("author").alias("of_feed"), F.explode("items").alias("i"))
    of = lambda n: F.col(f"i.{n}")
    broken = lambda d: d.isNotNull() & E.moment(form, d).isNull()
    item = lambda fault, details: _told(i, fault, details, of("position"))
    lacking = F.flatten(F.transform(F.col("i.enclosures"), lambda e: F.array_compact(F.array(*[F.when(F.coalesce(e[k], F.lit("")) == "", F.lit(f"enclosure's {k}")) for k in ("url", "length", "type")]))))
    ids = i.where("i.id IS NOT NULL").select("url", of("position").alias("position"), of("id").alias("id"))
    first = F.min("position").over(Window.partitionBy("url", "id"))
    repeated = ids.withColumn("first", first).where("position > first").select("url", F.lit("duplicate-id").alias("fault"), "position", F.concat(F.lit("as item "), F.col("first").cast("string")).alias("detail"))
    one = [
        _told(f, "required", F.col("missing")), _told(f, "required", _if(F.col("ttl").isNotNull() & ~F.col("ttl").rlike("^[0-9]+$"), F.lit("ttl in minutes"))), _told(f, "date", _if(broken(F.col("updated")), shown(F.col("updated")))),
        _told(f, "absolute-url", _if(relative(F.col("link")), F.col("link"))), _told(f, "language", _if(F.col("language").isNotNull() & ~S.language_tag(F.regexp_replace("language", "_", "-")), F.col("language"))),
        _told(f, "unknown-element", F.when(form != "json", F.col("unknown"))), _told(f, "email", no_mail(F.col("emails"))),
        _told(f, "version", F.when(form == "json", F.concat(F.col("unknown"), _if(F.col("version") != f"{E.JSON_FEED}1.1", F.col("version"))))),
    ]
    each = [
        item("required", of("missing")), item("required", _if((form != "rss") & ~F.col("of_feed") & ~of("author"), F.lit("author"))), item("required", F.when(form == "rss", lacking)),
        item("date", _if(broken(of("published")), shown(of("published")))), item("date", _if(broken(of("updated")), shown(of("updated")))), item("permalink", _if(of("permalink") & of("id").isNotNull() & ~of("id").rlike("(?i)^https?://"), of("id"))),
        item("id-tracking", _if(of("id").rlike(_ABSOLUTE) & (U.strip_parameters(of("id")) != F.regexp_replace(of("id"), "#.*$", "")), of("id"))), item("absolute-url", _if(relative(of("link")), of("link"))),
        item("absolute-url", F.when(form != "atom", F.filter(F.transform("i.enclosures", lambda e: e["url"]), lambda u: ~u.rlike(_ABSOLUTE)))), item("unknown-element", F.when(form != "json", of("unknown"))), item("version", F.when(form == "json", of("unknown"))), item("email", no_mail(of("emails"))),
    ]
    return reduce(DataFrame.unionByName, [bad, *one, repeated, *each])
