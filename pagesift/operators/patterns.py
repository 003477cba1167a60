"""Tables of globs met with tables of values by what must stand in a match, not value by value and pattern by pattern.

A glob's literal stretches stand in every value that it matches. One piece of them, of four characters where a stretch has
as many, else of two or one, is the glob's key: the piece that the fewest globs share. A value meets a glob only where it
has the glob's key among its own pieces; the expression then decides. Globs without any literal meet all values.

A file of alike rows is small for the rows that it has, and a value for the pieces that it has, so Spark takes sides for
small that are not. No side is broadcast but different globs with their keys, and different values with the globs that
match them, each once its rows were counted and are few.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagesift.sources.scratch import cut, dealt_out

SIZES = (4, 2, 1)
#: Rows that are sent to all tasks: so many, with texts of so many bytes.
FEW, FEW_BYTES = 100_000, 8 << 20
#: Rows that match one glob are dealt to so many groups, each with all rows of the glob.
SALTS = 16
#: What ends a literal stretch: choices from the first brace to the last, sets, escapes, and wildcards.
_OPEN = r"\{.*\}|\{.*$|\[[^\]]*\]|\\.|[*?]+|\\$"


def _pieces(text: Column, size: int) -> Column:
    """All pieces of a text, of ``size`` characters each, once."""
    chars = F.split(text, "")
    last = F.size(chars) - size
    joined = lambda i: F.concat(*[F.get(chars, i + k) for k in range(size)])
    return F.when((text != "") & (last >= 0), F.array_distinct(F.transform(F.sequence(F.lit(0), last), joined))).otherwise(F.array().cast("array<string>"))


def _are_few(rows: DataFrame, *texts: str) -> bool:
    n, size = rows.agg(F.count("*"), F.coalesce(F.sum(sum(F.coalesce(F.octet_length(t), F.lit(0)) for t in texts)), F.lit(0))).first()
    return n <= FEW and size <= FEW_BYTES


def glob_keys(patterns: DataFrame, glob: str = "glob") -> DataFrame:
    """(glob, key): each different glob once, in lower case where letters count; the key is null where it has no literal."""
    runs = F.filter(F.split(F.lower(F.regexp_replace(glob, _OPEN, "\u0001")), "\u0001"), lambda r: r != "")
    of_run = lambda r: F.when(F.length(r) >= 4, _pieces(r, 4)).when(F.length(r) >= 2, _pieces(r, 2)).otherwise(_pieces(r, 1))
    each = patterns.select(glob).where(F.col(glob).isNotNull()).distinct().select(glob, F.explode_outer(F.array_distinct(F.flatten(F.transform(runs, of_run)))).alias("key"))
    shared = each.where("key IS NOT NULL").groupBy("key").agg(F.count("*").alias("globs"))
    best = F.min(F.struct("globs", (-F.length("key")).alias("short"), "key"))
    return each.join(shared.hint("merge"), "key", "left").groupBy(glob).agg(best["key"].alias("key"))


def glob_pairs(values: DataFrame, patterns: DataFrame, value: str = "value", glob: str = "glob", regex: str = "regex", by: Sequence[str] = ()) -> DataFrame:
    """(by, value, glob, regex): each different value with each different glob that it may match, once, however many rows have them."""
    keyed = cut(patterns.select(*by, glob, regex).distinct().join(glob_keys(patterns, glob).hint("merge"), glob))
    few = _are_few(keyed, glob, regex)
    told = F.broadcast if few else lambda df: df.hint("merge")
    present = dealt_out(values.select(*by, value).where(F.col(value).isNotNull()).distinct(), *by, value)
    low = F.lower(F.col(value))
    pieces = F.flatten(F.array(*[_pieces(low, n) for n in SIZES]))
    asked = present.withColumn("key", F.explode(pieces))
    met = asked.join(told(keyed.where("key IS NOT NULL")), ["key", *by]).drop("key")
    free = keyed.where("key IS NULL").drop("key")
    if free.isEmpty():
        return met
    every = present.join(told(free), list(by)) if by else present.join(F.broadcast(free) if few else free.hint("shuffle_replicate_nl"), F.lit(True))
    return met.unionByName(every)


def glob_matches(values: DataFrame, patterns: DataFrame, value: str = "value", glob: str = "glob", regex: str = "regex", by: Sequence[str] = ()) -> DataFrame:
    """``values`` with the rows of ``patterns`` whose expression ``regex`` (that of their ``glob``) matches ``value``, and whose
    columns ``by`` are equal. Null values and null globs match nothing. No name may be in both but those in ``by``."""
    found = cut(glob_pairs(values, patterns, value, glob, regex, by).where(F.rlike(F.col(value), F.col(regex))))
    told = F.broadcast(found) if _are_few(found, value, glob, regex) else found.hint("merge")
    # Many rows may have a value, and many a glob: rows with their glob are dealt to all cores before they meet the glob's rows.
    salt = F.pmod(F.xxhash64(*[c for c, kind in values.dtypes if "map<" not in kind]), F.lit(SALTS).cast("long"))
    rows = dealt_out(values.join(told, [*by, value]).withColumn("__salt", salt), *by, glob, regex, "__salt")
    each = patterns.withColumn("__salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    return rows.join(each.hint("merge"), [*by, glob, regex, "__salt"]).select(*values.columns, *[c for c in patterns.columns if c not in by])
