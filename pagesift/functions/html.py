"""Facts of a page from its HTML, as columns over regular expressions.

Scripts, styles and comments are taken out first, so that markup inside them is not seen. Absent elements
give null, or an empty list; entities are left as they are.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UNSEEN = r"(?is)<script\b.*?</script>|<style\b.*?</style>|<!--.*?-->"


def seen(html: Column) -> Column:
    return F.regexp_replace(html, UNSEEN, "")


def _found(text: Column) -> Column:
    return F.nullif(text, F.lit(""))


def title(html: Column) -> Column:
    return _found(F.trim(F.regexp_extract(seen(html), r"(?is)<title[^>]*>(.*?)</title>", 1)))


def lang(html: Column) -> Column:
    return _found(F.regexp_extract(html, r"""(?is)<html[^>]*\slang=["']?([A-Za-z0-9-]+)""", 1))


def charset(html: Column) -> Column:
    return _found(F.lower(F.regexp_extract(html, r"""(?is)<meta[^>]*charset=["']?([A-Za-z0-9_-]+)""", 1)))


def meta(html: Column, name: str) -> Column:
    """The content of the first meta element of that name."""
    return _found(F.regexp_extract(seen(html), rf"""(?is)<meta\s[^>]*name=["']?{name}["']?[^>]*content=["']([^"']*)""", 1))


def canonical(html: Column) -> Column:
    return _found(F.regexp_extract(seen(html), r"""(?is)<link\s[^>]*rel=["']?canonical["']?[^>]*href=["']([^"']*)""", 1))


def headings(html: Column, level: int = 1) -> Column:
    """The trimmed texts of all headings of a level, without inner tags."""
    inner = F.regexp_extract_all(seen(html), F.lit(rf"(?is)<h{level}\b[^>]*>(.*?)</h{level}>"), 1)
    return F.transform(inner, lambda x: F.trim(F.regexp_replace(x, r"<[^>]*>", "")))


def hrefs(html: Column) -> Column:
    """href values of all anchors, in order."""
    return F.regexp_extract_all(seen(html), F.lit(r"""(?is)<a\s[^>]*?href=["']([^"']*)["']"""), 1)


def images(html: Column) -> Column:
    """array<struct<src, alt>>; alt is null where the attribute is missing."""
    tags = F.regexp_extract_all(seen(html), F.lit(r"(?is)<img\b[^>]*>"), 0)
    attribute = lambda t, a: F.regexp_extract(t, rf"""(?is)\s{a}=["']([^"']*)["']""", 1)
    return F.transform(tags, lambda t: F.struct(attribute(t, "src").alias("src"), F.when(t.rlike(r"(?is)\salt="), attribute(t, "alt")).alias("alt")))


def text(html: Column) -> Column:
    """Visible text: tags give way to spaces, white space is one space."""
    return F.trim(F.regexp_replace(F.regexp_replace(seen(html), r"(?s)<[^>]*>", " "), r"\s+", " "))


def words(html: Column) -> Column:
    t = text(html)
    return F.when(t == "", 0).otherwise(F.size(F.split(t, " "))).cast("long")
