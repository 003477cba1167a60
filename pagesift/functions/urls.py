"""URL parts and rewrites as columns. All take and give nullable strings; a null URL gives null."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: scheme, host with port, path, query without mark, fragment without mark.
PARTS = r"^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^?#]*)(?:\?([^#]*))?(?:#(.*))?$"


def without_fragment(url: Column) -> Column:
    return F.regexp_replace(url, "#.*$", "")


def part(url: Column, k: int) -> Column:
    return F.regexp_extract(url, PARTS, k)


def scheme(url: Column) -> Column:
    return F.lower(part(url, 1))


def host(url: Column) -> Column:
    return F.regexp_replace(F.lower(part(url, 2)), r":\d+$", "")


def authority(url: Column) -> Column:
    """The host with its port, if it has one."""
    return F.lower(part(url, 2))


def origin(url: Column) -> Column:
    return F.concat(scheme(url), F.lit("://"), F.lower(part(url, 2)))


def pathname(url: Column) -> Column:
    """The path; "/" where it is empty."""
    path = part(url, 3)
    return F.when(path == "", "/").otherwise(path)


def query(url: Column) -> Column:
    return part(url, 4)


def split_url(url: Column) -> Column:
    """struct(href, origin, protocol, host, pathname, search): href without fragment, search with its mark."""
    href, q = without_fragment(url), query(url)
    search = F.when(q == "", "").otherwise(F.concat(F.lit("?"), q))
    return F.struct(href.alias("href"), origin(url).alias("origin"), F.concat(scheme(url), F.lit(":")).alias("protocol"), host(url).alias("host"), pathname(url).alias("pathname"), search.alias("search"))


def resolve(base: Column, ref: Column) -> Column:
    """``ref`` resolved against ``base``, without fragment: absolute, scheme-relative, root-relative, query-only and plain relative references. Dot segments are not folded."""
    directory = F.regexp_replace(pathname(base), r"[^/]*$", "")
    made = (
        F.when(ref.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), ref)
        .when(ref.startswith("//"), F.concat(scheme(base), F.lit(":"), ref))
        .when(ref.startswith("/"), F.concat(origin(base), ref))
        .when(ref.startswith("?"), F.concat(origin(base), pathname(base), ref))
        .when((ref == "") | ref.startswith("#"), base)
        .otherwise(F.concat(origin(base), directory, ref))
    )
    return without_fragment(made)


def strip_parameters(url: Column, prefixes: Sequence[str] = ("utm_",), names: Sequence[str] = ("ref", "fbclid", "gclid")) -> Column:
    """The URL without the query parameters that only track; the query mark goes with the last one."""
    kept = F.filter(F.split(query(url), "&"), lambda p: ~_tracks(p, prefixes, names))
    rest = F.array_join(kept, "&")
    base = F.regexp_extract(url, r"^[^?#]*", 0)
    return F.concat(base, F.when(rest == "", "").otherwise(F.concat(F.lit("?"), rest)))


def _tracks(p: Column, prefixes: Sequence[str], names: Sequence[str]) -> Column:
    name = F.lower(F.split_part(p, F.lit("="), F.lit(1)))
    hit = name.isin(*names)
    for x in prefixes:
        hit = hit | name.startswith(x)
    return hit


def parents(name: Column) -> Column:
    """The domain name and all its parents, longest first: a.b.c gives [a.b.c, b.c, c]."""
    labels = F.split(name, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
