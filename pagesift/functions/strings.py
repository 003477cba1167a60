"""Text as columns: patterns, tokens, templates, tags, escapes. A null text gives null unless said otherwise."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Mapping

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters that drive terminals or turn the direction of text: controls, and the marks that override or isolate it.
UNPRINTABLE = r"[\p{Cc}\x{202A}-\x{202E}\x{2066}-\x{2069}]"
#: Longest text that a message shows whole, and what it keeps of a longer one.
WHOLE, HEAD, TAIL = 200, 100, 99


def like_header(value: Column, glob: str) -> Column:
    """Whether a header's value matches a glob in which * stands for anything; case doesn't matter."""
    return value.rlike("(?is)^" + ".*".join(re.escape(p) for p in glob.split("*")) + "$")


def tokens(text: Column) -> Column:
    """The distinct lower-case ASCII words of a text or slug, percent-escapes undone and accents folded, sorted."""

    @F.pandas_udf("string")
    def folded(texts: pd.Series) -> pd.Series:
        plain = lambda t: "".join(c for c in unicodedata.normalize("NFKD", t) if not unicodedata.combining(c))
        special = str.maketrans({"ß": "ss", "æ": "ae", "œ": "oe", "ø": "o", "đ": "d", "ł": "l", "þ": "th", "ı": "i"})
        return pd.Series([None if t is None else plain(t).lower().translate(special) for t in texts], dtype=object)

    decoded = F.try_url_decode(F.replace(text, F.lit("+"), F.lit("%2B")))
    broken = F.contains(decoded, F.lit("\ufffd")) & ~F.contains(text, F.lit("\ufffd"))  # escapes that are no UTF-8
    words = F.split(folded(F.coalesce(F.when(~broken, decoded), text)), "[^a-z0-9]+")
    return F.array_sort(F.array_distinct(F.filter(words, lambda w: w != "")))


def filled(template: Column, values: Mapping[str, Column]) -> Column:
    """A template with each {name} replaced; a null value leaves its name standing."""
    for name, value in values.items():
        mark = F.lit("{" + name + "}")
        template = F.replace(template, mark, F.coalesce(value.cast("string"), mark))
    return template


def elided(text: Column, whole: int = WHOLE, head: int = HEAD, tail: int = TAIL) -> Column:
    """Its head and its tail about an ellipsis where a text is longer than ``whole``."""
    return F.when(F.length(text) > whole, F.concat(F.substring(text, 1, head), F.lit("…"), F.right(text, F.lit(tail)))).otherwise(text)


def shortened(json: Column, most: int = 80) -> Column:
    """A value's JSON, cut where it is longer than ``most``."""
    return F.when(F.length(json) > most, F.concat(F.substring(json, 1, most - 3), F.lit("…"))).otherwise(json)


def shown(value: Column, kind: str) -> Column:
    """What a message says of an offending value: strings with their length, lists as quoted words, other values as JSON; absent and empty ones are none."""
    if kind == "string":
        said = F.concat(F.length(value).cast("string"), F.lit(" characters: “"), elided(value), F.lit("”"))
    elif kind == "list":
        said = F.when(F.size(value) > 0, elided(F.array_join(F.transform(value, lambda x: F.concat(F.lit("“"), x.cast("string"), F.lit("”"))), ", ")))
    else:
        said = shortened(value.cast("string") if kind == "scalar" else F.to_json(value))
    return F.coalesce(said, F.lit("none"))


def repeats(least: int = 2, most: int = 120, marks: str = "-|:–—·»") -> str:
    """A pattern for texts that end in a mark and what already stands before it; the group ``said`` is that."""
    return rf"(?<said>.{{{least},{most}}}?)\s*[{re.escape(marks)}]\s*\k<said>$"


def repeated_about(text: Column, marks: str = "-|:–—·»") -> Column:
    """The text of 2 to 120 characters that ends a title and already stands before the separator there; null if none does."""
    return F.nullif(F.trim(F.regexp_extract(text, repeats(marks=marks), 1)), F.lit(""))


def srcset(value: Column) -> Column:
    """The candidates' URLs of a srcset."""
    urls = F.transform(F.split(value, ","), lambda c: F.get(F.split(F.trim(F.regexp_replace(c, r"\s+", " ")), " "), F.lit(0)))
    return F.filter(urls, lambda u: u != "")


def printable(text: Column) -> Column:
    r"""Unprintable characters written as \u{hex}."""
    pieces = F.regexp_extract_all(text, F.lit(rf"(?s){UNPRINTABLE}|(?:(?!{UNPRINTABLE}).)++"), 0)
    # The code point of a single character, from its UTF-16 bytes; none of these is beyond the first plane.
    point = lambda p: F.regexp_replace(F.lower(F.hex(F.encode(p, "UTF-16BE"))), "^0+(?=.)", "")
    return F.when(text.isNotNull(), F.array_join(F.transform(pieces, lambda p: F.when(p.rlike(f"^{UNPRINTABLE}$"), F.concat(F.lit("\\u{"), point(p), F.lit("}"))).otherwise(p)), ""))


#: Fixed value: the namespace that podcast identifiers are made in.
PODCASTS = "ead4c236-bf58-58c6-a2c6-a6b28d128cb6"


def name_uuid(name: Column, namespace: str) -> Column:
    """The version 5 UUID of a name."""
    digest = F.sha1(F.concat(F.unhex(F.lit(namespace.replace("-", ""))), F.encode(name, "UTF-8")))
    variant = F.lower(F.hex((F.conv(F.substring(digest, 17, 2), 16, 10).cast("int").bitwiseAND(0x3F)).bitwiseOR(0x80)))
    cut = lambda a, n: F.substring(digest, a, n)
    return F.concat_ws("-", F.when(name.isNotNull(), cut(1, 8)), F.when(name.isNotNull(), cut(9, 4)), F.concat(F.lit("5"), cut(14, 3)), F.concat(variant, cut(19, 2)), cut(21, 12))


def podcast_guid(feed_url: Column) -> Column:
    """The identifier of a feed: of its URL without scheme and trailing slashes."""
    name = F.regexp_replace(F.regexp_replace(feed_url, r"(?i)^[a-z]+://", ""), "/+$", "")
    return F.when(feed_url.isNotNull(), name_uuid(name, PODCASTS))


_TAG = r"(?i)^(?:[a-z]{2,3}(?:-[a-z]{3}){0,3}|[a-z]{4}|[a-z]{5,8})(?:-[a-z]{4})?(?:-(?:[a-z]{2}|\d{3}))?(?:-(?:[a-z\d]{5,8}|\d[a-z\d]{3}))*(?:-[a-wyz\d](?:-[a-z\d]{2,8})+)*(?:-x(?:-[a-z\d]{1,8})+)?$|^x(?:-[a-z\d]{1,8})+$"


def language_tag(tag: Column) -> Column:
    """Whether a language tag is well-formed (RFC 5646); a variant or extension that repeats makes it not so."""
    parts = F.split(F.lower(tag), "-")
    singles = F.filter(parts, lambda p, i: (F.length(p) == 1) & (i > 0))
    variants = F.filter(parts, lambda p: p.rlike(r"^([a-z\d]{5,8}|\d[a-z\d]{3})$"))
    return F.coalesce(tag.rlike(_TAG) & (F.size(F.array_distinct(singles)) == F.size(singles)) & (F.size(F.array_distinct(variants)) == F.size(variants)), F.lit(False))


def primary_language(tag: Column) -> Column:
    return F.lower(F.split_part(F.trim(tag), F.lit("-"), F.lit(1)))


def languages_agree(one: Column, other: Column) -> Column:
    """Whether one tag is the other or narrows it."""
    a, b = (F.concat(F.lower(F.trim(t)), F.lit("-")) for t in (one, other))
    return a.startswith(b) | b.startswith(a)


_DIGITS, _HEX, _LETTERS = "0123456789", "abcdef", "abcdefghijklmnopqrstuvwxyz"


def fingerprinted(path: Column) -> Column:
    """Whether a path names its content's version: a word of six or more hexadecimal characters, figures and letters both, a word
    of eight or more letters and figures with a figure, or figures beside figures at a dot, as releases are numbered."""
    low, all_of = F.lower(path), lambda t, chars: (t != "") & (F.translate(t, chars, "") == "")
    some = lambda t, chars: F.translate(t, chars, "") != t
    digest = lambda t: (F.length(t) >= 6) & all_of(t, _DIGITS + _HEX) & some(t, _DIGITS) & some(t, _HEX)
    mixed = lambda t: (F.length(t) >= 8) & all_of(t, _DIGITS + _LETTERS) & some(t, _DIGITS)
    number = lambda t: all_of(t, _DIGITS)
    major = lambda t: number(F.when(t.startswith("v"), F.substring(t, 2, 1 << 30)).otherwise(t))
    by_dots = F.transform(F.split(low, "[/_~-]"), lambda s: F.split(s, r"\."))
    release = F.exists(by_dots, lambda d: F.exists(F.zip_with(d, F.slice(d, F.lit(2), F.size(d)), lambda x, y: F.coalesce(major(x) & number(y), F.lit(False))), lambda hit: hit))
    return F.exists(F.split(low, "[/._~-]"), lambda t: digest(t) | mixed(t)) | release


def nearest_name(df, name: str, known, known_name: str):
    """(name, nearest): for each unknown name the known one, or ``folder/*``, that a typing error away; null if none is that near.

    ``known`` is a rule catalogue, so it is small and its size doesn't grow with the pages; it is broadcast by Spark's own judgement."""
    folders = known.select(F.concat(F.split_part(F.col(known_name), F.lit("/"), F.lit(1)), F.lit("/*")).alias("candidate")).distinct()
    candidates = known.select(F.col(known_name).alias("candidate")).unionByName(folders)
    most = F.greatest(F.lit(2), F.floor(F.length(name) / 4))
    near = df.join(candidates, F.levenshtein(F.col(name), F.col("candidate")) <= most)
    best = near.groupBy(name).agg(F.min_by("candidate", F.struct(F.levenshtein(F.col(name), F.col("candidate")), F.col("candidate"))).alias("nearest"))
    return df.select(name).distinct().join(best, name, "left")


#: Units of a number of bytes, milliseconds, grams or seconds, smallest first, with what each holds of the one before.
UNITS = {"bytes": (("B", 1), ("kB", 1000), ("MB", 1000), ("GB", 1000)), "ms": (("ms", 1), ("s", 1000), ("min", 60)), "g": (("mg", 1), ("g", 1000), ("kg", 1000)), "s": (("s", 1), ("min", 60), ("h", 60), ("d", 24))}


def with_unit(value: Column, unit: str) -> Column:
    """A measure in the largest unit of which there is one at least, with one decimal at most; grams begin at milligrams."""
    x = value.cast("double") * (1000 if unit == "g" else 1)
    size, text = 1, None
    for name, factor in UNITS[unit]:
        size *= factor
        number = F.regexp_replace(F.format_number(x / size, 1), r",|\.0$", "")
        said = F.concat(number, F.lit(" " + name))
        text = said if text is None else F.when(F.abs(x) >= size, said).otherwise(text)
    return text
