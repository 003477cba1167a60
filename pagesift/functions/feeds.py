"""Feeds of all formats as one struct: RSS 2.0 and 0.9x, RSS 1.0 (RDF), Atom and JSON Feed, parsed in Arrow batches.

XML is parsed with its namespaces by the standard library; what isn't well-formed gives ``error`` and no items. Dates stay as
they are written, beside the field that has them, and are read by columns: ``rfc822`` and ``rfc3339``.
"""

from __future__ import annotations

import json
import re
import xml.etree.ElementTree as ET

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from pagesift.functions.weburl import resolve

# Namespaces of the formats and their modules, and the elements that RSS 2.0 knows.
ATOM, RDF, RSS1, DC = "http://www.w3.org/2005/Atom", "http://www.w3.org/1999/02/22-rdf-syntax-ns#", "http://purl.org/rss/1.0/", "http://purl.org/dc/elements/1.1/"
ENCODED, XML = "http://purl.org/rss/1.0/modules/content/", "http://www.w3.org/XML/1998/namespace"
RSS_CHANNEL = frozenset("title link description language copyright managingEditor webMaster pubDate lastBuildDate category generator docs cloud ttl image rating textInput skipHours skipDays item".split())
RSS_ITEM = frozenset("title link description author category comments enclosure guid pubDate source".split())
JSON_FEED = "https://jsonfeed.org/version/"

_S, _L = pa.string(), pa.list_(pa.string())
_DATE = pa.struct([("field", _S), ("raw", _S)])
_ITEM = pa.struct([
    ("position", pa.int32()), ("id", _S), ("permalink", pa.bool_()), ("link", _S), ("title", _S), ("published", _DATE), ("updated", _DATE), ("author", pa.bool_()), ("words", pa.int32()),
    ("enclosures", pa.list_(pa.struct([("url", _S), ("length", _S), ("type", _S)]))), ("emails", _L), ("missing", _L), ("unknown", _L),
])
_FEED = pa.struct([
    ("format", _S), ("version", _S), ("error", _S), ("title", _S), ("link", _S), ("language", _S), ("ttl", _S), ("self", _S), ("hubs", _L), ("updated", _DATE), ("author", pa.bool_()), ("emails", _L), ("missing", _L), ("unknown", _L), ("items", pa.list_(_ITEM)),
])
_D = "struct<field: string, raw: string>"
DDL = (
    f"struct<format: string, version: string, error: string, title: string, link: string, language: string, ttl: string, self: string, hubs: array<string>, updated: {_D}, author: boolean, emails: array<string>, missing: array<string>, unknown: array<string>,"
    f" items: array<struct<position: int, id: string, permalink: boolean, link: string, title: string, published: {_D}, updated: {_D}, author: boolean, words: int, enclosures: array<struct<url: string, length: string, type: string>>, emails: array<string>, missing: array<string>, unknown: array<string>>>>"
)


def _q(space: str, name: str) -> str:
    return f"{{{space}}}{name}" if space else name


def _text(node: ET.Element | None, *names: str) -> str | None:
    """The trimmed text of the first of the children that has one."""
    for n in names if node is not None else ():
        for child in node.findall(n):
            if text := "".join(child.itertext()).strip():
                return text
    return None


def _date(node: ET.Element | None, **fields: str) -> dict | None:
    """The first date that is there; ``fields`` are the names that reports use, with the elements."""
    return next(({"field": f.replace("_", ":"), "raw": t} for f, n in fields.items() if (t := _text(node, n))), None)


def _word_count(*texts: str | None) -> int:
    return sum(len(re.sub(r"<[^>]*>", " ", t).split()) for t in texts if t)


def _all_texts(node: ET.Element | None, *names: str) -> list[str]:
    return [t for n in names for c in (node.findall(n) if node is not None else []) if (t := "".join(c.itertext()).strip())]


def _links(node: ET.Element | None, base: str) -> dict[str, list[dict]]:
    """Atom links by relation."""
    out: dict[str, list[dict]] = {}
    for a in node.findall(_q(ATOM, "link")) if node is not None else ():
        out.setdefault(a.get("rel", "alternate"), []).append({"url": resolve(base, a.get("href", "")) or a.get("href"), "length": a.get("length"), "type": a.get("type")})
    return out


def _first_url(links: dict[str, list[dict]], rel: str) -> str | None:
    return links[rel][0]["url"] if rel in links else None


def _rss(root: ET.Element, base: str) -> dict:
    rdf = root.tag == _q(RDF, "RDF")
    q = lambda n: _q(RSS1 if rdf else "", n)
    channel = root.find(q("channel"))
    links, items = _links(channel, base), []
    for i, e in enumerate((root if rdf else channel if channel is not None else root).findall(q("item")), 1):
        guid, body = e.find("guid"), (_text(e, q("description")), _text(e, _q(ENCODED, "encoded")))
        link, titled = _text(e, q("link")), e.find(q("title")) is not None or e.find(q("description")) is not None
        items.append({
            "position": i, "id": _text(e, "guid") or e.get(_q(RDF, "about")), "permalink": guid is not None and guid.get("isPermaLink") != "false", "link": link, "title": _text(e, q("title")),
            "published": _date(e, pubDate="pubDate", dc_date=_q(DC, "date")), "updated": None, "author": _text(e, "author", _q(DC, "creator")) is not None, "words": _word_count(*body),
            "enclosures": [{k: x.get(k) for k in ("url", "length", "type")} for x in e.findall("enclosure")], "emails": _all_texts(e, "author"),
            "missing": ["title or description"] * (not titled) + ["link"] * (rdf and not link), "unknown": [] if rdf else sorted({c.tag for c in e if "{" not in c.tag} - RSS_ITEM),
        })
    missing = ["channel"] if channel is None else [n for n in ("title", "link", "description") if channel.find(q(n)) is None]
    return {
        "format": "rss", "version": root.get("version"), "title": _text(channel, q("title")), "link": _text(channel, q("link")), "language": _text(channel, "language", _q(DC, "language")), "ttl": _text(channel, "ttl"),
        "self": _first_url(links, "self"), "hubs": [x["url"] for x in links.get("hub", [])], "updated": _date(channel, lastBuildDate="lastBuildDate", pubDate="pubDate"), "author": True, "emails": _all_texts(channel, "managingEditor", "webMaster"),
        "missing": missing + ["version attribute"] * (not rdf and not root.get("version")), "unknown": [] if rdf or channel is None else sorted({c.tag for c in channel if "{" not in c.tag} - RSS_CHANNEL), "items": items,
    }


def _atom(root: ET.Element, base: str) -> dict:
    q = lambda n: _q(ATOM, n)
    lacks = lambda e: [n for n in ("id", "title", "updated") if e.find(q(n)) is None]
    links, items = _links(root, base), []
    for i, e in enumerate(root.findall(q("entry")), 1):
        own = _links(e, base)
        items.append({
            "position": i, "id": _text(e, q("id")), "permalink": False, "link": _first_url(own, "alternate"), "title": _text(e, q("title")), "published": _date(e, published=q("published")), "updated": _date(e, updated=q("updated")),
            "author": e.find(q("author")) is not None or e.find(f"{q('source')}/{q('author')}") is not None, "words": _word_count(_text(e, q("content")), _text(e, q("summary"))), "enclosures": own.get("enclosure", []),
            "emails": [], "missing": lacks(e), "unknown": [],
        })
    return {
        "format": "atom", "title": _text(root, q("title")), "link": _first_url(links, "alternate"), "language": root.get(_q(XML, "lang")), "self": _first_url(links, "self"), "hubs": [x["url"] for x in links.get("hub", [])],
        "updated": _date(root, updated=q("updated")), "author": root.find(q("author")) is not None, "emails": [], "missing": lacks(root), "unknown": [], "items": items,
    }


def _json(body: str, base: str) -> dict:
    feed = json.loads(body)
    said = lambda v: v if isinstance(v, str) and v.strip() else None
    authored = lambda v: bool(v.get("authors")) or isinstance(v.get("author"), dict)
    if not isinstance(feed, dict) or not str(feed.get("version", "")).startswith(JSON_FEED):
        raise ValueError("no JSON Feed")
    items = []
    for i, e in enumerate(feed["items"] if isinstance(feed.get("items"), list) else [], 1):
        e = e if isinstance(e, dict) else {}
        own = str(e["id"]) if isinstance(e.get("id"), (int, float)) and not isinstance(e.get("id"), bool) else said(e.get("id"))
        bodies = [said(e.get(k)) for k in ("content_html", "content_text", "summary")]
        dated = lambda k, e=e: {"field": k, "raw": e[k]} if said(e.get(k)) else None
        items.append({
            "position": i, "id": own, "permalink": False, "link": said(e.get("url")), "title": said(e.get("title")), "published": dated("date_published"), "updated": dated("date_modified"), "author": authored(e), "words": _word_count(*bodies),
            "enclosures": [{"url": said(a.get("url")), "length": str(a["size_in_bytes"]) if "size_in_bytes" in a else None, "type": said(a.get("mime_type"))} for a in e.get("attachments") or [] if isinstance(a, dict)],
            "emails": [], "missing": ["id"] * (own is None) + ["content_html or content_text"] * (not any(bodies[:2])), "unknown": ["author"] * isinstance(e.get("author"), dict),
        })
    return {
        "format": "json", "version": feed["version"], "title": said(feed.get("title")), "link": said(feed.get("home_page_url")), "language": said(feed.get("language")), "self": (resolve(base, feed["feed_url"]) or feed["feed_url"]) if said(feed.get("feed_url")) else None,
        "hubs": [resolve(base, h["url"]) or h["url"] for h in feed.get("hubs") or [] if isinstance(h, dict) and said(h.get("url"))], "updated": None, "author": authored(feed), "emails": [],
        "missing": ["title"] * (said(feed.get("title")) is None) + ["items"] * (not isinstance(feed.get("items"), list)), "unknown": ["author"] * isinstance(feed.get("author"), dict), "items": items,
    }


def read(body: str, base: str) -> dict:
    """One feed; ``error`` says why it can't be read."""
    if body.lstrip("﻿ \t\r\n").startswith("{"):
        try:
            return _json(body, base)
        except (ValueError, RecursionError, TypeError) as e:
            return {"format": "json", "error": str(e)[:200] or "unreadable", "items": []}
    try:
        root = ET.fromstring(body.lstrip("﻿ \t\r\n"))
    except (ET.ParseError, ValueError, RecursionError) as e:
        return {"format": "atom" if "<feed" in body else "rss", "error": str(e)[:200], "items": []}
    if root.tag == _q(ATOM, "feed"):
        return _atom(root, base)
    if root.tag in ("rss", _q(RDF, "RDF")):
        return _rss(root, base)
    return {"format": None, "error": f"no feed: {root.tag}", "items": []}


def feed(body: Column, url: Column) -> Column:
    """The struct of a feed; null if its body or its URL is."""

    @F.arrow_udf(DDL)
    def run(bodies: pa.Array, urls: pa.Array) -> pa.Array:
        return pa.array([None if b is None or u is None else read(b, u) for b, u in zip(bodies.to_pylist(), urls.to_pylist())], _FEED)

    return run(body, url)


_MONTHS, _DAYS = ("Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec"), ("Sun", "Mon", "Tue", "Wed", "Thu", "Fri", "Sat")
_ZONES = {"UT": 0, "GMT": 0, "Z": 0, "EST": -300, "EDT": -240, "CST": -360, "CDT": -300, "MST": -420, "MDT": -360, "PST": -480, "PDT": -420}


def rfc822(text: Column) -> Column:
    """The time of an RFC 822 date with four figures of the year; null for what breaks the grammar, names a day that isn't,
    or says another weekday than the date's."""
    grammar = rf"^\s*(?:({'|'.join(_DAYS)}),\s+)?([0-9]{{1,2}})\s+({'|'.join(_MONTHS)})\s+([0-9]{{4}})\s+([0-9]{{2}}):([0-9]{{2}})(?::([0-9]{{2}}))?\s+({'|'.join(_ZONES)}|[+-][0-9]{{4}})\s*$"
    part = lambda k: F.regexp_extract(text, grammar, k)
    number = lambda k: part(k).try_cast("int")
    named = F.array(*map(F.lit, _MONTHS))
    zone, sign = part(8), F.when(part(8).startswith("-"), -1).otherwise(1)
    offset = F.coalesce(F.try_element_at(F.create_map(*[x for k, v in _ZONES.items() for x in (F.lit(k), F.lit(v))]), zone), sign * (F.substring(zone, 2, 2).try_cast("int") * 60 + F.substring(zone, 4, 2).try_cast("int")))
    day = F.try_make_timestamp(number(4), F.array_position(named, part(3)).cast("int"), number(2), F.lit(0), F.lit(0), F.lit(0).cast("decimal(8,6)"), F.lit("UTC"))
    inside = (number(5) < 24) & (number(6) < 60) & (F.coalesce(number(7), F.lit(0)) < 60)
    right_day = (part(1) == "") | (F.get(F.array(*map(F.lit, _DAYS)), F.dayofweek(day) - 1) == part(1))
    seconds = F.unix_timestamp(day) + number(5) * 3600 + number(6) * 60 + F.coalesce(number(7), F.lit(0)) - offset * 60
    return F.when((part(4) != "") & inside & right_day, F.timestamp_seconds(seconds))


def rfc3339(text: Column, date_alone: bool = False) -> Column:
    """The time of an RFC 3339 date and time with its offset, or with ``date_alone`` of a date too; null for what is none."""
    grammar = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}[Tt][0-9]{2}:[0-9]{2}:[0-9]{2}(\.[0-9]+)?([Zz]|[+-][0-9]{2}:[0-9]{2})$"
    full = F.when(text.rlike(grammar), F.upper(text).try_cast("timestamp"))
    return F.coalesce(full, F.when(text.rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), text.try_cast("timestamp"))) if date_alone else full


def moment(form: Column, date: Column) -> Column:
    """When a feed's date is, in the grammar of its format: RFC 822 in RSS, but for Dublin Core's dates, and RFC 3339 elsewhere."""
    return F.when(form != "rss", rfc3339(date["raw"])).when(date["field"] == "dc:date", rfc3339(date["raw"], date_alone=True)).otherwise(rfc822(date["raw"]))
