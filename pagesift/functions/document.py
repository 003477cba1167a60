"""All facts of a page from its HTML, by a tolerant parser in Arrow batches.

For pages whose markup defeats the regular expressions of ``html``: elements are followed as they open and close,
so that regions, the head and what is inside scripts are known. A null page gives null; nothing makes it fail.
"""

from __future__ import annotations

import json
import re
from html.parser import HTMLParser
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from pagesift.functions.weburl import resolve

# Attributes kept of head links, regions by element name, resources by element and attribute, void elements.
LINK_KEYS = ("rel", "type", "hreflang", "sizes", "media", "as", "crossorigin", "color")
REGIONS = ("main", "nav", "header", "footer", "aside", "article")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
UNSEEN = frozenset(("script", "style", "template", "noscript"))
#: Elements that the opening of another ends.
CLOSES = {"p": frozenset("p div ul ol table section article aside header footer nav main h1 h2 h3 h4 h5 h6 form pre blockquote".split()), "li": frozenset(("li",)), "option": frozenset(("option",)), "td": frozenset(("td", "th", "tr")), "th": frozenset(("td", "th", "tr")), "tr": frozenset(("tr",))}

_S, _L = pa.string(), pa.list_(pa.string())
_MAP, _LISTS = pa.map_(_S, _S), pa.map_(_S, _L)
TYPE = pa.struct([
    ("lang", _S), ("dir", _S), ("charset", pa.struct([("declared", _S), ("offset", pa.int32())])), ("title", _S), ("h1", _L), ("canonical", _S), ("meta", _MAP),
    ("metas", pa.list_(pa.struct([("name", _S), ("content", _S), ("media", _S)]))), ("http_equiv", pa.list_(pa.struct([("name", _S), ("content", _S)]))), ("property", _MAP),
    ("head_links", pa.list_(pa.struct([("href", _S), *((k, _S) for k in LINK_KEYS)]))), ("hreflang", pa.list_(pa.struct([("lang", _S), ("href", _S)]))), ("jsonld", _L),
    ("scripts", pa.list_(pa.struct([("src", _S), ("type", _S), ("async", pa.bool_()), ("defer", pa.bool_()), ("head", pa.bool_())]))),
    ("links", pa.struct([("internal", _L), ("external", _L), ("nofollow", _L), ("sponsored", _L), ("ugc", _L), ("rel", _LISTS), ("regions", pa.map_(_S, _LISTS))])),
    ("images", pa.list_(pa.struct([("src", _S), ("alt", _S), ("width", _S), ("height", _S), ("srcset", _S), ("loading", _S), ("noscript", pa.bool_())]))),
    ("rels", _LISTS), ("inputs", pa.list_(pa.struct([("type", _S), ("autocomplete", _S), ("inputmode", _S)]))), ("text", pa.int32()),
    ("resources", pa.list_(pa.struct([("url", _S), ("kind", _S), ("origin", _S), ("integrity", _S), ("crossorigin", _S)]))), ("resources_dropped", pa.int32()), ("author", _S), ("published", _S),
])
DDL = (
    "struct<lang: string, dir: string, charset: struct<declared: string, offset: int>, title: string, h1: array<string>, canonical: string, meta: map<string, string>,"
    " metas: array<struct<name: string, content: string, media: string>>, http_equiv: array<struct<name: string, content: string>>, property: map<string, string>,"
    f" head_links: array<struct<href: string, {', '.join(f'`{k}`: string' for k in LINK_KEYS)}>>, hreflang: array<struct<lang: string, href: string>>, jsonld: array<string>,"
    " scripts: array<struct<src: string, type: string, async: boolean, defer: boolean, head: boolean>>,"
    " links: struct<internal: array<string>, external: array<string>, nofollow: array<string>, sponsored: array<string>, ugc: array<string>, rel: map<string, array<string>>, regions: map<string, map<string, array<string>>>>,"
    " images: array<struct<src: string, alt: string, width: string, height: string, srcset: string, loading: string, noscript: boolean>>,"
    " rels: map<string, array<string>>, inputs: array<struct<type: string, autocomplete: string, inputmode: string>>, text: int,"
    " resources: array<struct<url: string, kind: string, origin: string, integrity: string, crossorigin: string>>, resources_dropped: int, author: string, published: string>"
)


class _Reader(HTMLParser):
    def __init__(self, url: str):
        super().__init__(convert_charrefs=True)
        self.url, self.open, self.raw = url, [], []
        self.elements: list[tuple[str, dict, tuple[str, ...], tuple[str, ...]]] = []
        self.texts: list[tuple[str, list[str]]] = []
        self.into: list[list[str]] = []
        self.words, self.main_words = [], []

    def handle_starttag(self, tag, attrs):
        while self.open and tag in CLOSES.get(self.open[-1][0], ()):
            self.handle_endtag(self.open[-1][0])
        first: dict[str, str] = {}
        for k, v in attrs:
            first.setdefault(k, v or "")
        names = tuple(t for t, _ in self.open)
        comments = tuple("comments" for _, a in self.open if re.search("comment", a.get("id", "") + " " + a.get("class", ""), re.I))
        self.elements.append((tag, first, names, comments))
        if tag in ("title", "h1", "script"):
            held: list[str] = []
            self.texts.append((tag, held))
            self.elements[-1][1]["#text"] = held
        if tag not in VOID:
            self.open.append((tag, first))

    def handle_endtag(self, tag):
        if any(t == tag for t, _ in self.open):
            while self.open.pop()[0] != tag:
                pass

    def handle_data(self, data):
        names = [t for t, _ in self.open]
        for tag, attrs in self.open:
            if "#text" in attrs:
                attrs["#text"].append(data)
        if not UNSEEN.intersection(names) and "head" not in names:
            self.words.append(data)
            if "main" in names:
                self.main_words.append(data)


def _text(attrs: dict) -> str:
    return "".join(attrs.get("#text", ())).strip()


def srcset(value: str) -> list[str]:
    """The candidates' URLs."""
    return [c.split()[0] for c in value.split(",") if c.split()]


def _nodes(value) -> list[dict]:
    """All JSON-LD nodes of a value, through lists and @graph, in order."""
    found, todo = [], [value]
    while todo:
        x = todo.pop()
        if isinstance(x, list):
            todo += reversed(x)
        elif isinstance(x, dict):
            found.append(x)
            todo.append(x.get("@graph", []))
    return found


def _person(value) -> str | None:
    while isinstance(value, list):
        value = value[0] if value else None
    value = value.get("name") if isinstance(value, dict) else value
    return value if isinstance(value, str) else None


def _distinct(items) -> list:
    return list(dict.fromkeys(items))


_CHARSET = re.compile(r"""<meta\s[^>]*?charset\s*=\s*["']?\s*([^\s"';>]+)[^>]*>""", re.I)
_WEB = re.compile("https?:")


def extract(html: str, url: str, scope: str = "host", most: int | None = None) -> dict:
    """The facts of one page; links are internal if they share the page's ``scope`` (host or origin). All resources are listed, or with ``most``, a limit
    of the report on a page, the first ones, and ``resources_dropped`` counts the others."""
    reader = _Reader(url)
    reader.feed(html)
    reader.close()
    at = lambda ref: resolve(url, ref) or ref
    tokens = lambda a: a.get("rel", "").lower().split()
    of = lambda *tags: [e for e in reader.elements if e[0] in tags]
    first = lambda pairs: list({k: v for k, v in reversed(list(pairs))}.items())[::-1]
    root = next((a for t, a, _, _ in reader.elements if t == "html"), {})
    metas = [a for _, a, _, _ in of("meta")]
    links = [(a, names) for _, a, names, _ in of("link") if "href" in a]
    anchors = [(href, tokens(a), {*names, *marks}) for _, a, names, marks in of("a") if "href" in a and _WEB.match(href := at(a["href"]).partition("#")[0])]
    here = urlsplit(url)
    same = (lambda h: urlsplit(h).hostname == here.hostname) if scope == "host" else (lambda h: urlsplit(h)[:2] == here[:2])
    rel: dict[str, list[str]] = {}
    regions: dict[str, dict[str, list[str]]] = {}
    for href, ts, names in anchors:
        rel[href] = [t for t in rel.get(href, ts) if t in ts]
        for name in () if same(href) else (*REGIONS, "comments"):
            if name in names:
                region = regions.setdefault(name, {})
                region[href] = [t for t in region.get(href, ts) if t in ts]
    rels: dict[str, list[str]] = {}
    for _, a, _, _ in of("a", "area", "link"):
        if "rel" in a and "href" in a:
            for t in tokens(a):
                rels.setdefault(t, []).append(at(a["href"]))
    blocks, parsed = [], []
    for _, a, _, _ in of("script"):
        if a.get("type") == "application/ld+json":
            try:
                parsed.append(json.loads("".join(a["#text"])))
                blocks.append(json.dumps(parsed[-1], ensure_ascii=False))
            except ValueError as e:
                blocks.append(json.dumps({"@error": str(e)}))
    meta, prop = first((a["name"], a["content"]) for a in metas if "name" in a and "content" in a), first((a["property"], a["content"]) for a in metas if "property" in a and "content" in a)
    nodes = [n for p in parsed for n in _nodes(p)]
    named = dict(meta), dict(prop)
    author = next(filter(None, (_person(n.get("author")) for n in nodes)), None) or next(filter(None, (named[1].get("article:author"), named[0].get("author"), named[1].get("og:author"), named[0].get("og:author"))), None)
    published = next((n["datePublished"] for n in nodes if isinstance(n.get("datePublished"), str)), None) or named[1].get("article:published_time")
    sources = [("script", "script", "src", None), ("link", "style", "href", "stylesheet"), ("img", "image", "src", None), ("iframe", "iframe", "src", None), ("link", "preload", "href", "preload"), ("link", "manifest", "href", "manifest")]
    resources: dict = {}
    for tag, kind, attribute, token in sources:
        for _, a, _, _ in of(tag):
            if attribute not in a or (token and token not in tokens(a)):
                continue
            for raw in [a[attribute], *(srcset(a.get("srcset", "")) if kind == "image" else [])]:
                to = (resolve(url, raw) or "").partition("#")[0]
                if _WEB.match(to):
                    resources.setdefault((kind, to), {"url": to, "kind": kind, "origin": "same" if urlsplit(to)[:2] == here[:2] else "cross", "integrity": a.get("integrity") or None, "crossorigin": a.get("crossorigin")})
    charset = _CHARSET.search(html)
    with_token = lambda t: _distinct(h for h, ts, _ in anchors if t in ts)
    has_main = any(t == "main" for t, _, _, _ in reader.elements)
    return {
        "lang": root.get("lang"), "dir": root.get("dir"), "charset": charset and {"declared": charset[1], "offset": len(html[: charset.end()].encode("utf-8", "replace"))},
        "title": next((_text(a) for _, a, names, _ in of("title") if "svg" not in names), "") or None, "h1": [_text(a) for _, a, _, _ in of("h1")],
        "canonical": next((a["href"] for a, _ in links if a.get("rel") == "canonical"), None), "meta": meta, "property": prop,
        "metas": [{"name": a["name"], "content": a["content"], "media": a.get("media")} for a in metas if "name" in a and "content" in a],
        "http_equiv": [{"name": a["http-equiv"].lower(), "content": a["content"]} for a in metas if "http-equiv" in a and "content" in a],
        "head_links": [{"href": at(a["href"]), **{k: a.get(k) for k in LINK_KEYS}} for a, names in links if "body" not in names],
        "hreflang": [{"lang": a["hreflang"], "href": at(a["href"])} for a, _ in links if "hreflang" in a and "alternate" in tokens(a)], "jsonld": blocks,
        "scripts": [{"src": at(a["src"]) if "src" in a else None, "type": a.get("type"), "async": "async" in a, "defer": "defer" in a, "head": "head" in names} for _, a, names, _ in of("script")],
        "links": {
            "internal": _distinct(h for h, _, _ in anchors if same(h)), "external": _distinct(h for h, _, _ in anchors if not same(h)), "nofollow": with_token("nofollow"), "sponsored": with_token("sponsored"),
            "ugc": with_token("ugc"), "rel": [(k, v) for k, v in rel.items() if v], "regions": [(k, list(v.items())) for k, v in regions.items()],
        },
        "images": [{"src": a.get("src", ""), **{k: a.get(k) for k in ("alt", "width", "height", "srcset", "loading")}, "noscript": "noscript" in names} for _, a, names, _ in of("img")],
        "rels": [(k, _distinct(v)) for k, v in rels.items()], "inputs": [{"type": a.get("type", "text").lower(), "autocomplete": a.get("autocomplete"), "inputmode": a.get("inputmode")} for _, a, _, _ in of("input")],
        "text": len("".join(reader.main_words if has_main else reader.words).split()), "resources": list(resources.values())[:most], "resources_dropped": max(0, len(resources) - most) if most is not None else 0, "author": (author or "").strip() or None, "published": (published or "").strip() or None,
    }


def page(html: Column, url: Column, scope: str = "host", most: int | None = None) -> Column:
    """The struct of all facts of a page; null if its HTML or its URL is."""

    @F.arrow_udf(DDL)
    def run(pages: pa.Array, urls: pa.Array) -> pa.Array:
        # Captures that repeat a page within a batch are parsed once: each different one gets a place, rows take from these.
        places: dict[tuple[str, str], int] = {}
        rows = [None if h is None or u is None else places.setdefault((h, u), len(places)) for h, u in zip(pages.to_pylist(), urls.to_pylist())]
        return pa.array([extract(h, u, scope, most) for h, u in places], TYPE).take(pa.array(rows, pa.int32()))

    return run(html, url)
