"""Microdata and RDFa of a page as nodes of the same shape as JSON-LD, by one walk over its elements.

An item is an element with ``itemscope`` (or ``typeof``); a property belongs to the nearest item around it. Items that are
no property themselves are the page's nodes; an item that is one is its value. Pages without either marker aren't parsed.
"""

from __future__ import annotations

import json
import re
from collections import Counter
from collections.abc import Callable
from functools import lru_cache
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from pagesift.functions.document import CLOSES, VOID
from pagesift.functions.weburl import resolve

#: Per syntax: the attributes of an item, its types, a property, and the identity (the first that is there).
SYNTAXES = {"microdata": ("itemscope", "itemtype", "itemprop", ("itemid",)), "rdfa": ("typeof", "typeof", "property", ("resource", "about"))}
_MARKED = re.compile(r"\bitemscope\b|\btypeof\s*=", re.I)
_DDL = "struct<microdata: array<string>, rdfa: array<string>>"
_TYPE = pa.struct([(k, pa.list_(pa.string())) for k in SYNTAXES])


def _kept(f: Callable) -> Callable:
    """``f`` of a text, with the latest results of short texts kept."""
    kept = lru_cache(4096)(f)
    return lambda text: kept(text) if len(text) <= 200 else f(text)


@_kept
def terms(attribute: str) -> list[str]:
    """The names of a list of terms, without the vocabulary before them."""
    return [re.split(r"[/#:]", t)[-1] for t in attribute.split()]


class _Element:
    __slots__ = ("tag", "attrs", "items", "text")

    def __init__(self, tag: str, attrs: dict[str, str]):
        self.tag, self.attrs = tag, attrs
        self.items: dict[str, dict] = {}
        self.text: list[str] | None = None


class _Items(HTMLParser):
    def __init__(self, url: str, syntaxes=SYNTAXES):
        super().__init__(convert_charrefs=True)
        self.url, self.syntaxes, self.open, self.tags = url, syntaxes, [], Counter()
        #: Of the open elements: the items of each syntax, and those whose text is a value; so that depth costs nothing.
        self.around: dict[str, list[dict]] = {k: [] for k in SYNTAXES}
        self.texts: list[_Element] = []
        self.found: dict[str, list[dict]] = {k: [] for k in SYNTAXES}

    def _value(self, e: _Element):
        """What a property's attributes say; None where its text counts."""
        a = e.attrs
        if "content" in a:
            return a["content"]
        for k in ("href", "src", "data"):
            if k in a:
                return resolve(self.url, a[k]) or a[k]
        return a.get("value", a.get("datetime"))

    def handle_starttag(self, tag, attrs):
        while self.open and tag in CLOSES.get(self.open[-1].tag, ()):
            self.handle_endtag(self.open[-1].tag)
        first: dict[str, str] = attrs if isinstance(attrs, dict) else {k: v or "" for k, v in reversed(attrs)}
        e = _Element(tag, first)
        for syntax, (scope, types, prop, ids) in self.syntaxes.items() if first else ():
            owner = self.around[syntax][-1] if self.around[syntax] else None
            if scope in first:
                node = e.items[syntax] = {}
                if named := terms(first.get(types, "")):
                    node["@type"] = named
                if (own := next((first[k] for k in ids if k in first), None)) is not None:
                    node["@id"] = own if own.startswith("_:") else resolve(self.url, own) or own
                if prop not in first:
                    self.found[syntax].append(node)
            if prop in first and owner is not None:
                value = e.items.get(syntax, self._value(e))
                if value is None:  # its text, once it is known
                    e.text = value = [] if e.text is None else e.text
                for name in terms(first[prop]):
                    owner.setdefault(name, []).append(value)
        if tag not in VOID:
            self.open.append(e)
            self.tags[tag] += 1
            for syntax, node in e.items.items():
                self.around[syntax].append(node)
            if e.text is not None:
                self.texts.append(e)

    def handle_endtag(self, tag):
        while self.tags[tag]:
            e = self.open.pop()
            self.tags[e.tag] -= 1
            for syntax in e.items:
                self.around[syntax].pop()
            if e.text is not None:
                self.texts.pop()
            if e.tag == tag:
                break

    def handle_data(self, data):
        for e in self.texts:
            e.text.append(data)


def _plain(node: dict) -> dict:
    """A node with texts put together, and lists of one value as that value. Nesting isn't followed by recursion."""
    out: dict = {}
    todo = [(node, out)]
    while todo:
        source, target = todo.pop()
        for k, v in source.items():
            if k.startswith("@"):
                target[k] = v
                continue
            values = []
            for x in v:
                if isinstance(x, dict):
                    values.append({})
                    todo.append((x, values[-1]))
                else:
                    values.append(" ".join("".join(x).split()) if isinstance(x, list) else x)
            target[k] = values[0] if len(values) == 1 else values
    return out


_encode = json.JSONEncoder(ensure_ascii=False).encode


def _told(node: dict) -> str:
    try:
        return _encode(_plain(node))
    except RecursionError:
        return json.dumps({"@error": "nested too deeply"})


#: What every parser reads alike: tags in lower case, attributes with spaces before them and quoted values, text without references.
_SIMPLE = re.compile(r'(<([a-z][a-z0-9]*)((?:[ \n]+[a-z][a-z0-9:_-]*(?:="[^"<>&]*")?)*)>|</([a-z][a-z0-9]*)>|[^<&]+)')
_ATTRIBUTE = re.compile(r'([a-z][a-z0-9:_-]*)(?:="([^"]*)")?')
#: Elements whose contents aren't markup.
_RAW = {"script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes", "noscript", "plaintext", "svg", "math"}
_NONE: dict[str, str] = {}


@_kept
def _attributes(text: str) -> dict[str, str]:
    return dict(reversed(_ATTRIBUTE.findall(text)))


def _read_simple(html: str, url: str) -> _Items | None:
    """The items of a page that is simple throughout, without the parser's care for what may be wrong; none for another."""
    tokens = _SIMPLE.findall(html)
    if sum(len(t[0]) for t in tokens) < len(html) or not _RAW.isdisjoint([t[1] for t in tokens]):
        return None
    # An attribute that makes no item anywhere finds none.
    reader = _Items(url, {k: v for k, v in SYNTAXES.items() if v[0] in html})
    for whole, tag, attributes, ended in tokens:
        if tag:
            reader.handle_starttag(tag, _attributes(attributes) if attributes else _NONE)
        elif ended:
            reader.handle_endtag(ended)
        elif reader.texts:
            reader.handle_data(whole)
    return reader


def read(html: str, url: str) -> dict[str, list[str]]:
    """The nodes of each syntax as JSON texts, in order."""
    if not _MARKED.search(html):
        return {k: [] for k in SYNTAXES}
    reader = _read_simple(html, url)
    if reader is None:
        reader = _Items(url)
        reader.feed(html)
        reader.close()
    return {k: [_told(n) for n in v] for k, v in reader.found.items()}


def items(html: Column, url: Column) -> Column:
    """struct(microdata, rdfa): arrays of JSON texts, one for each item that is no property; null if page or URL is.
    ``structured_data.nodes`` takes them as it takes JSON-LD."""

    @F.arrow_udf(_DDL)
    def run(pages: pa.Array, urls: pa.Array) -> pa.Array:
        return pa.array([None if h is None or u is None else read(h, u) for h, u in zip(pages.to_pylist(), urls.to_pylist())], _TYPE)

    return run(html, url)
