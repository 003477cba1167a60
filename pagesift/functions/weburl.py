"""URLs as browsers read them: resolving, percent-encoding, default ports, internationalised hosts; registrable domains."""

from __future__ import annotations

import re
from collections.abc import Iterable
from urllib.parse import quote, urljoin, urlsplit, urlunsplit

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from pagesift.functions.urls import parents

#: The ports that a scheme leaves out.
PORTS = {"http": 80, "https": 443, "ws": 80, "wss": 443, "ftp": 21}
_PATH, _QUERY, _FRAGMENT = "!$%&'()*+,-./:;=@_~[]|^\\", "!$%&()*+,-./:;=?@_~[]|^`{}\\", "!$%&'()*+,-./:;=?@_~#[]|^{}\\"


def normalised(url: str) -> str | None:
    """A URL in its one written form; null for one that has no host or a port that is none."""
    try:
        p = urlsplit(url)
        port = p.port
        host = p.hostname
    except ValueError:
        return None
    scheme = p.scheme.lower()
    if scheme not in PORTS:
        return url if scheme else None
    if not host:
        return None
    if not host.isascii():
        try:
            host = host.encode("idna").decode()
        except UnicodeError:
            return None
    if re.search(r'[\s<>"^`{|}%\\]', host):
        return None
    host = f"[{host}]" if ":" in host else host
    login = p.netloc.rpartition("@")[0]
    place = (login + "@" if login else "") + host + (f":{port}" if port is not None and port != PORTS[scheme] else "")
    return urlunsplit((scheme, place, quote(_folded(p.path or "/"), _PATH), quote(p.query, _QUERY), quote(p.fragment, _FRAGMENT)))


def _folded(path: str) -> str:
    """The path without dot segments."""
    out: list[str] = []
    parts = path.replace("\\", "/").split("/")[1:]
    for i, part in enumerate(parts):
        name, last = part.lower().replace("%2e", "."), i == len(parts) - 1
        if name == "..":
            del out[-1:]
        elif name != ".":
            out.append(part)
        if name in (".", "..") and last:
            out.append("")
    return "/" + "/".join(out)


#: URLs that are in their one written form as they stand, and what can be put to one as it stands: nothing to escape, fold or leave out.
_PART, _LABEL = r"[A-Za-z0-9_~-][A-Za-z0-9_.~-]*", "[a-z0-9-]+"
_PLAIN_PATH, _PLAIN_FRAGMENT = rf"/(?:{_PART}/)*(?:{_PART})?", "#[A-Za-z0-9_.~-]+"
_PLAIN = re.compile(rf"(https?://{_LABEL}(?:\.{_LABEL})*)({_PLAIN_PATH})(?:{_PLAIN_FRAGMENT})?")
_PLAIN_REFS = {"#": (re.compile(_PLAIN_FRAGMENT), 2), "/": (re.compile(f"{_PLAIN_PATH}(?:{_PLAIN_FRAGMENT})?"), 1)}


def resolve(base: str, ref: str) -> str | None:
    """``ref`` against ``base``, normalised, the fragment kept; null for what is no URL."""
    if at := _PLAIN.fullmatch(base):
        like, parts = _PLAIN_REFS.get(ref[:1], (_PLAIN, 0))
        if like.fullmatch(ref):
            return "".join(at.groups()[:parts]) + ref
    return _resolve(base, ref)


def _resolve(base: str, ref: str) -> str | None:
    ref = re.sub(r"[\t\n\r]", "", ref.strip("\x00\x01\x02\x03\x04\x05\x06\x07\x08\x09\x0a\x0b\x0c\x0d\x0e\x0f\x10\x11\x12\x13\x14\x15\x16\x17\x18\x19\x1a\x1b\x1c\x1d\x1e\x1f "))
    if re.match(r"https?:", base, re.I):
        ref = re.sub(r"^(https?:)[\\/]*", r"\1//", ref.replace("\\", "/") if not re.match(r"[a-z][a-z0-9+.-]*:", ref, re.I) or re.match(r"https?:", ref, re.I) else ref, flags=re.I)
    try:
        return normalised(urljoin(base, ref))
    except ValueError:
        return None


def resolved(base: Column, ref: Column) -> Column:
    """``resolve`` as a column, in Arrow batches; null where either is null."""

    @F.pandas_udf("string")
    def run(bases: pd.Series, refs: pd.Series) -> pd.Series:
        return pd.Series([None if b is None or r is None else resolve(b, r) for b, r in zip(bases, refs)], dtype=object)

    return run(base, ref)


#: A few of the public suffixes that have more than one label; the whole list is given by the caller, as it changes.
SUFFIXES = ("co.uk", "org.uk", "ac.uk", "gov.uk", "com.au", "net.au", "org.au", "co.nz", "co.jp", "ne.jp", "or.jp", "com.br", "com.mx", "co.in", "co.za", "com.cn", "com.tr", "github.io", "*.ck", "!www.ck")


def registrable_domain(host: Column, suffixes: Iterable[str] = SUFFIXES) -> Column:
    """The public suffix of a host and one label more; null for an address and for a suffix itself.

    Suffixes are written as in the public list: ``*.`` stands for any label, ``!`` excepts a name from such a
    rule; a name that none covers has its last label as suffix."""
    plain = {s for s in suffixes if s[0] not in "*!"}
    wild = {s[2:] for s in suffixes if s.startswith("*.")}
    excepted = {s[1:] for s in suffixes if s.startswith("!")}
    names = parents(F.lower(host))
    above = lambda n: F.regexp_replace(n, r"^[^.]*\.?", "")
    one_of = lambda n, of: n.isin(*of) if of else F.lit(False)
    suffix = lambda n: (one_of(n, plain) | one_of(above(n), wild) | ~F.contains(n, F.lit("."))) & ~one_of(n, excepted)
    longest = F.get(F.filter(names, suffix), F.lit(0))
    found = F.get(F.filter(names, lambda n: (above(n) == longest) & ~suffix(n)), F.lit(0))
    exception = F.get(F.filter(names, lambda n: one_of(n, excepted)), F.lit(0))
    return F.when(~host.rlike(r"^[\d.]+$|:|^$"), F.coalesce(exception, found))
