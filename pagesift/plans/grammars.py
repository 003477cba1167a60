"""Queries over header grammars: valid and broken values, with what the defining documents say of them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagesift.functions import headers as H
from pagesift.plans.cases import Cases

_C = Cases()
QUERIES, SQL = _C.queries, _C.sql


def _shown(df, p: Column, **fields: Column):
    """id, the fields of the parsed header p and its errors as text."""
    df = df.withColumn("p", p)
    return df.select("id", *[c.alias(n) for n, c in fields.items()], F.array_join("p.errors", "; ").alias("errors"))


def joined(c: Column) -> Column:
    return F.array_join(c, " ")


_C.add(
    "header_cache_control",
    "max_age BIGINT, s_maxage BIGINT, public BOOLEAN, no_cache BOOLEAN, fields VARCHAR, errors VARCHAR",
    [
        ("Max-Age=60, public", (60, None, True, False, None, "")),
        ('no-cache="Set-Cookie, X-A", s-maxage=5', (None, 5, False, True, "set-cookie x-a", "")),
        (' , max-age="10",, private', (10, None, False, False, None, "")),
        ("max-age=1, max-age=2", (None, None, None, None, None, "again: max-age")),
        ("max-age=soon", (None, None, None, None, None, "no seconds: max-age")),
        ("public=1", (None, None, None, None, None, "no argument taken: public")),
        ("only-if-cached", (None, None, None, None, None, "for requests: only-if-cached")),
        ("max-age = 5", (None, None, None, None, None, "malformed: max-age = 5")),
        ("cacheable", (None, None, None, None, None, "unknown: cacheable")),
        (None, (None, None, None, None, None, None)),
    ],
    lambda df: _shown(df, H.cache_control(F.col("h")), max_age=F.col("p.value")["max_age"], s_maxage=F.col("p.value")["s_maxage"], public=F.col("p.value")["public"], no_cache=F.col("p.value")["no_cache"], fields=joined(F.col("p.value")["no_cache_fields"])),
)
_C.add(
    "header_hsts",
    "max_age BIGINT, subdomains BOOLEAN, preload BOOLEAN, errors VARCHAR",
    [
        ("max-age=31536000; includeSubDomains; preload", (31536000, True, True, "")),
        ('max-age="5" ; ', (5, False, False, "")),
        ("max-age = 7", (7, False, False, "")),
        ("includeSubDomains", (None, None, None, "no seconds: max-age")),
        ("max-age=x; preload", (None, None, None, "no seconds: max-age")),
        ("max-age=1; preload; preload", (None, None, None, "again: preload")),
        ("max-age=1; a b", (None, None, None, "malformed: a b")),
    ],
    lambda df: _shown(df, H.hsts(F.col("h")), max_age=F.col("p.value")["max_age"], subdomains=F.col("p.value")["subdomains"], preload=F.col("p.value")["preload"]),
)
_C.add(
    "header_vary",
    "names VARCHAR, errors VARCHAR",
    [("Accept-Encoding , accept", ("accept-encoding accept", "")), ("*", ("*", "")), ("a b, c", (None, "no field name: a b")), (" , ", ("", ""))],
    lambda df: _shown(df, H.vary(F.col("h")), names=joined(F.col("p.value"))),
)
_C.add(
    "header_content_type",
    "media VARCHAR, charset VARCHAR, boundary VARCHAR, errors VARCHAR",
    [
        ('Text/HTML; Charset="UTF-8"', ("text/html", "utf-8", None, "")),
        ('multipart/mixed;boundary="a;b"', ("multipart/mixed", None, "a;b", "")),
        ("html", (None, None, None, "no media type")),
        ("text/html; utf-8", (None, None, None, "malformed: utf-8")),
    ],
    lambda df: _shown(df, H.content_type(F.col("h")), media=F.col("p.value")["media"], charset=F.col("p.value")["charset"], boundary=F.try_element_at(F.col("p.value")["parameters"], F.lit("boundary"))),
)
_C.add(
    "header_retry_after",
    "seconds BIGINT, date BIGINT, errors VARCHAR",
    [
        ("120", (120, None, "")),
        ("Tue, 02 Jan 2024 00:01:00 GMT", (60, 1704153660, "")),
        ("Mon, 02 Jan 2024 00:01:00 GMT", (None, None, "neither seconds nor a date")),
        ("Fri, 30 Feb 2024 00:00:00 GMT", (None, None, "neither seconds nor a date")),
        ("-5", (None, None, "neither seconds nor a date")),
        ("soon", (None, None, "neither seconds nor a date")),
    ],
    lambda df: _shown(df, H.retry_after(F.col("h"), F.lit("2024-01-02 00:00:00").cast("timestamp")), seconds=F.col("p.value")["seconds"], date=F.col("p.value")["date"]),
)
_C.add(
    "header_referrer_policy",
    "policy VARCHAR, errors VARCHAR",
    [("no-referrer, Strict-Origin", ("strict-origin", "")), ("origin", ("origin", "")), ("never, origin", (None, "unknown: never")), ("", (None, ""))],
    lambda df: _shown(df, H.referrer_policy(F.col("h")), policy=F.col("p.value")),
)
_C.add(
    "header_alt_svc",
    "protocols VARCHAR, authorities VARCHAR, longest BIGINT, errors VARCHAR",
    [
        ('h3=":443"; ma=86400, h2="alt.example:8443"', ("h3 h2", ":443 alt.example:8443", 86400, "")),
        ("clear", ("", "", None, "")),
        ('h3="[2001:db8::1]:443"; ma=60; persist=1', ("h3", "[2001:db8::1]:443", 60, "")),
        ("h3=:443", (None, None, None, "no protocol and authority")),
        ('h3="host"', (None, None, None, "no authority")),
        ('h3=":443"; ma=long', (None, None, None, "no seconds: ma")),
    ],
    lambda df: _shown(df, H.alt_svc(F.col("h")), protocols=joined(F.col("p.value")["protocol"]), authorities=joined(F.col("p.value")["authority"]), longest=F.array_max(F.col("p.value")["ma"])),
)
_C.add(
    "header_link",
    "hrefs VARCHAR, rels VARCHAR, shown VARCHAR, errors VARCHAR",
    [
        ("</a>; rel=next, </b,c>; rel=\"Preload\"; as=script", ("/a /b,c", "next|preload", "script", "")),
        ('<https://e.example/;x>; REL=icon; title="a, b; c"', ("https://e.example/;x", "icon", None, "")),
        ("</a>; rel=next; rel=prev", (None, None, None, "again in: /a")),
        ("</a>; as=style", (None, None, None, "no rel: /a")),
        ("/a; rel=next", (None, None, None, "malformed")),
        ("</a>; rel=next junk", (None, None, None, "malformed")),
        ("</a>; rel=preload; as", ("/a", "preload", "", "")),
    ],
    lambda df: _shown(df, H.link(F.col("h")), hrefs=joined(F.col("p.value")["href"]), rels=F.array_join(F.col("p.value")["rel"], "|"), shown=F.try_element_at(F.filter(F.transform(F.col("p.value"), lambda x: F.try_element_at(x["parameters"], F.lit("as"))), lambda x: x.isNotNull()), F.lit(1))),
)
_C.add(
    "header_csp",
    "policies BIGINT, names VARCHAR, errors VARCHAR",
    [
        ("default-src 'self'; img-src *, script-src https://a.example:443/x", (2, "default-src img-src|script-src", "")),
        ("img-src a.example; IMG-SRC b.example", (None, None, "again: img-src")),
        ("image-src a.example", (None, None, "unknown: image-src")),
        ("script-src self", (None, None, "not quoted: script-src self")),
        ("style-src 'none' b.example", (None, None, "none beside others: style-src")),
        ("font-src 'slef'", (None, None, "malformed: font-src 'slef'")),
        ("upgrade-insecure-requests 1", (None, None, "no argument taken: upgrade-insecure-requests")),
        ("frame-ancestors 'none'; report-to x", (1, "frame-ancestors report-to", "")),
    ],
    lambda df: _shown(df, H.content_policies(F.col("h")), policies=F.when(F.col("p.value").isNotNull(), F.size(F.col("p.value"))).cast("bigint"), names=F.array_join(F.transform(F.col("p.value"), lambda m: F.array_join(F.array_sort(F.map_keys(m)), " ")), "|")),
)


def _combined(df):
    policies = F.array_compact(F.array(H.content_policy(F.col("one")), H.content_policy(F.col("two")), H.content_policy(F.col("meta"), meta=True)))
    df = df.select("id", policies.alias("p")).select("id", "p", H.combined(F.col("p")).alias("c"))
    of = lambda d: F.array_join(F.try_element_at("c", F.lit(d)), " ")
    return df.select("id", of("script-src").alias("script"), of("style-src").alias("style"), of("frame-ancestors").alias("ancestors"), F.array_join(H.effective_sources(F.col("p"), "worker-src"), " ").alias("worker"))


_C.add(
    "header_csp_combine",
    "script VARCHAR, style VARCHAR, ancestors VARCHAR, worker VARCHAR",
    [
        # Two policies hold together: what both allow remains, in whatever case; style-src is governed by default-src in the second.
        (("script-src https://A.example https://b.example", "script-src https://a.example; default-src x", None), ("https://A.example", None, None, "https://A.example")),
        (("style-src a b", "default-src B c", None), (None, "b", None, "B c")),
        # A nonce drops unsafe-inline; with strict-dynamic also hosts and self, but not the nonce.
        (("script-src 'NONCE-x' 'unsafe-inline' 'self' h", None, None), ("'NONCE-x' 'self' h", None, None, "'NONCE-x' 'self' h")),
        (("script-src 'nonce-x' 'Strict-Dynamic' 'self' https: h", None, None), ("'nonce-x' 'Strict-Dynamic'", None, None, "'Strict-Dynamic' 'nonce-x'")),
        # A meta element can't set frame-ancestors; worker-src falls back through child-src.
        ((None, None, "frame-ancestors a; child-src w"), (None, None, None, "w")),
        (("frame-ancestors a; script-src s", None, "child-src w"), ("s", None, "a", "")),
        ((None, None, None), (None, None, None, None)),
    ],
    _combined,
    names=("one", "two", "meta"),
)


def _field(name: str, parse, cases) -> None:
    _C.add(name, "value VARCHAR, errors VARCHAR", cases, lambda df: _shown(df, parse(F.col("h")), value=F.col("p.value")))


_field("header_permissions_policy", H.permissions_policy, [
    ('camera=(), geolocation=(self "https://a.example")', ('{"camera": [], "geolocation": ["self", "https://a.example"]}', "")),
    ("fullscreen=*", ('{"fullscreen": "*"}', "")),
    ("camera=none", (None, "no origin: camera")),
    ("camera 'none'", (None, "malformed: no comma at 7")),
])
_field("header_reporting_endpoints", H.reporting_endpoints, [
    ('main="https://r.example/a", csp="/b"', ('{"main": "https://r.example/a", "csp": "/b"}', "")),
    ("main", (None, "no address: main")),
    ('main="a" csp="b"', (None, "malformed: no comma at 9")),
])
_field("header_priority", H.priority, [
    ("u=1, i", ('{"u": 1, "i": true}', "")), ("u=9", (None, "no urgency: u")), ("i=?0", ('{"i": false}', "")), ("u=2.0", (None, "no urgency: u")), ("i=1", (None, "no truth value: i")), ("", ("{}", "")),
])
_field("header_accept_ch", H.accept_ch, [
    ("Sec-CH-UA, DPR", ('["Sec-CH-UA", "DPR"]', "")), ("DPR,", (None, "malformed: a comma at the end")), ('"a"; q=1', ('["a"]', "")),
])
_field("header_cache_status", H.cache_status, [
    ("ExampleCache; hit; ttl=376", ('["ExampleCache"]', "")), ('"CDN"; fwd=miss, Origin; hit', ('["CDN", "Origin"]', "")), ("Cache; =1", (None, "malformed: no key at 7")),
])
_field("header_use_as_dictionary", H.use_as_dictionary, [
    ('match="/js/*", ttl=600, ok=?1, raw=:aGk=:', ('{"match": "/js/*", "ttl": 600, "ok": true, "raw": "aGk="}', "")), ("at=@1659578233, r=-1.5", ('{"at": 1659578233, "r": -1.5}', "")), ('d=%"f%c3%bc"', ('{"d": "fü"}', "")), ("Match=1", (None, "malformed: no key at 0")),
])
_field("header_opener_policy", H.opener_policy, [("same-origin; report-to=\"x\"", ('"same-origin"', "")), ("same_origin", (None, "unknown: same_origin")), ("same-origin, unsafe-none", (None, "malformed: more at 11"))])
_field("header_embedder_policy", H.embedder_policy, [("require-corp", ('"require-corp"', "")), ("credentialless ", ('"credentialless"', "")), ("\"require-corp", (None, "malformed: no value at 0"))])

_C.add(
    "cookie_flags",
    "name VARCHAR, secure BOOLEAN, http_only BOOLEAN, same_site VARCHAR, path VARCHAR, domain VARCHAR, max_age BIGINT",
    [
        ("sid=a=b; Secure; HttpOnly; SameSite=Lax; Path=/; Domain=.Example.com; Max-Age=60", ("sid", True, True, "lax", "/", "example.com", 60)),
        ("k=v; expires=Tue, 02 Jan 2024 01:00:00 GMT", ("k", False, False, None, None, None, 3600)),
        ("k=v; Expires=Tue, 02 Jan 2024 01:00:00 GMT; max-age=-1", ("k", False, False, None, None, None, -1)),
        ("k=v; max-age=soon; path=/a", ("k", False, False, None, "/a", None, None)),
    ],
    lambda df: df.select("id", H.cookie(F.col("h"), F.lit("2024-01-02 00:00:00").cast("timestamp")).alias("p")).select("id", "p.*"),
)


def _header_map(*names: str) -> Column:
    """A map of the named columns that are not null; an underscore stands for a hyphen."""
    entries = F.filter(F.array(*[F.struct(F.lit(n.replace("_", "-")).alias("k"), F.col(n).alias("v")) for n in names]), lambda e: e["v"].isNotNull())
    return F.map_from_entries(entries)


_C.add(
    "header_redaction",
    "names VARCHAR, cookie VARCHAR, auth VARCHAR, kept VARCHAR",
    [(("Bearer x", "sid=secret; Path=/", "ok"), ("authorization server set-cookie", "sid=***; Path=/", "***", "ok")), ((None, None, None), ("", None, None, None)), ((None, "a=b", "n"), ("server set-cookie", "a=***", None, "n"))],
    lambda df: df.withColumn("m", H.redacted(F.map_concat(_header_map("authorization", "set_cookie", "server"), F.create_map(F.lit(":status"), F.lit("200"))))).select(
        "id", joined(F.array_sort(F.map_keys("m"))).alias("names"), *[F.try_element_at("m", F.lit(k)).alias(n) for k, n in (("set-cookie", "cookie"), ("authorization", "auth"), ("server", "kept"))]
    ),
    names=("authorization", "set_cookie", "server"),
)
_C.add(
    "date_skew",
    "skew BIGINT",
    [
        (("Tue, 02 Jan 2024 00:10:00 GMT", None, None), (600,)),  # ten minutes and half a second, less half a second
        (("Tue, 02 Jan 2024 00:00:00 GMT", None, None), (0,)),
        (("Mon, 01 Jan 2024 23:59:50 GMT", None, None), (-10,)),
        (("Tue, 02 Jan 2024 00:10:00 GMT", "30", None), (None,)),
        (("Tue, 02 Jan 2024 00:10:00 GMT", None, "HIT from edge"), (None,)),
        (("today", None, None), (None,)),
    ],
    lambda df: df.select("id", H.date_skew(_header_map("date", "age", "x_cache"), F.lit("2024-01-02 00:00:00").cast("timestamp"), F.lit("2024-01-02 00:00:01").cast("timestamp")).alias("skew")),
    names=("date", "age", "x_cache"),
)
_C.add(
    "robots_directives",
    "noindex BOOLEAN, nofollow BOOLEAN, noai BOOLEAN",
    [(("NoIndex, follow", None), (True, False, False)), ((None, "none"), (True, True, False)), (("index", "bot: nofollow, noimageai"), (False, True, True)), ((None, None), (False, False, False)), (("noindexed", "noaiming"), (False, False, False))],
    lambda df: df.select("id", H.robots_directives(F.col("meta"), F.col("tag")).alias("r")).select("id", "r.*"),
    names=("meta", "tag"),
)
_C.add(
    "document_type",
    "document BOOLEAN",
    [("text/html; charset=utf-8", (True,)), ("Application/PDF", (True,)), ("image/png", (False,)), (None, (False,)), ("text/x-own ", (True,))],
    lambda df: df.select("id", H.document(F.col("h"), ("Text/X-Own",)).alias("document")),
)
