"""Certificates: against the standard library's reader, chains of every shape, and bytes that are none."""

import re
import ssl
from datetime import UTC, datetime, timedelta
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from pagesift.functions import certificates as C
from pagesift.operators import chains as T
from pagesift.plans.certificates import made

NOW = datetime(2024, 1, 1, tzinfo=UTC)


def cert(subject, issuer, signature="sha256WithRSAEncryption", days=100, **more):
    return made((subject, None), (issuer, None), NOW, NOW + timedelta(days=days), "EC P-256", signature, **more)


def bundle():
    certifi = pytest.importorskip("pip._vendor.certifi")
    return [ssl.PEM_cert_to_DER_cert(x) for x in re.findall(r"-----BEGIN CERTIFICATE-----.*?-----END CERTIFICATE-----", Path(certifi.where()).read_text(), re.DOTALL)]


def test_real_roots_as_the_standard_library_reads_them(tmp_path):
    ders = bundle()
    assert len(ders) > 50
    for i, der in enumerate(ders):
        got = C.read(der)
        (tmp_path / str(i)).write_text(ssl.DER_cert_to_PEM_cert(der))
        want = ssl._ssl._test_decode_cert(str(tmp_path / str(i)))
        first = lambda name, key: next((v for rdn in want[name] for k, v in rdn if k == key), None)
        assert got["subject"] == first("subject", "commonName")
        assert got["issuer"] == (first("issuer", "organizationName") or first("issuer", "commonName"))
        assert got["not_after"].timestamp() == ssl.cert_time_to_seconds(want["notAfter"]) and got["not_before"].timestamp() == ssl.cert_time_to_seconds(want["notBefore"])
        assert got["key"]["type"] in ("RSA", "EC") and (got["key"]["bits"] in (2048, 4096) or got["key"]["curve"] in ("P-256", "P-384", "P-521"))
        assert got["ca"] and got["subject_name"] == got["issuer_name"] and not got["signature"][0].isdigit()


def test_made_leaf_is_read_by_the_standard_library(tmp_path):
    der = made(("a.example", "A & Söhne"), ("CA", "Authority"), NOW, NOW + timedelta(days=20_000), "RSA 2048", "sha512WithRSAEncryption", ["a.example", "*.a.example"])
    (tmp_path / "pem").write_text(ssl.DER_cert_to_PEM_cert(der))
    want, got = ssl._ssl._test_decode_cert(str(tmp_path / "pem")), C.read(der)
    assert [n for _, n in want["subjectAltName"]] == got["san"] == ["a.example", "*.a.example"]
    assert got["not_after"].timestamp() == ssl.cert_time_to_seconds(want["notAfter"]) and got["not_after"].year == 2078
    assert (got["subject"], got["issuer"], got["key"]["bits"], got["signature"], got["ca"]) == ("a.example", "Authority", 2048, "sha512WithRSAEncryption", False)


def test_bytes_that_are_no_certificate(spark):
    good = cert("a", "b")
    rows = [None, b"", b"\x30", b"0\x82\xff\xff", b"hello", good[:-3], good[:40], b"\x30\x80\x00\x00", bytes(1000), good + b"trailing"]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(rows)], "i int, der binary").select("i", C.facts(F.col("der")).alias("c"))
    got = {r.i: r.c for r in df.collect()}
    assert got[0] is None and got[9].error is None and got[9].subject == "a"
    assert all(got[i].error and got[i].subject is None and got[i].san is None for i in range(1, 9))


#: Name: (issuer, how the chain of a leaf below it is to end, and over which names it goes).
def test_chains_of_every_shape(spark):
    long = [cert(f"n{i}", f"n{i + 1}", f"ecdsa-with-SHA{[256, 384, 512][i % 3]}") for i in range(15)]
    ders = [
        cert("root", "root", "md5WithRSAEncryption"), cert("mid", "root", "sha384WithRSAEncryption"), cert("leaf", "mid"), cert("lost", "nobody"), cert("x", "y"), cert("y", "x", "sha384WithRSAEncryption"), cert("under loop", "x", "ED25519"), *long,
        cert("own", "own", linked=False), cert("keyless", "mid", linked=False),
    ]
    certs = T.parsed(spark.createDataFrame([(d,) for d in ders] * 2 + [(None,), (b"none",)], "der binary").repartition(3)).cache()
    names = {r.fingerprint: r.name for r in certs.select("fingerprint", F.col("cert.subject").alias("name")).collect()}
    assert len(names) == len(ders)
    got = {names[r.fingerprint]: ([names[p] for p in r.path], r.signatures, r.ends) for r in T.chains(certs).collect()}
    assert got["leaf"] == (["leaf", "mid", "root"], ["sha256WithRSAEncryption", "sha384WithRSAEncryption"], "root")
    assert got["root"] == (["root"], ["md5WithRSAEncryption"], "root") and got["own"][2] == "root"
    assert got["keyless"][0] == ["keyless", "mid", "root"] and got["lost"] == (["lost"], ["sha256WithRSAEncryption"], "unknown")
    assert got["x"] == (["x", "y"], ["sha256WithRSAEncryption", "sha384WithRSAEncryption"], "loop") and got["y"][0] == ["y", "x"]
    assert got["under loop"] == (["under loop", "x", "y"], ["ED25519", "sha256WithRSAEncryption", "sha384WithRSAEncryption"], "loop")
    assert got["n0"][2] == "long" and got["n0"][0] == [f"n{i}" for i in range(10)] and len(got["n0"][1]) == 10
    assert got["n5"][2] == "unknown" and got["n5"][0] == [f"n{i}" for i in range(5, 15)]


def test_the_issuer_that_ends_last_and_has_the_key(spark):
    key, old, new, other = (("CA", x) for x in ("k", "k", "k", "z"))
    of = lambda subject, issuer, days: made(subject, issuer, NOW, NOW + timedelta(days=days), "Ed25519", "ED25519")
    ders = {"old": of(old, ("R", None), 10), "new": of(new, ("R", None), 500), "other": of(other, ("R", None), 900), "leaf": of(("leaf", None), key, 5)}
    certs = T.parsed(spark.createDataFrame([(d,) for d in ders.values()], "der binary"))
    prints = {r.f: r.n for r in spark.createDataFrame(list(ders.items()), "n string, der binary").select("n", F.sha2("der", 256).alias("f")).collect()}
    got = {prints[r.fingerprint]: prints.get(r.issuer) for r in T.issuers(certs).collect()}
    assert got == {"leaf": "new", "old": None, "new": None, "other": None}


def test_facts_as_rules_read_them(spark):
    leaf, mid = cert("leaf", "mid", names=["leaf.example"]), cert("mid", "mid")
    certs = T.parsed(spark.createDataFrame([(leaf,), (mid,)], "der binary"))
    got = T.tls_facts(spark.createDataFrame([("u", leaf), ("v", None), ("w", b"no")], "url string, der binary"), certs, now=F.lit("2024-03-01 12:00:00").cast("timestamp"))
    rows = {r.url: r.cert for r in got.collect()}
    assert rows["v"] is None and rows["w"] is None
    assert rows["u"]["days-left"] == 39 and rows["u"].signatures == ["sha256WithRSAEncryption"] and rows["u"].san == ["leaf.example"] and rows["u"].key.curve == "P-256"
    assert T.chains(certs.limit(0)).count() == 0


@pytest.mark.parametrize(("oid", "want"), [("2.5.4.3", "550403"), ("1.2.840.113549.1.1.11", "2a864886f70d01010b"), ("2.999.1", "883701")])
def test_object_identifiers(oid, want):
    assert C._Value(bytes([6, len(want) // 2]) + bytes.fromhex(want)).oid() == oid
