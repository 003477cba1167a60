"""Queries over certificates: DER bytes are made of customers, nations and regions, and read again."""

from __future__ import annotations

import hashlib
from datetime import UTC, datetime, timedelta

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from pagesift.functions import certificates as C
from pagesift.operators import chains as T
from pagesift.plans.pages import read
from pagesift.sources.scratch import dealt_out

QUERIES: dict = {}
SQL: dict[str, str] = {}


def _der(tag: int, *parts: bytes) -> bytes:
    inner = b"".join(parts)
    size = len(inner)
    head = bytes([size]) if size < 128 else bytes([0x80 | (k := (size.bit_length() + 7) // 8)]) + size.to_bytes(k)
    return bytes([tag]) + head + inner


def _oid(name: str) -> bytes:
    a, b, *rest = map(int, name.split("."))
    out = b""
    for n in [40 * a + b, *rest]:
        digits = [n & 0x7F]
        while n := n >> 7:
            digits.append(n & 0x7F | 0x80)
        out += bytes(reversed(digits))
    return _der(6, out)


def _integer(n: int) -> bytes:
    return _der(2, n.to_bytes(n.bit_length() // 8 + 1))


def _name(common: str, organization: str | None) -> bytes:
    pairs = [(C.ORGANIZATION, organization)] * (organization is not None) + [(C.COMMON_NAME, common)]
    return _der(0x30, *[_der(0x31, _der(0x30, _oid(k), _der(12, v.encode()))) for k, v in pairs])


def _time(t: datetime) -> bytes:
    return _der(23, t.strftime("%y%m%d%H%M%SZ").encode()) if 1950 <= t.year < 2050 else _der(24, t.strftime("%Y%m%d%H%M%SZ").encode())


def made(subject: tuple[str, str | None], issuer: tuple[str, str | None], begins: datetime, ends: datetime, key: str, signature: str, names: list[str] = [], ca: bool = False, linked: bool = True) -> bytes:  # noqa: B006
    """A certificate with an empty signature. ``key`` is RSA and bits, EC and a curve, or Ed25519; ``linked`` adds key identifiers."""
    kind, _, size = key.partition(" ")
    if kind == "RSA":
        info = _der(0x30, _der(0x30, _oid(C.RSA), _der(5)), _der(3, b"\0", _der(0x30, _integer(2 ** (int(size) - 1) + 1), _integer(65537))))
    elif kind == "EC":
        info = _der(0x30, _der(0x30, _oid(C.EC), _oid(next(o for o, n in C.CURVES.items() if n == size))), _der(3, b"\0\4" + bytes(64)))
    else:
        info = _der(0x30, _der(0x30, _oid(C.ED25519)), _der(3, bytes(33)))
    signed = _der(0x30, _oid(next(o for o, n in C.SIGNATURES.items() if n == signature)))
    of = lambda name: hashlib.sha1(repr(name).encode()).digest()
    more = [(C.ALTERNATIVE_NAMES, _der(0x30, *[_der(0x82, n.encode()) for n in names]))] * bool(names) + [(C.BASIC_CONSTRAINTS, _der(0x30, _der(1, b"\xff")))] * ca
    more += [(C.SUBJECT_KEY, _der(4, of(subject))), (C.AUTHORITY_KEY, _der(0x30, _der(0x80, of(issuer))))] * linked
    extensions = _der(0xA3, _der(0x30, *[_der(0x30, _oid(k), _der(4, v)) for k, v in more]))
    tbs = _der(0x30, _der(0xA0, _integer(2)), _integer(1), signed, _name(*issuer), _der(0x30, _time(begins), _time(ends)), _name(*subject), info, *[extensions] * bool(more))
    return _der(0x30, tbs, signed, _der(3, b"\0"))


_NOW = datetime(2024, 1, 1, tzinfo=UTC)


def _leaf(key: int, name: str, nation: str, place: int) -> bytes:
    host = name.lower().replace("#", "-") + ".example"
    kinds = [f"RSA {2048 + 8 * (key % 5)}", "EC P-256", "EC P-384", "Ed25519"]
    return made((name, None), (nation, f"{nation} CA"), _NOW, _NOW + timedelta(days=key % 9000 - 100, hours=12), kinds[key % 4], ["sha256WithRSAEncryption", "ecdsa-with-SHA256"][key % 2], [host, f"*.{host}"], linked=key % 3 > 0)


@F.arrow_udf(BinaryType())
def _leaves(keys: pa.Array, names: pa.Array, nations: pa.Array, places: pa.Array) -> pa.Array:
    return pa.array([_leaf(*r) for r in zip(*(c.to_pylist() for c in (keys, names, nations, places)))], pa.binary())


@F.arrow_udf(BinaryType())
def _authorities(names: pa.Array, signers: pa.Array) -> pa.Array:
    end = _NOW + timedelta(days=4000)
    return pa.array([made((n, f"{n} CA"), (s, f"{s} CA"), _NOW, end, "RSA 4096", "sha512WithRSAEncryption" if n == s else "sha384WithRSAEncryption", ca=True) for n, s in zip(names.to_pylist(), signers.to_pylist())], pa.binary())


def _customers(spark, sf_dir) -> DataFrame:
    """(c_custkey, der): a leaf for each customer, issued by its nation."""
    nations = read(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    own = dealt_out(read(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey"), "c_custkey").join(F.broadcast(nations), F.col("c_nationkey") == F.col("n_nationkey"))
    return own.select("c_custkey", _leaves(F.col("c_custkey"), F.col("c_name"), F.col("n_name"), F.col("n_nationkey")).alias("der"))


def _issued(spark, sf_dir) -> DataFrame:
    """(der) of nations and regions. Of each five nations one has no certificate, two name each other, and two are issued by their region, which issues itself."""
    nations, regions = read(spark, sf_dir, "nation"), read(spark, sf_dir, "region")
    other = nations.select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("other"))
    n = F.col("n_nationkey")
    partner = F.when(n % 5 == 1, n + 1).when(n % 5 == 2, n - 1)
    signed = nations.where("n_nationkey % 5 > 0").join(regions, F.col("n_regionkey") == F.col("r_regionkey")).join(other, partner == F.col("k"), "left")
    of_nations = signed.select(F.col("n_name").alias("name"), F.coalesce("other", "r_name").alias("signer"))
    every = of_nations.unionByName(regions.select(F.col("r_name").alias("name"), F.col("r_name").alias("signer")))
    return every.select(_authorities(F.col("name"), F.col("signer")).alias("der"))


def certificate_facts(spark, sf_dir):
    """What a certificate says, from its bytes."""
    from pagesift.operators.site import days_left

    told = _customers(spark, sf_dir).withColumn("c", C.facts(F.col("der")))
    days = days_left(F.col("c.not_after"), F.lit("2024-01-01 00:00:00").cast("timestamp"))
    return told.select(
        F.col("c_custkey").alias("id"), F.col("c.subject").alias("subject"), F.col("c.issuer").alias("issuer"), F.array_join("c.san", " ").alias("san"), F.col("c.key.type").alias("kind"), F.col("c.key.bits").alias("bits"),
        F.col("c.key.curve").alias("curve"), F.col("c.signature").alias("signature"), F.col("c.ca").alias("ca"), days.alias("days"),
    )


_LEAF_SIGNED = "CASE c_custkey % 2 WHEN 0 THEN 'sha256WithRSAEncryption' ELSE 'ecdsa-with-SHA256' END"
SQL["certificate_facts"] = f"""
SELECT c_custkey AS id, c_name AS subject, n_name || ' CA' AS issuer, replace(lower(c_name), '#', '-') || '.example *.' || replace(lower(c_name), '#', '-') || '.example' AS san,
       ['RSA', 'EC', 'EC', 'Ed25519'][c_custkey % 4 + 1] AS kind, CASE WHEN c_custkey % 4 = 0 THEN 2048 + 8 * (c_custkey % 5) END::INTEGER AS bits,
       CASE c_custkey % 4 WHEN 1 THEN 'P-256' WHEN 2 THEN 'P-384' END AS curve, {_LEAF_SIGNED} AS signature, false AS ca, (c_custkey % 9000 - 100)::INTEGER AS days
FROM customer JOIN nation ON n_nationkey = c_nationkey"""


def certificate_chains(spark, sf_dir):
    """How far each customer's certificate is followed, and the algorithms that sign it and those above."""
    leaves = _customers(spark, sf_dir)
    certs = T.parsed(leaves.select("der").unionByName(_issued(spark, sf_dir)))
    told = leaves.select("c_custkey", F.sha2("der", 256).alias("fingerprint")).join(T.chains(certs), "fingerprint")
    return told.select(F.col("c_custkey").alias("id"), F.size("path").alias("n"), F.array_join("signatures", " ").alias("signatures"), "ends")


SQL["certificate_chains"] = f"""
SELECT c_custkey AS id, CASE WHEN n_nationkey % 5 = 0 THEN 1 ELSE 3 END::INTEGER AS n,
       {_LEAF_SIGNED} || CASE n_nationkey % 5 WHEN 0 THEN '' WHEN 1 THEN ' sha384WithRSAEncryption sha384WithRSAEncryption' WHEN 2 THEN ' sha384WithRSAEncryption sha384WithRSAEncryption' ELSE ' sha384WithRSAEncryption' END AS signatures,
       CASE n_nationkey % 5 WHEN 0 THEN 'unknown' WHEN 1 THEN 'loop' WHEN 2 THEN 'loop' ELSE 'root' END AS ends
FROM customer JOIN nation ON n_nationkey = c_nationkey"""

QUERIES.update(certificate_facts=certificate_facts, certificate_chains=certificate_chains)
