"""Facts of X.509 certificates, read from their DER bytes in Arrow batches.

Only what judging needs is read: names, validity, alternative names, key, signature algorithm, and the key
identifiers that say which issuer is meant. Bytes that are no certificate give an error and no facts.
"""

from __future__ import annotations

import ipaddress
from datetime import UTC, datetime
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

# Object identifiers of name attributes, extensions, curves and algorithms, with the names OpenSSL gives them.
COMMON_NAME, ORGANIZATION = "2.5.4.3", "2.5.4.10"
SUBJECT_KEY, ALTERNATIVE_NAMES, BASIC_CONSTRAINTS, AUTHORITY_KEY = "2.5.29.14", "2.5.29.17", "2.5.29.19", "2.5.29.35"
RSA, RSA_PSS, EC, ED25519, ED448 = "1.2.840.113549.1.1.1", "1.2.840.113549.1.1.10", "1.2.840.10045.2.1", "1.3.101.112", "1.3.101.113"
CURVES = {"1.2.840.10045.3.1.7": "P-256", "1.3.132.0.34": "P-384", "1.3.132.0.35": "P-521", "1.3.132.0.10": "secp256k1"}
SIGNATURES = {
    "1.2.840.113549.1.1.4": "md5WithRSAEncryption", "1.2.840.113549.1.1.5": "sha1WithRSAEncryption", RSA_PSS: "rsassaPss", "1.2.840.113549.1.1.11": "sha256WithRSAEncryption", "1.2.840.113549.1.1.12": "sha384WithRSAEncryption",
    "1.2.840.113549.1.1.13": "sha512WithRSAEncryption", "1.2.840.10045.4.1": "ecdsa-with-SHA1", "1.2.840.10045.4.3.2": "ecdsa-with-SHA256", "1.2.840.10045.4.3.3": "ecdsa-with-SHA384", "1.2.840.10045.4.3.4": "ecdsa-with-SHA512", ED25519: "ED25519", ED448: "ED448",
}
_TEXTS = {12: "utf-8", 18: "ascii", 19: "ascii", 20: "latin-1", 22: "ascii", 26: "ascii", 28: "utf-32-be", 30: "utf-16-be"}

DDL = (
    "struct<subject: string, issuer: string, not_before: timestamp, not_after: timestamp, san: array<string>, key: struct<type: string, bits: int, curve: string>, signature: string, ca: boolean,"
    " subject_name: string, issuer_name: string, subject_key: string, authority_key: string, error: string>"
)
_S, _T = pa.string(), pa.timestamp("us", tz="UTC")
_TYPE = pa.struct([
    ("subject", _S), ("issuer", _S), ("not_before", _T), ("not_after", _T), ("san", pa.list_(_S)), ("key", pa.struct([("type", _S), ("bits", pa.int32()), ("curve", _S)])), ("signature", _S), ("ca", pa.bool_()),
    ("subject_name", _S), ("issuer_name", _S), ("subject_key", _S), ("authority_key", _S), ("error", _S),
])


class _Value:
    """One DER value: its tag, the bytes inside, and the bytes with its head."""

    def __init__(self, data: bytes, at: int = 0):
        if at + 2 > len(data):
            raise ValueError("it ends too early")
        self.tag, size, start = data[at], data[at + 1], at + 2
        if size & 0x80:
            k = size & 0x7F
            if not 0 < k <= 4 or start + k > len(data):
                raise ValueError("a length isn't valid")
            size, start = int.from_bytes(data[start : start + k]), start + k
        self.end = start + size
        if self.end > len(data):
            raise ValueError("it ends too early")
        self.inner, self.whole = data[start : self.end], data[at : self.end]

    def parts(self) -> list[_Value]:
        found, at = [], 0
        while at < len(self.inner):
            found.append(_Value(self.inner, at))
            at = found[-1].end
        return found

    def expect(self, tag: int) -> _Value:
        if self.tag != tag:
            raise ValueError(f"a value has tag {self.tag}, not {tag}")
        return self

    def oid(self) -> str:
        return _oid(bytes(self.expect(6).inner))

    def text(self) -> str:
        return self.inner.decode(_TEXTS.get(self.tag, "utf-8"), "replace")

    def time(self) -> datetime:
        raw = self.inner.decode("ascii").rstrip("Z")
        if self.tag == 23:  # two digits of a year, from 1950 to 2049
            raw = ("19" if raw[:2] >= "50" else "20") + raw
        return datetime.strptime(raw[:14], "%Y%m%d%H%M%S").replace(tzinfo=UTC)


@lru_cache(1024)  # certificates name the same few
def _oid(inner: bytes) -> str:
    numbers, n = [], 0
    for byte in inner:
        n = n << 7 | byte & 0x7F
        if not byte & 0x80:
            numbers.append(n)
            n = 0
    if not numbers:
        raise ValueError("an object identifier is empty")
    first = min(numbers[0] // 40, 2)
    return ".".join(map(str, [first, numbers[0] - 40 * first, *numbers[1:]]))


def _attributes(name: _Value) -> dict[str, str]:
    """The first value of each attribute of a name."""
    out: dict[str, str] = {}
    for relative in name.expect(0x30).parts():
        for pair in relative.parts():
            kind, value = pair.parts()[:2]
            out.setdefault(kind.oid(), value.text())
    return out


def _key(info: _Value) -> dict:
    algorithm, bits = info.expect(0x30).parts()[:2]
    kind, *parameters = algorithm.parts()
    kind = kind.oid()
    if kind in (RSA, RSA_PSS):
        modulus = _Value(bits.inner, 1).expect(0x30).parts()[0]
        return {"type": "RSA", "bits": int.from_bytes(modulus.inner).bit_length(), "curve": None}
    if kind == EC:
        curve = parameters[0].oid() if parameters and parameters[0].tag == 6 else None
        return {"type": "EC", "bits": None, "curve": CURVES.get(curve, curve)}
    return {"type": {ED25519: "Ed25519", ED448: "Ed448"}.get(kind, kind), "bits": None, "curve": None}


def _general_names(value: _Value) -> list[str]:
    """DNS names, mail and web addresses, and IP addresses, in order."""
    out = []
    for n in value.expect(0x30).parts():
        if n.tag in (0x81, 0x82, 0x86):
            out.append(n.inner.decode("ascii", "replace"))
        elif n.tag == 0x87 and len(n.inner) in (4, 16):
            out.append(str(ipaddress.ip_address(n.inner)))
    return out


def read(der: bytes) -> dict:
    """The facts of one certificate; ValueError if it isn't one."""
    tbs, algorithm = _Value(der).expect(0x30).parts()[:2]
    fields = tbs.expect(0x30).parts()
    if fields and fields[0].tag == 0xA0:  # the version
        fields = fields[1:]
    if len(fields) < 6:
        raise ValueError("fields are missing")
    _, _, issuer, validity, subject, key, *rest = fields
    begins, ends = validity.expect(0x30).parts()[:2]
    extensions: dict[str, _Value] = {}
    for field in rest:
        if field.tag == 0xA3:
            for e in _Value(field.inner).parts():
                kind, *_, value = e.parts()
                extensions[kind.oid()] = _Value(value.expect(4).inner)
    by, of = _attributes(issuer), _attributes(subject)
    constraint = extensions[BASIC_CONSTRAINTS].parts() if BASIC_CONSTRAINTS in extensions else []
    authority = next((p.inner.hex() for p in extensions[AUTHORITY_KEY].parts() if p.tag == 0x80), None) if AUTHORITY_KEY in extensions else None
    signed = algorithm.expect(0x30).parts()[0].oid()
    return {
        "subject": of.get(COMMON_NAME), "issuer": by.get(ORGANIZATION, by.get(COMMON_NAME)), "not_before": begins.time(), "not_after": ends.time(), "san": _general_names(extensions[ALTERNATIVE_NAMES]) if ALTERNATIVE_NAMES in extensions else [],
        "key": _key(key), "signature": SIGNATURES.get(signed, signed), "ca": bool(constraint and constraint[0].tag == 1 and any(constraint[0].inner)), "subject_name": subject.whole.hex(), "issuer_name": issuer.whole.hex(),
        "subject_key": extensions[SUBJECT_KEY].expect(4).inner.hex() if SUBJECT_KEY in extensions else None, "authority_key": authority, "error": None,
    }


def facts(der: Column) -> Column:
    """The struct of a certificate's facts. Null bytes give null; bytes that are none give ``error`` alone. The fingerprint is sha2(der, 256)."""

    def told(x: bytes | None) -> dict | None:
        if x is None:
            return None
        try:
            return read(x)
        except (ValueError, IndexError) as e:
            return {"error": str(e) or "unreadable"}

    @F.arrow_udf(DDL)
    def run(cells: pa.Array) -> pa.Array:
        return pa.array([told(x) for x in cells.to_pylist()], _TYPE)

    return run(der)
