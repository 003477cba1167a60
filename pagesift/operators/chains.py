"""Chains of certificates: from each one over its issuers, as joins over a table of certificates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagesift.functions import certificates as C
from pagesift.sources.scratch import cut

#: Certificates of a chain that are looked at.
MOST = 10


def parsed(df: DataFrame, der: str = "der") -> DataFrame:
    """(fingerprint, cert): each different certificate once; bytes that are none are left out."""
    read = df.where(F.col(der).isNotNull()).select(F.col(der).alias("der")).distinct()
    return read.select(F.sha2("der", 256).alias("fingerprint"), C.facts(F.col("der")).alias("cert")).where("cert.error IS NULL")


def _own(cert: str) -> Column:
    """Whether a certificate names itself as its issuer."""
    c = F.col(cert)
    return (c["subject_name"] == c["issuer_name"]) & F.coalesce(c["authority_key"] == c["subject_key"], F.lit(True))


def issuers(certs: DataFrame) -> DataFrame:
    """(fingerprint, signature, root, issuer): the certificate whose subject is the issuer's name and, where both tell it,
    whose key is the issuer's; of several the one that ends last, then the smallest fingerprint. Null if it isn't there."""
    own = certs.select("fingerprint", F.col("cert.signature").alias("signature"), _own("cert").alias("root"), F.col("cert.issuer_name").alias("name"), F.col("cert.authority_key").alias("key"))
    last = F.max(F.struct(F.col("cert.not_after").alias("ends"), F.translate("fingerprint", "0123456789abcdef", "fedcba9876543210").alias("least"), "fingerprint"))
    named = certs.select(F.col("cert.subject_name").alias("name"), F.col("cert.subject_key").alias("key"), "fingerprint", "cert")
    # One candidate for each name and key, and one for each name alone, so that many renewals meet nobody.
    by_key = named.groupBy("name", "key").agg(last.alias("best"))
    by_name = named.groupBy("name").agg(last.alias("any"), F.max(F.when(F.col("key").isNull(), F.struct(F.col("cert.not_after").alias("ends"), F.translate("fingerprint", "0123456789abcdef", "fedcba9876543210").alias("least"), "fingerprint"))).alias("keyless"))
    found = own.join(by_key.withColumnRenamed("best", "exact"), ["name", "key"], "left").join(by_name, "name", "left")
    issuer = F.when(F.col("root"), F.col("fingerprint")).when(F.col("key").isNull(), F.col("any.fingerprint")).otherwise(F.greatest("exact", "keyless")["fingerprint"])
    return found.select("fingerprint", "signature", "root", issuer.alias("issuer"))


def chains(certs: DataFrame, most: int = MOST) -> DataFrame:
    """(fingerprint, path, signatures, ends) for each certificate of ``parsed``: the fingerprints from it up, and the signature
    algorithms without a root's own, except where the root itself is asked. ``ends`` says why: root, unknown (the issuer is
    not there), loop, or long (``most`` certificates were read).

    Only certificates that issue others are walked, a join for each step, so that the many leaves join once, at the end."""
    c = F.col("cert")  # read three times; bytes are parsed once
    named = F.struct(*[c[n].alias(n) for n in ("signature", "subject_name", "issuer_name", "subject_key", "authority_key", "not_after")])
    links = cut(issuers(cut(certs.select("fingerprint", named.alias("cert")))))
    step = links.select(F.col("fingerprint").alias("at"), "signature", "root", "issuer")
    authorities = links.where("issuer IS NOT NULL AND issuer <> fingerprint").select(F.col("issuer").alias("top")).distinct()
    # A walk from each issuer: the path it has, and where it goes next (null: it has ended).
    walks = authorities.select("top", F.array().cast("array<string>").alias("path"), F.array().cast("array<string>").alias("signatures"), F.col("top").alias("next"), F.lit(None).cast("string").alias("ends"))
    for _ in range(most - 1):
        moved = walks.join(step, F.col("next") == F.col("at"), "left")
        on = F.col("at").isNotNull()
        path = F.when(on, F.concat("path", F.array("at"))).otherwise(F.col("path"))
        signatures = F.when(on & ~F.col("root"), F.concat("signatures", F.array("signature"))).otherwise(F.col("signatures"))
        ends = F.when(on & F.col("root"), "root").when(on & F.col("issuer").isNull(), "unknown").when(on & F.array_contains(path, F.col("issuer")), "loop").otherwise(F.col("ends"))
        walks = cut(moved.select("top", path.alias("path"), signatures.alias("signatures"), F.when(on & ends.isNull(), F.col("issuer")).alias("next"), ends.alias("ends")))
        if not walks.where("next IS NOT NULL").limit(1).count():
            break
    told = walks.select("top", F.col("path").alias("above"), F.col("signatures").alias("signed"), F.coalesce("ends", F.lit("long")).alias("why"))
    found = links.join(told, (F.col("issuer") == F.col("top")) & (F.col("issuer") != F.col("fingerprint")), "left")
    # A certificate inside a loop comes up again on its issuer's walk: it ends there.
    again = F.coalesce(F.array_position("above", F.col("fingerprint")), F.lit(0))
    upto = F.when(again > 0, again - 1).otherwise(F.coalesce(F.size("above"), F.lit(0))).cast("int")
    above = lambda c: F.coalesce(F.slice(c, F.lit(1), upto), F.array().cast("array<string>"))
    ends = F.when(F.col("root"), "root").when(F.col("issuer").isNull(), "unknown").when(again > 0, "loop").otherwise(F.col("why"))
    return found.select("fingerprint", F.concat(F.array("fingerprint"), above("above")).alias("path"), F.concat(F.array("signature"), above("signed")).alias("signatures"), ends.alias("ends"))


def tls_facts(leaves: DataFrame, certs: DataFrame, der: str = "der", now: Column | None = None) -> DataFrame:
    """``leaves`` with cert: subject, issuer, not-before, not-after, days-left, san, fingerprint256, key and signatures, as rules read them."""
    from pagesift.operators.site import days_left

    up = chains(certs).select("fingerprint", "signatures").join(certs, "fingerprint")
    c = F.col("cert")
    told = F.struct(
        c["subject"].alias("subject"), c["issuer"].alias("issuer"), c["not_before"].alias("not-before"), c["not_after"].alias("not-after"), days_left(c["not_after"], now if now is not None else F.current_timestamp()).alias("days-left"),
        c["san"].alias("san"), F.col("fingerprint").alias("fingerprint256"), c["key"].alias("key"), F.col("signatures"),
    )
    return leaves.withColumn("fingerprint", F.sha2(F.col(der), 256)).join(up.select("fingerprint", told.alias("cert")), "fingerprint", "left").drop("fingerprint")
