"""Mail records: SPF terms and the tree of included records, walked in rounds over a table of DNS answers; DMARC by host or organisation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagesift.functions import headers as H
from pagesift.functions import weburl as W
from pagesift.sources.scratch import cut

#: Lookups that a check may take, where the walk stops counting, and lookups that may find nothing.
ALLOWED, LIMIT, VOID = 10, 30, 2
#: Terms that ask for another name, and those whose answer may be empty.
ASKING, ANSWERED = ("include", "redirect", "a", "mx", "ptr", "exists"), ("a", "mx", "exists", "include", "redirect")
_TERM = r"(?i)^(?:[+?~-]?(?:all|include:\S+|exists:\S+|ptr(?::\S+)?|(?:a|mx)(?::[^/\s]+)?(?:/(?:3[0-2]|[12]?\d))?(?://(?:12[0-8]|1[01]\d|\d?\d))?|ip4:\d{1,3}(?:\.\d{1,3}){3}(?:/(?:3[0-2]|[12]?\d))?|ip6:[0-9a-f:.]+(?:/(?:12[0-8]|1[01]\d|\d?\d))?)|[a-z][a-z0-9._-]*=\S*)$"


def _words(records: DataFrame) -> DataFrame:
    """(name, position, word) of SPF records, names lower-case."""
    words = F.filter(F.split(F.trim("record"), r"\s+"), lambda w, i: (i > 0) & (w != ""))
    return records.where(F.lower("record").rlike(r"^v=spf1(\s|$)")).select(F.lower("name").alias("name"), F.posexplode(words).alias("position", "word"))


def spf_terms(records: DataFrame) -> DataFrame:
    """(name, position, qualifier, term, target): the terms of each record up to and with ``all``; a redirect counts where there is no ``all``."""
    plain = F.regexp_replace(F.lower("word"), r"^[+?~-]", "")
    term = F.regexp_extract(plain, r"^[a-z0-9]+", 0)
    target = F.regexp_extract(plain, r"^[a-z0-9]+[:=]([^/]+)", 1)
    found = _words(records).select("name", "position", F.regexp_extract("word", r"^[+?~-]", 0).alias("qualifier"), term.alias("term"), F.nullif(F.regexp_replace(target, r"\.$", ""), F.lit("")).alias("target"))
    ends = found.where("term = 'all'").groupBy("name").agg(F.min("position").alias("end"))
    kept = found.join(ends, "name", "left").where("end IS NULL OR position <= end OR term = 'redirect'")
    return kept.where("term <> 'redirect' OR end IS NULL").drop("end")


def spf_faults(records: DataFrame) -> DataFrame:
    """(name, errors, after_all, redundant, ptr): of each record its malformed terms and modifiers given twice, what stands after
    ``all``, whether a redirect stands beside ``all``, and whether ptr is used. Names with several records have the error "several records"."""
    words = _words(records)
    plain = F.regexp_replace(F.lower("word"), r"^[+?~-]", "")
    rows = words.withColumns({"plain": plain, "bad": ~F.col("word").rlike(_TERM)})
    ends = rows.where("plain = 'all'").groupBy("name").agg(F.min("position").alias("end"))
    rows = rows.join(ends, "name", "left")
    modifier = F.regexp_extract("plain", r"^(redirect|exp)=", 1)
    twice = rows.where(modifier != "").groupBy("name", modifier.alias("m")).agg(F.count("*").alias("c")).where("c > 1").groupBy("name").agg(F.array_sort(F.collect_list(F.concat(F.lit("again: "), "m"))).alias("again"))
    several = records.where(F.lower("record").rlike(r"^v=spf1(\s|$)")).groupBy(F.lower("name").alias("name")).agg(F.count("*").alias("records"))
    out = rows.groupBy("name").agg(
        F.array_sort(F.collect_list(F.when(F.col("bad"), F.concat(F.lit("malformed: "), "word")))).alias("bad"),
        F.count_if((F.col("position") > F.col("end")) & ~F.col("plain").rlike("^[a-z0-9._-]+=")).alias("after_all"),
        F.coalesce(F.max(F.col("end").isNotNull() & F.col("plain").startswith("redirect=")), F.lit(False)).alias("redundant"), F.max(F.col("plain").rlike("^ptr(:|$)")).alias("ptr"),
    )
    told = several.join(out, "name", "left").join(twice, "name", "left")
    many = F.when(F.col("records") > 1, F.array(F.lit("several records"))).otherwise(F.array().cast("array<string>"))
    nothing = F.array().cast("array<string>")
    errors = F.concat(F.coalesce("bad", nothing), F.coalesce("again", nothing), many)
    return told.select("name", errors.alias("errors"), F.coalesce("after_all", F.lit(0)).alias("after_all"), F.coalesce("redundant", F.lit(False)).alias("redundant"), F.coalesce("ptr", F.lit(False)).alias("ptr"))


def spf_walk(domains: DataFrame, records: DataFrame, empty: DataFrame | None = None, limit: int | None = LIMIT) -> DataFrame:
    """(domain, lookups, within): lookups of each domain's tree; with ``empty`` also voids and missing.

    Names are compared lower-case. A name has a record only if it has exactly one. Each record counts once per domain, so
    loops end; a domain's walk goes no deeper once it has ``limit`` lookups, and its count is told as far as it went;
    with ``limit`` None the whole tree is counted.
    ``empty`` is (name, term) of questions whose answer was empty; voids counts these, missing the included names without one record."""
    own = records.where(F.lower("record").rlike(r"^v=spf1(\s|$)")).withColumn("name", F.lower("name"))
    single = own.groupBy("name").agg(F.count("*").alias("c"), F.min("record").alias("record")).where("c = 1").select("name", "record")
    terms = cut(spf_terms(single).where(F.col("term").isin(*ASKING)))
    seen = cut(domains.select("domain", F.lower("domain").alias("name")).distinct())
    frontier, total, counted = seen, None, None
    while True:
        met = cut(frontier.join(terms, "name").select("domain", "name", "position", "term", "target"))
        total = met if total is None else cut(total.unionByName(met))
        counted = total.groupBy("domain").agg(F.count("*").alias("n"))
        new = met.where("term IN ('include', 'redirect') AND target IS NOT NULL").select("domain", F.col("target").alias("name")).distinct().join(seen, ["domain", "name"], "left_anti")
        frontier = cut(new if limit is None else new.join(counted.where(F.col("n") < limit).select("domain"), "domain", "left_semi"))
        if not frontier.limit(1).count():
            break
        seen = cut(seen.unionByName(frontier))
    lookups = F.coalesce("n", F.lit(0))
    every = domains.select("domain").distinct().join(counted, "domain", "left").select("domain", lookups.alias("lookups"), (lookups <= ALLOWED).alias("within"))
    if empty is None:
        return every
    asked = total.where(F.col("term").isin(*ANSWERED)).select("domain", F.coalesce("target", "name").alias("name"), "term")
    voids = asked.join(empty.select(F.lower("name").alias("name"), "term").distinct(), ["name", "term"], "left_semi").groupBy("domain").agg(F.count("*").alias("voids"))
    missing = asked.where("term = 'include'").join(single.select("name"), "name", "left_anti").groupBy("domain").agg(F.count_distinct("name").alias("missing"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return every.join(voids, "domain", "left").join(missing, "domain", "left").select("domain", "lookups", "within", zero("voids"), zero("missing"))


#: What the tags of a DMARC record may hold.
_DMARC = {"p": "none|quarantine|reject", "sp": "none|quarantine|reject", "np": "none|quarantine|reject", "adkim": "r|s", "aspf": "r|s", "pct": r"\d|[1-9]\d|100", "fo": "[01ds](:[01ds])*", "ri": r"\d{1,10}"}


def dmarc(hosts: DataFrame, records: DataFrame, host: str = "host", suffixes=W.SUFFIXES) -> DataFrame:
    """(host, at, policy, errors): the DMARC record of each host, else of its registrable domain, where ``sp`` goes before ``p``.

    ``records`` is (name, record) of the names that the records are for. A name with other than one record has none."""
    mine = records.where(F.col("record").rlike(r"(?i)^v\s*=\s*DMARC1\s*(;|$)")).groupBy(F.lower("name").alias("at")).agg(F.count("*").alias("c"), F.min("record").alias("record")).where("c = 1").drop("c")
    asked = hosts.select(F.col(host).alias("host")).distinct().withColumn("own", F.lower("host")).withColumn("org", W.registrable_domain(F.col("own"), suffixes))
    rows = asked.select("host", "own", F.explode(F.array_distinct(F.array_compact(F.array("own", "org")))).alias("at")).join(mine, "at")
    best = rows.groupBy("host").agg(F.min_by(F.struct("at", "record", (F.col("at") == F.col("own")).alias("direct")), (F.col("at") != F.col("own")).cast("int")).alias("r"))
    tags = H.tag_list(F.col("r.record"))
    get = lambda k: F.lower(F.try_element_at("tags", F.lit(k)))
    wrong: list[Column] = [F.when(get(k).isNotNull() & ~get(k).rlike(f"^({v})$"), F.lit(f"wrong: {k}")) for k, v in _DMARC.items()]
    errors = F.filter(F.array(*wrong, F.when(get("p").isNull(), F.lit("missing: p"))), lambda e: e.isNotNull())
    policy = F.when(~F.col("r.direct"), F.coalesce(get("sp"), get("p"))).otherwise(get("p"))
    return best.withColumn("tags", tags).select("host", "r.at", policy.alias("policy"), errors.alias("errors"))
