"""Globs met with values by their keys, against every value with every glob; stacks with addresses as evidence."""

import random
import re

from pyspark.sql import functions as F

from pagesift.operators import patterns as P
from pagesift.operators import site
from pagesift.operators.rules import glob_pattern


def test_every_match_is_met(spark):
    r = random.Random(5)
    word = lambda: "".join(r.choices("abcXé./-", k=r.randint(1, 7)))
    globs = list({"".join(r.choice([word(), "*", "?", "{a,bc}", "[ab]", "**", "/", "\\*", "{x,{y,z}}q"]) for _ in range(r.randint(1, 4))) for _ in range(300)} | {"*", "", "**", "?"})
    values = list({word() + r.choice(["", word(), "/" + word()]) for _ in range(300)} | {"", "abcd", "ABCD"})
    regex = {g: "(?is)" + glob_pattern(g, across=True) for g in globs}
    df = spark.createDataFrame([(v,) for v in values] + [(None,)], "value string")
    pats = spark.createDataFrame([(g, regex[g]) for g in globs] + [(None, None)], "glob string, regex string")
    got = {(x.value, x.glob) for x in P.glob_matches(df, pats).collect()}
    every = df.where("value IS NOT NULL").crossJoin(pats.where("glob IS NOT NULL")).where(F.rlike("value", F.col("regex")))
    want = {(x.value, x.glob) for x in every.collect()}
    assert got == want and len(want) > 300 and P.glob_matches(df, pats).count() == len(want)


def test_a_thousand_patterns_make_no_row_for_each_value(spark):
    values = spark.range(2000).select(F.concat(F.lit("https://cdn"), F.col("id"), F.lit(".example.com/lib/app.js")).alias("value"))
    pats = spark.range(1000).select(F.concat(F.lit("https://cdn"), F.col("id") * 7, F.lit(".example.com/**")).alias("glob")).withColumn("regex", F.concat(F.lit("^"), F.replace("glob", F.lit("**"), F.lit(".*"))))
    keys = P.glob_keys(pats)
    assert keys.where("key IS NULL").count() == 0 and keys.where("key LIKE '%http%' OR key LIKE '%exam%'").count() == 0
    low = F.lower("value")
    met = values.withColumn("key", F.explode(F.flatten(F.array(*[P._pieces(low, n) for n in P.SIZES])))).join(pats.join(keys, "glob"), "key").count()
    assert P.glob_matches(values, pats).count() == 286 and met < 30_000  # of two million pairs


def test_addresses_are_evidence(spark):
    services = [{"name": "edge", "kind": "cdn", "header": {"server": "edge*"}, "address": ["192.0.2.0/24", "2001:db8::/32"]}, {"name": "other", "kind": "cdn", "nameserver": ["*.other.example"], "address": ["198.51.100.0/25"]}]
    rows = [("a", "address", "", "192.0.2.7"), ("a", "address", "", "192.0.2.8"), ("a", "nameserver", "", "ns.other.example"), ("b", "address", "", "198.51.100.200"), ("b", "header", "Server", "EDGE"), ("c", "address", "", "2001:DB8::1"), ("c", "address", "", "no address"), ("c", "header", "via", "edge"), ("d", "header", "server", None)]
    observed = spark.createDataFrame(rows, "origin string, signal string, name string, value string")
    found = {(x.origin, x.service, x.signal, x.evidence) for x in site.service_signals(observed, services).collect()}
    assert found == {("a", "edge", "address", "192.0.2.7"), ("a", "other", "nameserver", "ns.other.example"), ("b", "edge", "header", "EDGE"), ("c", "edge", "address", "2001:DB8::1")}
    assert {(x.origin, x.service, x.confidence) for x in site.stack(site.service_signals(observed, services)).collect()} == {("a", "edge", "medium"), ("b", "edge", "medium"), ("c", "edge", "medium")}


def test_glob_with_literal_marks_is_read_as_the_expression_reads_it():
    assert re.search("(?is)" + glob_pattern("a\\*b", across=True).replace("(?is)", ""), "a*b")
