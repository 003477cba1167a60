"""Language detection: held-out accuracy, a plain count of trigrams, and texts at their edges."""

import math
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from pagesift.functions import language as N
from pagesift.plans import languages

DATA = "/root/testdata/sf0.01"


def test_held_out_documents_are_told_by_language(spark):
    told = languages.language_detect(spark, DATA).where("held_out AND language IS NOT NULL")
    right = {r.lang: (r.n, r.share, r.sure) for r in told.groupBy("lang").agg(F.count("*").alias("n"), F.avg((F.col("lang") == F.col("language")).cast("double")).alias("share"), F.avg(F.when(F.col("reliable"), (F.col("lang") == F.col("language")).cast("double"))).alias("sure")).collect()}
    assert set(right) == {"en", "fr", "de", "es"}
    assert all(n > 20 and share > 0.97 and sure > 0.99 for n, share, sure in right.values()), right


TEXTS = [("en", "the one and the other, the end"), ("en", "the The THE"), ("es", "uno y el otro, el fin"), ("es", "él — el, año"), (None, "not taught"), ("fr", None), ("fr", "")]


def plain_weights(texts, most):
    out = {}
    for lang in {la for la, t in texts if la and t}:
        n = Counter(f" {w} "[i : i + 3] for la, t in texts if la == lang and t for w in re.findall(r"[^\W\d_]+", t.lower()) for i in range(len(w)))
        total = sum(n.values())
        best = sorted(n, key=lambda g: (-n[g], g))[:most]
        out |= {(lang, g): math.floor(1000 * math.log(n[g] / total)) for g in best}
    return out


def test_profiles_are_counts_of_trigrams(spark):
    df = spark.createDataFrame(TEXTS, "lang string, text string")
    for most in (4, 1000):
        assert {(r.lang, r.gram): r.weight for r in N.profiles(df, most=most).collect()} == plain_weights(TEXTS, most)
    model = N.learn(df)
    assert model.languages == ("en", "es") and model.weights["the"][1] == N.FLOOR
    assert N.learn(df.limit(0)).guess("anything") is None


def test_guesses(spark):
    model = N.learn(spark.createDataFrame(TEXTS, "lang string, text string"))
    rows = [(0, None), (1, ""), (2, "the other end"), (3, "   the other end   \n" + " " * 30), (4, "the other and the one in the end"), (5, "4711 . . . 4711 . . . 4711 . . ."), (6, "EL OTRO AÑO y el fin, uno y otro"), (7, "zzzzzz qqqqqqq xxxxxxx wwwwwwww"), (8, "the " * 50_000), (9, "é" * 200_000)]
    df = spark.createDataFrame(rows, "id int, text string")
    got = {r.id: r.g for r in df.select("id", N.detect(F.col("text"), model).alias("g")).collect()}
    assert [got[i] for i in (0, 1, 2, 3, 5)] == [None] * 5
    assert (got[4].language, got[4].reliable) == (got[8].language, got[8].reliable) == ("en", True) and got[8].confidence == 1.0
    assert got[6].language == "es" and got[6].reliable
    assert got[7].language == "en" and not got[7].reliable and got[7].confidence == got[9].confidence == 0  # a tie: nothing is known


@pytest.mark.parametrize(("lang", "title", "description", "want"), [
    ("es-MX", "the other and the one in the end", None, ["title reads as en (1)"]), ("en-GB", "the other and the one in the end", "el otro y uno y el fin y otro", ["description reads as es (1)"]),
    ("ES", "el otro y uno y el fin y otro", "uno", []), ("", "el otro y uno y el fin y otro", None, None), (None, "el otro y uno y el fin y otro", None, None),
])
def test_pages_that_disagree_with_what_they_declare(spark, lang, title, description, want):
    model = N.learn(spark.createDataFrame([("en", "the other and the one in the end"), ("es", "el otro y uno y el fin y otro")], "lang string, text string"))
    meta = F.create_map(F.lit("description"), F.lit(description)) if description else F.create_map().cast("map<string, string>")
    df = spark.range(1).select(F.struct(F.lit(title).alias("title"), meta.alias("meta")).alias("html"))
    got = df.select(N.disagreeing(F.lit(lang).cast("string"), N.detected(F.col("html"), model)).alias("off")).first().off
    assert got == want
