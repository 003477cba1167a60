"""Phrase collocations against plain counts of word tuples."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from pagesift.llm import collocations as C

DATA = "/root/testdata/sf0.001"


def plain(rows, least, best, longest=5):
    """[(lang, rank, phrase, a, l, r, n, score)] from (lang, text)."""
    counts, total = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")):
            w = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(w)
            for k in range(1, longest + 1):
                counts[lang].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, f in counts.items():
        frequent = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        gone = {q[i : i + k] for q, a in frequent.items() for k in range(2, len(q)) for i in range(len(q) - k + 1) if frequent[q[i : i + k]] == a}
        found = []
        for p, a in frequent.items():
            score, k = min((1000 * a * total[lang] // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
            if p not in gone:
                found.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        out += [(lang, i + 1, p.decode(), -a, x, y, total[lang], -s) for i, (s, a, p, x, y) in enumerate(sorted(found)[:best])]
    return sorted(out)


def mined(df, **options):
    got = C.collocations(df, **options)
    return sorted(tuple(r[c] for c in ("lang", "rank", "phrase", "a", "l", "r", "n", "score")) for r in got.collect())


@pytest.fixture(scope="module")
def corpus():
    """Few words, so that phrases repeat; a hot line, marks, case, tabs, letters beyond ASCII, null languages and texts."""
    r, words = random.Random(11), ["a", "B", "c,", "d", "é", "ß.", "Ω", "e", "f\tg", "h;i", "\x1c", "x" * 40]
    rows = [(r.choice(["en", "en", "en", "de", None, ""]), " ".join(r.choices(words, range(12, 0, -1), k=r.randint(0, 60)))) for _ in range(300)]
    return rows + [("en", "the very same line of words\nonce more")] * 150 + [("en", None), (None, None), ("fr", ""), ("de", " \t\n. "), ("en", "word " * 30_000)]


def test_counts_and_ranks_against_plain_ones(spark, corpus):
    df = spark.createDataFrame(corpus, "lang string, text string").repartition(5)
    want = plain(corpus, 20, 50)
    assert len({w[0] for w in want}) == 4 and any(w[1] == 50 for w in want)
    assert mined(df, least=20, best=50) == want


def test_blocks_with_their_own_ids_and_many_ranges(spark, corpus, monkeypatch):
    monkeypatch.setattr(C, "RANGE_KEYS", 900)
    df = spark.createDataFrame(corpus, "lang string, text string").repartition(5)
    want = plain(corpus, 5, 2000)
    assert mined(df, least=5) == want
    assert mined(df, least=5, most_local=3) == want


def test_query_against_plain_counts(spark):
    df = spark.read.parquet(f"{DATA}/documents.parquet")
    got = C.op11_collocations(spark, DATA)
    assert dict(got.dtypes) == dict(lang="string", rank="bigint", phrase="string", **dict.fromkeys("alrn", "bigint"), score="bigint")
    rows = [(r.lang, r.text) for r in df.collect()]
    assert sorted(tuple(r[c] for c in ("lang", "rank", "phrase", "a", "l", "r", "n", "score")) for r in got.collect()) == plain(rows, 100, 2000)
    assert mined(df, least=10, best=300) == plain(rows, 10, 300)


def test_tables_without_phrases(spark):
    df = spark.createDataFrame([("en", "one two three", 1)], "lang string, text string, rank int")
    assert mined(df) == mined(df.limit(0)) == mined(df.selectExpr("lang", "CAST(NULL AS STRING) AS text")) == []
    assert mined(df, least=1) == plain([("en", "one two three")], 1, 2000) and len(mined(df, least=1)) == 1


def test_radix_order_and_run_lengths():
    rng = np.random.default_rng(3)
    keys = rng.integers(0, 3, (2000, 4)).astype(np.uint32) * np.array([1, 2**17, 70_000, 2**31 - 1], np.uint32)
    order = C.radix_order(keys)
    assert keys[order].tolist() == sorted(keys.tolist())
    once, counts = C.run_lengths(keys[order], np.ones(len(keys), np.int64))
    assert dict(zip(map(tuple, once.tolist()), counts.tolist())) == Counter(map(tuple, keys.tolist()))
    assert C.ngram_keys(np.array([1, 2, 3, 0, 4, 0, 5, 6, 0], np.uint32), 3).tolist() == [[1, 2, 3], [2, 3, 0], [5, 6, 0]]
