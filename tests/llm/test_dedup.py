"""Exact and near deduplication against brute force."""

import hashlib
import random

import pytest

from pagesift.llm import exact_dedup as X
from pagesift.llm import near_dedup as N
from pagesift.llm.components import components
from pagesift.llm.shingles import circulant_signature, shingle_set

SCHEMA = "doc_id long, text string, kept string, __x string"


def frame(spark, rows):
    """With a column whose name clashes with a result's."""
    return spark.createDataFrame([(i, t, "mine", None) for i, t in rows], SCHEMA)


@pytest.mark.parametrize("bits", [64, 2**16])
def test_exact_dedup_against_brute_force(spark, bits):
    rng = random.Random(1)
    rows = [(i, rng.choice([None, "", " ", "a", "A", "b" * 5000, f"only {i}"])) for i in range(300)] + [(None, "a"), (None, "alone")]
    out = X.exact_dedup(frame(spark, rows), filter_bits=bits).collect()
    assert len(out) == len(rows)
    groups = {}
    for i, t in rows:
        groups.setdefault(t or "", []).append(i)
    kept = {}
    for r in out:
        ids = groups[r.text or ""]
        assert r.group_size == len(ids)
        assert r.keep_id == max((i for i in ids if i is not None), default=None)
        assert r.text_sha256 == hashlib.sha256((r.text or "").encode()).hexdigest()
        kept[r.text or ""] = kept.get(r.text or "", 0) + r.kept
    assert set(kept.values()) == {1}


def test_exact_dedup_of_repeated_rows_and_nothing(spark):
    df = frame(spark, [(1, "a"), (1, "a"), (2, None), (2, None), (2, "")])
    assert sorted((r.doc_id, r.kept) for r in X.exact_dedup(df).collect()) == [(1, False), (1, True), (2, False), (2, False), (2, True)]
    assert X.deduplicated(df).columns == df.columns
    assert X.exact_dedup(frame(spark, [])).count() == 0


def brute(rows, part, whole):
    sets, name = {}, {}
    for i, t in rows:
        sets[i] = set(shingle_set(t).tolist())
        name[i] = i
    for i in sets:
        for j in sets:
            if i < j and sets[i] and sets[j]:
                both = len(sets[i] & sets[j])
                if whole * both >= part * (len(sets[i]) + len(sets[j]) - both):
                    a, b = sorted((name[i], name[j]))
                    name = {k: a if v == b else v for k, v in name.items()}
    return sets, name


def near_rows(seed):
    """Groups of near copies: stars around a base, chains, a shared passage, exact copies and odd texts."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7)))
    texts = [None, "", " \n\t ", "a b", "a b", "A B", "one two three four five", "one two three four"]
    for _ in range(6):
        base = [word() for _ in range(rng.randint(40, 160))]
        for _ in range(12):
            copy = list(base)
            for _ in range(rng.randint(0, 6)):
                copy[rng.randrange(len(copy))] = word()
            texts.append(" ".join(copy))
        chain = list(base)
        for _ in range(6):
            chain[rng.randrange(len(chain))] = word()
            texts.append(" ".join(chain))
    passage = [word() for _ in range(80)]
    for _ in range(15):
        texts.append(" ".join(passage + [word() for _ in range(rng.randint(5, 60))]))
    texts += rng.sample([t for t in texts if t], 20)
    rng.shuffle(texts)
    return list(enumerate(texts))


@pytest.mark.parametrize(("part", "seed"), [(85, 1), (80, 2)])
def test_near_dedup_against_brute_force(spark, part, seed):
    rows = near_rows(seed)
    sets, name = brute(rows, part, 100)
    out = {r.doc_id: r for r in N.near_duplicates(frame(spark, rows), part=part, whole=100).collect()}
    assert len(out) == len(rows)
    assert {i: r.component_id for i, r in out.items()} == name
    assert all(r.n_shingles == len(sets[i]) and r.kept == (name[i] == i) for i, r in out.items())


def test_near_dedup_nulls_and_nothing(spark):
    df = frame(spark, [(None, "a b c d e f"), (5, "a b c d e f"), (None, "x"), (7, None)])
    out = sorted((str(r.doc_id), str(r.component_id), r.kept) for r in N.near_duplicates(df).collect())
    assert out == [("5", "5", True), ("7", "7", True), ("None", "5", False), ("None", "None", True)]
    assert N.near_duplicates(frame(spark, [])).count() == 0


def test_representatives_keep_one_row_of_each_group(spark):
    df = frame(spark, near_rows(3))
    _, name = brute(near_rows(3), 80, 100)
    assert sorted(r.doc_id for r in N.representatives(df).collect()) == sorted({v for v in name.values()})


def test_signature_estimates_similarity():
    import numpy as np

    rng = np.random.default_rng(2)
    x = np.unique(rng.integers(0, 2**63, 900).astype(np.uint64))
    a, b = x[:700], x[200:]
    true = 500 / 900
    assert abs((circulant_signature(a, 1024) == circulant_signature(b, 1024)).mean() - true) < 0.08


def test_components_of_a_long_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101)], "a long, b long")
    found = {r.node: r.component for r in components(links).collect()}
    assert all(found[i] == 0 for i in range(41))
    assert found[101] == 100
