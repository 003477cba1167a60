"""Whole queries against plain versions that share no code with the library."""

import hashlib
import re
from collections import defaultdict

import pyarrow.parquet as pq
import pytest

from pagesift.llm import exact_dedup, near_dedup, piece_encoding, sharding

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def documents():
    return pq.read_table(f"{DATA}/documents.parquet").to_pylist()


def shingles(text, k=5):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)} if len(words) >= k else {tuple(words)} if words else set()


def components(sets, part, whole):
    """The smallest id that each id reaches over links of similar sets; every pair that shares a shingle is looked at."""
    holders, root = defaultdict(list), {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in sorted(sets):
        met = defaultdict(int)
        for s in sets[i]:
            for j in holders[s]:
                met[j] += 1
            holders[s].append(i)
        for j, shared in met.items():
            if whole * shared >= part * (len(sets[i]) + len(sets[j]) - shared):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: find(i) for i in sets}


@pytest.mark.parametrize(("part", "extra"), [(85, []), (80, [(10**6 + i, "Same Words  in\teach of\nthese texts, but for case " + "and more " * 20 + "x" * (i % 3)) for i in range(40)] + [(10**7, "one two"), (10**7 + 1, "ONE two"), (10**7 + 2, None), (10**7 + 3, " ")])])
def test_near_duplicates_by_plain_sets(spark, documents, part, extra):
    rows = [(d["doc_id"], d["text"]) for d in documents] + extra
    sets = {i: shingles(t) for i, t in rows}
    want = components(sets, part, 100)
    got = {r.doc_id: r for r in near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(6), part=part).collect()}
    assert {i: (r.n_shingles, r.component_id, r.kept) for i, r in got.items()} == {i: (len(sets[i]), want[i], want[i] == i) for i in sets}
    assert len(set(want.values())) < len(want)


def test_exact_duplicates_by_plain_groups(spark, documents):
    groups = defaultdict(list)
    for d in documents:
        groups[d["text"] or ""].append(d["doc_id"])
    want = {(i, max(ids), len(ids), i == max(ids), hashlib.sha256(t.encode()).hexdigest()) for t, ids in groups.items() for i in ids}
    assert {tuple(r) for r in exact_dedup.op1_exact_dedup(spark, DATA).collect()} == want
    assert exact_dedup.filter_size(0) == exact_dedup.LEAST_BITS and exact_dedup.filter_size(2**20) == 2**24 and exact_dedup.filter_size(10**12) == exact_dedup.MOST_BITS


def test_no_text_takes_the_library_for_the_agenda(spark, documents):
    """Encoding falls back to the library where they differ; over whole tables they never do."""
    df = spark.createDataFrame([(d["doc_id"], d["text"]) for d in documents], "doc_id long, text string")
    assert piece_encoding.encode(df).where("n_repaired > 0").count() == 0


def test_shards_hold_every_document_once(spark, documents):
    got = sharding.op10_sharding(spark, DATA)
    assert sorted(r.doc_id for r in got.select("doc_id").collect()) == sorted(d["doc_id"] for d in documents)
