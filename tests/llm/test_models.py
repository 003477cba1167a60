"""Quality classifier, mixing, neighbours, sharding and the pipeline."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from pagesift.llm import mixing, neighbours, quality, sharding
from pagesift.llm.common import table

SF = "/root/testdata/sf0.01"


def test_quality_on_held_out_rows(spark):
    scored = quality.op7_quality(spark, SF).join(table(spark, SF, "labels"), "doc_id").where("held_out").select("predicted", "quality").collect()
    assert sum(r.predicted == r.quality for r in scored) / len(scored) > 0.95


def test_quality_rows(spark):
    docs = spark.createDataFrame([(1, None, "c"), (1, "", "c"), (None, "some words here", None), (2, "x " * 90000, "c")], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(1, 1, None), (2, None, 1), (3, 0, 1)], "doc_id long, quality int, toxic int")
    out = quality.quality_scores(docs, labels).collect()
    assert len(out) == 4
    assert all(0 <= r.score <= 1 and r.held_out is not None for r in out)
    assert quality.quality_scores(docs, labels.limit(0)).where("score = 0.5").count() == 4
    assert quality.quality_scores(docs.limit(0), labels).count() == 0
    assert quality.accepted(docs, labels.limit(0)).count() == 0


def test_mixing_meets_targets(spark):
    rng = random.Random(3)
    rows = [(i, rng.choice(["a", "a", "a", "b", "c", "d", None, ""]), "w " * rng.randint(0, 60)) for i in range(3000)] + [(None, "a", None), (5, "e", ""), (5, "e", "")]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, source string, text string, size string")
    out = mixing.systematic_mix(df).collect()
    assert len(out) == len(rows)
    taken, target, size, largest = {}, {}, {}, {}
    for r in out:
        assert 0 <= r.copies <= 2
        taken[r.source] = taken.get(r.source, 0) + r.copies * r.size
        target[r.source], size[r.source] = r.target, r.source_size
        largest[r.source] = max(largest.get(r.source, 0), r.size)
    total = sum(size.values())
    assert math.isclose(sum(target.values()), 1.5 * total)
    assert all(target[s] <= 2 * size[s] + 1e-6 for s in size)
    assert all(abs(taken[s] - target[s]) <= 8 * largest[s] for s in size)
    names = sorted(s for s in size if s is not None) + [None]
    level = {s: target[s] / (5, 2, 1)[i % 3] for i, s in enumerate(names) if size[s]}
    free = [level[s] for s in level if target[s] < 2 * size[s] - 1e-6]
    assert max(free) - min(free) < 1e-6
    assert all(level[s] <= free[0] + 1e-6 for s in level)
    assert sorted(map(str, mixing.systematic_mix(df).collect())) == sorted(map(str, out))
    assert mixing.mixed(df).columns == df.columns
    assert mixing.mixed(df).count() == sum(r.copies for r in out)
    assert mixing.systematic_mix(df.limit(0)).count() == 0


def brute(rows, k):
    good = [(i, np.array(v, float)) for i, v in dict.fromkeys((i, tuple(v)) for i, v in rows if v is not None and i is not None and len(v) == 4 and all(x is not None and math.isfinite(x) for x in v) and any(v))]
    out = {}
    for q, x in good:
        if q % 20 == 0:
            out[q] = sorted((-float(x @ y), i) for i, y in good if i != q)[:k]
    return out


def test_neighbours_with_ties_and_odd_vectors(spark):
    rng = random.Random(8)
    hot = [0.5, 0.5, 0.25, 0.0]
    rows = [(i, hot if i % 3 == 0 else [rng.choice([-1.0, 0.0, 0.5, 1.0]) for _ in range(4)]) for i in range(200)]
    rows += [(300, None), (320, [0.0] * 4), (340, [None, 1.0, 1.0, 1.0]), (360, [float("nan"), 1.0, 1.0, 1.0]), (None, hot), (380, [1.0]), (20, hot), rows[40]]
    rows = [r for r in rows if r[0] != 20] + [(20, hot), (20, hot)]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "vec_id long, embedding array<float>, rank string")
    got = {}
    for r in neighbours.nearest(df, F.col("vec_id") % 20 == 0, k=20).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((-r.score, r.vec_id))
    want = brute(rows, 20)
    assert set(got) == set(want)
    for q in want:
        assert [i for _, i in got[q]] == [i for _, i in want[q]]
        assert np.allclose([s for s, _ in got[q]], [s for s, _ in want[q]])
    assert neighbours.nearest(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0
    few = neighbours.nearest(df.where("vec_id IN (40, 41, 43)"), F.col("vec_id") == 40).collect()
    assert len(few) == 2


def test_neighbours_recall(spark):
    df = table(spark, SF, "embeddings")
    rows = {r.vec_id: np.array(r.embedding, float) for r in df.collect()}
    got: dict = {}
    for r in neighbours.op4_neighbours(spark, SF).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    hits = total = 0
    for q in got:
        want = sorted((-float(rows[q] @ x), i) for i, x in rows.items() if i != q)[:20]
        hits, total = hits + len(got[q] & {i for _, i in want}), total + 20
    assert hits / total >= 0.95


def test_recall_where_few_candidates_are_reranked():
    rng = np.random.default_rng(5)
    x = rng.normal(size=(6000, 32)).astype(np.float32)
    quantizer = neighbours.AdditiveQuantizer(32).fit(x[:3000])
    codes = quantizer.encode(x)
    near = np.argsort(-quantizer.scores(x[:50], codes), 1)[:, :100]
    true = np.argsort(-(x[:50] @ x.T), 1)[:, :20]
    assert np.mean([len(set(a) & set(b)) / 20 for a, b in zip(near, true)]) >= 0.9


def test_sharding_keeps_rows_and_commits_whole(spark, tmp_path):
    df = spark.createDataFrame([(i if i % 7 else None, "t" * i, "x") for i in range(500)] + [(1, "t", "x")] * 3, "doc_id long, text string, shard string")
    store = sharding.ShardStore(spark, f"file://{tmp_path}/s", target_bytes=1 << 20, small_bytes=1 << 10, fanout=2)
    for i in range(5):
        store.append(df.where(F.pmod(F.hash("text"), F.lit(5)) == i).repartition(3))
    before = store.version()
    many = len(store.shards())
    store.compact()
    assert sorted(map(str, store.read().collect())) == sorted(map(str, df.collect()))
    assert sorted(map(str, store.read(before).collect())) == sorted(map(str, df.collect()))
    assert len(store.shards()) < many
    version = store.version()
    df.write.parquet(f"{store.root}/data/left-over")  # a job that died before its commit
    assert store.version() == version
    assert store.read().count() == 503
    with pytest.raises(sharding.CommitConflict):
        store._commit(version - 1, df.schema.json(), [])
    assert store.version() == version
    store.vacuum()
    assert store.read().count() == 503
    assert {s.path.split("/")[1] for s in store.shards()} == {p.name for p in (tmp_path / "s/data").iterdir()}


def test_sharding_of_nothing(spark, tmp_path):
    store = sharding.shard_arrivals([spark.createDataFrame([], "doc_id long")], f"file://{tmp_path}/s")
    assert store.read().count() == 0


def test_op10_has_every_document(spark):
    sf = "/root/testdata/sf0.001"
    out = sharding.op10_sharding(spark, sf)
    assert sorted(r.doc_id for r in out.collect()) == sorted(r.doc_id for r in table(spark, sf, "documents").collect())


@pytest.mark.parametrize("metric", ["ip", "l2"])
def test_no_neighbour_is_lost_in_tight_clusters(spark, metric, monkeypatch):
    """Thousands of vectors that differ by less than what codes leave over, in several blocks."""
    monkeypatch.setattr(neighbours, "CODE_BLOCK", 1 << 15)
    rng = np.random.default_rng(12)
    x = np.repeat(rng.normal(size=(3, 16)), 1500, 0) + rng.normal(size=(4500, 16)) * 1e-3
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got: dict = {}
    for r in neighbours.nearest(df, F.col("vec_id") % 300 == 0, metric=metric, quantizer=neighbours.AdditiveQuantizer(16, books=3).fit(x[::9], rounds=1)).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    assert len(got) == 15
    for q, found in got.items():
        near = x @ x[q] if metric == "ip" else -((x - x[q]) ** 2).sum(1)
        near[q] = -np.inf
        assert found == np.argsort(-near, kind="stable")[:20].tolist()
