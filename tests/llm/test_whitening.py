"""Whitening against numpy's full eigendecomposition of the covariance."""

import math

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from pagesift.llm import whitening as W

DATA = "/root/testdata/sf0.001"


def plain(vectors, k=8):
    """What the operator is to give, from all vectors in one array; sums in Python integers."""
    x = [[math.floor(1024 * float(c)) + 100_000 for c in v] for v in vectors]
    n, sums = len(x), [sum(c) for c in zip(*x)]
    c = np.array([[n * a - s for a, s in zip(r, sums)] for r in x], float) / n
    v = c.T @ c / n
    e, u = np.linalg.eigh(v)
    e, u = e[::-1][:k], u[:, ::-1][:, :k]
    return n, [sum((n * a - s) ** 2 for a, s in zip(r, sums)) for r in x], c @ u / np.sqrt(e), e / np.trace(v)


def held(got, vectors, ids, k=8):
    n, deviation, z, explained = plain(vectors, k)
    rows = {(r[0], r.component): r for r in got}
    assert len(got) == len(rows) == len(vectors) * k and {r.n for r in got} == {n}
    mine = np.array([[rows[i, j + 1].whitened for j in range(k)] for i in ids])
    signs = np.sign((mine * z).sum(0))
    assert np.abs(mine * signs - z).max() < 1e-8
    assert [int(rows[i, 1].deviation) for i in ids] == deviation
    assert np.allclose([rows[ids[0], j + 1].explained for j in range(k)], explained, rtol=1e-9)
    assert len({r.identity_error for r in got}) == 1 and got[0].identity_error < 1e-9
    assert np.abs(np.cov(mine.T, bias=True) - np.eye(k)).max() < 1e-9


def test_query_against_a_full_decomposition(spark):
    rows = pq.read_table(f"{DATA}/embeddings.parquet").to_pylist()
    got = W.op13_whitening(spark, DATA)
    assert dict(got.dtypes) == {"vec_id": "bigint", "component": "int", "n": "bigint", "deviation": "bigint", "whitened": "double", "explained": "double", "identity_error": "double"}
    held(got.collect(), [r["embedding"] for r in rows], [r["vec_id"] for r in rows])


def test_range_finder_is_enough_where_the_spectrum_falls(spark):
    rng = np.random.default_rng(1)
    x = rng.standard_normal((400, 30)) * 4.0 ** -np.arange(30) * 400
    df = spark.createDataFrame([(i, [float(c) for c in v]) for i, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(5)
    model = W.fit(W.steps(df, "vec_id", "embedding"), 3)
    assert model.block == 11 < 30
    held(W.whiten(df, components=3).collect(), x, range(400), 3)
    flat = W.steps(df.select("vec_id", F.transform("embedding", lambda e: F.sin(e * 1e6)).alias("embedding")), "vec_id", "embedding")
    assert W.fit(flat, 3).block == 30


def test_odd_vectors(spark):
    """Null, empty, unusable and far entries, other lengths, repeated rows, null ids, clashing columns."""
    nan, inf = float("nan"), float("inf")
    rng = np.random.default_rng(2)
    good = [(i, [float(c) for c in rng.standard_normal(3)], i) for i in range(20)]
    odd = [(50, None, 1), (51, [], 1), (52, [1.0, None, 0.0], 1), (53, [nan, 1.0, 1.0], 1), (54, [inf, 1.0, 1.0], 1), (55, [1.0, 2.0], 1), (56, [1e300, 0.0, 0.0], 1)]
    df = spark.createDataFrame(good + odd, "vec_id long, embedding array<double>, component int")
    held(W.whiten(df).collect(), [r[1] for r in good], range(20), 3)
    again = W.whiten(df.unionByName(df)).collect()
    assert len(again) == 2 * 20 * 3 and {r.n for r in again} == {40} and len({tuple(r) for r in again}) == 60
    assert W.whiten(df.limit(0)).count() == W.whiten(df.where("vec_id > 49 AND vec_id <> 55")).count() == 0
    same = spark.createDataFrame([(None, [0.5, 0.5]), (1, [0.5, 0.5])], "vec_id long, embedding array<float>")
    assert W.whiten(same).count() == 0
    line = spark.createDataFrame([(None, [0.0, 1.0]), (1, [1.0, 1.0]), (2, [2.0, 1.0])], "vec_id long, embedding array<float>")
    got = sorted(W.whiten(line).collect(), key=lambda r: r.vec_id or 0)
    assert [(r.vec_id, r.component) for r in got] == [(None, 1), (1, 1), (2, 1)] and got[1].whitened == pytest.approx(0) and got[0].explained == pytest.approx(1)


def test_deviations_stay_exact_beyond_64_bits():
    model = W.Whitening(10**9, [10**14, 10**14], np.eye(2), np.ones(2), 2.0, 2)
    assert model.deviations(np.array([[2**39, 5], [100_000, 100_001]])) == [(2**39 * 10**9 - 10**14) ** 2 + (5 * 10**9 - 10**14) ** 2, 10**18]
    assert model.deviations(np.zeros((0, 2), np.int64)) == []
