"""Embedding whitening: principal components by a randomised range finder, scaled to unit variance.

1. Entries are rounded down to whole steps, so that sums of them are exact in any order of tasks.
2. A random block of ``components + OVERSAMPLE`` directions is multiplied by the covariance again and again. Each
   power pass reads all rows, centres them, and adds up one small product per task; only sums over all tasks, as many
   numbers as dimensions times directions, reach the driver.
3. After each pass Rayleigh-Ritz on the block gives components and their residuals. If these are small enough, the passes
   end; if they still aren't after ``PASSES`` of them, the block is expanded to the full dimension, where one more
   pass makes Rayleigh-Ritz exact. Passes that can't get there at the rate at which residuals fall are left out.
4. Two passes more measure how far the covariance of the whitened rows is from the identity.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import in_arrow, stored, table

COMPONENTS, OVERSAMPLE, PASSES = 8, 8, 4
#: A component's residual is at most this share of the largest eigenvalue; a smaller eigenvalue than NONE of it is none.
TOLERANCE, NONE = 1e-13, 1e-12
SCALE, OFFSET = 1024, 100_000
#: Steps beyond which an entry isn't held exactly.
FURTHEST = 2**40


@dataclass
class Whitening:
    """Of ``n`` vectors: exact sums, and by falling eigenvalue unit components as rows. ``block`` directions were enough."""

    n: int
    sums: list[int]
    components: np.ndarray
    eigenvalues: np.ndarray
    trace: float
    block: int
    identity_error: float = 0.0

    @property
    def mean(self) -> np.ndarray:
        return np.array([s / self.n for s in self.sums])

    def project(self, x: np.ndarray) -> np.ndarray:
        """Whitened rows (n, components) of integer rows."""
        return (x - self.mean) @ (self.components / np.sqrt(self.eigenvalues)[:, None]).T

    def deviations(self, x: np.ndarray) -> list[int]:
        """The sum over dimensions of (n * x - sums)**2 of each row, exact."""
        sums = np.array(self.sums, object)
        if float(np.abs(x).max(initial=0)) * self.n < 2**61 and max(map(abs, self.sums)) < 2**61:
            apart = x * np.int64(self.n) - sums.astype(np.int64)
            if (np.square(apart.astype(float)).sum(1) < 2**62).all():
                return np.square(apart).sum(1).tolist()
        apart = x.astype(object) * self.n - sums
        return (apart * apart).sum(1).tolist() if len(x) else []


def steps(df: DataFrame, id_col: str, vector_col: str, scale: int = SCALE, offset: int = OFFSET) -> DataFrame:
    """(id, x array<long>): floor(scale * entry) + offset. Null vectors, those without entries and those with entries that
    are null, not finite or beyond ``FURTHEST`` steps are dropped."""
    c = F.col(vector_col)
    bad: Callable[[Column], Column] = lambda e: e.isNull() | F.isnan(e) | (F.abs(e.cast("double")) * scale > F.lit(float(FURTHEST)))
    rows = df.where(F.coalesce((F.size(c) > 0) & ~F.exists(c, bad), F.lit(False)))
    return rows.select(F.col(id_col), F.transform(c, lambda e: F.floor(e.cast("double") * scale) + offset).alias("x"))


def _matrix(column, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def summed(rows: DataFrame, dim: int, size: int, part: Callable[[np.ndarray], np.ndarray], exact: bool = False) -> list:
    """The sum of ``part`` (``size`` numbers of a block of rows) over all rows: a sum in each task, then Spark's sums of these."""

    def run(batches):
        import pyarrow as pa

        total = np.zeros(size, np.int64 if exact else float)
        for b in batches:
            if b.num_rows:
                total += part(_matrix(b.column(0), dim)).ravel()
        yield pa.RecordBatch.from_arrays([pa.array(range(size), pa.int32()), pa.array(total)], ["at", "v"])

    kind = "long" if exact else "double"
    sums = in_arrow(rows.select("x"), run, f"at int, v {kind}").groupBy("at").agg(F.sum(F.col("v").cast("decimal(28,0)" if exact else kind)).alias("v"))
    out = {r["at"]: r["v"] for r in sums.collect()}
    return [(int if exact else float)(out.get(i, 0)) for i in range(size)]


def _orthonormal(y: np.ndarray) -> np.ndarray:
    return np.linalg.qr(y)[0]


def _ritz(q: np.ndarray, vq: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Eigenvalues (falling), vectors as columns, and their residuals' norms, of the block ``q`` and its product ``vq``."""
    b = q.T @ vq
    e, u = np.linalg.eigh((b + b.T) / 2)
    e, u = e[::-1], u[:, ::-1]
    return e, q @ u, np.linalg.norm(vq @ u - (q @ u) * e, axis=0)


def fit(rows: DataFrame, components: int = COMPONENTS, oversample: int = OVERSAMPLE, passes: int = PASSES, tolerance: float = TOLERANCE, seed: int = 13) -> Whitening | None:
    """The whitening of all ``rows`` (x array<long>, of one length); None of no rows."""
    first = rows.select(F.size("x").alias("d")).limit(1).collect()
    if not first:
        return None
    dim = first[0]["d"]
    n, *sums = summed(rows, dim, dim + 1, lambda x: np.concatenate([[len(x)], x.sum(0)]), exact=True)
    mean = np.array([s / n for s in sums])

    def times_covariance(q: np.ndarray) -> tuple[np.ndarray, float]:
        def part(x):
            c = x - mean
            return np.concatenate([(c.T @ (c @ q)).ravel(), [(c * c).sum()]])

        *product, square = summed(rows, dim, q.size + 1, part)
        return np.array(product).reshape(q.shape) / n, square / n

    rng, k = np.random.default_rng(seed), min(components, dim)
    block = min(dim, k + oversample)
    q, before = _orthonormal(rng.standard_normal((dim, block))), np.inf
    for left in range(passes, -1, -1):
        vq, trace = times_covariance(q)
        e, vectors, residuals = _ritz(q, vq)
        worst, least = residuals[:k].max(), tolerance * max(e[0], 0)
        if block == dim or worst <= least:
            break
        hopeless = before < np.inf and worst * (worst / before) ** left > least
        before = worst
        if hopeless or left == 0:
            block = dim
            q = _orthonormal(np.hstack([vectors, rng.standard_normal((dim, dim - vectors.shape[1]))]))
            vq, trace = times_covariance(q)
            e, vectors, residuals = _ritz(q, vq)
            break
        q = _orthonormal(vq)
    real = int((e[:k] > NONE * max(e[0], 0)).sum())
    found = Whitening(n, sums, vectors[:, :real].T, e[:real], trace, block)
    if real:
        middle = np.array(summed(rows, dim, real, lambda x: found.project(x).sum(0))) / n

        def part(x):
            z = found.project(x) - middle
            return z.T @ z

        found.identity_error = float(np.abs(np.array(summed(rows, dim, real * real, part)).reshape(real, real) / n - np.eye(real)).max())
    return found


def whiten(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS, **options) -> DataFrame:
    """(id, component, n, deviation, whitened, explained, identity_error) for each row with a usable vector and each component.

    ``steps`` says which vectors are usable; of their lengths the one of most rows counts (of as many, the smaller), rows of
    other lengths are dropped. Directions without variance are no components: there are as many as asked for, or as many as
    the vectors span; equal vectors alone give no rows, as does an empty table. Rows that repeat count and appear as
    often as they stand; ids may be null; other columns are not read. Where eigenvalues are equal, any basis of
    their space may come. ``deviation`` is a decimal, as it grows with the square of the number of rows.
    """
    kind = dict(df.dtypes)[id_col]
    schema = f"`{id_col}` {kind}, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"
    every = stored(steps(df, id_col, vector_col), "steps")
    lengths = every.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    rows = every.where(F.size("x") == (lengths[0]["d"] if lengths else 0))
    model = fit(rows, components, **options)
    if model is None:
        return df.sparkSession.createDataFrame([], schema)
    dim, told = len(model.sums), model.eigenvalues / model.trace if model.trace else model.eigenvalues

    def run(batches):
        from decimal import Decimal

        import pyarrow as pa

        k = len(told)
        for b in batches:
            x = _matrix(b.column(1), dim)
            each, m = np.repeat(np.arange(len(x)), k), len(x) * k
            apart = [Decimal(v) for v in model.deviations(x)]
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(0).take(pa.array(each)), pa.array(np.tile(np.arange(1, k + 1), len(x)), pa.int32()), pa.array(np.full(m, model.n)), pa.array(apart, pa.decimal128(38, 0)).take(pa.array(each)),
                    pa.array(model.project(x).ravel()), pa.array(np.tile(told, len(x))), pa.array(np.full(m, model.identity_error)),
                ],
                [id_col, "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return in_arrow(rows.select(id_col, "x"), run, schema)


def op13_whitening(spark, sf_dir):
    return whiten(table(spark, sf_dir, "embeddings")).withColumn("deviation", F.col("deviation").cast("long"))


SQL: dict[str, str] = {}
QUERIES = {"op13_whitening": op13_whitening}
