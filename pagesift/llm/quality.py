"""Quality classifier: regularised quadratic discriminant over transformed document statistics.

Statistics are computed once per document in Arrow batches and stored. The class means and covariances
are sums over all labelled training rows, added up by Spark (no sample); only these few sums reach the
driver. Each covariance is shrunk towards the pooled one and towards a multiple of the identity, and its
Cholesky factor is cached in the model. The score is the logistic of the difference of the two classes'
Mahalanobis log-densities plus the log prior ratio, worked out as a column.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, in_arrow, stored, table

THRESHOLD = 0.7
_STATS = "__quality_stats"
#: Shares of the pooled covariance and of the identity in a class covariance.
TO_POOLED, TO_IDENTITY = 0.05, 0.05


def _classes() -> np.ndarray:
    m = np.zeros((256, 7))
    for j, chars in enumerate((b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b"\n", b".", b"#$%&*<>{}[]=_~^", b"|", b"!?")):
        m[list(chars), j] = 1
    return m


_CLASSES = _classes()
DIMENSIONS = 13


def statistics(text: str | None) -> list[float]:
    """Thirteen transformed statistics of one whole text; a null text is an empty one."""
    raw = (text or "").encode("utf-8", "replace")
    upper, digit, line, stop, symbol, pipe, shout = np.bincount(np.frombuffer(raw, np.uint8), minlength=256) @ _CLASSES
    words = raw.split()
    n, size = len(words), len(raw)
    counts: dict[bytes, int] = {}
    for w in words:
        counts[w] = counts.get(w, 0) + 1
    twice = sum(map(bytes.__eq__, words, words[1:]))
    lines = raw.split(b"\n")
    rate = lambda k, of: math.log((k + 0.5) / (of + 20))
    return [
        math.log1p(n), math.log((size + 5) / (n + 1)), rate(upper, size), rate(digit, size), rate(line, n), rate(stop, n),
        rate(symbol, n), rate(pipe, n), rate(shout, n), rate(twice, n), rate(len(counts), n),
        math.log((max(counts.values(), default=0) + 1) / (n + 10)), rate(len(lines) - len(set(lines)), len(lines)),
    ]


def document_statistics(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, stats array<double>) for each row."""

    def run(batches):
        import pyarrow as pa

        for b in batches:
            stats = pa.array([statistics(t) for t in b.column(1).to_pylist()], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([b.column(0), stats], [id_col, "stats"])

    kind = dict(df.dtypes)[id_col]
    return in_arrow(df.select(id_col, F.col(text_col).cast("string")), run, f"`{id_col}` {kind}, stats array<double>")


@dataclass
class QuadraticDiscriminant:
    """Fitted by ``fit``; ``log_odds`` scores rows of statistics."""

    center: np.ndarray
    scale: np.ndarray
    prior: float
    means: list[np.ndarray] = field(default_factory=list)
    factors: list[np.ndarray] = field(default_factory=list)

    def log_density(self, k: int, z: np.ndarray) -> np.ndarray:
        y = np.linalg.solve(self.factors[k], (z - self.means[k]).T)
        return -0.5 * (y * y).sum(0) - np.log(np.diag(self.factors[k])).sum()

    def score(self, x: np.ndarray) -> np.ndarray:
        z = (np.asarray(x, float).reshape(-1, len(self.center)) - self.center) / self.scale
        odds = self.log_density(1, z) - self.log_density(0, z) + self.prior
        return 1 / (1 + np.exp(-np.clip(odds, -500, 500)))

    def score_column(self, stats: str) -> Column:
        """``score`` as a column over the array ``stats``, with the inverses of the cached factors as numbers."""

        def log_density(k: int) -> Column:
            inverse = np.linalg.solve(self.factors[k], np.eye(len(self.center)))
            weights, offset = inverse / self.scale, inverse @ (self.center / self.scale + self.means[k])
            total = F.lit(-float(np.log(np.diag(self.factors[k])).sum()))
            for i, row in enumerate(weights):
                y = F.lit(-float(offset[i]))
                for j in range(i + 1):
                    y = y + F.col(stats)[j] * float(row[j])
                total = total - y * y * 0.5
            return total

        odds = log_density(1) - log_density(0) + self.prior
        return 1 / (1 + F.exp(-F.greatest(F.lit(-500.0), F.least(F.lit(500.0), odds))))


def class_sums(df: DataFrame, label_col: str = "quality") -> dict[int, tuple[float, np.ndarray, np.ndarray]]:
    """For each label: number of rows, sum of stats, sum of their outer products. 2 * (1 + d + d * d) numbers."""

    def run(batches):
        import pyarrow as pa

        sums = {0: np.zeros((DIMENSIONS + 1, DIMENSIONS + 1)), 1: np.zeros((DIMENSIONS + 1, DIMENSIONS + 1))}
        for b in batches:
            if b.num_rows:
                x = np.array(b.column(1).to_pylist(), float)
                x, y = np.c_[np.ones(len(x)), x], np.array(b.column(0).to_pylist())
                for k in (0, 1):
                    sums[k] += x[y == k].T @ x[y == k]
        flat = np.concatenate([sums[0].ravel(), sums[1].ravel()])
        yield pa.RecordBatch.from_arrays([pa.array(range(len(flat))), pa.array(flat)], ["i", "v"])

    parts = in_arrow(df.select(F.col(label_col).cast("int"), "stats"), run, "i long, v double")
    d = DIMENSIONS + 1
    total = np.zeros(2 * d * d)
    for i, v in parts.groupBy("i").agg(F.sum("v")).collect():
        total[i] = v
    return {k: (m[0, 0], m[0, 1:], m[1:, 1:]) for k, m in enumerate(total.reshape(2, d, d))}


def fit(sums: dict, to_pooled: float = TO_POOLED, to_identity: float = TO_IDENTITY) -> QuadraticDiscriminant:
    """Without rows of a class, that class takes the other's moments; without any row, scores are 0.5."""
    n = {k: s[0] for k, s in sums.items()}
    total = n[0] + n[1]
    if not total:
        one = np.ones(DIMENSIONS)
        return QuadraticDiscriminant(0 * one, one, 0.0, [0 * one] * 2, [np.eye(DIMENSIONS)] * 2)
    center = (sums[0][1] + sums[1][1]) / total
    scale = np.sqrt(np.maximum(np.diag(sums[0][2] + sums[1][2]) / total - center**2, 0)) + 1e-3
    mean, cov = {}, {}
    for k in (0, 1):
        m, s1, s2 = sums[k] if n[k] else sums[1 - k]
        mu = s1 / m
        mean[k], cov[k] = (mu - center) / scale, (s2 / m - np.outer(mu, mu)) / np.outer(scale, scale)
    pooled = (n[0] * cov[0] + n[1] * cov[1]) / total
    factors = []
    for k in (0, 1):
        c = (1 - to_pooled) * cov[k] + to_pooled * pooled
        c = (1 - to_identity) * c + to_identity * (np.trace(c) / DIMENSIONS + 1e-6) * np.eye(DIMENSIONS)
        factors.append(np.linalg.cholesky((c + c.T) / 2))
    return QuadraticDiscriminant(center, scale, math.log((n[1] + 1) / (n[0] + 1)), [mean[0], mean[1]], factors)


def held_out(id_col: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _fitted(stats: DataFrame, labels: DataFrame, id_col: str, label_col: str) -> QuadraticDiscriminant:
    wanted = labels.where(F.col(label_col).isin(0, 1)).select(id_col, F.col(label_col).alias("__label"))
    return fit(class_sums(stats.where(~held_out(id_col)).join(wanted, id_col), "__label"))


def quality_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", threshold: float = THRESHOLD) -> DataFrame:
    """(id, held_out, score, predicted) for each row of ``docs``.

    Learns from labelled rows that are not held out; null labels and labels other than 0 and 1 are skipped.
    Null texts score as empty ones. A null id is never labelled nor held out. Repeated rows give repeated
    results; an id labelled twice counts twice, and so does a labelled id that documents share. Other columns
    of either table are not read. Class sums are floating-point sums in the order of the shuffle, so that the
    last digits of a score may differ between runs.
    """
    stats = stored(document_statistics(docs.select(id_col, text_col), id_col, text_col), "statistics")
    scored = stats.select(id_col, held_out(id_col).alias("held_out"), _fitted(stats, labels, id_col, label_col).score_column("stats").alias("score"))
    return scored.withColumn("predicted", F.when(F.col("score") >= threshold, 1).otherwise(0))


def accepted(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` predicted to be good. Each row is scored by itself: rows that share an id don't matter
    to each other. Rows are written once with their statistics, from which the model is fitted and scores follow."""

    @F.pandas_udf("array<double>")
    def counted(texts: pd.Series) -> pd.Series:  # only the text goes to the Python workers
        return pd.Series([statistics(t) for t in texts], dtype=object)

    rows = stored(bounded_batches(docs).withColumn(_STATS, counted(F.col(text_col).cast("string"))), "statistics")
    model = _fitted(rows.select(id_col, F.col(_STATS).alias("stats")), labels, id_col, label_col)
    return rows.where(model.score_column(_STATS) >= threshold).select(*docs.columns)


def op7_quality(spark, sf_dir):
    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


SQL: dict[str, str] = {}
QUERIES = {"op7_quality": op7_quality}
