"""Approximate nearest neighbours by additive quantisation.

A vector is approximated by the sum of one word from each of ``BOOKS`` codebooks, all of full dimension.
Codebooks are fitted on a bounded sample: first by k-means on what the earlier books leave over, then by
least squares on the codes that beam search finds, one book after the other with the others held fixed. Every vector is encoded by beam search; its code and squared
norm are stored, and the length of what the code leaves over. A query's products with all words form a table; the
sum of ``BOOKS`` look-ups is a candidate's approximate product (its distance, with the stored norm). It is wrong by at most
the query's length times what the code leaves over. The ``RERANK`` best of a block are scored on the original vectors; they say
how good a neighbour has to be, and every other candidate that may be as good by its bound is scored too. So no
neighbour is lost however the vectors lie; where codes fit badly, more candidates are scored.

Equal vectors form one class, so that many copies of one vector can't crowd others out of the reranking;
a class keeps its smallest ids, as many as an answer can hold. Classes and queries meet in blocks: each block
of queries is sent to each block of codes with their vectors.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import in_arrow, stored, table

BOOKS, WORDS, BEAM = 24, 256, 4
#: Vectors that codebooks are fitted on, at most: those with the smallest hashes.
SAMPLE = 8192
#: Candidates of a block that are scored before bounds decide on the others.
RERANK = 64
#: Numbers in a block of coded vectors and of queries.
CODE_BLOCK, QUERY_BLOCK = 1 << 20, 1 << 17


class AdditiveQuantizer:
    def __init__(self, dim: int, books: int = BOOKS, words: int = WORDS, beam: int = BEAM, seed: int = 4):
        self.beam, self.seed = beam, seed
        self.books = np.zeros((books, words, dim), np.float32)

    def fit(self, x: np.ndarray, rounds: int = 2, steps: int = 6, sweeps: int = 4) -> AdditiveQuantizer:
        x = np.asarray(x, np.float32)
        m, k, d = self.books.shape
        rng, rest = np.random.default_rng(self.seed), x.copy()
        for b in range(m):
            words = rest[rng.integers(0, len(rest), k)] if len(rest) else np.zeros((k, d), np.float32)
            for _ in range(steps):
                near = (rest @ words.T - 0.5 * (words * words).sum(1)).argmax(1)
                count = np.bincount(near, minlength=k)
                sums = np.zeros((k, d), np.float32)
                np.add.at(sums, near, rest)
                words = np.where(count[:, None] > 0, sums / np.maximum(count, 1)[:, None], rest[rng.integers(0, len(rest), k)] if len(rest) else words)
            near = (rest @ words.T - 0.5 * (words * words).sum(1)).argmax(1)
            self.books[b] = words
            rest -= words[near]
        for _ in range(rounds if len(x) else 0):
            codes = self.encode(x)
            rest = x - sum(self.books[b][codes[:, b]] for b in range(m))
            for b in [*range(m)] * sweeps:
                own, code = self.books[b], codes[:, b]
                rest += own[code]
                sums = np.zeros((k, d), np.float32)
                np.add.at(sums, code, rest)
                # A word that few vectors use stays near where it was.
                self.books[b] = (sums + 0.1 * own) / (np.bincount(code, minlength=k) + 0.1)[:, None]
                rest -= self.books[b][code]
        return self

    def encode(self, x: np.ndarray) -> np.ndarray:
        """(n, books) uint8: after each book the ``beam`` codes that leave the least over are kept."""
        x = np.asarray(x, np.float32)
        m, k, d = self.books.shape
        out = np.zeros((len(x), m), np.uint8)
        norms = (self.books * self.books).sum(2)
        for a in range(0, len(x), 1024):
            rest = x[a : a + 1024, None, :]
            n = len(rest)
            codes, left = np.zeros((n, 1, 0), np.uint8), (rest * rest).sum(2)
            for b in range(m):
                error = left[:, :, None] + norms[b] - 2 * (rest.reshape(-1, d) @ self.books[b].T).reshape(n, -1, k)
                flat = error.reshape(n, -1)
                width = min(self.beam, flat.shape[1])
                best = np.argpartition(flat, width - 1, 1)[:, :width]
                left = np.take_along_axis(flat, best, 1)
                came, word = best // k, best % k
                rest = np.take_along_axis(rest, came[:, :, None], 1) - self.books[b][word]
                codes = np.concatenate([np.take_along_axis(codes, came[:, :, None], 1), word[:, :, None].astype(np.uint8)], 2)
            out[a : a + 1024] = codes[np.arange(n), left.argmin(1)]
        return out

    def decode(self, codes: np.ndarray) -> np.ndarray:
        """The sums of the words that codes stand for."""
        out = np.zeros((len(codes), self.books.shape[2]))
        for b, words in enumerate(self.books):
            out += words[codes[:, b]]
        return out

    def scores(self, queries: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """Approximate inner products (queries, codes)."""
        tables = np.einsum("mkd,qd->mqk", self.books, np.asarray(queries, np.float32))
        out = np.zeros((len(queries), len(codes)), np.float32)
        for b in range(len(self.books)):
            out += tables[b][:, codes[:, b]]
        return out


def usable(vector: str) -> Column:
    """Vectors that take part: not null, nor without or with null or non-finite components, nor zero."""
    x = F.col(vector)
    bad = lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))
    return F.coalesce((F.size(x) > 0) & ~F.exists(x, bad) & F.exists(x, lambda c: c != 0), F.lit(False))


def _product(a: str, b: str) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def _stack(cell, width: int, kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(cell), kind).reshape(-1, width)


def vector_classes(df: DataFrame, id_col: str, vector_col: str, most: int) -> DataFrame:
    """(cls, vector, ids): equal vectors once, with their ``most`` smallest ids. Long groups are cut before they are shuffled."""
    rank = F.dense_rank().over(Window.partitionBy("vector").orderBy("id"))
    least = df.where(usable(vector_col)).select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("vector")).where("id IS NOT NULL")
    least = least.withColumn("r", rank).where(F.col("r") <= most)
    groups = least.groupBy("vector").agg(F.sort_array(F.collect_set("id")).alias("ids"))
    return groups.select(F.concat_ws(":", F.hex(F.xxhash64("vector")), F.element_at("ids", 1).cast("string")).alias("cls"), "vector", "ids")


def nearest(df: DataFrame, is_query: Column, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", rerank: int = RERANK, metric: str = "ip", quantizer: AdditiveQuantizer | None = None) -> DataFrame:
    """(query_id, rank, id, score): for each query row the ``k`` nearest other rows found.

    ``metric`` ip: largest inner product; l2: smallest squared distance, whose negative is the score. Equal
    scores go to the smaller id; with fewer than ``k`` others, all are given. Vectors that ``usable`` bars,
    vectors of another length than most, and rows with a null id take no part. Rows that repeat id and
    vector count once; a query's own id is never its neighbour. An id that rows give to different vectors has an answer
    for each of them as a query, and is named with each as a neighbour. An empty table gives an empty result.
    """
    classes = stored(vector_classes(df, id_col, vector_col, k + 1), "classes")
    lengths = classes.groupBy(F.size("vector").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    schema = f"query_id {dict(df.dtypes)[id_col]}, rank int, {id_col} {dict(df.dtypes)[id_col]}, score double"
    if not lengths:
        return df.sparkSession.createDataFrame([], schema)
    dim, n = lengths[0]["d"], lengths[0]["count"]
    classes = classes.where(F.size("vector") == dim)
    if quantizer is None:
        sample = classes.select("vector").orderBy(F.xxhash64("vector"), "vector").limit(SAMPLE).toPandas()
        quantizer = AdditiveQuantizer(dim).fit(np.stack(sample["vector"].to_numpy()))
    books = len(quantizer.books)

    def encode(batches):
        import pyarrow as pa

        for b in batches:
            x = b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
            codes = quantizer.encode(x)
            left = np.linalg.norm(x - quantizer.decode(codes), axis=1)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array((x * x).sum(1)), pa.array(left)], ["cls", "vector", "code", "norm", "left"])

    coded = in_arrow(classes.select("cls", "vector"), encode, "cls string, vector array<double>, code binary, norm double, left double")
    queries = df.where(usable(vector_col) & is_query & (F.size(vector_col) == dim)).select(F.col(id_col).alias("query_id"), F.col(vector_col).cast("array<double>").alias("vector")).where("query_id IS NOT NULL")
    asked = stored(queries.join(classes.select("cls", "vector"), "vector").select("query_id", "cls").distinct(), "asked")
    wanted = stored(classes.join(asked.select("cls").distinct(), "cls", "left_semi").select("cls", "vector"), "wanted")
    code_blocks, query_blocks = max(1, -(-n * dim // CODE_BLOCK)), max(1, -(-wanted.count() * dim // QUERY_BLOCK))
    block = lambda m, salt: F.pmod(F.xxhash64("cls", F.lit(salt)), F.lit(m)).cast("int")
    codes = coded.groupBy(block(code_blocks, 1).alias("cb")).agg(F.collect_list(F.struct("cls", "vector", "code", "norm", "left")).alias("codes"))
    asks = wanted.groupBy(block(query_blocks, 2).alias("qb")).agg(F.collect_list(F.struct(F.col("cls").alias("ask"), "vector")).alias("asks"))
    asks = asks.withColumn("cb", F.explode(F.sequence(F.lit(0), F.lit(code_blocks - 1))))
    least = k + 1  # a query's own class may be among its best

    def score(batches):
        import pyarrow as pa

        for b in batches:
            for i in range(b.num_rows):
                asks, codes = b.column(0)[i].values, b.column(1)[i].values
                code = _stack(codes.field("code").to_pylist(), books, np.uint8)
                q = asks.field("vector").flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
                x = codes.field("vector").flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
                names, ask = codes.field("cls"), asks.field("ask")
                norms, left = (codes.field(f).to_numpy(zero_copy_only=False) for f in ("norm", "left"))
                sizes = np.sqrt(norms)
                for a in range(0, len(q), 64):
                    rows, places, low, high = [], [], [], []
                    some = q[a : a + 64]
                    for j, (y, s) in enumerate(zip(some, quantizer.scores(some, code), strict=True), a):
                        # Slack for single precision, in which the look-ups are summed, and for the rounding of double.
                        size = np.linalg.norm(y)
                        slack, rounding = size * (left + 1e-5 * (sizes + left)), 1e-12 * (size * sizes)
                        if metric == "l2":
                            s, slack, rounding = 2 * s - norms, 2 * slack, 2 * rounding + 1e-12 * norms
                        upper = np.where(np.isfinite(s + slack), s + slack, np.inf)
                        exact = lambda c: 2 * (x[c] @ y) - norms[c] if metric == "l2" else x[c] @ y  # noqa: B023, E731
                        c = np.arange(len(s))
                        if len(s) > max(rerank, least):
                            first = np.argpartition(-upper, max(rerank, least))[: max(rerank, least)]
                            c = np.flatnonzero(upper >= np.partition(exact(first) - rounding[first], -least)[-least])
                        e = exact(c)
                        if len(c) > least:
                            # Scores that differ by no more than their rounding all go on.
                            near = e + rounding[c] >= np.partition(e - rounding[c], -least)[-least]
                            c, e = c[near], e[near]
                        rows.append(np.full(len(c), j))
                        places.append(c)
                        low.append(e - rounding[c])
                        high.append(e + rounding[c])
                    joined = [pa.array(np.concatenate(v)) for v in (rows, places, low, high)]
                    yield pa.RecordBatch.from_arrays([ask.take(joined[0]), names.take(joined[1]), joined[2], joined[3]], ["ask", "cls", "low", "high"])

    rough = in_arrow(asks.join(codes, "cb").select("asks", "codes"), score, "ask string, cls string, low double, high double")
    if code_blocks > 1:
        goal = F.nth_value("low", least).over(Window.partitionBy("ask").orderBy(F.desc("low")).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
        rough = rough.withColumn("goal", goal).where(F.col("goal").isNull() | (F.col("high") >= F.col("goal")))
    exact = rough.select("ask", "cls").join(classes, "cls").join(wanted.select(F.col("cls").alias("ask"), F.col("vector").alias("q")), "ask")
    product = _product("q", "vector")
    if metric == "l2":
        product = -F.aggregate(F.zip_with("q", "vector", lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)
    scored = exact.select("ask", product.alias("score"), F.explode("ids").alias("id"))
    best = scored.withColumn("r", F.row_number().over(Window.partitionBy("ask").orderBy(F.desc("score"), "id"))).where(F.col("r") <= k + 1)
    lists = best.groupBy("ask").agg(F.sort_array(F.collect_list(F.struct("r", "id", "score"))).alias("found"))
    others = F.slice(F.filter("found", lambda x: x["id"] != F.col("query_id")), 1, k)
    told = asked.join(lists, asked.cls == lists.ask).select("query_id", F.posexplode(others).alias("rank", "x"))
    return told.select("query_id", (F.col("rank") + 1).alias("rank"), F.col("x.id").alias(id_col), F.col("x.score").alias("score"))


def op4_neighbours(spark, sf_dir):
    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


SQL: dict[str, str] = {}
QUERIES = {"op4_neighbours": op4_neighbours}
