"""Mixing sources to target weights by systematic sampling.

Each source has a target number of words. A document's expected number of copies is target / source size;
the prefix sum of these within the source, shifted by one random offset, crosses an integer once for each
copy taken. The prefix sum is taken in two levels so that no task holds a source: rows are numbered within
blocks (source, bit length of the size, two hex digits of md5(id)), and only the blocks' row counts are
summed along the source. Small and large documents are thereby spread evenly over the sample.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stored, table, word_count

WEIGHTS = (5, 2, 1)
SHARE = 1.5
LIMIT = 2.0

_K, _CLASS, _BLOCK, _N, _BEFORE, _E, _U, _RANK = (f"__mix_{x}" for x in ("key", "class", "block", "n", "before", "e", "u", "rank"))


def source_targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = SHARE, limit: float = LIMIT) -> DataFrame:
    """From (key, source_size), one row per source, adds the target.

    Targets share ``share`` times all words by weight; none exceeds ``limit`` times its source, and the
    excess is shared again by weight. That is one common level, target = min(limit * size, weight * level):
    with sources sorted by limit * size / weight, the level is the largest of
    (words left after the sources before) / (weights left). One row per source, so this window is small.
    """
    ordered = Window.orderBy(_K)
    by_room = Window.orderBy((F.col("cap") / F.col("w")), _K)
    before = by_room.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.row_number().over(ordered) - 1) % len(weights) + 1))
    return (
        sizes.withColumn("w", weight)
        .withColumn("cap", F.col("source_size") * F.lit(limit))
        .withColumn("total", F.sum("source_size").over(every) * F.lit(share))
        .withColumn("level", (F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / (F.sum("w").over(every) - F.coalesce(F.sum("w").over(before), F.lit(0.0))))
        .withColumn("target", F.least("cap", F.col("w") * F.max("level").over(every)))
        .select(_K, "source_size", "target")
    )


def systematic_mix(df: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", seed: int = 8, size_col: str | None = None, **targets) -> DataFrame:
    """Every row of ``df`` with size, source_size, target and copies (how often the mix takes the row).

    Size is the number of words, or ``size_col`` if given. A null text has size 0; null sources form one
    source, last in order; a source without words takes nothing. Rows with equal id are told apart by size,
    then by text; rows equal in all three may be numbered either way, which gives the same result. An empty
    table gives an empty result. Input columns named like a result give way to it.
    """
    results = ("size", "source_size", "target", "copies")
    keep = [c for c in df.columns if c not in results]
    size = F.col(size_col).cast("long") if size_col else word_count(text_col)
    rows = (
        df.select(*[F.col(c) for c in keep], size.alias("size"))
        .withColumn(_K, F.when(F.col(source_col).isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), source_col)))
        .withColumn(_CLASS, F.length(F.bin("size")))
        .withColumn(_BLOCK, F.substring(F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")), 1, 2))
    )
    # Used twice; a row for each block, so small beside the texts whose words it counts.
    slim = stored(rows.groupBy(_K, _CLASS, _BLOCK).agg(F.count("*").alias(_N), F.sum("size").alias("words")), "blocks")
    along = Window.partitionBy(_K).orderBy(_CLASS, _BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    blocks = (
        slim.withColumn(_BEFORE, F.coalesce(F.sum(_N).over(along), F.lit(0)))
        .join(source_targets(slim.groupBy(_K).agg(F.sum("words").alias("source_size")), **targets), _K)
        .withColumn(_E, F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0))
        .withColumn(_U, F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.col(_K)).cast("binary")), 1, 8), 16, 10).cast("double") / 4294967296.0)
        .select(_K, _CLASS, _BLOCK, _BEFORE, _E, _U, "source_size", "target")
    )
    tie = [F.col(id_col), F.col("size")] + ([F.xxhash64(text_col)] if text_col in keep else [])
    within = Window.partitionBy(_K, _CLASS, _BLOCK).orderBy(*tie)
    at = lambda r: F.floor(F.col(_E) * r + F.col(_U))
    return (
        rows.withColumn(_RANK, F.row_number().over(within))
        .join(blocks, [_K, _CLASS, _BLOCK])
        .withColumn(_RANK, F.col(_RANK) + F.col(_BEFORE))
        .withColumn("copies", at(F.col(_RANK)) - at(F.col(_RANK) - 1))
        .select(*keep, "size", "source_size", "target", "copies")
    )


def mixed(df: DataFrame, **options) -> DataFrame:
    """The mix itself: each row as often as it is taken, with ``df``'s columns."""
    copies = F.sequence(F.lit(1).cast("long"), F.col("copies"))
    return systematic_mix(df, **options).where("copies > 0").withColumn("__mix_copy", F.explode(copies)).select(*df.columns)


def op8_mixing(spark, sf_dir):
    docs = stored(table(spark, sf_dir, "documents").select("doc_id", "source", word_count("text").alias("n")), "sizes")
    return systematic_mix(docs, size_col="n", text_col="").select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


#: Rows of the mix from a relation named docs, with columns doc_id, source, text.
MIX_SQL = r"""
sized AS (
  SELECT *, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         CASE WHEN source IS NULL THEN '1' ELSE '0' || source END AS k,
         substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 2) AS block
  FROM docs),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY k ORDER BY length(bin(size)), block, doc_id NULLS FIRST, size) AS r FROM sized),
weighed AS (
  SELECT k, sum(size)::BIGINT AS source_size, [5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE][(row_number() OVER (ORDER BY k) - 1) % 3 + 1] AS w
  FROM sized GROUP BY k),
levels AS (
  SELECT *, source_size * 2.0::DOUBLE AS cap,
         ((sum(source_size) OVER ())::DOUBLE * 1.5::DOUBLE - coalesce(sum(source_size * 2.0::DOUBLE) OVER before, 0))
         / (sum(w) OVER () - coalesce(sum(w) OVER before, 0)) AS level
  FROM weighed
  WINDOW before AS (ORDER BY source_size * 2.0::DOUBLE / w, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
targets AS (
  SELECT k, source_size, least(cap, w * max(level) OVER ()) AS target FROM levels),
mix AS (
  SELECT ranked.*, source_size, target,
         CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS e,
         ('0x' || substr(md5('8:' || k), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS u
  FROM ranked JOIN targets USING (k)),
taken AS (
  SELECT *, (floor(e * r + u) - floor(e * (r - 1) + u))::BIGINT AS copies FROM mix)"""

SQL = {"op8_mixing": "WITH docs AS (SELECT * FROM documents)," + MIX_SQL + " SELECT doc_id, size, source_size, target, copies * size AS taken FROM taken"}
QUERIES = {"op8_mixing": op8_mixing}
