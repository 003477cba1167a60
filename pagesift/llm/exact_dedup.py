"""Exact deduplication by two passes of a Bloom filter.

Pass one counts how often each bit of a blocked Bloom filter is set and keeps the bits set twice or more.
Pass two asks that filter of every row: a row with a bit set once is certainly unique and passes straight
through without a shuffle; only the others, which may repeat, are grouped by their SHA-256.

The filter is a table of 64-bit words and is broadcast. It has ``BITS_PER_ROW`` bits for each row of the input, and
``MOST_BITS`` at most, whatever the input, so the broadcast is bounded (2**29 bits: eight million rows of 16 bytes). With
16 bits a row one unique row in seventy passes as possibly repeated; from 33 million rows on the filter is fuller, and of a
hundred million one in ten passes. A fuller filter only sends more rows through the grouping; the result does not change.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import empty_text, stored, table

BITS_PER_ROW, LEAST_BITS, MOST_BITS = 16, 2**16, 2**29

_H, _WORD, _MASK, _BITS, _SHA, _ROW = (f"__dedup_{x}" for x in ("h", "word", "mask", "bits", "sha", "row"))


def filter_size(rows: int) -> int:
    """Bits of a filter for so many rows: a power of two."""
    return min(MOST_BITS, max(LEAST_BITS, 1 << max(0, BITS_PER_ROW * rows - 1).bit_length()))


def _addressed(df: DataFrame, text: str, filter_bits: int) -> DataFrame:
    """Adds the row's word of the filter and a mask of its two bits there."""
    one, h = F.lit(1).cast("long"), F.col(_H)
    first = F.shiftrightunsigned(h, 52) % 64
    second = (first + 1 + F.shiftrightunsigned(h, 40) % 63) % 64
    shift = lambda c: F.call_function("shiftleft", one, c.cast("int"))
    return (
        df.withColumn(_H, F.xxhash64(empty_text(text)))
        .withColumn(_WORD, F.pmod(h, F.lit(max(1, filter_bits // 64)).cast("long")))
        .withColumn(_MASK, shift(first).bitwiseOR(shift(second)))
    )


def repeated_bits(df: DataFrame, text: str, filter_bits: int) -> DataFrame:
    """The filter: (word, bits set by two rows or more). Counting is pre-aggregated before its shuffle."""
    one = F.lit(1).cast("long")
    first = F.shiftrightunsigned(F.col(_H), 52) % 64
    second = (first + 1 + F.shiftrightunsigned(F.col(_H), 40) % 63) % 64
    return (
        _addressed(df.select(text), text, filter_bits)
        .select(_WORD, F.explode(F.array(first, second)).alias("bit"))
        .groupBy(_WORD, "bit")
        .count()
        .where("count > 1")
        .groupBy(_WORD)
        .agg(F.bit_or(F.call_function("shiftleft", one, F.col("bit").cast("int"))).alias(_BITS))
    )


def exact_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", filter_bits: int | None = None, carry: list[str] | None = None) -> DataFrame:
    """Every row of ``df`` with keep_id, group_size, kept and text_sha256.

    ``carry`` are the columns that the result is to have besides (all, if not given): what isn't carried isn't shuffled.

    Texts are equal if identical; null counts as the empty text. Of equal texts the row with the largest id
    stays; a null id is below all others. If rows repeat id and text alike, one of them stays. An empty table
    gives an empty result. Input columns named like the four results give way to them, others are kept.
    """
    results = ("keep_id", "group_size", "kept", "text_sha256")
    keep = [c for c in df.columns if c not in results or c in (id_col, text_col)]
    carried = [c for c in keep if carry is None or c in carry]
    rows = df.select(*dict.fromkeys([*carried, id_col, text_col]))
    filter_bits = filter_bits or filter_size(df.count())
    bits = stored(repeated_bits(rows, text_col, filter_bits), "filter")  # used twice, made once
    flagged = _addressed(rows, text_col, filter_bits).join(F.broadcast(bits), _WORD, "left")
    hit = F.coalesce(F.col(_BITS).bitwiseAND(F.col(_MASK)) == F.col(_MASK), F.lit(False))
    sha = F.sha2(empty_text(text_col).cast("binary"), 256)
    unique = flagged.where(~hit).select(*carried, F.col(id_col).alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), sha.alias("text_sha256"))
    # Written once: the row number then names a row for good, even if tasks are run again.
    maybe = stored(flagged.where(hit).select(*dict.fromkeys([*carried, id_col]), sha.alias(_SHA)).withColumn(_ROW, F.monotonically_increasing_id()), "maybe_repeated")
    # Written too: the join then deals both sides anew, and copies of a hot text are split over tasks.
    groups = stored(
        maybe.groupBy(_SHA)
        .agg(F.max(F.struct(F.col(id_col).alias("id"), F.col(_ROW).alias("row"))).alias("best"), F.count("*").alias("group_size"))
        .select(_SHA, F.col("best.id").alias("keep_id"), F.col("best.row").alias("best_row"), "group_size"),
        "groups",
    )
    repeated = maybe.join(groups, _SHA).select(*carried, "keep_id", "group_size", (F.col(_ROW) == F.col("best_row")).alias("kept"), F.col(_SHA).alias("text_sha256"))
    return unique.unionByName(repeated)


def deduplicated(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows that stay, with ``df``'s columns."""
    return exact_dedup(df, id_col, text_col).where("kept").select(*df.columns)


def op1_exact_dedup(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return exact_dedup(docs, carry=["doc_id"]).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


SQL = {
    "op1_exact_dedup": """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       row_number() OVER (PARTITION BY coalesce(text, '') ORDER BY doc_id DESC) = 1 AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))"""
}
QUERIES = {"op1_exact_dedup": op1_exact_dedup}
