"""Event-time operators. Each works on a batch and on a stream alike; on a stream it takes a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _late(df: DataFrame, at: str, watermark: str | None) -> DataFrame:
    timed = df.withColumn(at, F.col(at).cast("timestamp"))
    return timed.withWatermark(at, watermark) if watermark and df.isStreaming else timed


def counts(df: DataFrame, at: str, by: list[str], width: str, slide: str | None = None, watermark: str | None = "1 hour") -> DataFrame:
    """(start, by, n, total) per tumbling window, or sliding with ``slide``; rows with a null time are left out."""
    w = F.window(at, width, slide) if slide else F.window(at, width)
    return _late(df, at, watermark).groupBy(w.alias("w"), *by).agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), *by, "n", "total")


def sessions(df: DataFrame, at: str, by: list[str], gap: str, watermark: str | None = "1 hour") -> DataFrame:
    """(by, start, end, n): runs of events with pauses shorter than ``gap``; the end is the last event's time plus the gap."""
    return _late(df, at, watermark).groupBy(F.session_window(at, gap).alias("w"), *by).agg(F.count("*").alias("n")).select(*by, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def first_seen(df: DataFrame, at: str, keys: list[str], watermark: str | None = "1 hour") -> DataFrame:
    """One row per key. On a stream keys are forgotten once the watermark has passed them."""
    timed = _late(df, at, watermark)
    return timed.dropDuplicatesWithinWatermark(keys) if df.isStreaming else timed.dropDuplicates(keys)


def bucket_levels(df: DataFrame, at: str, tie: str, by: list[str], per_second: float) -> DataFrame:
    """``df`` with level: a bucket that leaks ``per_second`` and takes 1 with each event.

    The level after event n is the largest n - k + 1 - rate * (t_n - t_k) over k up to n, which is a running
    maximum, so no state is carried from row to row."""
    order = Window.partitionBy(*by).orderBy(at, tie)
    t = F.unix_micros(F.col(at).cast("timestamp")) / 1e6 * per_second
    n = F.row_number().over(order)
    rows = df.withColumns({"__n": n, "__t": t}).withColumn("__best", F.max(F.col("__t") - F.col("__n")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.withColumn("level", F.col("__n") + 1 - F.col("__t") + F.col("__best")).drop("__n", "__t", "__best")


def drained(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Runs a stream over all that is there now and reads back what it wrote."""
    stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start().awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(path)


def joined(left: DataFrame, right: DataFrame, keys: list[str], at: str, other: str, within: str, watermark: str = "1 hour") -> DataFrame:
    """Rows of two inputs with equal keys whose right time ``other`` lies in ``within`` after the left time ``at``.

    On streams both sides are kept no longer than the bound and the watermarks ask for."""
    a, b = _late(left, at, watermark), _late(right, other, watermark)
    b = b.select(*[F.col(k).alias(f"__{k}") for k in keys], *[c for c in b.columns if c not in keys])
    on = [F.col(k) == F.col(f"__{k}") for k in keys]
    bound = (F.col(other) >= F.col(at)) & (F.col(other) <= F.col(at) + F.expr(f"INTERVAL {within}"))
    return a.join(b, [*on, bound]).drop(*[f"__{k}" for k in keys])
