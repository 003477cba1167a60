"""Places of rows within groups where a group may hold most of all rows: no group is one task's work."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagesift.sources.scratch import cut

_RANGE = "__range"


def place_within(df: DataFrame, by: Sequence[str], order: Sequence[Column], name: str = "place") -> DataFrame:
    """``df`` with the place from 1 of each row among those with equal ``by``, in ``order``.

    Rows are partitioned by ranges of (by, order); a row's place is that in its range and the rows of its group in the
    ranges before. Only one number for each range and group is added up along the ranges. Null groups are groups."""
    if not by:
        df, by = df.withColumn("__all", F.lit(0)), ["__all"]
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = cut(df.repartitionByRange(parts, *by, *order).withColumn(_RANGE, F.spark_partition_id()))
    sizes = ranged.groupBy(*by, _RANGE).agg(F.count("*").alias("__n"))
    before = F.sum("__n").over(Window.partitionBy(*by).orderBy(_RANGE)) - F.col("__n")
    offsets = sizes.select(*[F.col(c).alias(f"__{i}") for i, c in enumerate(by)], F.col(_RANGE).alias("__r"), before.alias("__before"))
    own = F.row_number().over(Window.partitionBy(*by, _RANGE).orderBy(*order))
    met = [F.col(c).eqNullSafe(F.col(f"__{i}")) for i, c in enumerate(by)]
    told = ranged.withColumn(name, own).join(offsets, [*met, F.col(_RANGE) == F.col("__r")])
    return told.withColumn(name, (F.col(name) + F.col("__before")).cast("long")).drop(_RANGE, "__r", "__before", "__all", *[f"__{i}" for i in range(len(by))])
