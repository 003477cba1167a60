"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Most bytes of an Arrow batch on its way to a Python worker, where the session allows more.
BATCH_BYTES = 2 << 20
#: One word, for every operator that counts or shingles words.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors see: ``spark.checkpoint.dir``. Only where it is unset, as in tests, a local one is made."""
    conf = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not conf and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors see")
    if not conf:
        conf = "file://" + tempfile.mkdtemp(prefix="pagesift-")
        spark.conf.set("spark.checkpoint.dir", conf)
    return conf


def scratch(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/pagesift-{uuid.uuid4().hex}/{name}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read again: lineage ends here, and lost executors cost nothing before it."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def empty_text(text: str) -> Column:
    return F.coalesce(F.col(text), F.lit(""))


def word_count(text: str) -> Column:
    return F.regexp_count(empty_text(text), F.lit(WORD)).cast("long")


def bounded_batches(df: DataFrame) -> DataFrame:
    """``df``, with the session's limit for the bytes of an Arrow batch lowered, so that long texts can't fill a worker's memory."""
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    if not 0 < int(conf.get(name).rstrip("Bb")) <= BATCH_BYTES:
        conf.set(name, str(BATCH_BYTES))
    return df


def in_arrow(df: DataFrame, run: Callable, schema: str) -> DataFrame:
    """``mapInArrow`` in bounded batches. A task that ends gives its free memory back, as workers live on."""

    def bounded(batches):
        import ctypes

        import pyarrow as pa

        yield from run(batches)
        pa.default_memory_pool().release_unused()
        if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
            trim(0)

    return bounded_batches(df).mapInArrow(bounded, schema)
