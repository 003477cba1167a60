"""Cutting the lineage of iterations through the shared checkpoint folder."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame


def shared(spark) -> str:
    """The shared folder for what jobs leave to later ones. On a cluster it has to be set; a machine's own folder would be seen by no other."""
    context = spark.sparkContext
    if not context.getConf().get("spark.checkpoint.dir") and not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors see")
    if not context._jsc.sc().getCheckpointDir().isDefined():
        context.setCheckpointDir(context.getConf().get("spark.checkpoint.dir") or "file://" + tempfile.mkdtemp(prefix="pagesift-"))
    return context.getConf().get("spark.checkpoint.dir") or context._jsc.sc().getCheckpointDir().get()


def dealt_out(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` dealt by ``keys`` to twice as many tasks as there are cores. A file is read by no more tasks than it has row groups,
    and one of narrow rows may have a single one; before work that is long for each row, its rows are spread."""
    return df.repartition(2 * df.sparkSession.sparkContext.defaultParallelism, *keys)


BATCH_BYTES = 4 << 20


def small_batches(df: DataFrame) -> DataFrame:
    """``df``, with the session's limit for the bytes of an Arrow batch lowered, so that long pages can't fill a worker's memory."""
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    if not 0 < int(conf.get(name).rstrip("Bb")) <= BATCH_BYTES:
        conf.set(name, str(BATCH_BYTES))
    return df


def cut(df: DataFrame) -> DataFrame:
    """``df``, checkpointed. The session's ``spark.checkpoint.dir`` is used; a local folder only where none is set, as in tests."""
    shared(df.sparkSession)
    return df.checkpoint()
