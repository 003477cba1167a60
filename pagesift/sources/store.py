"""Facts of pages by run, as Parquet: later jobs read the columns and nested fields that they ask for, and no others.

A run counts once its manifest is written, after its facts; what a broken write left is not seen and is written over.
"""

from __future__ import annotations

import json
import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from pagesift.sources.scratch import shared

MANIFEST = "run string, pages long, at timestamp, columns string"


class FactStore:
    def __init__(self, spark: SparkSession, path: str | None = None):
        """``path`` is a folder that all executors see; without one, the facts are kept in the shared folder for this job only."""
        self.spark, self.path = spark, path or f"{shared(spark)}/facts-{uuid.uuid4().hex}"
        spark.createDataFrame([], MANIFEST).write.mode("append").parquet(f"{self.path}/manifest/none")

    def _facts(self, run: str) -> str:
        if not re.fullmatch(r"[A-Za-z0-9_-]+", run):
            raise ValueError(f"no name of a run: {run!r}")
        return f"{self.path}/facts/{run}"

    def write(self, run: str, facts: DataFrame) -> DataFrame:
        """Writes the facts of a run, with a digest of each page's address, and gives them as they are read back."""
        keyed = facts.withColumn("digest", F.sha2(F.col("url.href"), 256))
        keyed.write.mode("overwrite").parquet(self._facts(run))
        back = self.spark.read.schema(keyed.schema).parquet(self._facts(run))
        told = back.agg(F.count("*").alias("pages")).select(F.lit(run).alias("run"), "pages", F.current_timestamp().alias("at"), F.lit(keyed.schema.json()).alias("columns"))
        told.write.mode("overwrite").parquet(f"{self.path}/manifest/{run}")
        return back

    def runs(self) -> DataFrame:
        """(run, pages, at, columns) of all runs that were written to their end."""
        return self.spark.read.schema(MANIFEST).option("recursiveFileLookup", "true").parquet(f"{self.path}/manifest")

    def _last(self, runs: DataFrame) -> str | None:
        row = runs.orderBy(F.desc("at"), F.desc("run")).limit(1).collect()
        return row[0]["run"] if row else None

    def read(self, run: str | None = None) -> DataFrame:
        """The facts of a run, or of the last one."""
        name = run or self._last(self.runs())
        told = self.runs().where(F.col("run") == name).collect() if name else []
        if not told:
            raise ValueError(f"no run {name or 'yet'}")
        return self.spark.read.schema(StructType.fromJson(json.loads(told[0]["columns"]))).parquet(self._facts(told[0]["run"]))

    def before(self, run: str) -> DataFrame | None:
        """The facts of the run before ``run``; None for the first."""
        at = self.runs().where(F.col("run") == run).select(F.col("at").alias("__at"))
        name = self._last(self.runs().join(F.broadcast(at), F.col("at") < F.col("__at"), "left_semi"))
        return self.read(name) if name else None
