"""The log of a run: its state reduced from events, and rules that settle phase by phase."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Phases in order; a rule settles with the last one that it reads.
PHASES = ("crawl", "resources", "probes", "site", "lint")


def run_state(events: DataFrame, run: str, kind: str, at: str, order: str) -> DataFrame:
    """(run, events, started, last_kind, pages): the state that a run's log amounts to, as one ordered aggregate."""
    return events.groupBy(run).agg(F.count("*").alias("events"), F.min(at).alias("started"), F.max_by(kind, F.struct(at, order)).alias("last_kind"), F.count_if(F.col(kind) == "view").alias("pages"))


def settled(rules: DataFrame, done: DataFrame, judged: DataFrame) -> DataFrame:
    """Rules (rule, phase) whose phase is over and that were not judged before."""
    place = F.array_position(F.array(*[F.lit(p) for p in PHASES]), F.col("phase"))
    upto = done.agg(F.coalesce(F.max(place), F.lit(0)).alias("upto"))
    return rules.withColumn("place", place).join(F.broadcast(upto)).where("place <= upto").join(judged.select("rule"), "rule", "left_anti").select("rule", "phase")
