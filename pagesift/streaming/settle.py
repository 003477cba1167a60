"""Judging pages as they come: a store of judged cells, one for each page and rule, that goes on from where it stopped.

Pages arrive in micro-batches. Of each batch only the pairs of page and rule that the store lacks are judged: a page
that came before with the same content is not judged again, a rule that is new judges all pages that come, and a page
whose content changed replaces its cells. A micro-batch writes a folder of its own, so one that runs again replaces
what it had written; the newest cell of a page and rule counts. After each batch a partial report can be read.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagesift.operators import rules as R
from pagesift.operators import verdicts as V
from pagesift.sources.scratch import cut, shared
from pagesift.streaming.runs import PHASES

CELLS = "`group` string, href string, rule string, ok boolean, severity string, score double, digest string, batch long"
_KEY = ["href", "rule"]


class CellStore:
    def __init__(self, spark: SparkSession, path: str | None = None):
        """``path`` is a folder that all executors see; without one the cells are kept in the shared folder for this job only."""
        self.spark, self.path = spark, path or f"{shared(spark)}/cells-{uuid.uuid4().hex}"
        spark.createDataFrame([], CELLS).write.mode("append").parquet(f"{self.path}/batch=-1")

    def _all(self) -> DataFrame:
        return self.spark.read.schema(CELLS).parquet(self.path)

    def cells(self, but: int | None = None) -> DataFrame:
        """The newest cell of each page and rule; without what the batch ``but`` wrote."""
        rows = self._all() if but is None else self._all().where(F.col("batch") != but)
        rest = ["group", "ok", "severity", "score", "digest"]
        return rows.groupBy(*_KEY).agg(F.max_by(F.struct(*rest, "batch"), "batch").alias("c")).select(*_KEY, *[f"c.{n}" for n in (*rest, "batch")])

    def settle(self, pages: DataFrame, batch: int, rules: Sequence[R.Rule], digest: str = "digest") -> DataFrame:
        """Judges of ``pages`` (group, href, the facts, and a digest of what they were read from) what isn't judged, keeps it as the
        batch's cells, and gives them. Of rows that share an address the one with the largest digest counts."""
        names = F.broadcast(self.spark.createDataFrame([(r.id,) for r in rules], "rule string"))
        last = pages.groupBy("href").agg(F.max_by("group", digest).alias("group"), F.max(digest).alias("digest"))
        done = self.cells(but=batch).select("href", "digest", "rule")
        # A row for each page and rule, as cells are: rules are few.
        due = cut(last.crossJoin(names).join(done, ["href", "digest", "rule"], "left_anti"))
        wanted = pages.withColumn("digest", F.col(digest)).join(due.select("href", "digest").distinct(), ["href", "digest"], "left_semi").dropDuplicates(["href", "digest"])
        judged = R.evaluate(wanted, list(rules), ["href", "digest"]).select("href", "digest", "rule", "ok", "severity", "score")
        # What a rule doesn't apply to is kept with a null verdict, so that it isn't asked again.
        new = due.join(judged, ["href", "digest", "rule"], "left").select("group", *_KEY, "ok", "severity", "score", "digest")
        new.write.mode("overwrite").parquet(f"{self.path}/batch={batch}")
        return self._all().where(F.col("batch") == batch)

    def report(self) -> dict[str, DataFrame]:
        """verdicts, counters and rating of what is judged so far."""
        verdicts = V.verdict_cells(self.cells().where("ok IS NOT NULL"))
        counters = V.check_counters(verdicts)
        return {"verdicts": verdicts, "counters": counters, "rating": V.rating(counters)}


def due_rules(rules: Sequence[R.Rule], phases: dict[str, str], over: str) -> list[R.Rule]:
    """The rules that settle once the phase ``over`` is done: those whose last phase it or an earlier one is. Rules without one settle last."""
    upto = PHASES.index(over)
    return [r for r in rules if PHASES.index(phases.get(r.id, PHASES[-1])) <= upto]


def judge_stream(pages: DataFrame, store: CellStore, rules: Sequence[R.Rule], checkpoint: str, facts: Callable[[DataFrame], DataFrame], each: Callable[[int, dict[str, DataFrame]], None] | None = None) -> None:
    """Judges all that a stream of pages has now. ``facts`` makes (group, href, digest and the facts) of a micro-batch; ``each``
    gets the number and the partial report after each batch that judged something."""

    def step(batch: DataFrame, number: int) -> None:
        new = store.settle(facts(batch), number, rules)
        if each is not None and new.limit(1).count():
            each(number, store.report())

    pages.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
