"""Connected components of a link table, as Spark joins and groupings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


def components(links: DataFrame) -> DataFrame:
    """(node, component) for each node of ``links`` (a, b); a component is named by its smallest node.

    In each round a node takes the smallest name among itself and its neighbours, then the name its name
    has. Rounds end when no name changes, so any shape of component is followed to its end. Each round is
    written to the shared folder; only one count per round reaches the driver.
    """
    both = stored(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    names = stored(both.groupBy("a").agg(F.min("b").alias("least")).select(F.col("a").alias("node"), F.least("a", "least").alias("component")), "names")
    while True:
        near = both.join(names, both.b == names.node).groupBy("a").agg(F.min("component").alias("near"))
        step = names.join(near, names.node == near.a).select("node", F.col("component").alias("old"), F.least("component", "near").alias("new"))
        of = names.select(F.col("node").alias("new"), F.col("component").alias("jump"))
        now = stored(step.join(of, "new", "left").select("node", "old", F.least("new", F.coalesce("jump", "new")).alias("component")), "names")
        names = now.select("node", "component")
        if not now.where("old <> component").limit(1).count():
            return names
