"""Connected components of links, by rounds of joins and aggregations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from taskloom.llm.common import written


def components(links: DataFrame) -> DataFrame:
    """``doc_id, component``: the smallest id reachable, for every id that has a link ``a, b``.

    Each round every node points at the least label among its own and its neighbours', and then at the label of
    that label (pointer jumping), so long chains shorten by half or more in a round.  Labels are written to the
    shared folder after each round, and the rounds end when none changes.  All aggregations combine before the
    shuffle, and joins split skewed keys, so a node with a third of all links is no bottleneck.
    """
    edges = written(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct(), "edges")
    labels = written(edges.groupBy("a").agg(F.min("b").alias("least")).select(F.col("a").alias("doc_id"), F.least("a", "least").alias("component")), "labels")
    while True:
        near = edges.join(labels.withColumnRenamed("doc_id", "b"), "b").groupBy("a").agg(F.min("component").alias("near"))
        new = labels.join(near.withColumnRenamed("a", "doc_id"), "doc_id").select("doc_id", F.col("component").alias("before"), F.least("component", "near").alias("component"))
        of = labels.select(F.col("doc_id").alias("component"), F.col("component").alias("far"))
        new = new.join(of, "component").select("doc_id", "before", F.least("component", "far").alias("component"))
        new = written(new, "labels")
        changed = new.where("before <> component").limit(1).count()
        labels = new.select("doc_id", "component")
        if not changed:
            return labels
