"""Connected components and cycles of edges in tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.checkpoints import checkpointed


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, label) of all nodes of the edges: label is the least node of the component.

    Each round a node takes the least label of itself and its neighbours, and then that label's own label, so paths halve
    and chains take a logarithm of their length. Lineage is cut by checkpoints in the shared folder.
    """
    pairs = edges.select(F.col(a).alias("node"), F.col(b).alias("other")).where("node IS NOT NULL AND other IS NOT NULL").distinct()
    both = checkpointed(pairs.union(pairs.select("other", "node")).distinct())
    labels = checkpointed(both.groupBy("node").agg(F.least(F.min("other"), F.first("node")).alias("label")))
    while True:
        seen = both.join(labels.select(F.col("node").alias("other"), "label"), "other").groupBy("node").agg(F.min("label").alias("_near"))
        nearer = labels.join(seen, "node").select("node", F.least("label", "_near").alias("label"), F.col("label").alias("_old"))
        own = labels.select(F.col("node").alias("label"), F.col("label").alias("_up"))
        new = checkpointed(nearer.join(own, "label", "left").select("node", F.least("label", F.coalesce("_up", "label")).alias("label"), "_old"))
        if new.where("label <> _old").isEmpty():
            return new.select("node", "label")
        labels = new.select("node", "label")


def acyclic_rest(edges: DataFrame, source: str, target: str) -> DataFrame:
    """The edges (source, target) on cycles or between them: sources that nothing points to, and targets that point nowhere, are taken away until none is left.

    The result is empty if there is no cycle. The rounds are as many as the longest way without a cycle.
    """
    rest = checkpointed(edges.select(F.col(source).alias("source"), F.col(target).alias("target")).distinct())
    while True:
        kept = checkpointed(rest.join(rest.select(F.col("target").alias("source")).distinct(), "source", "left_semi").join(rest.select(F.col("source").alias("target")).distinct(), "target", "left_semi").select("source", "target"))
        if kept.count() == rest.count():
            return kept
        rest = kept
