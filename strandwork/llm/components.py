"""Connected components of a graph given as a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import discard, settle


def connected_components(edges: DataFrame) -> DataFrame:
    """``node long, label long`` for every node of ``edges (a long, b long)``: the smallest node reachable.

    Each round takes the smallest label among the neighbours and then the label of that label, so
    a chain halves in a round. Labels are written to the shared folder after each round.
    """
    both = settle(edges.select("a", "b").union(edges.select("b", "a")).where("a <> b").distinct(), "edges")
    now = settle(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("label")), "labels")
    while True:
        labels = now.select("node", "label")
        near = both.join(labels, both.b == labels.node).groupBy("a").agg(F.min("label").alias("near"))
        closer = labels.join(near, labels.node == near.a).select("node", F.col("label").alias("was"), F.least("label", "near").alias("label"))
        of = labels.select(F.col("node").alias("label"), F.col("label").alias("next"))
        nearer = settle(closer.join(of, "label", "left").select("node", "was", F.least("label", F.coalesce("next", "label")).alias("label")), "labels")
        discard(now)
        now = nearer
        if nearer.where("label <> was").limit(1).isEmpty():
            discard(both)
            return nearer.select("node", "label")
