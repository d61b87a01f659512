"""Connected components of a graph given as edges, by label propagation with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitelens.llm.common import materialise


def components(edges: DataFrame) -> DataFrame:
    """node, label (smallest node of its component) for every node of edges (a, b). Rounds grow with the logarithm of the
    longest chain; each is written to the shared folder. Nothing is collected but counts."""
    both = edges.select(F.col("a").alias("node"), F.col("b").alias("other")).union(edges.select("b", "a")).where("node <> other").distinct()
    both = materialise(both, "edges")
    labels = materialise(both.groupBy("node").agg(F.least(F.min("other"), F.col("node")).alias("label")), "labels")
    while True:
        # the smallest label around each node, offered to the node and to the root it points at
        near = both.join(labels.select(F.col("node").alias("other"), F.col("label").alias("seen")), "other").groupBy("node").agg(F.min("seen").alias("seen"))
        step = labels.join(near, "node").select("node", "label", F.least("label", "seen").alias("seen"))
        offers = step.select(F.col("node"), "seen").union(step.select(F.col("label").alias("node"), "seen")).groupBy("node").agg(F.min("seen").alias("parent"))
        offers = materialise(offers, "parents")
        root = offers.select(F.col("node").alias("parent"), F.col("parent").alias("root"))
        jumped = offers.join(root, "parent").select("node", F.least("parent", "root").alias("label"))
        new = materialise(jumped, "labels")
        changed = new.join(labels.select("node", F.col("label").alias("old")), "node").where("label <> old").limit(1).count()
        labels = new
        if not changed:
            return labels
