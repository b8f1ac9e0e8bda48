"""Connected components of an edge list, by joins alone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelake.llm.common import cut_lineage, hot_keys, join_spread


def connected_components(edges: DataFrame) -> DataFrame:
    """node, label of every node of edges (a, b); label is the smallest node of its component.

    Each round gives a node the smallest label among its own and its neighbours', and then the label of
    that label, so long chains halve. Rows with a null end are skipped. Ends when nothing changes. Hubs, and labels that many nodes
    share, are joined by broadcast (there are fewer than SHARE of each).
    """
    both = edges.filter("a is not null and b is not null and a <> b").select("a", "b")
    both = cut_lineage(both.union(both.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    start = cut_lineage(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("n")))
    hubs = hot_keys(start, "node", "n")
    labels = start.select("node", F.least("node", "m").alias("label"))
    while True:
        near = join_spread(both, labels.select(F.col("node").alias("b"), "label"), "b", hubs).groupBy(F.col("a").alias("node")).agg(F.min("label").alias("m"))
        step = cut_lineage(labels.join(near, "node").select("node", F.col("label").alias("old"), F.least("label", "m").alias("label")))
        used = step.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
        jump = step.select(F.col("node").alias("label"), F.col("label").alias("next"))
        step = cut_lineage(join_spread(step, jump, "label", hot_keys(used, "label", "n")).select("node", "old", F.least("label", "next").alias("label")))
        labels = step.select("node", "label")
        if step.filter("label <> old").isEmpty():
            return labels
