"""Connected components by iterated minimum labels with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.session import cut_lineage


def connected_components(edges: DataFrame, left: str = "src", right: str = "dst") -> DataFrame:
    """(node, component): component is the smallest node id reachable over edges, ignoring direction.

    Nulls, self edges and repeated edges change nothing; an empty table gives an empty result.
    Labels and edges stay distributed; each round is written to the shared checkpoint folder.
    """
    pairs = edges.select(F.col(left).alias("a"), F.col(right).alias("b")).where("a is not null and b is not null and a <> b")
    both = cut_lineage(pairs.union(pairs.select("b", "a")).distinct())
    labels = cut_lineage(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("component")))
    while True:  # labels only fall, so this ends
        near = both.join(labels, both["b"] == labels["node"]).groupBy(F.col("a")).agg(F.min("component").alias("low"))
        merged = labels.join(near, labels["node"] == near["a"]).select("node", F.col("component").alias("old"), F.least("component", "low").alias("mid"))
        jump = labels.select(F.col("node").alias("at"), F.col("component").alias("further"))
        nxt = cut_lineage(
            merged.join(jump, merged["mid"] == jump["at"], "left").select("node", F.least("mid", "further").alias("component"), "old")
        )
        done = nxt.where("component <> old").isEmpty()
        labels = nxt.select("node", "component")
        if done:
            return labels
