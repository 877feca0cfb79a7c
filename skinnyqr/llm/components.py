"""Connected components of an edge table by label exchange with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, save


def connected_components(edges: DataFrame, max_rounds: int = 60, keep: Scratch | None = None) -> DataFrame:
    """(node, component) of every node of the edges (a, b); component: its smallest node.

    Each round takes the smallest label among a node and its neighbours and
    then the label of that label, so long chains shorten by doubling.  Every
    round is a written table (of ``keep``, if given); no edge or label reaches
    the driver.
    """
    save_ = keep.save if keep else save
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    labels = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("component"))
    labels = save_(labels, "labels")
    for _ in range(max_rounds):
        near = both.join(labels, F.col("b") == F.col("node")).groupBy("a").agg(F.min("component").alias("m"))
        step = labels.join(near, F.col("node") == F.col("a"), "left").select("node", F.col("component").alias("old"), F.least("component", "m").alias("c"))
        up = labels.select(F.col("node").alias("p"), F.col("component").alias("pc"))
        new = step.join(up, F.col("c") == F.col("p"), "left").select("node", "old", F.coalesce(F.least("c", "pc"), "c").alias("component"))
        new = save_(new, "labels")
        labels = new.select("node", "component")
        if new.filter("old <> component").isEmpty():
            return labels
    raise RuntimeError(f"components have not settled after {max_rounds} rounds")
