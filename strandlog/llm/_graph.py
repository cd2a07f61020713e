"""Connected components by joins and aggregates, without collecting links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import kept


def components(links: DataFrame) -> DataFrame:
    """(node, component) of the nodes in links (a, b); component: the least node that is reachable.

    Each round takes the least label among a node's neighbours and then the label of that label, so long chains
    shorten fast. Labels of a hub's neighbours are reduced before the shuffle; every round is written out.
    """
    both = kept(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("component"))
    labels = kept(labels)
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "component"), "b").groupBy("a").agg(F.min("component").alias("m"))
        lower = labels.join(near, labels.node == near.a).select("node", F.col("component").alias("old"), F.least("component", "m").alias("next"))
        of = labels.select(F.col("node").alias("next"), F.col("component").alias("jump"))
        lower = lower.join(of, "next").select("node", "old", F.least("next", "jump").alias("component"))
        new = kept(lower)
        if not new.where("component <> old").limit(1).count():
            return new.select("node", "component")
        labels = new.select("node", "component")
