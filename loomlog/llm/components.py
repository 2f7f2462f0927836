"""Connected components of links, as repeated joins and sums."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable


def connected_components(links: DataFrame) -> DataFrame:
    """(node, component) of every end of the links (a, b); the component is its smallest node.

    Each round a node takes the smallest label among its neighbours' and then
    its label's own label, so long chains shrink by half a round.
    """
    both = durable(links.select("a", "b").union(links.select("b", "a")).where("a <> b").distinct())
    labels = durable(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("component")))
    while True:
        near = both.join(labels, both["b"] == labels["node"]).groupBy(F.col("a").alias("node")).agg(F.min("component").alias("near"))
        step = labels.join(near, "node").select("node", F.col("component").alias("old"), F.least("component", "near").alias("next"))
        jump = labels.select(F.col("node").alias("next"), F.col("component").alias("up"))
        new = durable(step.join(jump, "next", "left").select("node", "old", F.least("next", F.coalesce("up", "next")).alias("component")))
        changed = new.where("old <> component").limit(1).count()
        labels = new.select("node", "component")
        if not changed:
            return labels
