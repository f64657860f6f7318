"""Connected components by least labels with pointer jumping, in DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.durable import discard, durable
from graphloom.llm.spread import hot_keys, spread_join


def components(links: DataFrame) -> DataFrame:
    """node and label, the least node reachable, for every node with a link (columns a and b).

    Each round takes the least label among the neighbours and then the label of the label,
    so long chains shorten as fast as a tournament; rounds follow until nothing changes.
    Labels are written each round. A node with many links and a label of many nodes are
    dealt over many tasks: the jump looks up distinct labels, not members.
    """
    both = durable(links.select(F.col("a").alias("node"), F.col("b").alias("other")).unionByName(links.select(F.col("b").alias("node"), F.col("a").alias("other"))).distinct(), "links")
    busy = durable(hot_keys(both.groupBy("other").agg(F.count(F.lit(1)).alias("n")), "other", "n", both.count()), "busy-nodes")
    labels = durable(both.groupBy("node").agg(F.least(F.min("node"), F.min("other")).alias("label")), "labels")
    total = labels.count()
    while True:
        near = spread_join(both, labels.select(F.col("node").alias("other"), "label"), "other", "node", busy).groupBy("node").agg(F.min("label").alias("near"))
        stepped = durable(labels.join(near, "node", "left").select("node", F.col("label").alias("old"), F.least("label", "near").alias("label")), "labels")
        sizes = durable(stepped.groupBy("label").agg(F.count(F.lit(1)).alias("n")), "label-sizes")
        heads = sizes.select(F.col("label").alias("node")).join(stepped, "node").select(F.col("node").alias("label"), F.col("label").alias("head"))
        jumped = spread_join(stepped, heads, "label", "node", hot_keys(sizes, "label", "n", total), "left")
        jumped = durable(jumped.select("node", "old", F.least("label", "head").alias("label")), "labels")
        discard(labels, stepped, sizes)
        labels = jumped.select("node", "label")
        labels.path = jumped.path
        if not jumped.filter("label <> old").limit(1).count():
            discard(both, busy)
            return labels
