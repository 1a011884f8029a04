"""Connected components of a link table, by smallest labels and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scoreloom.llm.common import stored


def components(links: DataFrame) -> DataFrame:
    """(node, label) of every node in ``links`` (a, b): label is the smallest node reachable.

    Every round takes the smallest label among a node's neighbours and then the label of that label,
    so a path of n nodes needs about log n rounds. Labels only travel by joins and minimum aggregates.
    """
    both = stored(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).filter("a != b").distinct(), "links")
    labels = stored(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("label")).withColumnRenamed("a", "node"), "labels")
    while True:
        near = both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("label").alias("near"))
        hooked = labels.join(near, labels["node"] == near["a"]).select("node", F.least("label", "near").alias("label"), F.col("label").alias("old"))
        # a label's own node may have found a smaller one
        roots = labels.join(near, labels["node"] == near["a"]).select(F.col("node").alias("root"), F.least("label", "near").alias("up"))
        jumped = hooked.join(roots, hooked["label"] == roots["root"]).select("node", F.least("label", "up").alias("label"), "old")
        jumped = stored(jumped, "labels")
        labels = jumped.select("node", "label")
        if jumped.filter("label != old").isEmpty():
            return labels
