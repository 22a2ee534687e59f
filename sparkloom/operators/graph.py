"""Connected components as repeated joins, with written tables between rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.operators.joins import lookup
from sparkloom.staging import materialize


def connected_components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """Label every node of an undirected edge list with its component's smallest node.

    Returns (node, label). Edges with a null end are ignored; a loop edge makes
    its node a component of its own; repeated edges count once; an empty edge
    list gives an empty result.

    Each round takes the smallest label among a node's neighbours and then the
    label of that label, so paths shorten geometrically; a round costs one
    aggregation that combines on the map side, and joins in which hubs and
    labels of many nodes are not dealt to one task. Only the number of changed
    labels reaches the driver.
    """
    e = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a IS NOT NULL AND b IS NOT NULL")
    both = materialize(e.union(e.select(F.col("b"), F.col("a"))).distinct(), "cc-edges")
    labels = materialize(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("label")), "cc-labels")
    while True:
        near = lookup(both, labels.withColumnRenamed("node", "b"), "b", row_bytes=16).groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        step = labels.join(near, "node").select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        step = materialize(step, "cc-steps")
        # a label is itself a node: follow it once in the previous round's labels
        hop = labels.select(F.col("node").alias("label"), F.col("label").alias("hop"))
        step = materialize(lookup(step, hop, "label", row_bytes=16).select("node", "old", F.least("label", "hop").alias("label")), "cc-labels")
        labels = step.select("node", "label")
        if step.where("label <> old").isEmpty():
            return labels
