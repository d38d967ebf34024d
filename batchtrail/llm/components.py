"""Connected components of a link table, by minimum labels with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from batchtrail.llm.common import stored


def components(links: DataFrame) -> DataFrame:
    """``links(a, b)`` -> ``(node, label)``, label the smallest node of the component.

    Every round joins the links with the labels, takes the minimum per node
    (combined before the shuffle, so a hub costs one row per task) and follows
    each label to its own label.  Rounds are written to the shared folder.
    Nodes without a link have no row.  Empty input gives an empty table.
    """
    edges = links.select(F.col("a").alias("src"), F.col("b").alias("dst"))
    edges = stored(edges.unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct(),
                   "edges")
    labels = stored(edges.groupBy(F.col("src").alias("node")).agg(F.min("dst").alias("m"))
                    .select("node", F.least("node", "m").alias("label")), "labels")
    while True:
        told = (edges.join(labels.withColumnRenamed("node", "dst"), "dst")
                .groupBy(F.col("src").alias("node")).agg(F.min("label").alias("told")))
        least = labels.join(told, "node").select("node", F.col("label").alias("was"),
                                                 F.least("label", "told").alias("near"))
        jump = labels.select(F.col("node").alias("near"), F.col("label").alias("far"))
        step = stored(least.join(jump, "near").select("node", "was", F.least("near", "far").alias("label")), "labels")
        labels = step.select("node", "label")
        if step.where("was <> label").isEmpty():
            return labels
