"""Connected components of an edge table, by smallest labels and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from peakforge.llm.common import keep


def components(edges: DataFrame) -> DataFrame:
    """(``node``, ``label``): the smallest node reachable, for every node of ``edges`` (a long, b long).

    A round takes the smallest label among neighbours, then the label of the label, so that paths halve. Neighbours' labels
    are minima (combined before the shuffle), so a node with any number of links costs one row per task.
    """
    both = keep(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
                .filter("a <> b").distinct())
    labels = keep(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("label")))
    while True:
        near = (both.join(labels.select(F.col("node").alias("b"), "label"), "b")
                .groupBy(F.col("a").alias("node")).agg(F.min("label").alias("other")))
        step = labels.join(near, "node").select("node", "label", F.least("label", "other").alias("low"))
        jump = labels.select(F.col("node").alias("low"), F.col("label").alias("further"))
        step = keep(step.join(jump, "low").select("node", "label", F.least("low", "further").alias("low")))
        labels = step.select("node", F.col("low").alias("label"))
        if step.filter("low < label").isEmpty():
            return labels
