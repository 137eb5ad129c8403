"""Connected components by smallest labels and pointer jumping, on tables only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.shared import forget, written


def components(edges: DataFrame, start: DataFrame | None = None, steps: int | None = None) -> DataFrame:
    """node, label: the smallest node that each node of an edge (a, b) reaches.

    A step takes the smallest label of the neighbours and then that label's
    own label, so the distance covered about doubles; steps are written
    tables. start: labels of an earlier call, from which to go on. With steps, so
    many are taken and no more: nodes of one label are then connected, but not all
    that are connected have one label yet. Nulls, repeated edges and loops are passed over. No edges give an
    empty table.
    """
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b")
    both = written(both.distinct(), "both")  # one table for all steps, however many parts edges has
    labels = both.groupBy(F.col("a").alias("node")).agg(F.least("node", F.min("b")).alias("label"))
    if start is not None:
        labels = labels.unionByName(start).groupBy("node").agg(F.min("label").alias("label"))
    labels, done = written(labels, "labels"), 0
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "label"), "b").select(F.col("a").alias("node"), F.lit(None).cast(labels.schema["label"].dataType).alias("was"), "label")
        step = near.union(labels.select("node", F.col("label").alias("was"), "label")).groupBy("node").agg(F.min("was").alias("was"), F.min("label").alias("label"))
        own = labels.select(F.col("node").alias("to"), F.col("label").alias("far"))
        new = step.join(own, F.col("label") == F.col("to"), "left").select("node", "was", F.least("label", "far").alias("label"))
        new, done = written(new, "labels"), done + 1
        forget(labels)
        labels = new
        if done == steps or (steps is None and not new.where("label <> was").limit(1).count()):
            forget(both)
            return labels.select("node", "label")
