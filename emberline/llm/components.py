"""Connected components by minimum-label propagation with pointer jumping, fully distributed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._store import staged


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, component) of every endpoint of ``edges``; component is the smallest reachable id.

    Each round takes the smallest label of the neighbours, then jumps to the label's own
    label, so stars end in one round and chains in about log2 of their length. Links with a
    null end are ignored, repeated links and self links change nothing, no links give no rows.
    """
    e = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).dropna().where("a <> b")
    both = staged(e.union(e.select("b", "a")).distinct(), "links")
    labels = staged(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("label")).withColumnRenamed("a", "id"), "labels")
    while True:
        near = both.join(labels, both.b == labels.id).groupBy("a").agg(F.min("label").alias("near"))
        step = labels.join(near, labels.id == near.a, "left").select("id", F.col("label").alias("old"), F.least("label", F.coalesce("near", "label")).alias("label"))
        top = labels.select(F.col("id").alias("top"), F.col("label").alias("up"))
        step = staged(step.join(top, step.label == top.top, "left").select("id", "old", F.least("label", F.coalesce("up", "label")).alias("label")), "labels")
        if step.where("label <> old").isEmpty():
            return step.select("id", F.col("label").alias("component"))
        labels = step.drop("old")
