"""Connected components by minimum labels with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mnemolith.session import materialize


def connected_components(edges: DataFrame, src: str, dst: str) -> DataFrame:
    """edges -> (node, label): every node of an edge with the smallest node of its component.

    Each round takes the minimum over the neighbours, then the label of that label, so the number of rounds grows
    with the logarithm of the longest chain. Joins are merged. Rounds are written to the shared folder. Edges with a null end and
    self-loops are ignored; repeated edges change nothing; without edges the result is empty.
    """
    pairs = edges.select(F.col(src).alias("u"), F.col(dst).alias("v")).where("u IS NOT NULL AND v IS NOT NULL AND u <> v")
    both = materialize(pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct(), narrow=True)
    labels = materialize(both.groupBy(F.col("u").alias("node")).agg(F.least(F.min("u"), F.min("v")).alias("label")), narrow=True)
    while True:
        near = both.join(labels.select(F.col("node").alias("v"), "label").hint("merge"), "v").groupBy(F.col("u").alias("node")).agg(F.min("label").alias("near"))
        step = labels.join(near.hint("merge"), "node").select("node", F.col("label").alias("old"), F.least("label", "near").alias("mid"))
        jump = labels.select(F.col("node").alias("mid"), F.col("label").alias("far"))
        step = step.join(jump.hint("merge"), "mid", "left").select("node", "old", F.least("mid", F.coalesce("far", "mid")).alias("label"))
        step = materialize(step, narrow=True)
        labels = step.select("node", "label")
        if step.where("old <> label").isEmpty():
            return labels
