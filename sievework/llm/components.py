"""Connected components of pairs, by least labels and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievework.llm.common import materialize


def components(edges: DataFrame) -> DataFrame:
    """node, root (the least node of its component) for edges (a, b). Each round is written to the shared folder; their
    number grows with the logarithm of the longest path."""
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select("b", "a")).union(edges.select("a", "a")).distinct()
    both = materialize(both)
    labels = materialize(both.groupBy("u").agg(F.min("v").alias("root")))
    while True:
        near = both.join(labels.withColumnRenamed("u", "v"), "v").groupBy("u").agg(F.min("root").alias("near"))
        far = labels.select(F.col("u").alias("near"), F.col("root").alias("far"))
        jumped = materialize(near.join(far, "near").join(labels, "u").select("u", F.least("near", "far").alias("root"), (F.least("near", "far") < F.col("root")).alias("moved")))
        if jumped.where("moved").isEmpty():
            return labels.withColumnRenamed("u", "node")
        labels = jumped.drop("moved")
