"""Connected components of a graph that is too large for one machine."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideglass.session import cut


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, root of each node of the edges; root is the smallest node of its component.

    In each round a node takes the smallest label around it and then its label's label, so that the rounds
    grow with the logarithm of the longest path. Labels are written after each round; only
    the number of changes comes to the driver. Edges may be repeated, go either way or be loops; null ends are left out.
    """
    ends = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).filter("u IS NOT NULL AND v IS NOT NULL")
    both = cut(ends.unionByName(ends.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct())
    labels = cut(both.groupBy("u").agg(F.least("u", F.min("v")).alias("label")))
    while True:
        around = both.join(labels.withColumnRenamed("u", "v"), "v").groupBy("u").agg(F.min("label").alias("near"))
        nearer = labels.join(around, "u").select("u", F.least("label", "near").alias("label"), F.col("label").alias("old"))
        jump = labels.select(F.col("u").alias("label"), F.col("label").alias("far"))
        new = nearer.join(jump, "label", "left").select("u", F.least("label", "far").alias("label"), "old")
        new = cut(new)
        changed = new.filter("label <> old").count()
        labels = new.select("u", "label")
        if not changed:
            return labels.select(F.col("u").alias("node"), F.col("label").alias("root"))
