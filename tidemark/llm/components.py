"""Connected components of an edge table by contraction, all in joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import cut


def components(edges: DataFrame) -> DataFrame:
    """node, label for every node of ``edges`` (a, b): label is the smallest node it is connected with.

    Each round hangs every node under its smallest neighbour, follows that link once more, and replaces edges by
    those between the parents; loops and repeats go, so edges shrink from round to round and rounds grow
    with the logarithm of a component's size. Every round is written to the shared
    folder. Loops in ``edges`` and repeated edges do no harm; no edges give no rows.
    """
    pairs = cut(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    labels = cut(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct().withColumn("label", F.col("node")))
    pairs = pairs.filter("a <> b")
    while not pairs.isEmpty():
        # an edge's larger end hangs under the smallest smaller neighbour; smallest ends stay roots
        up = cut(pairs.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("parent")))  # written, so a join on a hot parent can be split
        far = up.select(F.col("node").alias("parent"), F.col("parent").alias("grand"))
        up = cut(up.join(far, "parent", "left").select("node", F.coalesce("grand", "parent").alias("parent")))
        labels = cut(
            labels.join(up.withColumnRenamed("node", "label"), "label", "left").select("node", F.coalesce("parent", "label").alias("label"))
        )
        for end in ("a", "b"):
            pairs = pairs.join(up.withColumnRenamed("node", end), end, "left").withColumn(end, F.coalesce("parent", end)).drop("parent")
        pairs = cut(pairs.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    return labels
