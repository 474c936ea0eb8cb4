"""Connected components of an edge table by label propagation with shortcuts; every round is a written table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .workspace import Scratch


def connected_components(edges: DataFrame, max_rounds: int = 100) -> DataFrame:
    """(node, label) for every node of ``edges`` (a, b): the label is the smallest node of its component.

    A round takes the least label among a node's neighbours and then its label's label, so chains halve. Joins are on
    one unique side, so a node with very many edges is split by the adaptive skew join; minima combine before shuffles.
    Each round's table replaces the one before.
    """
    scratch = Scratch(edges.sparkSession)
    both = scratch.keep(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))), "edges")
    if both.isEmpty():
        return both.select(F.col("a").alias("node"), F.col("b").alias("label"))
    first = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("label"), F.col("node").alias("old"))
    labels = scratch.keep(first, "labels").select("node", "label")
    for _ in range(max_rounds):
        near = both.join(labels, both["b"] == labels["node"]).groupBy(F.col("a").alias("n")).agg(F.min("label").alias("m"))
        spread = labels.join(near, labels["node"] == near["n"], "left").select("node", F.least("label", F.coalesce("m", "label")).alias("label"), F.col("label").alias("old"))
        target = spread.select(F.col("node").alias("t"), F.col("label").alias("further"))
        stepped = scratch.keep(spread.join(target, spread["label"] == target["t"]).select("node", F.col("further").alias("label"), "old"), "labels")
        labels = stepped.select("node", "label")
        if stepped.where("label <> old").isEmpty():
            scratch.drop("edges")
            return labels
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
