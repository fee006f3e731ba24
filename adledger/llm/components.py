"""Connected components as joins: minimum labels with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from adledger.llm.common import staged


def components(edges: DataFrame) -> DataFrame:
    """edges (a, b) of any number; returns id, comp: comp is the smallest id of its component.

    Each round takes the smallest label around each node, then follows the labels once.
    Labels are written out each round; the rounds grow with the logarithm of the longest chain.
    """
    both = staged(edges.select("a", "b").union(edges.select("b", "a")).distinct(), "links")
    labels = staged(both.groupBy("a").agg(F.least("a", F.min("b")).alias("comp"))
                    .withColumnRenamed("a", "id"), "labels")
    while True:
        near = (both.join(labels.withColumnRenamed("id", "b"), "b").groupBy("a").agg(F.min("comp").alias("near"))
                .withColumnRenamed("a", "id"))
        step = labels.join(near, "id").select("id", F.least("comp", "near").alias("next"), "comp")
        jump = labels.select(F.col("id").alias("next"), F.col("comp").alias("further"))
        fresh = staged(step.join(jump, "next", "left")
                       .select("id", F.least("next", F.coalesce("further", "next")).alias("comp"),
                               F.col("comp").alias("old")), "labels")
        if fresh.where("comp <> old").isEmpty():
            return labels
        labels = fresh.select("id", "comp")


def merged(comp: DataFrame, edges: DataFrame) -> DataFrame:
    """Components (id, comp) after further edges (a, b), which need not be of known nodes.

    Only edges between different components count, and of several between two of them one,
    so the rounds work on the components that grow together and not on all edges so far.
    """
    root = edges.select("a", "b")
    for end in ("a", "b"):
        known = comp.select(F.col("id").alias(end), F.col("comp").alias("root"))
        root = root.join(known, end, "left").withColumn(end, F.coalesce("root", end)).drop("root")
    across = root.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    tops = components(across)
    moved = comp.join(tops.select(F.col("id").alias("comp"), F.col("comp").alias("top")), "comp", "left").select(
        "id", F.coalesce("top", "comp").alias("comp"))
    return staged(moved.unionByName(tops.join(comp.select("id"), "id", "left_anti")), "labels")
