"""Smallest node reachable in an undirected graph, by contraction over staged tables.

Each round every node hooks to its smallest neighbour if that is smaller, pointers are doubled until they
reach roots, and the edges are rewritten between roots. No round gathers a node's neighbours in one place:
hooking is a min that combines before the shuffle, and all joins read staged tables with a unique key on one
side, so a hub's rows can be split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.common import stage


def _mapped(rows: DataFrame, col: str, roots: DataFrame) -> DataFrame:
    """rows with col replaced by its root where roots (node, parent) has one."""
    right = roots.select(F.col("node").alias("_n"), F.col("parent").alias("_p"))
    return rows.join(right, F.col(col) == F.col("_n"), "left").withColumn(col, F.coalesce("_p", col)).drop("_n", "_p")


def min_labels(edges: DataFrame) -> DataFrame:
    """(node, label) of each node of edges (a, b): the smallest node that it reaches. Self-links do nothing."""
    ordered = lambda e: e.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    left, labels = stage(ordered(edges), "edges"), None
    while not left.isEmpty():
        roots = stage(left.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("parent")), "hooks")
        while True:
            up = roots.select(F.col("node").alias("_n"), F.col("parent").alias("_p"))
            jumped = stage(roots.join(up, F.col("parent") == F.col("_n"), "left").select("node", F.coalesce("_p", "parent").alias("parent"), F.col("_p").isNotNull().alias("moved")), "jumps")
            roots = jumped.select("node", "parent")
            if jumped.filter("moved").isEmpty():
                break
        labels = roots if labels is None else stage(_mapped(labels, "parent", roots).unionByName(roots), "labels")
        left = stage(ordered(_mapped(_mapped(left, "a", roots), "b", roots)), "edges")
    if labels is None:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("label")).limit(0)
    every = labels.unionByName(labels.select(F.col("parent").alias("node"), "parent").distinct())
    return every.select("node", F.col("parent").alias("label"))
